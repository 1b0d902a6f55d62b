"""Projections and filters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riverspark.functions.classes import climate_zone, dof_class, latitude_class, length_class, moran_label, percent_change, signed_log, stars, threshold_flag, width_by_discharge, width_by_order
from riverspark.operators.ordering import quantiles
from riverspark.operators.tables import keyed_replace
from riverspark.plans.base import Catalog, basin_table, dams, layer, reaches, settled, table, units
from riverspark.plans.scans import LINES, OBB, RASTER, annotation_lines, cells
from riverspark.sources.config import scenario_fields
from riverspark.sources.obb import obb_tokens

C = Catalog()
TYPE4 = ("e", "g", "b", "a")


@C.add("WITH " + LINES + " SELECT replace(line, ' Barrage_dam ', ' other_dam ') AS line, CAST(line LIKE '% Barrage_dam %' AS BIGINT) AS modified, count(*) AS n FROM ln GROUP BY 1, 2")
def prj1_type_remap(spark, d):
    """A type rewritten inside text rows, with a mark on modified ones."""
    t = F.split("line", " ")
    kind = F.when(t[8] == "Barrage_dam", F.lit("other_dam")).otherwise(t[8])
    return annotation_lines(spark, d).select(F.concat_ws(" ", F.slice(t, 1, 8), kind, F.slice(t, 10, 10)).alias("line"), (t[8] == "Barrage_dam").cast("long").alias("modified")).groupBy("line", "modified").agg(F.count(F.lit(1)).alias("n"))


@C.add("SELECT unit_id, TRY_CAST(CASE WHEN unit_id % 7 = 0 THEN 'n/a' ELSE CAST(ele_mt_sav AS VARCHAR) END AS DOUBLE) AS num, coalesce(CAST(TRY_CAST(CASE WHEN unit_id % 7 = 0 THEN 'n/a' ELSE CAST(ele_mt_sav AS VARCHAR) END AS DOUBLE) AS INT), 0) AS filled FROM un", "un")
def prj2_coercion(spark, d):
    """Text to numbers; what isn't one is null, and 0 in the filled column."""
    raw = F.when(F.col("unit_id") % 7 == 0, "n/a").otherwise(F.col("ele_mt_sav").cast("string"))
    num = raw.try_cast("double")
    return units(spark, d).select("unit_id", num.alias("num"), F.coalesce(num.cast("int"), F.lit(0)).alias("filled"))


@C.add("SELECT unit_id, stat_year, CASE WHEN isnan(hdi_ix_sav) OR hdi_ix_sav = -999 THEN NULL ELSE hdi_ix_sav END AS hdi FROM basin_units")
def prj3_sentinel(spark, d):
    from riverspark.sources.tables import measured

    return table(spark, d, "basin_units").select("unit_id", "stat_year", measured("hdi_ix_sav").alias("hdi"))


@C.add("SELECT goid, round(ln(1 + greatest(dis, 0)) + 1e-9, 6) AS ln_dis, round(ln(1 + greatest(length_km - 2, 0)) + 1e-9, 6) AS ln_leng FROM re", "re")
def prj4_log_columns(spark, d):
    """log1p of clipped columns, named by the first letters of the column."""
    r = reaches(spark, d).withColumn("length_km", F.col("length_km") - 2)
    return r.select("goid", *[settled(F.log1p(F.greatest(F.col(c), F.lit(0.0))), 6).alias(f"ln_{c[:n]}") for c, n in (("dis", 3), ("length_km", 4))])


_DELTAS = "SELECT hybas_id, " + ", ".join(f"{t}20 - {t}10 AS d_{t}" for t in TYPE4) + ", " + " + ".join(f"({t}20 - {t}10)" for t in TYPE4) + " AS d_total FROM bsn"


@C.add(_DELTAS, "bsn")
def prj5_deltas(spark, d):
    b = basin_table(spark, d)
    diff = {t: F.col(f"{t}20") - F.col(f"{t}10") for t in TYPE4}
    return b.select("hybas_id", *[x.alias(f"d_{t}") for t, x in diff.items()], (diff["e"] + diff["g"] + diff["b"] + diff["a"]).alias("d_total"))


@C.add("SELECT hybas_id, (e10 + e20) / 2.0::DOUBLE AS e_mid, CAST(g15 AS DOUBLE) AS g_mid FROM bsn", "bsn")
def prj6_mid_year(spark, d):
    """The middle year as the mean of the others, only where its column is absent."""
    b = basin_table(spark, d).drop("e15")
    mid = lambda t: (F.col(f"{t}15").cast("double") if f"{t}15" in b.columns else (F.col(f"{t}10") + F.col(f"{t}20")) / F.lit(2.0)).alias(f"{t}_mid")
    return b.select("hybas_id", mid("e"), mid("g"))


@C.add("WITH x AS (SELECT hybas_id, CAST(e20 - e10 AS DOUBLE) AS v FROM bsn), m AS (SELECT max(abs(sign(v) * ln(1 + abs(v)))) AS m FROM x) SELECT hybas_id, round(tanh(coalesce(CASE WHEN m = 0 THEN NULL ELSE sign(v) * ln(1 + abs(v)) / m END, 0)) + 1e-9, 6) AS scaled FROM x, m", "bsn")
def prj7_signed_log(spark, d):
    x = basin_table(spark, d).select("hybas_id", (F.col("e20") - F.col("e10")).cast("double").alias("v"))
    most = x.agg(F.max(F.abs(F.signum("v") * F.log1p(F.abs("v"))))).scalar()
    return x.select("hybas_id", settled(signed_log(F.col("v"), most), 6).alias("scaled"))


@C.add("SELECT hybas_id, round((e20 + g20 + b20 + a20) / area + 1e-9, 6) AS density, round((e20 + g20 + b20 + a20 - e10 - g10 - b10 - a10) / area / 10 + 1e-9, 6) AS yearly FROM bsn WHERE area > 0", "bsn")
def prj8_density(spark, d):
    """Dams per area and their yearly increase; without area: left out."""
    b = basin_table(spark, d).where("area > 0")
    n = lambda y: F.col(f"e{y}") + F.col(f"g{y}") + F.col(f"b{y}") + F.col(f"a{y}")
    return b.select("hybas_id", settled(n(20) / F.col("area"), 6).alias("density"), settled((n(20) - n(10)) / F.col("area") / F.lit(10), 6).alias("yearly"))


@C.add("SELECT hybas_id, e20 + g20 + b20 + a20 AS total, round(CASE WHEN e20 + g20 + b20 + a20 = 0 THEN 0 ELSE e20 * 100.0::DOUBLE / (e20 + g20 + b20 + a20) END + 1e-7, 4) AS share_e, CASE WHEN a10 = 0 THEN CASE WHEN a20 > 0 THEN 'inf'::DOUBLE ELSE 0 END ELSE round((a20 - a10) * 100.0::DOUBLE / a10 + 1e-7, 4) END AS change_a FROM bsn", "bsn")
def prj9_shares(spark, d):
    b = basin_table(spark, d).withColumn("total", F.col("e20") + F.col("g20") + F.col("b20") + F.col("a20"))
    return b.select("hybas_id", "total", settled(F.coalesce(F.try_divide(F.col("e20") * F.lit(100.0), F.col("total")), F.lit(0.0)), 4).alias("share_e"), F.when((F.col("a10") == 0) & (F.col("a20") > 0), F.lit(float("inf"))).when(F.col("a10") == 0, F.lit(0.0)).otherwise(settled(percent_change(F.col("a10"), F.col("a20")), 4)).alias("change_a"))


@C.add("WITH t AS (SELECT dam_type, count(*) FILTER (WHERE first_year <= 2010) AS n10, count(*) AS n20 FROM da WHERE dam_type IS NOT NULL GROUP BY 1) SELECT dam_type, n10, n20, round((n20 - n10) * 100.0::DOUBLE / nullif(n10, 0) + 1e-7, 3) AS growth, CASE WHEN n20 >= 1000000 THEN printf('%.1fM', n20 / 1000000.0::DOUBLE) WHEN n20 >= 1000 THEN printf('%.1fK', n20 / 1000.0::DOUBLE) ELSE CAST(n20 AS VARCHAR) END AS label FROM t", "da")
def prj10_growth(spark, d):
    """Growth per type in percent, and short number labels."""
    t = dams(spark, d).where("dam_type IS NOT NULL").groupBy("dam_type").agg(F.count_if(F.col("first_year") <= 2010).alias("n10"), F.count(F.lit(1)).alias("n20"))
    n = F.col("n20")
    label = F.when(n >= 1000000, F.format_string("%.1fM", n / F.lit(1e6))).when(n >= 1000, F.format_string("%.1fK", n / F.lit(1e3))).otherwise(n.cast("string"))
    return t.select("dam_type", "n10", "n20", F.round(F.try_divide((n - F.col("n10")) * F.lit(100.0), F.col("n10")) + F.lit(1e-7), 3).alias("growth"), label.alias("label"))


@C.add("SELECT hybas_id, round(CASE WHEN e10 = e15 AND e15 = e20 THEN 0 ELSE (e20 - e10) / 10.0::DOUBLE END + 1e-7, 4) AS slope FROM bsn", "bsn")
def prj11_slope(spark, d):
    """Least-squares slope over the three years: over even steps it is that of the ends."""
    return basin_table(spark, d).select("hybas_id", settled((F.col("e20") - F.col("e10")) / F.lit(10.0), 4).alias("slope"))


@C.add("SELECT bb_id, CASE WHEN l > 1000 THEN 1000 WHEN l > 500 THEN 500 WHEN l > 100 THEN 100 WHEN l > 10 THEN 10 ELSE 0 END AS lcat FROM (SELECT bb_id, sum(length_km) AS l FROM re GROUP BY 1)", "re")
def prj12_length_class(spark, d):
    return reaches(spark, d).groupBy("bb_id").agg(F.sum("length_km").alias("l")).select("bb_id", length_class(F.col("l")).alias("lcat"))


@C.add("SELECT dam_id, CASE WHEN abs(lat) <= 30 THEN 'Low' WHEN abs(lat) <= 60 THEN 'Mid' WHEN abs(lat) <= 91 THEN 'High' END AS cls FROM da", "da")
def prj13_latitude_class(spark, d):
    return dams(spark, d).select("dam_id", latitude_class(F.col("lat")).alias("cls"))


@C.add("SELECT dam_id, CASE WHEN lat < -66.5 THEN 'Antarctic' WHEN lat < -23.5 THEN 'S. Temperate' WHEN lat < 23.5 THEN 'Tropical' WHEN lat < 66.5 THEN 'N. Temperate' WHEN lat IS NOT NULL THEN 'Arctic' END AS zone FROM da", "da")
def prj14_zone(spark, d):
    return dams(spark, d).select("dam_id", climate_zone(F.col("lat")).alias("zone"))


@C.add("SELECT goid, snap_year, CASE WHEN dis >= 2000 THEN 4.0::DOUBLE WHEN dis >= 1500 THEN 2.0::DOUBLE WHEN dis >= 600 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS width FROM la", "la")
def prj15_width_by_discharge(spark, d):
    return layer(spark, d).select("goid", "snap_year", width_by_discharge(F.col("dis")).alias("width"))


@C.add("SELECT goid, CASE riv_ord WHEN 1 THEN 0.9::DOUBLE WHEN 2 THEN 0.8::DOUBLE WHEN 3 THEN 0.7::DOUBLE WHEN 4 THEN 0.6::DOUBLE WHEN 5 THEN 0.3::DOUBLE WHEN 6 THEN 0.2::DOUBLE ELSE 0.05::DOUBLE END AS width FROM re", "re")
def prj16_width_by_order(spark, d):
    return reaches(spark, d).select("goid", width_by_order(F.col("riv_ord"), {1: 0.9, 2: 0.8, 3: 0.7, 4: 0.6, 5: 0.3, 6: 0.2, 7: 0.05}).alias("width"))


@C.add("SELECT dam_id, CASE WHEN 1 - confidence < 0.001 THEN '***' WHEN 1 - confidence < 0.01 THEN '**' WHEN 1 - confidence < 0.05 THEN '*' ELSE '' END AS marks FROM da", "da")
def prj17_stars(spark, d):
    return dams(spark, d).select("dam_id", stars(F.lit(1) - F.col("confidence")).alias("marks"))


@C.add("SELECT dam_id, CASE WHEN dist - 200 > 0 AND 1 - confidence < 0.05 THEN 'positive' WHEN dist - 200 < 0 AND 1 - confidence < 0.05 THEN 'negative' ELSE 'none' END AS label FROM da", "da")
def prj18_label(spark, d):
    """Label by sign and significance (of a distance anomaly here)."""
    return dams(spark, d).select("dam_id", moran_label(F.col("dist") - 200, F.lit(1) - F.col("confidence")).alias("label"))


@C.add("SELECT goid, snap_year, CASE WHEN dof_all < 50 THEN 0 ELSE 1 END AS flag FROM la", "la")
def prj19_threshold_flag(spark, d):
    return layer(spark, d).select("goid", "snap_year", threshold_flag(F.col("dof_all"), 50.0).alias("flag"))


@C.add("SELECT goid, 0.0::DOUBLE AS dof, 0.0::DOUBLE AS dor, CAST(0 AS INT) AS ff FROM re", "re")
def prj20_result_columns(spark, d):
    """Result columns that begin at 0."""
    return reaches(spark, d).select("goid").withColumns({"dof": F.lit(0.0), "dor": F.lit(0.0), "ff": F.lit(0)})


@C.add("SELECT goid, snap_year, CASE WHEN n.goid IS NULL THEN a.dof_all ELSE n.v END AS dof_all FROM la a LEFT JOIN (SELECT goid, max(dof_all) AS v FROM la WHERE snap_year = 2020 GROUP BY 1) n USING (goid)", "la")
def prj21_keyed_replace(spark, d):
    """A column replaced from another table by key; rows without a partner keep theirs."""
    a = layer(spark, d).select("goid", "snap_year", "dof_all")
    return keyed_replace(a, a.where("snap_year = 2020").groupBy("goid").agg(F.max("dof_all").alias("dof_all")), ["goid"], ["dof_all"])


_W, _H, _A = "sqrt(power(x1-x2,2)+power(y1-y2,2))", "sqrt(power(x3-x2,2)+power(y3-y2,2))", "atan2(y2-y1, x2-x1)"


def corners(spark, d):
    b = obb_tokens(annotation_lines(spark, d), "line")
    return b.select("doc_id", "pos", *[F.col("t")[i].cast("double").alias(f"{'xy'[i % 2]}{i // 2 + 1}") for i in range(8)])


@C.add("WITH " + OBB + ", p AS (SELECT doc_id, pos, (x1 + x3) / 2 AS cx, (y1 + y3) / 2 AS cy, (x1 - (x1 + x3) / 2) AS dx, (y1 - (y1 + y3) / 2) AS dy FROM ob) SELECT doc_id, pos, round(cx + dx * cos(radians(30)) - dy * sin(radians(30)) + 1e-8, 5) AS x, round(cy + dx * sin(radians(30)) + dy * cos(radians(30)) + 1e-8, 5) AS y FROM p")
def prj22_rotate(spark, d):
    """The first corner of each box, rotated by 30 degrees about the box's middle."""
    c = corners(spark, d)
    cx, cy = (F.col("x1") + F.col("x3")) / 2, (F.col("y1") + F.col("y3")) / 2
    dx, dy, a = F.col("x1") - cx, F.col("y1") - cy, F.radians(F.lit(30.0))
    return c.select("doc_id", "pos", settled(cx + dx * F.cos(a) - dy * F.sin(a), 5).alias("x"), settled(cy + dx * F.sin(a) + dy * F.cos(a), 5).alias("y"))


@C.add("WITH " + OBB + f" SELECT doc_id, pos, round((x1 + x3) / 2 + 1e-7, 4) AS cx, round((y1 + y3) / 2 + 1e-7, 4) AS cy, round({_W} + 1e-7, 4) AS w, round({_H} + 1e-7, 4) AS h, round(CASE WHEN {_A} < 0 THEN {_A} + pi() ELSE {_A} - pi() * floor({_A} / pi()) END + 1e-9, 6) AS angle FROM ob")
def prj23_rotated_box(spark, d):
    """Corners as middle, width, height and angle below pi."""
    c = corners(spark, d)
    w = F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2"))
    h = F.hypot(F.col("x3") - F.col("x2"), F.col("y3") - F.col("y2"))
    angle = F.pmod(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")), F.lit(3.141592653589793))
    return c.select("doc_id", "pos", settled((F.col("x1") + F.col("x3")) / 2, 4).alias("cx"), settled((F.col("y1") + F.col("y3")) / 2, 4).alias("cy"), settled(w, 4).alias("w"), settled(h, 4).alias("h"), settled(angle, 6).alias("angle"))


_XS, _YS = ", ".join(f"x{i}" for i in range(1, 5)), ", ".join(f"y{i}" for i in range(1, 5))


@C.add("WITH " + OBB + f" SELECT doc_id, pos, CAST(trunc(greatest(least({_XS}), 1)) AS INT) AS xmin, CAST(trunc(greatest(least({_YS}), 1)) AS INT) AS ymin, CAST(trunc(greatest({_XS})) AS INT) AS xmax, CAST(trunc(greatest({_YS})) AS INT) AS ymax FROM ob")
def prj24_bounding_box(spark, d):
    """Whole-number bounds, the lower ones at least 1."""
    c = corners(spark, d)
    xs, ys = [f"x{i}" for i in range(1, 5)], [f"y{i}" for i in range(1, 5)]
    return c.select("doc_id", "pos", F.greatest(F.least(*xs), F.lit(1.0)).cast("int").alias("xmin"), F.greatest(F.least(*ys), F.lit(1.0)).cast("int").alias("ymin"), F.greatest(*xs).cast("int").alias("xmax"), F.greatest(*ys).cast("int").alias("ymax"))


@C.add("WITH " + OBB + f" SELECT doc_id, pos, greatest({_W}, {_H}) AS long_side, least({_W}, {_H}) AS short_side FROM ob")
def prj25_min_area_box(spark, d):
    """The smallest rectangle around each polygon, long side first."""
    from riverspark.functions.geometry import min_area_box

    c = corners(spark, d)
    box = min_area_box(F.array(*[F.col(f"x{i}") for i in range(1, 5)]), F.array(*[F.col(f"y{i}") for i in range(1, 5)]))
    return c.select("doc_id", "pos", box.alias("b")).select("doc_id", "pos", F.round("b.long_side", 6).alias("long_side"), F.round("b.short_side", 6).alias("short_side"))


@C.add("WITH " + OBB + f" SELECT doc_id, pos, least({_XS}) <= 20 OR least({_YS}) <= 20 OR greatest({_XS}) >= 700 OR greatest({_YS}) >= 700 AS truncated FROM ob")
def prj26_truncated(spark, d):
    """Whether a box touches the border of its image (here 20 to 700)."""
    c = corners(spark, d)
    xs, ys = [f"x{i}" for i in range(1, 5)], [f"y{i}" for i in range(1, 5)]
    return c.select("doc_id", "pos", ((F.least(*xs) <= 20) | (F.least(*ys) <= 20) | (F.greatest(*xs) >= 700) | (F.greatest(*ys) >= 700)).alias("truncated"))


@C.add("SELECT dam_id FROM da WHERE x IS NOT NULL", "da")
def prj27_valid_geometry(spark, d):
    """Rows with usable coordinates; geometries aren't repaired."""
    return dams(spark, d).where("x IS NOT NULL AND y IS NOT NULL").select("dam_id")


@C.add()
def prj28_simplify(spark, d):
    """Mainstems simplified with a tolerance, as parts in the projection of the map."""
    from riverspark.functions.geometry import robinson, simplify

    m = table(spark, d, "mainstems").groupBy("goid").agg(F.array_sort(F.collect_list(F.struct("seg_no", (F.col("from_x") / 1e5 - 180).alias("x"), (F.col("from_y") / 1e5 - 90).alias("y")))).alias("p"))
    s = m.select("goid", simplify(F.col("p.x"), F.col("p.y"), F.lit(0.01)).alias("s"))
    e = s.select("goid", F.posexplode(F.arrays_zip(F.col("s.xs").alias("x"), F.col("s.ys").alias("y"))).alias("pos", "q"))
    return e.select("goid", "pos", robinson(F.col("q.x"), F.col("q.y")).alias("r")).select("goid", "pos", F.round("r.x", 3).alias("x"), F.round("r.y", 3).alias("y"))


@C.add("SELECT 'EPSG:4326' AS crs, count(*) AS n FROM da WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90", "da")
def prj29_crs(spark, d):
    """Coordinates of an absent CRS count as EPSG:4326; others are refused."""
    from riverspark.functions.geometry import checked_crs

    return dams(spark, d).where("lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90").select(F.lit(checked_crs(None)).alias("crs")).groupBy("crs").agg(F.count(F.lit(1)).alias("n"))


@C.add("SELECT * FROM (VALUES ('csi', 'base'), ('dom', 'base_D'), ('ff', 'base_FF'), ('status1', 'base_FF1'), ('status2', 'base_FF2'), ('stretch', 'base_FFID')) t(field, name)")
def prj30_scenario_fields(spark, d):
    return spark.createDataFrame(list(scenario_fields("base").items()), "field string, name string")


@C.add("SELECT dam_id FROM da WHERE inc = 1 AND z_level > 0", "da")
def flt1_included(spark, d):
    return dams(spark, d).where("inc = 1 AND z_level > 0").select("dam_id")


@C.add("SELECT goid FROM re WHERE goid % 7 = 0 AND 1 + goid % 3 = 1 AND goid % 5 <> 0", "re")
def flt2_natural_lakes(spark, d):
    from riverspark.plans.routing import lakes

    return lakes(spark, d).where("lake_type = 1 AND good = 0").select(F.col("node").alias("goid"))


@C.add("SELECT goid FROM re WHERE riv_ord <= 7 AND dis >= 0.1", "re")
def flt3_display(spark, d):
    return reaches(spark, d).where("riv_ord <= 7 AND dis >= 0.1").select("goid")


@C.add("WITH p AS (SELECT goid, max(dof_all) FILTER (WHERE snap_year = 2010) AS a, max(dof_all) FILTER (WHERE snap_year = 2020) AS b FROM la GROUP BY 1) SELECT goid, round(b - a + 1e-7, 4) AS diff FROM p WHERE abs(b - a) > 0.1", "la")
def flt4_significant_change(spark, d):
    p = layer(spark, d).groupBy("goid").agg(F.max(F.when(F.col("snap_year") == 2010, F.col("dof_all"))).alias("a"), F.max(F.when(F.col("snap_year") == 2020, F.col("dof_all"))).alias("b"))
    return p.where(F.abs(F.col("b") - F.col("a")) > 0.1).select("goid", settled(F.col("b") - F.col("a"), 4).alias("diff"))


@C.add("WITH " + RASTER + ", q AS (SELECT quantile_cont(n, 0.95) AS p FROM rs WHERE n > 0), k AS (SELECT row, col, n FROM rs, q WHERE n <= p), m AS (SELECT min(n) AS lo, max(n) AS hi FROM k) SELECT row, col, n, CAST(CASE WHEN hi = lo THEN 1 ELSE least(4, 1 + floor((n - lo) * 4 / (hi - lo))) END AS BIGINT) AS cls FROM k, m", "da")
def flt5_percentile_clip(spark, d):
    """Cells up to the 95th percentile of the filled ones, in four classes of equal width."""
    c = cells(spark, d).where("n > 0")
    k = c.where(F.col("n") <= quantiles(c.select("n"), [], "n", {"p": 0.95}).scalar())
    lo, hi = k.agg(F.min("n")).scalar(), k.agg(F.max("n")).scalar()
    cls = F.coalesce(F.least(F.lit(4), F.lit(1) + F.floor(F.try_divide((F.col("n") - lo) * 4, hi - lo))), F.lit(1)).cast("long")
    return k.select("row", "col", "n", cls.alias("cls"))


@C.add("SELECT goid FROM re WHERE from_x IS NOT NULL AND to_x IS NOT NULL", "re")
def flt6_geometry_present(spark, d):
    return reaches(spark, d).where("from_x IS NOT NULL AND to_x IS NOT NULL").select("goid")


@C.add("SELECT continent, count(*) AS n FROM un WHERE hdi IS NOT NULL AND lka IS NOT NULL AND sub_area IS NOT NULL GROUP BY 1 HAVING count(*) >= 10", "un")
def flt7_complete_cases(spark, d):
    """Complete cases per group, for groups with at least ten."""
    return units(spark, d).na.drop(subset=["hdi", "lka", "sub_area"]).groupBy("continent").agg(F.count(F.lit(1)).alias("n")).where("n >= 10")


@C.add("WITH " + OBB + f" SELECT doc_id FROM ob GROUP BY 1 HAVING bool_or(greatest({_XS}) - least({_XS}) < 30 OR greatest({_YS}) - least({_YS}) < 30)")
def flt8_small_annotations(spark, d):
    """Documents with a box narrower or lower than 30."""
    c = corners(spark, d)
    xs, ys = [f"x{i}" for i in range(1, 5)], [f"y{i}" for i in range(1, 5)]
    return c.groupBy("doc_id").agg(F.bool_or((F.greatest(*xs) - F.least(*xs) < 30) | (F.greatest(*ys) - F.least(*ys) < 30)).alias("s")).where("s").select("doc_id")


@C.add("WITH " + LINES + ", s AS (SELECT d.doc_id, count(line) AS n, coalesce(bool_or(regexp_matches(lower(k[9]), 'gravity|arch|barrage')), false) AS special FROM documents d LEFT JOIN tk USING (doc_id) GROUP BY 1) SELECT doc_id, n, special FROM s WHERE n = 0 OR special")
def flt9_label_content(spark, d):
    """Documents without labels, or with one of some kinds."""
    k = annotation_lines(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.lower(F.split("line", " ")[8]).rlike("gravity|arch|barrage")).alias("special"))
    s = table(spark, d, "documents").select("doc_id").join(k, "doc_id", "left").na.fill(0, ["n"]).na.fill(False, ["special"])
    return s.where("n = 0 OR special")


@C.add("SELECT 'Global' AS region, count(*) AS n FROM da WHERE lat IS NOT NULL UNION ALL SELECT CASE WHEN abs(lat) <= 30 THEN 'Low' WHEN abs(lat) <= 60 THEN 'Mid' ELSE 'High' END, count(*) FROM da WHERE lat IS NOT NULL GROUP BY 1", "da")
def flt10_region_subsets(spark, d):
    """Every row in its latitude class and in Global."""
    p = dams(spark, d).where("lat IS NOT NULL").withColumn("region", F.explode(F.array(F.lit("Global"), latitude_class(F.col("lat")))))
    return p.groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@C.add("SELECT goid, snap_year, CASE WHEN dof_all > -0.1 AND dof_all <= 0 THEN 0 WHEN dof_all > 0 AND dof_all <= 25 THEN 1 WHEN dof_all > 25 AND dof_all <= 50 THEN 2 WHEN dof_all > 50 AND dof_all <= 75 THEN 3 WHEN dof_all > 75 AND dof_all <= 100 THEN 4 END AS cls FROM la", "la")
def prj31_dof_class(spark, d):
    return layer(spark, d).select("goid", "snap_year", dof_class(F.col("dof_all")).alias("cls"))


@C.add("SELECT dam_id, first_year, rank() OVER (PARTITION BY first_year ORDER BY stor_mcm DESC) AS r FROM da", "da")
def prj32_rank_by_storage(spark, d):
    return dams(spark, d).select("dam_id", "first_year", F.rank().over(Window.partitionBy("first_year").orderBy(F.desc("stor_mcm"))).cast("long").alias("r"))
