"""Aggregations, report tables, sorts, sets and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riverspark.functions.classes import climate_zone, dof_class, length_class
from riverspark.operators.bins import auto_bins, signed_histogram, split_bins
from riverspark.operators.ordering import next_match, quantiles, ranks
from riverspark.operators.spatial import regions_of
from riverspark.operators.tables import differences
from riverspark.plans.base import Catalog, basin_table, basins, dams, dim, layer, reaches, settled, table
from riverspark.plans.joins import CELL
from riverspark.plans.routing import CSI, STATUS, connectivity, status
from riverspark.plans.scans import LINES, annotation_lines
from riverspark.sources.raster import band, rasterize

C = Catalog()
TYPE4 = ["embankment_dam", "gravity_dam", "Barrage_dam", "arch_dam"]
LABELS5 = ["0", "0-25", "25-50", "50-75", "75-100"]

_PLACED = "pc AS (SELECT d.dam_id, d.dam_type, d.first_year, coalesce(b.continent, 'Unknown') AS continent, b.hybas_id AS hb FROM da d LEFT JOIN basins b ON d.x > min_x AND d.x < max_x AND d.y > min_y AND d.y < max_y)"


def placed(spark: SparkSession, d: str) -> DataFrame:
    """Dams with the continent (else Unknown) and the basin that hold them."""
    p = dams(spark, d).select("dam_id", "dam_type", "first_year", "x", "y")
    inside = regions_of(p.select("dam_id", "x", "y"), basins(spark, d), "hybas_id", "x", "y", CELL).join(basins(spark, d).select("hybas_id", "continent"), "hybas_id").select("dam_id", "hybas_id", "continent")
    return p.join(inside, "dam_id", "left").select("dam_id", "dam_type", "first_year", F.coalesce("continent", F.lit("Unknown")).alias("continent"), F.col("hybas_id").alias("hb"))


@C.add("WITH " + _PLACED + " SELECT coalesce(continent, 'Total') AS continent, coalesce(CAST(first_year AS VARCHAR), 'Total') AS yr, count(*) AS n FROM pc GROUP BY CUBE (continent, first_year)", "da")
def agg1_counts_with_totals(spark, d):
    """Dams by continent and year, with row and column totals."""
    g = placed(spark, d).cube("continent", F.col("first_year").cast("string").alias("yr")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.coalesce("continent", F.lit("Total")).alias("continent"), F.coalesce("yr", F.lit("Total")).alias("yr"), "n")


@C.add("WITH " + _PLACED + " SELECT c.continent, count(pc.dam_id) AS n FROM (SELECT DISTINCT continent FROM basins WHERE continent IS NOT NULL UNION SELECT 'Unknown') c LEFT JOIN pc USING (continent) GROUP BY 1", "da")
def agg2_filled_counts(spark, d):
    """Counts of all categories, also those without dams; partial counts are merged by the engine."""
    every = basins(spark, d).where("continent IS NOT NULL").select("continent").union(dim(spark, [("Unknown",)], "continent string")).distinct()
    n = placed(spark, d).groupBy("continent").agg(F.count(F.lit(1)).alias("n"))
    return every.join(n, "continent", "left").na.fill(0, ["n"])


@C.add("WITH " + _PLACED + " SELECT b.hybas_id, " + ", ".join(f"count(*) FILTER (WHERE dam_type = '{t}') AS {c}2010" for t, c in zip(TYPE4, "egba")) + " FROM basins b LEFT JOIN (SELECT * FROM pc WHERE first_year <= 2010) p ON p.hb = b.hybas_id GROUP BY 1", "da")
def agg3_types_per_basin(spark, d):
    """Dams of 2010 per basin, a column per type; basins without dams have zeros, other types don't count."""
    p = placed(spark, d).where("first_year <= 2010 AND hb IS NOT NULL").groupBy(F.col("hb").alias("hybas_id")).pivot("dam_type", TYPE4).count()
    return basins(spark, d).select("hybas_id").join(p, "hybas_id", "left").select("hybas_id", *[F.coalesce(F.col(t), F.lit(0)).alias(f"{c}2010") for t, c in zip(TYPE4, "egba")])


@C.add("SELECT unit_id, min(stat_year) AS stat_year FROM un GROUP BY 1", "un")
def agg4_first_per_key(spark, d):
    """One row per key: the first in an explicit order."""
    from riverspark.plans.base import units

    w = Window.partitionBy("unit_id").orderBy("stat_year")
    return units(spark, d).select("unit_id", "stat_year").withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


_RAST = """pb AS (SELECT *, min(lon) OVER w AS x0, max(lon) OVER w AS x1, min(lat) OVER w AS y0, max(lat) OVER w AS y1 FROM da WHERE lon IS NOT NULL {where} WINDOW w AS ({part})),
pr AS (SELECT {cols} CAST(floor((y1 - lat) / 0.5) AS BIGINT) AS row, CAST(floor((lon - x0) / 0.5) AS BIGINT) AS col, greatest(ceil((x1 - x0) / 0.5), 1) AS w, greatest(ceil((y1 - y0) / 0.5), 1) AS h FROM pb)"""


@C.add("WITH " + _RAST.format(where="", part="", cols="") + " SELECT row, col, count(*) AS n FROM pr WHERE col < w AND row < h GROUP BY 1, 2", "da")
def agg5_rasterize(spark, d):
    """Dams per cell of half a degree, over the data's own bounds."""
    return rasterize(dams(spark, d), "lon", "lat", 0.5)


@C.add("WITH " + _RAST.format(where="AND dam_type IS NOT NULL", part="PARTITION BY dam_type", cols="dam_type,") + " SELECT dam_type, row, col, count(*) AS n FROM pr WHERE col < w AND row < h GROUP BY 1, 2, 3", "da")
def agg6_rasterize_types(spark, d):
    """A layer per type, each over its own bounds."""
    return rasterize(dams(spark, d).where("dam_type IS NOT NULL"), "lon", "lat", 0.5, ["dam_type"])


@C.add("SELECT b.band, count(dam_id) AS n FROM range(0, 3600) b(band) LEFT JOIN da ON CAST(floor((lat + 90) / 0.05) AS INT) = b.band GROUP BY 1", "da")
def agg7_latitude_bands(spark, d):
    """Dams by left-closed bands of 0.05 degrees, empty bands present."""
    n = dams(spark, d).where("lat IS NOT NULL").groupBy(band(F.col("lat"), 0.05).cast("long").alias("band")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(3600).withColumnRenamed("id", "band").join(n, "band", "left").na.fill(0, ["n"])


@C.add("SELECT CAST(floor(lat / 5) * 5 AS INT) AS lo, CASE WHEN lat < -66.5 THEN 'Antarctic' WHEN lat < -23.5 THEN 'S. Temperate' WHEN lat < 23.5 THEN 'Tropical' WHEN lat < 66.5 THEN 'N. Temperate' ELSE 'Arctic' END AS zone, first_year AS yr, count(*) AS n FROM da WHERE lat IS NOT NULL GROUP BY 1, 2, 3", "da")
def agg8_large_bands(spark, d):
    """Sums by 5 degrees, zone and year."""
    p = dams(spark, d).where("lat IS NOT NULL")
    return p.groupBy((F.floor(F.col("lat") / 5) * 5).cast("int").alias("lo"), climate_zone(F.col("lat")).alias("zone"), F.col("first_year").alias("yr")).agg(F.count(F.lit(1)).alias("n"))


_CH = "ch AS (" + " UNION ALL ".join(f"SELECT continent, '{t}' AS type, {t}20 - {t}10 AS d FROM bsn" for t in "egba") + ")"


@C.add("WITH " + _CH + ", g AS (SELECT continent, type, d FROM ch WHERE continent IS NOT NULL UNION ALL SELECT 'Global', type, d FROM ch) SELECT continent, type, count(*) FILTER (WHERE d > 0) AS up, count(*) FILTER (WHERE d < 0) AS down, count(*) FILTER (WHERE d = 0) AS same, CAST(sum(d) AS BIGINT) AS net, round(count(*) FILTER (WHERE d > 0) * 100.0::DOUBLE / count(*) + 1e-7, 3) AS up_pct FROM g GROUP BY 1, 2", "bsn")
def agg9_change_directions(spark, d):
    """Basins with more, fewer or equally many dams per continent and type, and over all (with unnamed continents)."""
    b = basin_table(spark, d).select("continent", F.explode(F.array(*[F.struct(F.lit(t).alias("type"), (F.col(f"{t}20") - F.col(f"{t}10")).alias("d")) for t in "egba"])).alias("s")).select("continent", "s.*")
    every = b.withColumn("continent", F.explode(F.array_compact(F.array("continent", F.lit("Global")))))
    return every.groupBy("continent", "type").agg(F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"), F.count_if(F.col("d") == 0).alias("same"), F.sum("d").alias("net"), F.round(F.count_if(F.col("d") > 0) * 100.0 / F.count(F.lit(1)) + F.lit(1e-7), 3).alias("up_pct"))


_EDGES = [-50.0, -10.0, 0.0, 10.0, 50.0, 200.0]


def _bins_sql(rows: list[tuple], values: str) -> str:
    body = ", ".join(f"({k}, '{n}', {lo}::DOUBLE, {hi}::DOUBLE, {str(a).lower()}, {str(b).lower()})" for k, n, lo, hi, a, b in rows)
    return f"""bn(k, label, lo, hi, lc, hc) AS (VALUES {body}), vv AS ({values}), tt AS (SELECT count(*) AS t FROM vv)
SELECT label, count(v) AS n, round(count(v) * 100.0::DOUBLE / max(t) + 1e-7, 3) AS pct FROM tt, bn LEFT JOIN vv ON (v > lo OR lc AND v = lo) AND (v < hi OR hc AND v = hi) GROUP BY label"""


_INF = "'inf'"
_V1 = [(0, "< -50", "'-inf'", -50, False, False), (1, "[-50, -10]", -50, -10, True, True), (2, "[-10, 0)", -10, 0, True, False), (3, "= 0", 0, 0, True, True), (4, "(0, 10]", 0, 10, False, True), (5, "[10, 50]", 10, 50, True, True), (6, "[50, 200]", 50, 200, True, True), (7, "> 200", 200, _INF, False, False)]
_DV = "SELECT CAST(e20 + g20 + b20 + a20 - e10 - g10 - b10 - a10 AS DOUBLE) AS v FROM bsn"


def change_values(spark: SparkSession, d: str) -> DataFrame:
    total = lambda y: sum((F.col(f"{t}{y}") for t in "gba"), F.col(f"e{y}"))
    return basin_table(spark, d).select((total(20) - total(10)).cast("double").alias("v"))


@C.add("WITH h AS (WITH " + _bins_sql(_V1, _DV) + ") SELECT * FROM h WHERE n > 0 UNION ALL SELECT 'Total', count(*), 100.0::DOUBLE FROM bsn", "bsn")
def agg10_signed_histogram(spark, d):
    """Histogram that keeps zeros apart; shared edges count in both bins, empty bins are left out, a total is added."""
    return signed_histogram(change_values(spark, d), "v", _EDGES)


_V2 = [(0, "-50,-10", -50, -10, True, False), (1, "-10,0", -10, 0, True, False), (2, "0,0", 0, 0, True, True), (3, "0,10", 0, 10, False, True), (4, "10,50", 10, 50, False, True), (5, "50,200", 50, 200, False, True)]


@C.add("WITH " + _bins_sql(_V2, _DV), "bsn")
def agg11_split_histogram(spark, d):
    """Bins that meet at zero are split into below, at and above it; the zero bin is always there."""
    return split_bins(change_values(spark, d), "v", _EDGES)


@C.add("WITH vv AS (" + _DV + "), p AS (SELECT unnest(quantile_cont(v, [0, 0.2, 0.4, 0.6, 0.8, 1])) AS edge FROM vv WHERE v > 0 UNION SELECT unnest(quantile_cont(v, [0, 0.2, 0.4, 0.6, 0.8, 1])) FROM vv WHERE v < 0) SELECT DISTINCT round(edge, 6) AS edge FROM p", "bsn")
def agg12_auto_bins(spark, d):
    """Edges by quantiles of each sign."""
    return auto_bins(change_values(spark, d), "v", 5).select(F.round("edge", 6).alias("edge")).distinct()


@C.add("WITH vv AS (" + _DV + ") SELECT round(avg(v) + 1e-7, 4) AS mean, median(v) AS median, round(stddev_samp(v) + 1e-7, 4) AS sd, min(v) AS lo, max(v) AS hi, round(count(*) FILTER (WHERE v <> 0) * 100.0::DOUBLE / count(*) + 1e-7, 3) AS nonzero, count(*) FILTER (WHERE v > 0) AS up, count(*) FILTER (WHERE v < 0) AS down FROM vv", "bsn")
def agg13_distribution(spark, d):
    v = F.col("v")
    return change_values(spark, d).agg(settled(F.avg(v), 4).alias("mean"), F.median(v).alias("median"), settled(F.stddev_samp(v), 4).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.round(F.count_if(v != 0) * 100.0 / F.count(F.lit(1)) + F.lit(1e-7), 3).alias("nonzero"), F.count_if(v > 0).alias("up"), F.count_if(v < 0).alias("down"))


@C.add("WITH m AS (SELECT min(dis) AS lo, max(dis) AS hi FROM re) SELECT CAST(least(50, 1 + floor((dis - lo) * 50 / (hi - lo))) AS BIGINT) AS bin, count(*) AS n FROM re, m GROUP BY 1", "re")
def agg14_discharge_histogram(spark, d):
    """Fifty bins of equal width."""
    r = reaches(spark, d).select("dis")
    lo, hi = r.agg(F.min("dis")).scalar(), r.agg(F.max("dis")).scalar()
    return r.groupBy(F.least(F.lit(50), F.lit(1) + F.floor((F.col("dis") - lo) * 50 / (hi - lo))).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@C.add("SELECT count(*) AS n, round(avg(dis) + 1e-7, 4) AS mean, round(stddev_pop(dis) + 1e-7, 4) AS sd, round(median(dis), 6) AS median FROM re", "re")
def agg14_discharge_summary(spark, d):
    r = reaches(spark, d).select("dis")
    whole = r.agg(F.count(F.lit(1)).alias("n"), settled(F.avg("dis"), 4).alias("mean"), settled(F.stddev_pop("dis"), 4).alias("sd"))
    return whole.join(quantiles(r, [], "dis", {"m": 0.5}), F.lit(True), "left").select("n", "mean", "sd", F.round("m", 6).alias("median"))


@C.add("WITH s AS (SELECT CASE WHEN e10 = e15 AND e15 = e20 THEN 0 ELSE (e20 - e10) / 10.0::DOUBLE END AS s FROM bsn) SELECT count(*) FILTER (WHERE s > 0) AS up, count(*) FILTER (WHERE s < 0) AS down, count(*) FILTER (WHERE s = 0) AS flat, round(avg(s) + 1e-7, 4) AS mean FROM s", "bsn")
def agg15_trend_summary(spark, d):
    s = basin_table(spark, d).select(((F.col("e20") - F.col("e10")) / 10.0).alias("s"))
    return s.agg(F.count_if(F.col("s") > 0).alias("up"), F.count_if(F.col("s") < 0).alias("down"), F.count_if(F.col("s") == 0).alias("flat"), settled(F.avg("s"), 4).alias("mean"))


_CLS = "CASE WHEN dof_all > -0.1 AND dof_all <= 0 THEN 0 WHEN dof_all > 0 AND dof_all <= 25 THEN 1 WHEN dof_all > 25 AND dof_all <= 50 THEN 2 WHEN dof_all > 50 AND dof_all <= 75 THEN 3 WHEN dof_all > 75 AND dof_all <= 100 THEN 4 END"
_FR = f"fg AS (SELECT l.*, r.length_km, r.volume_tcm, {_CLS} AS cls FROM la l JOIN re r USING (goid) WHERE snap_year = 2020)"


def classed(spark: SparkSession, d: str) -> DataFrame:
    """DOF of 2020 with length and volume of the reach and the class (null outside of all)."""
    r = reaches(spark, d).select("goid", "length_km", "volume_tcm")
    return layer(spark, d).where("snap_year = 2020").join(r, "goid").withColumn("cls", dof_class(F.col("dof_all")))


@C.add("WITH " + _FR + " SELECT CAST(c.range AS INT) AS cls, count(goid) AS n, round(coalesce(sum(length_km), 0) + 1e-7, 3) AS km, round(avg(dis) + 1e-7, 4) AS mean_dis, round(coalesce(sum(volume_tcm), 0) + 1e-7, 3) AS volume FROM range(0, 5) c LEFT JOIN fg ON fg.cls = c.range GROUP BY 1", "la re")
def agg16_fragmentation_profile(spark, d):
    """Number, length, mean discharge and volume per DOF class; empty classes stay."""
    g = classed(spark, d).where("cls IS NOT NULL").groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.sum("length_km").alias("km"), F.avg("dis").alias("m"), F.sum("volume_tcm").alias("v"))
    c = dim(spark, [(k,) for k in range(5)], "cls int")
    z = lambda x: F.round(F.coalesce(x, F.lit(0.0)) + F.lit(1e-7), 3)
    return c.join(g, "cls", "left").select("cls", F.coalesce("n", F.lit(0)).alias("n"), z(F.col("km")).alias("km"), settled("m", 4).alias("mean_dis"), z(F.col("v")).alias("volume"))


@C.add("WITH " + _FR + " SELECT cls, " + ", ".join(f"count(*) FILTER (WHERE riv_ord = {k}) AS o{k}" for k in range(1, 8)) + " FROM fg WHERE cls IS NOT NULL GROUP BY 1", "la re")
def agg16_class_by_order(spark, d):
    """Classes against river orders."""
    p = classed(spark, d).where("cls IS NOT NULL").groupBy("cls").pivot("riv_ord", list(range(1, 8))).count()
    return p.select("cls", *[F.coalesce(F.col(str(k)), F.lit(0)).alias(f"o{k}") for k in range(1, 8)])


@C.add("SELECT continent, snap_year, round(avg(dof_all) + 1e-7, 4) AS mean, round(median(dof_all) + 1e-7, 5) AS median, count(dof_all) AS n FROM la WHERE continent IS NOT NULL GROUP BY 1, 2", "la")
def agg17_dof_by_continent(spark, d):
    keys = ["continent", "snap_year"]
    a = layer(spark, d).where("continent IS NOT NULL").select(*keys, "dof_all")
    g = a.groupBy(*keys).agg(settled(F.avg("dof_all"), 4).alias("mean"), F.count("dof_all").alias("n"))
    return g.join(quantiles(a, keys, "dof_all", {"m": 0.5}), keys, "left").select(*keys, "mean", F.round(F.col("m") + F.lit(1e-7), 5).alias("median"), "n")


@C.add("WITH " + _FR + " SELECT hybas_id, count(*) AS n, round(avg(dof_all) + 1e-7, 4) AS mean, round(sum(length_km) + 1e-7, 3) AS km FROM fg WHERE hybas_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, hybas_id LIMIT 10", "la re")
def agg18_top_basins(spark, d):
    """The ten basins with most reaches; the limit is the feature."""
    g = classed(spark, d).where("hybas_id IS NOT NULL").groupBy("hybas_id").agg(F.count(F.lit(1)).alias("n"), settled(F.avg("dof_all"), 4).alias("mean"), settled(F.sum("length_km"), 3).alias("km"))
    return g.orderBy(F.desc("n"), "hybas_id").limit(10)


@C.add("SELECT hybas_id, snap_year, round(avg(coalesce(dof_all, 0)) + 1e-7, 4) AS mean FROM la WHERE hybas_id IS NOT NULL GROUP BY 1, 2", "la")
def agg19_mean_by_basin(spark, d):
    """Mean DOF per basin, no value counting as 0."""
    return layer(spark, d).where("hybas_id IS NOT NULL").groupBy("hybas_id", "snap_year").agg(settled(F.avg(F.coalesce("dof_all", F.lit(0.0))), 4).alias("mean"))


_DIFF = "df AS (SELECT hybas_id, avg(coalesce(dof_all, 0)) FILTER (WHERE snap_year = 2020) - avg(coalesce(dof_all, 0)) FILTER (WHERE snap_year = 2010) AS x FROM la WHERE hybas_id IS NOT NULL GROUP BY 1)"


@C.add("WITH " + _DIFF + " SELECT count(*) FILTER (WHERE x < 0) AS improved, count(*) FILTER (WHERE x > 0) AS worsened, count(*) FILTER (WHERE x = 0) AS unchanged, round(avg(x) + 1e-7, 4) AS mean FROM df", "la")
def agg20_improved_worsened(spark, d):
    v = F.coalesce("dof_all", F.lit(0.0))
    x = layer(spark, d).where("hybas_id IS NOT NULL").groupBy("hybas_id").agg((F.avg(F.when(F.col("snap_year") == 2020, v)) - F.avg(F.when(F.col("snap_year") == 2010, v))).alias("x"))
    return x.agg(F.count_if(F.col("x") < 0).alias("improved"), F.count_if(F.col("x") > 0).alias("worsened"), F.count_if(F.col("x") == 0).alias("unchanged"), settled(F.avg("x"), 4).alias("mean"))


@C.add("WITH " + CSI + " SELECT scenario, count(csi) AS n, count(*) FILTER (WHERE csi < 99.99999999999999) AS impacted, round(count(*) FILTER (WHERE csi < 99.99999999999999) * 100.0::DOUBLE / count(csi) + 1e-7, 1) AS impacted_pct, round(avg(csi) FILTER (WHERE csi < 99.99999999999999) + 1e-7, 1) AS impacted_mean, count(*) FILTER (WHERE csi < 95) AS below, round(count(*) FILTER (WHERE csi < 95) * 100.0::DOUBLE / count(csi) + 1e-7, 1) AS below_pct FROM ci GROUP BY 1", "re")
def agg21_global_stats(spark, d):
    """Reaches in all, impacted and below the threshold, per scenario."""
    hit, low = F.col("csi") < 99.99999999999999, F.col("csi") < 95
    pct = lambda c: F.round(F.count_if(c) * 100.0 / F.count("csi") + F.lit(1e-7), 1)
    return connectivity(spark, d).groupBy("scenario").agg(F.count("csi").alias("n"), F.count_if(hit).alias("impacted"), pct(hit).alias("impacted_pct"), F.round(F.avg(F.when(hit, F.col("csi"))) + F.lit(1e-7), 1).alias("impacted_mean"), F.count_if(low).alias("below"), pct(low).alias("below_pct"))


@C.add("WITH " + CSI + " SELECT scenario, dom, count(*) AS n FROM ci WHERE csi < 95 GROUP BY 1, 2", "re")
def agg22_dominance(spark, d):
    return connectivity(spark, d).where("csi < 95").groupBy("scenario", "dom").agg(F.count(F.lit(1)).alias("n"))


def _backbone(kind: str) -> str:
    return f" SELECT continent, lcat, cat, round(sum(km) + 1e-6, 3) AS km, CAST(sum(oc) AS BIGINT) AS ocean, count(*) AS num FROM (SELECT continent, bb_id, CASE WHEN bb_len > 1000 THEN 1000 WHEN bb_len > 500 THEN 500 WHEN bb_len > 100 THEN 100 WHEN bb_len > 10 THEN 10 ELSE 0 END AS lcat, {kind} AS cat, sum(length_km) AS km, max(bb_ocean) AS oc FROM so WHERE inc = 1 GROUP BY ALL) GROUP BY 1, 2, 3"


def backbone(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """River level first, then continent, length class and status."""
    r = status(spark, d).where("inc = 1").groupBy("continent", "bb_id", length_class(F.col("bb_len")).alias("lcat"), F.col(kind).alias("cat")).agg(F.sum("length_km").alias("km"), F.max("bb_ocean").alias("oc"))
    return r.groupBy("continent", "lcat", "cat").agg(settled(F.sum("km"), 3).alias("km"), F.sum("oc").alias("ocean"), F.count(F.lit(1)).alias("num"))


@C.add("WITH RECURSIVE " + STATUS + _backbone("status1"), "re")
def agg23_backbones_two_classes(spark, d):
    return backbone(spark, d, "status1")


@C.add("WITH RECURSIVE " + STATUS + _backbone("status2"), "re")
def agg23_backbones_three_classes(spark, d):
    return backbone(spark, d, "status2")


_LEN = "CASE WHEN km > 1000 THEN 1000 WHEN km > 500 THEN 500 WHEN km > 100 THEN 100 WHEN km > 10 THEN 10 ELSE 0 END"


@C.add("WITH RECURSIVE " + STATUS + f" SELECT continent, lcat, round(sum(km) + 1e-6, 3) AS km, count(*) AS num FROM (SELECT *, {_LEN} AS lcat FROM (SELECT continent, bb_id, sum(length_km) AS km FROM so WHERE inc = 1 AND status2 = 2 GROUP BY 1, 2)) GROUP BY 1, 2", "re")
def agg24_good_status(spark, d):
    """Stretches of good status, in the class of their summed length."""
    g = status(spark, d).where("inc = 1 AND status2 = 2").groupBy("continent", "bb_id").agg(F.sum("length_km").alias("km"))
    return g.groupBy("continent", length_class(F.col("km")).alias("lcat")).agg(settled(F.sum("km"), 3).alias("km"), F.count(F.lit(1)).alias("num"))


@C.add("WITH RECURSIVE " + STATUS + " SELECT bb_id, continent, km, riv_ord FROM (SELECT bb_id, arg_min(continent, goid) AS continent, round(sum(length_km) + 1e-6, 3) AS km, min(riv_ord) AS riv_ord, max(status1) AS s FROM so WHERE inc = 1 GROUP BY 1) WHERE km > 3 AND s = 1", "re")
def agg25_free_flowing_list(spark, d):
    """Backbones longer than a threshold (3 km here) that flow freely."""
    g = status(spark, d).where("inc = 1").groupBy("bb_id").agg(F.min_by("continent", "node").alias("continent"), settled(F.sum("length_km"), 3).alias("km"), F.min("riv_ord").alias("riv_ord"), F.max("status1").alias("s"))
    return g.where("km > 3 AND s = 1").select("bb_id", "continent", "km", "riv_ord")


_BENCH = "bm AS (SELECT s_suppkey * 7 + 10000104 AS goid, s_suppkey % 10 AS ffrid FROM supplier)"


def bench(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select((F.col("s_suppkey") * 7 + 10000104).alias("goid"), (F.col("s_suppkey") % 10).alias("ffrid"))


@C.add("WITH " + CSI + ", " + _BENCH + " SELECT ffrid, dom, count(*) AS n FROM ci JOIN bm USING (goid) WHERE scenario = 'base' AND csi < 95 GROUP BY 1, 2", "re")
def agg26_benchmark_dominance(spark, d):
    return connectivity(spark, d).where("scenario = 'base' AND csi < 95").join(bench(spark, d), "goid").groupBy("ffrid", "dom").agg(F.count(F.lit(1)).alias("n"))


@C.add("WITH " + CSI + ", " + _BENCH + " SELECT count(*) AS rivers, count(*) FILTER (WHERE lo >= 50) AS matching FROM (SELECT ffrid, min(csi) AS lo FROM ci JOIN bm USING (goid) WHERE scenario = 'base' GROUP BY 1)", "re")
def agg27_benchmark_match(spark, d):
    """Benchmark rivers whose lowest score reaches the threshold."""
    g = connectivity(spark, d).where("scenario = 'base'").join(bench(spark, d), "goid").groupBy("ffrid").agg(F.min("csi").alias("lo"))
    return g.agg(F.count(F.lit(1)).alias("rivers"), F.count_if(F.col("lo") >= 50).alias("matching"))


@C.add("WITH " + CSI + ", r AS (SELECT goid, csi, avg(csi) OVER (PARTITION BY goid ORDER BY scenario ROWS UNBOUNDED PRECEDING) AS m FROM ci) SELECT goid, round(avg(csi) + 1e-7, 4) AS mean, min(csi) AS lo, max(csi) AS hi, round(max(csi) - min(csi) + 1e-8, 5) AS spread, round(sqrt(avg(power(csi - m, 2))) + 1e-7, 4) AS running_sd, round(stddev_pop(csi) + 1e-7, 4) AS sd FROM r GROUP BY 1", "re")
def agg28_sensitivity(spark, d):
    """Spread of each reach over the scenarios; the deviation from running means, and the true one."""
    w = Window.partitionBy("goid").orderBy("scenario").rowsBetween(Window.unboundedPreceding, 0)
    r = connectivity(spark, d).select("goid", "csi", F.avg("csi").over(w).alias("m"))
    return r.groupBy("goid").agg(settled(F.avg("csi"), 4).alias("mean"), F.min("csi").alias("lo"), F.max("csi").alias("hi"), settled(F.max("csi") - F.min("csi"), 5).alias("spread"), settled(F.sqrt(F.avg(F.pow(F.col("csi") - F.col("m"), 2))), 4).alias("running_sd"), settled(F.stddev_pop("csi"), 4).alias("sd"))


@C.add("WITH " + LINES + " SELECT k[9] AS label, year(collected_at) AS yr, count(*) AS n FROM tk JOIN documents USING (doc_id) GROUP BY 1, 2")
def agg29_annotation_counts(spark, d):
    a = annotation_lines(spark, d).join(table(spark, d, "documents").select("doc_id", F.year("collected_at").cast("long").alias("yr")), "doc_id")
    return a.groupBy(F.split("line", " ")[8].alias("label"), "yr").agg(F.count(F.lit(1)).alias("n"))


@C.add("SELECT continent, count(*) AS parts, min(min_x) AS min_x, max(max_y) AS max_y FROM basins WHERE continent IS NOT NULL GROUP BY 1")
def agg30_geometry_collection(spark, d):
    """Geometries gathered per group (a collection, no topological union), with its bounds."""
    b = basins(spark, d).where("continent IS NOT NULL").groupBy("continent").agg(F.collect_list(F.struct("min_x", "min_y", "max_x", "max_y")).alias("g"))
    return b.select("continent", F.size("g").cast("long").alias("parts"), F.array_min(F.transform("g", lambda x: x["min_x"])).alias("min_x"), F.array_max(F.transform("g", lambda x: x["max_y"])).alias("max_y"))


@C.add("WITH " + _FR + ", o AS (SELECT riv_ord, round(count(*) FILTER (WHERE dof_all > 50) * 100.0::DOUBLE / count(*) + 1e-7, 4) AS pct FROM fg WHERE riv_ord IS NOT NULL GROUP BY 1) SELECT riv_ord, pct, rank() OVER (ORDER BY pct DESC) AS top, rank() OVER (ORDER BY pct) AS bottom FROM o", "la re")
def rpt1_high_dof_by_order(spark, d):
    o = classed(spark, d).where("riv_ord IS NOT NULL").groupBy("riv_ord").agg(F.round(F.count_if(F.col("dof_all") > 50) * 100.0 / F.count(F.lit(1)) + F.lit(1e-7), 4).alias("pct"))
    return o.withColumn("top", F.rank().over(Window.orderBy(F.desc("pct"))).cast("long")).withColumn("bottom", F.rank().over(Window.orderBy("pct")).cast("long"))


@C.add("WITH m AS (SELECT continent, round(avg(dof_all) + 1e-7, 4) AS mean FROM la WHERE snap_year = 2020 AND continent IS NOT NULL GROUP BY 1) SELECT continent, mean, rank() OVER (ORDER BY mean DESC) AS r, mean > avg(mean) OVER () AS above FROM m", "la")
def rpt2_continent_ranking(spark, d):
    m = layer(spark, d).where("snap_year = 2020 AND continent IS NOT NULL").groupBy("continent").agg(settled(F.avg("dof_all"), 4).alias("mean"))
    return m.withColumn("r", F.rank().over(Window.orderBy(F.desc("mean"))).cast("long")).withColumn("above", F.col("mean") > F.avg("mean").over(Window.partitionBy()))


_BASIN_FR = ", bf AS (SELECT hybas_id, count(*) AS n, sum(length_km) AS km, avg(dof_all) AS mean, median(dof_all) AS med, sum(length_km) / count(*) AS density FROM fg WHERE hybas_id IS NOT NULL GROUP BY 1)"


def by_basin(spark: SparkSession, d: str) -> DataFrame:
    rows = classed(spark, d).where("hybas_id IS NOT NULL").select("hybas_id", "length_km", "dof_all")
    g = rows.groupBy("hybas_id").agg(F.count(F.lit(1)).alias("n"), F.sum("length_km").alias("km"), F.avg("dof_all").alias("mean"))
    return g.join(quantiles(rows, ["hybas_id"], "dof_all", {"med": 0.5}), "hybas_id", "left").withColumn("density", F.col("km") / F.col("n"))


@C.add("WITH " + _FR + _BASIN_FR + " SELECT round(corr(n, mean) + 1e-7, 4) AS n_mean, round(corr(km, mean) + 1e-7, 4) AS km_mean, round(corr(density, mean) + 1e-7, 4) AS density_mean FROM bf", "la re")
def rpt3_correlations(spark, d):
    return by_basin(spark, d).agg(*[settled(F.corr(F.col(c).cast("double"), F.col("mean")), 4).alias(f"{c}_mean") for c in ("n", "km", "density")])


@C.add("WITH " + _FR + _BASIN_FR + " SELECT hybas_id, n, round(density + 1e-7, 4) AS density, rank() OVER (ORDER BY round(density + 1e-7, 4) DESC) AS r, mean > 30 AND med < 10 AS skewed FROM bf", "la re")
def rpt4_skewed_basins(spark, d):
    """Density ranking, and basins whose mean is far above their median."""
    b = ranks(by_basin(spark, d).withColumn("density", settled("density", 4)), -F.col("density"), "r")
    return b.select("hybas_id", "n", "density", "r", ((F.col("mean") > 30) & (F.col("med") < 10)).alias("skewed"))


@C.add("WITH " + _FR + ", c AS (SELECT cls, avg(dis) AS m FROM fg WHERE cls IS NOT NULL GROUP BY 1), u AS (SELECT m AS u FROM c WHERE cls = 0) SELECT cls, round(m / u + 1e-7, 4) AS ratio, rank() OVER (ORDER BY m DESC) AS r, m > lag(m) OVER (ORDER BY cls) AS rising FROM c, u", "la re")
def rpt5_discharge_ratios(spark, d):
    """Mean discharge of the classes against the unfragmented one, ranks, and whether it rises from class to class."""
    c = classed(spark, d).where("cls IS NOT NULL").groupBy("cls").agg(F.avg("dis").alias("m"))
    unfragmented = F.max(F.when(F.col("cls") == 0, F.col("m"))).over(Window.partitionBy())
    return c.select("cls", settled(F.col("m") / unfragmented, 4).alias("ratio"), F.rank().over(Window.orderBy(F.desc("m"))).cast("long").alias("r"), (F.col("m") > F.lag("m").over(Window.orderBy("cls"))).alias("rising"))


@C.add("SELECT coalesce(CAST(snap_year AS VARCHAR), 'all') AS file, round(count(*) FILTER (WHERE dof_all = 0) * 100.0::DOUBLE / count(*) + 1e-7, 3) AS free_pct, round(count(*) FILTER (WHERE dof_all > 50) * 100.0::DOUBLE / count(*) + 1e-7, 3) AS high_pct, round(coalesce(sum(length_km) FILTER (WHERE dof_all > 50), 0) * 100 / sum(length_km) + 1e-7, 3) AS high_km_pct FROM la JOIN re USING (goid) GROUP BY GROUPING SETS ((snap_year), ())", "la re")
def rpt6_comparison(spark, d):
    """Shares by number and length per snapshot and over all."""
    j = layer(spark, d).join(reaches(spark, d).select("goid", "length_km"), "goid").withColumn("file", F.col("snap_year").cast("string"))
    pct = lambda c: F.round(F.count_if(c) * 100.0 / F.count(F.lit(1)) + F.lit(1e-7), 3)
    high = F.col("dof_all") > 50
    g = j.rollup("file").agg(pct(F.col("dof_all") == 0).alias("free_pct"), pct(high).alias("high_pct"), F.round(F.coalesce(F.sum(F.when(high, F.col("length_km"))), F.lit(0.0)) * 100 / F.sum("length_km") + F.lit(1e-7), 3).alias("high_km_pct"))
    return g.withColumn("file", F.coalesce("file", F.lit("all")))


@C.add("SELECT g.grp, round(avg(dof_all) + 1e-7, 4) AS mean FROM la JOIN (VALUES ('Asia', 'east'), ('Europe', 'east'), ('Africa', 'south'), ('South America', 'south'), ('North America', 'north')) g(continent, grp) USING (continent) GROUP BY 1", "la")
def rpt7_grouped_continents(spark, d):
    """Mean over a fixed grouping of continents."""
    g = dim(spark, [("Asia", "east"), ("Europe", "east"), ("Africa", "south"), ("South America", "south"), ("North America", "north")], "continent string, grp string")
    return layer(spark, d).join(F.broadcast(g), "continent").groupBy("grp").agg(settled(F.avg("dof_all"), 4).alias("mean"))


@C.add("SELECT goid, row_number() OVER (ORDER BY hybas_id NULLS LAST, upland_skm NULLS LAST, goid) AS pos FROM re", "re")
def srt1_multi_key_sort(spark, d):
    """Rows in the order of several keys, with their position: ranges are sorted, and offsets are added."""
    from riverspark.operators.ordering import positions

    return positions(reaches(spark, d).select("goid", "hybas_id", "upland_skm"), ["hybas_id", "upland_skm", "goid"]).select("goid", "pos")


@C.add("WITH " + _FR + " SELECT cls, count(*) AS n FROM fg WHERE cls IS NOT NULL GROUP BY 1 ORDER BY 1", "la re")
def srt2_class_order(spark, d):
    return classed(spark, d).where("cls IS NOT NULL").groupBy("cls").agg(F.count(F.lit(1)).alias("n")).orderBy("cls")


@C.add("SELECT dam_id, stor_mcm FROM da ORDER BY stor_mcm DESC, dam_id LIMIT 10", "da")
def srt3_top_ten(spark, d):
    return dams(spark, d).select("dam_id", "stor_mcm").distinct().orderBy(F.desc("stor_mcm"), "dam_id").limit(10)


@C.add("SELECT hybas_id, dam_id, r FROM (SELECT hybas_id, dam_id, row_number() OVER (PARTITION BY hybas_id ORDER BY stor_mcm DESC, dam_id) AS r FROM da WHERE hybas_id IS NOT NULL) WHERE r <= 3", "da")
def srt4_top_per_group(spark, d):
    """The three largest of each basin, pre-selected within salts so that a hot basin is no single sort."""
    p = dams(spark, d).where("hybas_id IS NOT NULL").select("hybas_id", "dam_id", "stor_mcm")
    order = [F.desc("stor_mcm"), F.asc("dam_id")]
    some = p.withColumn("_s", F.pmod(F.xxhash64("dam_id"), F.lit(32))).withColumn("r", F.row_number().over(Window.partitionBy("hybas_id", "_s").orderBy(*order))).where("r <= 3").drop("r")
    return some.withColumn("r", F.row_number().over(Window.partitionBy("hybas_id").orderBy(*order))).where("r <= 3").select("hybas_id", "dam_id", F.col("r").cast("long").alias("r"))


@C.add("SELECT hybas_id, arg_max(dam_id, struct_pack(a := stor_mcm, b := -dam_id)) AS largest, arg_min(dam_id, struct_pack(a := stor_mcm, b := dam_id)) AS smallest FROM da WHERE hybas_id IS NOT NULL GROUP BY 1", "da")
def srt5_arg_extremes(spark, d):
    g = dams(spark, d).where("hybas_id IS NOT NULL").groupBy("hybas_id")
    return g.agg(F.max_by("dam_id", F.struct("stor_mcm", -F.col("dam_id"))).alias("largest"), F.min_by("dam_id", F.struct("stor_mcm", "dam_id")).alias("smallest"))


@C.add("SELECT DISTINCT source, lower(source) AS folded FROM documents WHERE source IS NOT NULL ORDER BY folded")
def srt6_case_insensitive(spark, d):
    return table(spark, d, "documents").where("source IS NOT NULL").select("source", F.lower("source").alias("folded")).distinct().orderBy("folded")


@C.add("SELECT 'reaches' AS part, goid, hybas_id FROM reaches UNION ALL SELECT 'mainstems', goid, hybas_id FROM mainstems")
def set1_union(spark, d):
    a = table(spark, d, "reaches").select(F.lit("reaches").alias("part"), "goid", "hybas_id")
    return a.unionByName(table(spark, d, "mainstems").select("goid", "hybas_id", F.lit("mainstems").alias("part")))


@C.add("SELECT goid, max(dof_all) AS dof FROM la GROUP BY 1", "la")
def set2_row_maximum(spark, d):
    return layer(spark, d).groupBy("goid").agg(F.max("dof_all").alias("dof"))


@C.add("SELECT goid, CAST(bool_or(v IS DISTINCT FROM f) AS BOOLEAN) AS changed FROM (SELECT goid, riv_ord AS v, first_value(riv_ord) OVER (PARTITION BY goid ORDER BY snap_year) AS f FROM la) GROUP BY 1", "la")
def set3_set_changes(spark, d):
    """Whether the set of values of any year differs from that of the first."""
    g = layer(spark, d).groupBy("goid", "snap_year").agg(F.array_sort(F.collect_set("riv_ord")).alias("s"))
    h = g.groupBy("goid").agg(F.min_by("s", "snap_year").alias("f"), F.collect_set("s").alias("all"))
    return h.select("goid", F.exists("all", lambda x: x != F.col("f")).alias("changed"))


@C.add("SELECT DISTINCT hybas_id FROM reaches WHERE hybas_id <> 0")
def set4_distinct(spark, d):
    return table(spark, d, "reaches").where("hybas_id <> 0").select("hybas_id").distinct()


@C.add("SELECT * FROM (VALUES ('dis'), ('length_km')) t(name)")
def set5_schema_intersection(spark, d):
    wanted = ["dis", "length_km", "hft_ix_s09"]
    return dim(spark, [(c,) for c in wanted if c in reaches(spark, d).columns], "name string")


@C.add("SELECT goid, 'b' AS side FROM la WHERE snap_year = 2020 AND goid NOT IN (SELECT goid FROM la WHERE snap_year = 2010) UNION ALL SELECT goid, 'a' FROM la WHERE snap_year = 2010 AND goid NOT IN (SELECT goid FROM la WHERE snap_year = 2020)", "la")
def set6_differences(spark, d):
    """Keys of either of two tables that the other lacks."""
    a = layer(spark, d)
    return differences(a.where("snap_year = 2010").select("goid"), a.where("snap_year = 2020").select("goid"))


@C.add("SELECT dam_id, nxt FROM (SELECT dam_id, first_year, min(CASE WHEN z_level = 16 THEN dam_id END) OVER (PARTITION BY first_year ORDER BY dam_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM da)", "da")
def win1_next_match(spark, d):
    """The next row that matches, in order."""
    return next_match(dams(spark, d).select("dam_id", "first_year", "z_level"), ["first_year"], "dam_id", F.col("z_level") == 16, "nxt").select("dam_id", "nxt")
