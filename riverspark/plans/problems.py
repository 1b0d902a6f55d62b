"""Queries of the data-processing problems, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverspark.functions.numbers import settled
from riverspark.operators.proximity import near_pairs, usable
from riverspark.operators.references import ForeignKey, orphan_cascade
from riverspark.operators.skew import Measure, salted_aggregate
from riverspark.operators.snapshots import chunk_report, snapshot_changes
from riverspark.sources.tables import NO_RIVER, latest, measured, table

REACH = 5_000.0


def dams(spark: SparkSession, d: str) -> DataFrame:
    """dams without repeated deliveries."""
    return table(spark, d, "dams").drop("loaded_at").distinct()


def dof_rows(spark: SparkSession, d: str) -> DataFrame:
    """dof_layer as it holds: the latest row per (snap_year, goid), measurements cleaned."""
    raw = table(spark, d, "dof_layer").select("snap_year", "goid", "hybas_id", "continent", measured("dof_all").alias("dof_all"), measured("dis_av_cms").alias("dis_av_cms"), "loaded_at")
    return latest(raw, ["snap_year", "goid"], "loaded_at", ["hybas_id", "continent", "dof_all", "dis_av_cms"])


def unit_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "basin_units").select("unit_id", "hybas_id", "continent", "stat_year", measured("hdi_ix_sav").alias("hdi_ix_sav"), "sub_area", "n_e", "n_g", "n_b", "n_a").distinct()


def p1_river_load(spark: SparkSession, d: str) -> DataFrame:
    """Per river: distinct dams, their storage, and its DOF over the snapshots."""
    a = salted_aggregate(
        dams(spark, d).where(F.col("nearest_river_goid") != NO_RIVER), ["nearest_river_goid"],
        {"n_dams": Measure("distinct", F.col("dam_id")), "n_rows": Measure("count"), "stor_mcm": Measure("sum", measured("stor_mcm")), "mean_distance": Measure("mean", measured("distance_to_river", -1.0)), "max_confidence": Measure("max", F.col("confidence"))},
    )
    b = salted_aggregate(dof_rows(spark, d), ["goid"], {"n_snapshots": Measure("count"), "mean_dof_all": Measure("mean", F.col("dof_all")), "var_dof_all": Measure("var_pop", F.col("dof_all"))})
    j = a.withColumnRenamed("nearest_river_goid", "goid").join(b, "goid", "full_outer")
    return j.select(
        "goid", F.coalesce("n_dams", F.lit(0)).alias("n_dams"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.round("stor_mcm", 3).alias("stor_mcm"), settled("mean_distance", 4).alias("mean_distance"), "max_confidence",
        F.coalesce("n_snapshots", F.lit(0)).alias("n_snapshots"), settled("mean_dof_all", 4).alias("mean_dof_all"), settled(F.abs("var_dof_all"), 3).alias("var_dof_all"),
    )


def p1_basin_load(spark: SparkSession, d: str) -> DataFrame:
    """Per basin: dams, reaches, units and DOF; null hybas_id is a group of its own."""
    a = salted_aggregate(dams(spark, d), ["hybas_id"], {"n_dams": Measure("distinct", F.col("dam_id")), "stor_mcm": Measure("sum", measured("stor_mcm"))})
    b = salted_aggregate(dof_rows(spark, d), ["hybas_id"], {"n_dof": Measure("count"), "n_rivers": Measure("distinct", F.col("goid")), "mean_dof_all": Measure("mean", F.col("dof_all"))})
    r = table(spark, d, "reaches").drop("loaded_at").distinct()
    c = salted_aggregate(r, ["hybas_id"], {"n_reaches": Measure("distinct", F.col("reach_id")), "length_km": Measure("sum", F.col("length_km")), "max_dis": Measure("max", measured("dis_av_cms"))})
    u = salted_aggregate(unit_rows(spark, d), ["hybas_id"], {"n_units": Measure("distinct", F.col("unit_id")), "mean_hdi": Measure("mean", F.col("hdi_ix_sav"))})
    whole = None
    for x in (a, b, c, u):
        whole = x if whole is None else whole.join(x.withColumnRenamed("hybas_id", "_k"), F.col("hybas_id").eqNullSafe(F.col("_k")), "full_outer").withColumn("hybas_id", F.coalesce("hybas_id", "_k")).drop("_k")
    n = [F.coalesce(k, F.lit(0)).alias(k) for k in ("n_dams", "n_dof", "n_rivers", "n_reaches", "n_units")]
    return whole.select("hybas_id", *n, F.round("stor_mcm", 3).alias("stor_mcm"), settled("mean_dof_all", 4).alias("mean_dof_all"), F.round("length_km", 3).alias("length_km"), "max_dis", settled("mean_hdi", 4).alias("mean_hdi"))


def rivers(spark: SparkSession, d: str) -> DataFrame:
    columns = ["goid", "from_x", "from_y", "to_x", "to_y", "valid_from", "valid_to"]
    return table(spark, d, "reaches").select(columns).unionByName(table(spark, d, "mainstems").select(columns))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Dams whose stored river or distance is wrong, with the right river or -1."""
    shapes = rivers(spark, d).select(F.col("goid").alias("sid"), F.col("from_x").alias("ax"), F.col("from_y").alias("ay"), F.col("to_x").alias("bx"), F.col("to_y").alias("by"))
    places = table(spark, d, "dams").where(usable("x", "y"))
    own = places.select("dam_id", "x", "y", F.coalesce("nearest_river_goid", F.lit(NO_RIVER)).alias("stored"), "distance_to_river").distinct()
    near = near_pairs(places.select(F.col("dam_id").alias("pid"), "x", "y"), shapes, REACH)
    j = own.join(near, F.col("dam_id") == F.col("pid"), "left").withColumn("river_goid", F.coalesce("sid", F.lit(NO_RIVER).cast("long")))
    stored = measured("distance_to_river")
    wrong = (F.col("stored") != F.col("river_goid")) | ((F.col("river_goid") != NO_RIVER) & (stored.isNull() | (F.abs(stored - F.col("distance")) > 1)))
    return j.where(wrong).select("dam_id", "river_goid").distinct()


def p3_basin_of_dam(spark: SparkSession, d: str) -> DataFrame:
    """Dams by the basin box that holds them, beside the stored basin (null: in no box)."""
    boxes = table(spark, d, "basins").select(F.col("hybas_id").alias("sid"), F.col("min_x").alias("ax"), F.col("min_y").alias("ay"), F.col("max_x").alias("bx"), F.col("max_y").alias("by"))
    own = table(spark, d, "dams").where(usable("x", "y")).select("dam_id", "x", "y", F.col("hybas_id").alias("stored_id")).distinct()
    near = near_pairs(own.select(F.col("dam_id").alias("pid"), "x", "y"), boxes, 0.0, kind="box", strip=500_000.0)
    return own.join(near, F.col("dam_id") == F.col("pid"), "left").select("dam_id", "stored_id", F.col("sid").alias("basin_id")).distinct()


def p3_nearest_dam(spark: SparkSession, d: str) -> DataFrame:
    """Of each dam location the nearest other location within 2,000; dams at one place are one location."""
    places = table(spark, d, "dams").where(usable("x", "y")).groupBy("x", "y").agg(F.min("dam_id").alias("pid"))
    shapes = places.select(F.col("pid").alias("sid"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return near_pairs(places, shapes, 2_000.0, others=True).select(F.col("pid").alias("dam_id"), F.col("sid").alias("other_id"), F.round("distance", 3).alias("distance"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(table(spark, d, "dof_layer"), "snap_year", "goid", measured("dof_all"), order="loaded_at")


def p4_chunks(spark: SparkSession, d: str) -> DataFrame:
    """How many chunks and rows the digests discard. Without SQL, which lacks the hash; tests hold it against brute force."""
    return chunk_report(table(spark, d, "dof_layer"), "snap_year", "goid", measured("dof_all"), order="loaded_at")


def _river_parents(spark: SparkSession, d: str) -> DataFrame:
    return rivers(spark, d).select(F.col("goid").alias("rec_id"), F.lit(None).cast("int").alias("period"), "goid", "valid_from", "valid_to").distinct()


def _open(df: DataFrame) -> DataFrame:
    return df.withColumn("valid_from", F.lit(None).cast("int")).withColumn("valid_to", F.lit(None).cast("int"))


def _dam_refs(spark: SparkSession, d: str) -> DataFrame:
    goid = F.when(F.col("nearest_river_goid") != NO_RIVER, F.col("nearest_river_goid"))
    return _open(table(spark, d, "dams").select(F.col("dam_id").alias("rec_id"), F.col("first_year").alias("period"), goid.alias("goid")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    layer = _open(table(spark, d, "dof_layer").select(F.col("goid").alias("rec_id"), F.col("snap_year").alias("period"), "goid"))
    found = orphan_cascade(
        {"dof_layer": layer, "dams": _dam_refs(spark, d), "rivers": _river_parents(spark, d)},
        [ForeignKey("dof_layer", "goid", "rivers", "goid"), ForeignKey("dams", "goid", "rivers", "goid")],
    )
    return found.select("src_table", F.col("period").alias("snap_year"), "rec_id", F.col("ref").alias("goid"))


def p5_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Reaches that drain into a reach missing in a snapshot year, all upstream of them, and the dams on any of those."""
    r = table(spark, d, "reaches").select("goid", "hybas_id", "noid", "ndoid", "valid_from", "valid_to").distinct()
    valid = r.withColumn("period", F.explode(F.array(F.lit(2010), F.lit(2015), F.lit(2020)))).where((F.col("valid_from") <= F.col("period")) & (F.col("valid_to").isNull() | (F.col("valid_to") >= F.col("period"))))
    # one number: basins have 34 bits, nodes of a basin 28; what has more is an error
    fits = F.col("hybas_id").between(0, 2**34 - 1) & F.col("noid").between(0, 2**28 - 1) & F.col("ndoid").between(0, 2**28 - 1)
    valid = valid.where(F.when(F.coalesce(fits, F.lit(True)), True).otherwise(F.raise_error(F.lit("a basin or node number is too large"))))
    node = lambda n: F.shiftleft("hybas_id", 28) + F.col(n)
    nowhere = F.lit(None).cast("long")
    reaches = valid.select(F.col("goid").alias("rec_id"), "period", "goid", node("noid").alias("node"), F.when(F.col("ndoid") != 0, node("ndoid")).alias("down"), F.col("period").alias("valid_from"), F.col("period").alias("valid_to"))
    main = table(spark, d, "mainstems").select(F.col("goid").alias("rec_id"), F.lit(None).cast("int").alias("period"), "goid", nowhere.alias("node"), nowhere.alias("down"), "valid_from", "valid_to").distinct()
    network = reaches.unionByName(main)
    found = orphan_cascade({"reaches": network, "dams": _dam_refs(spark, d)}, [ForeignKey("reaches", "down", "reaches", "node"), ForeignKey("dams", "goid", "reaches", "goid")])
    ref = F.when(F.col("src_table") == "reaches", F.concat_ws(":", F.shiftright("ref", 28), F.col("ref").bitwiseAND(F.lit(2**28 - 1)))).otherwise(F.col("ref").cast("string"))
    return found.select("src_table", F.col("period").alias("snap_year"), "rec_id", ref.alias("ref"), "level", "kind")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table and year."""
    return p5_found(spark, d).groupBy("src_table", "snap_year").agg(F.count(F.lit(1)).alias("n_orphans"), F.countDistinct("goid").alias("n_missing"))


QUERIES = {f.__name__: f for f in (p1_river_load, p1_basin_load, p3_found, p3_basin_of_dam, p3_nearest_dam, p4_found, p4_chunks, p5_found, p5_cascade, p5_report)}

_M = "CASE WHEN isnan({0}) OR {0} = -999 THEN NULL ELSE {0} END"
_DAMS = "dm AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM dams)"
DOF_SQL = f"""dl AS (SELECT snap_year, goid, m.h AS hybas_id, m.c AS continent, m.a AS dof_all, m.q AS dis_av_cms FROM (
  SELECT snap_year, goid, max({{'l': loaded_at, 'h': hybas_id, 'c': continent, 'a': {_M.format('dof_all')}, 'q': {_M.format('dis_av_cms')}}}) AS m FROM dof_layer GROUP BY ALL))"""
UNITS_SQL = f"bu AS (SELECT DISTINCT unit_id, hybas_id, continent, stat_year AS snap_year, {_M.format('hdi_ix_sav')} AS hdi_ix_sav FROM basin_units)"
_RIVERS = "rv AS (SELECT goid, from_x, from_y, to_x, to_y, valid_from, valid_to FROM reaches UNION SELECT goid, from_x, from_y, to_x, to_y, valid_from, valid_to FROM mainstems)"
_SEG = "least(greatest(CASE WHEN (to_x-from_x)*(to_x-from_x)+(to_y-from_y)*(to_y-from_y) > 0 THEN ((x-from_x)*(to_x-from_x)+(y-from_y)*(to_y-from_y))/((to_x-from_x)*(to_x-from_x)+(to_y-from_y)*(to_y-from_y)) ELSE 0 END, 0), 1)"
_P5 = """SELECT DISTINCT src_table, snap_year, rec_id, goid FROM (
  SELECT 'dof_layer' AS src_table, snap_year, goid AS rec_id, goid FROM dof_layer UNION ALL
  SELECT 'dams', first_year, dam_id, nearest_river_goid FROM dams WHERE nearest_river_goid <> -1) r
WHERE goid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rv WHERE rv.goid = r.goid AND valid_from <= snap_year AND (valid_to IS NULL OR valid_to >= snap_year))"""


ORACLES = {
    "p1_river_load": f"""WITH {_DAMS}, {DOF_SQL},
a AS (SELECT nearest_river_goid AS goid, count(DISTINCT dam_id) AS n_dams, count(*) AS n_rows, round(sum({_M.format('stor_mcm')}), 3) AS stor_mcm,
  round(avg(CASE WHEN isnan(distance_to_river) OR distance_to_river = -1 THEN NULL ELSE distance_to_river END) + 1e-7, 4) AS mean_distance, max(confidence) AS max_confidence FROM dm WHERE nearest_river_goid <> -1 GROUP BY 1),
b AS (SELECT goid, count(*) AS n_snapshots, round(avg(dof_all) + 1e-7, 4) AS mean_dof_all, round(var_pop(dof_all) + 1e-6, 3) AS var_dof_all FROM dl GROUP BY 1)
SELECT goid, coalesce(n_dams, 0) AS n_dams, coalesce(n_rows, 0) AS n_rows, stor_mcm, mean_distance, max_confidence, coalesce(n_snapshots, 0) AS n_snapshots, mean_dof_all, var_dof_all FROM a FULL JOIN b USING (goid)""",
    "p1_basin_load": f"""WITH {_DAMS}, {DOF_SQL}, {UNITS_SQL}, rr AS (SELECT DISTINCT * EXCLUDE (loaded_at) FROM reaches),
k AS (SELECT hybas_id FROM dm UNION SELECT hybas_id FROM dl UNION SELECT hybas_id FROM rr UNION SELECT hybas_id FROM bu),
a AS (SELECT hybas_id, count(DISTINCT dam_id) AS n_dams, round(sum({_M.format('stor_mcm')}), 3) AS stor_mcm FROM dm GROUP BY 1),
b AS (SELECT hybas_id, count(*) AS n_dof, count(DISTINCT goid) AS n_rivers, round(avg(dof_all) + 1e-7, 4) AS mean_dof_all FROM dl GROUP BY 1),
c AS (SELECT hybas_id, count(DISTINCT reach_id) AS n_reaches, round(sum(length_km), 3) AS length_km, max({_M.format('dis_av_cms')}) AS max_dis FROM rr GROUP BY 1),
u AS (SELECT hybas_id, count(DISTINCT unit_id) AS n_units, round(avg(hdi_ix_sav) + 1e-7, 4) AS mean_hdi FROM bu GROUP BY 1)
SELECT k.hybas_id, coalesce(n_dams, 0) AS n_dams, coalesce(n_dof, 0) AS n_dof, coalesce(n_rivers, 0) AS n_rivers, coalesce(n_reaches, 0) AS n_reaches, coalesce(n_units, 0) AS n_units, stor_mcm, mean_dof_all, length_km, max_dis, mean_hdi
FROM k LEFT JOIN a ON k.hybas_id IS NOT DISTINCT FROM a.hybas_id LEFT JOIN b ON k.hybas_id IS NOT DISTINCT FROM b.hybas_id LEFT JOIN c ON k.hybas_id IS NOT DISTINCT FROM c.hybas_id LEFT JOIN u ON k.hybas_id IS NOT DISTINCT FROM u.hybas_id""",
    "p3_found": f"""WITH {_RIVERS}, pt AS (SELECT DISTINCT dam_id, x, y, coalesce(nearest_river_goid, -1) AS stored, CASE WHEN isnan(distance_to_river) THEN NULL ELSE distance_to_river END AS dist FROM dams WHERE x IS NOT NULL AND y IS NOT NULL AND NOT (x = 0 AND y = 0)),
pr AS (SELECT dam_id, goid, sqrt(power(x - (from_x + t*(to_x-from_x)), 2) + power(y - (from_y + t*(to_y-from_y)), 2)) AS d FROM (
  SELECT *, {_SEG} AS t FROM (SELECT DISTINCT dam_id, x, y FROM pt) p JOIN rv ON y BETWEEN least(from_y, to_y) - 5000 AND greatest(from_y, to_y) + 5000 WHERE x BETWEEN least(from_x, to_x) - 5000 AND greatest(from_x, to_x) + 5000)),
nr AS (SELECT dam_id, min({{'d': d, 'g': goid}}) AS m FROM pr WHERE d <= 5000 GROUP BY 1)
SELECT DISTINCT dam_id, coalesce(m.g, -1) AS river_goid FROM pt LEFT JOIN nr USING (dam_id) WHERE stored <> coalesce(m.g, -1) OR (m.g IS NOT NULL AND (dist IS NULL OR abs(dist - m.d) > 1))""",
    "p3_basin_of_dam": """SELECT DISTINCT dam_id, d.hybas_id AS stored_id, b.hybas_id AS basin_id FROM dams d LEFT JOIN basins b ON x >= min_x AND x <= max_x AND y >= min_y AND y <= max_y WHERE x IS NOT NULL AND y IS NOT NULL AND NOT (x = 0 AND y = 0)""",
    "p3_nearest_dam": """WITH pl AS (SELECT x, y, min(dam_id) AS dam_id FROM dams WHERE x IS NOT NULL AND y IS NOT NULL AND NOT (x = 0 AND y = 0) GROUP BY 1, 2),
pr AS (SELECT a.dam_id, b.dam_id AS other_id, sqrt(power(a.x-b.x, 2) + power(a.y-b.y, 2)) AS d FROM pl a JOIN pl b ON b.y BETWEEN a.y - 2000 AND a.y + 2000 WHERE a.dam_id <> b.dam_id AND abs(a.x - b.x) <= 2000)
SELECT dam_id, m.o AS other_id, round(m.d, 3) AS distance FROM (SELECT dam_id, min({'d': d, 'o': other_id}) AS m FROM pr WHERE d <= 2000 GROUP BY 1)""",
    "p4_found": f"""WITH {DOF_SQL}, pr AS (SELECT a.snap_year AS y0, a.goid AS g0, a.dof_all AS v0, b.snap_year AS y1, b.goid AS g1, b.dof_all AS v1
  FROM (SELECT *, CASE snap_year WHEN 2010 THEN 2015 ELSE 2020 END AS pair FROM dl WHERE snap_year < 2020) a FULL JOIN (SELECT *, snap_year AS pair FROM dl WHERE snap_year > 2010) b ON a.pair = b.pair AND a.goid = b.goid)
SELECT coalesce(y1, CASE y0 WHEN 2010 THEN 2015 ELSE 2020 END) AS snap_year, coalesce(g0, g1) AS goid, CASE WHEN g0 IS NULL THEN 'added' WHEN g1 IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM pr WHERE g0 IS NULL OR g1 IS NULL OR (v0 IS NULL) <> (v1 IS NULL) OR abs(v0 - v1) > 0.000001""",
    "p5_found": f"WITH {_RIVERS} {_P5}",
    "p5_report": f"WITH {_RIVERS} SELECT src_table, snap_year, count(*) AS n_orphans, count(DISTINCT goid) AS n_missing FROM ({_P5}) GROUP BY 1, 2",
    "p5_cascade": """WITH RECURSIVE va AS (SELECT DISTINCT goid, hybas_id, noid, ndoid, yr FROM reaches, (VALUES (2010), (2015), (2020)) t(yr) WHERE valid_from <= yr AND (valid_to IS NULL OR valid_to >= yr)),
oc AS (SELECT goid, hybas_id, noid, ndoid, yr, 0 AS level FROM va a WHERE ndoid <> 0 AND NOT EXISTS (SELECT 1 FROM va b WHERE b.hybas_id = a.hybas_id AND b.noid = a.ndoid AND b.yr = a.yr)
  UNION ALL SELECT c.goid, c.hybas_id, c.noid, c.ndoid, c.yr, level + 1 FROM oc JOIN va c ON c.hybas_id = oc.hybas_id AND c.ndoid = oc.noid AND c.yr = oc.yr),
dr AS (SELECT DISTINCT dam_id, first_year, nearest_river_goid AS goid FROM dams WHERE nearest_river_goid <> -1)
SELECT 'reaches' AS src_table, yr AS snap_year, goid AS rec_id, hybas_id || ':' || ndoid AS ref, level, CASE level WHEN 0 THEN 'direct' ELSE 'inherited' END AS kind FROM oc
UNION ALL SELECT 'dams', first_year, dam_id, CAST(goid AS VARCHAR), 0, 'direct' FROM dr WHERE NOT EXISTS (SELECT 1 FROM va WHERE va.goid = dr.goid AND yr = first_year) AND NOT EXISTS (SELECT 1 FROM mainstems m WHERE m.goid = dr.goid AND valid_from <= first_year AND (valid_to IS NULL OR valid_to >= first_year))
UNION ALL SELECT 'dams', first_year, dam_id, CAST(dr.goid AS VARCHAR), oc.level + 1, 'inherited' FROM dr JOIN oc ON oc.goid = dr.goid AND oc.yr = first_year""",
}
