"""Base frames of the river tables in clean form, the same as SQL views, and the catalog of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riverspark.functions.numbers import settled
from riverspark.sources.tables import measured, table

YEARS = (2010, 2015, 2020)
#: Dam types and their codes.
TYPES = {"embankment_dam": "e", "gravity_dam": "g", "Barrage_dam": "b", "arch_dam": "a"}


class Catalog:
    """Queries and their SQL under one name; with= names the views of VIEWS that the SQL uses."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None, uses: str = ""):
        def register(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracles[f.__name__] = with_views(sql, uses.split())
            return f

        return register


def with_views(sql: str, names: list[str]) -> str:
    need: list[str] = []

    def visit(n: str) -> None:
        for m in VIEW_NEEDS.get(n, ()):
            visit(m)
        if n not in need:
            need.append(n)

    for n in names:
        visit(n)
    if not need:
        return sql
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    head = "WITH RECURSIVE " if recursive else "WITH "
    rest = body[len("WITH RECURSIVE") if recursive else len("WITH") :].lstrip() if body.upper().startswith("WITH") else None
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in need)
    return f"{head}{views}, {rest}" if rest is not None else f"{head}{views} {body}"


def hashed(k: int, m: int, name: str = "goid") -> Column:
    """A small whole number from a key, for attributes that the tables lack."""
    return F.pmod(F.col(name) * F.lit(k), F.lit(m))


def reaches(spark: SparkSession, d: str) -> DataFrame:
    """Reaches once each; no discharge is 0; backbone = the run of left branches; three pressures from the key."""
    r = table(spark, d, "reaches").drop("loaded_at").distinct()
    odd = F.floor(F.col("noid") / F.col("noid").bitwiseAND(-F.col("noid"))).cast("long")
    return r.select(
        "goid", "reach_id", "noid", "ndoid", "nuoid", "hybas_id", F.coalesce("continent", F.lit("Unknown")).alias("continent"), "riv_ord",
        F.coalesce(measured("dis_av_cms"), F.lit(0.0)).alias("dis"), "length_km", "volume_tcm", "upland_skm", "hyfall", F.col("fld").cast("double").alias("fld"), F.col("ero_yld_ton").cast("double").alias("ero"), "inc",
        (F.col("hybas_id") * 1000000 + odd).alias("bb_id"), (odd == 1).cast("int").alias("bb_ocean"),
        hashed(7, 101).cast("double").alias("use_"), hashed(13, 101).cast("double").alias("rdd"), (hashed(19, 101).cast("double") / F.lit(100.0)).alias("urb"),
        "from_x", "from_y", "to_x", "to_y", "valid_from", "valid_to",
    )


def dams(spark: SparkSession, d: str) -> DataFrame:
    """Dams once each, with one spelling per type, lon and lat from the planar coordinates, and the river (null: none)."""
    t = table(spark, d, "dams").drop("loaded_at").distinct()
    low = F.lower("dam_type")
    kind = F.when(low == "embankment_dam", "embankment_dam").when(low == "gravity_dam", "gravity_dam").when(low.isin("barrage_dam", "other_dam"), "Barrage_dam").when(low == "arch_dam", "arch_dam")
    fine = F.col("x").isNotNull() & F.col("y").isNotNull() & ~((F.col("x") == 0) & (F.col("y") == 0))
    return t.select(
        "dam_id", kind.alias("dam_type"), "first_year", "hybas_id", F.when(fine, F.col("x")).alias("x"), F.when(fine, F.col("y")).alias("y"),
        F.when(fine, F.col("x") / F.lit(100000.0) - F.lit(180.0)).alias("lon"), F.when(fine, F.col("y") / F.lit(100000.0) - F.lit(90.0)).alias("lat"),
        F.when(F.col("nearest_river_goid") != -1, F.col("nearest_river_goid")).alias("goid"), measured("distance_to_river", -1.0).alias("dist"), F.coalesce(measured("stor_mcm"), F.lit(0.0)).alias("stor_mcm"),
        "is_certain", "confidence", "z_level", "inc",
    )


def units(spark: SparkSession, d: str) -> DataFrame:
    """Sub-basin units once each, measurements cleaned."""
    t = table(spark, d, "basin_units").drop("loaded_at").distinct()
    return t.select("unit_id", "hybas_id", F.coalesce("continent", F.lit("Unknown")).alias("continent"), "stat_year", "sub_area", measured("hdi_ix_sav").alias("hdi"), measured("lka_pc_sse").alias("lka"), "ele_mt_sav", "n_e", "n_g", "n_b", "n_a")


def layer(spark: SparkSession, d: str) -> DataFrame:
    """dof_layer as it holds, no value as null."""
    v = F.max(F.struct("loaded_at", "hybas_id", "continent", "riv_ord", measured("dis_av_cms").alias("q"), measured("dof").alias("d"), measured("dof_all").alias("a"))).alias("m")
    m = table(spark, d, "dof_layer").groupBy("snap_year", "goid").agg(v)
    return m.select("snap_year", "goid", F.col("m.hybas_id").alias("hybas_id"), F.col("m.continent").alias("continent"), F.col("m.riv_ord").alias("riv_ord"), F.col("m.q").alias("dis"), F.col("m.d").alias("dof"), F.col("m.a").alias("dof_all"))


def basins(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "basins")


_CLEAN = "CASE WHEN isnan({0}) OR {0} = {1} THEN NULL ELSE {0} END"
VIEW_NEEDS = {"byear": ("un",), "bsn": ("un",)}
VIEWS = {
    "re": f"""SELECT goid, reach_id, noid, ndoid, nuoid, hybas_id, coalesce(continent, 'Unknown') AS continent, riv_ord, coalesce({_CLEAN.format('dis_av_cms', -999)}, 0) AS dis, length_km, volume_tcm, upland_skm, hyfall,
  CAST(fld AS DOUBLE) AS fld, CAST(ero_yld_ton AS DOUBLE) AS ero, inc, hybas_id * 1000000 + noid // (noid & (-noid)) AS bb_id, CAST(noid // (noid & (-noid)) = 1 AS INT) AS bb_ocean,
  CAST((goid * 7) % 101 AS DOUBLE) AS use_, CAST((goid * 13) % 101 AS DOUBLE) AS rdd, CAST((goid * 19) % 101 AS DOUBLE) / 100 AS urb, from_x, from_y, to_x, to_y, valid_from, valid_to
  FROM (SELECT DISTINCT * EXCLUDE (loaded_at) FROM reaches)""",
    "da": f"""SELECT dam_id, CASE lower(dam_type) WHEN 'embankment_dam' THEN 'embankment_dam' WHEN 'gravity_dam' THEN 'gravity_dam' WHEN 'barrage_dam' THEN 'Barrage_dam' WHEN 'other_dam' THEN 'Barrage_dam' WHEN 'arch_dam' THEN 'arch_dam' END AS dam_type,
  first_year, hybas_id, CASE WHEN x = 0 AND y = 0 OR y IS NULL THEN NULL ELSE x END AS x, CASE WHEN x = 0 AND y = 0 OR x IS NULL THEN NULL ELSE y END AS y,
  CASE WHEN x = 0 AND y = 0 OR y IS NULL THEN NULL ELSE x END / 100000.0::DOUBLE - 180.0::DOUBLE AS lon, CASE WHEN x = 0 AND y = 0 OR x IS NULL THEN NULL ELSE y END / 100000.0::DOUBLE - 90.0::DOUBLE AS lat,
  nullif(nearest_river_goid, -1) AS goid, {_CLEAN.format('distance_to_river', -1)} AS dist, coalesce({_CLEAN.format('stor_mcm', -999)}, 0) AS stor_mcm, is_certain, confidence, z_level, inc FROM (SELECT DISTINCT * EXCLUDE (loaded_at) FROM dams)""",
    "un": f"""SELECT unit_id, hybas_id, coalesce(continent, 'Unknown') AS continent, stat_year, sub_area, {_CLEAN.format('hdi_ix_sav', -999)} AS hdi, {_CLEAN.format('lka_pc_sse', -999)} AS lka, ele_mt_sav, n_e, n_g, n_b, n_a FROM (SELECT DISTINCT * EXCLUDE (loaded_at) FROM basin_units)""",
    "la": f"""SELECT snap_year, goid, m.h AS hybas_id, m.c AS continent, m.r AS riv_ord, m.q AS dis, m.d AS dof, m.a AS dof_all FROM (SELECT snap_year, goid, max({{'l': loaded_at, 'h': hybas_id, 'c': continent, 'r': riv_ord, 'q': {_CLEAN.format('dis_av_cms', -999)}, 'd': {_CLEAN.format('dof', -999)}, 'a': {_CLEAN.format('dof_all', -999)}}}) AS m FROM dof_layer GROUP BY ALL)""",
    # one row per basin: counts by type and year, and attributes; a null basin is left out
    "bsn": """SELECT hybas_id, CAST(coalesce(sum(n_e) FILTER (WHERE stat_year = 2010), 0) AS BIGINT) AS e10, CAST(coalesce(sum(n_g) FILTER (WHERE stat_year = 2010), 0) AS BIGINT) AS g10, CAST(coalesce(sum(n_b) FILTER (WHERE stat_year = 2010), 0) AS BIGINT) AS b10, CAST(coalesce(sum(n_a) FILTER (WHERE stat_year = 2010), 0) AS BIGINT) AS a10,
  CAST(coalesce(sum(n_e) FILTER (WHERE stat_year = 2015), 0) AS BIGINT) AS e15, CAST(coalesce(sum(n_g) FILTER (WHERE stat_year = 2015), 0) AS BIGINT) AS g15, CAST(coalesce(sum(n_b) FILTER (WHERE stat_year = 2015), 0) AS BIGINT) AS b15, CAST(coalesce(sum(n_a) FILTER (WHERE stat_year = 2015), 0) AS BIGINT) AS a15,
  CAST(coalesce(sum(n_e) FILTER (WHERE stat_year = 2020), 0) AS BIGINT) AS e20, CAST(coalesce(sum(n_g) FILTER (WHERE stat_year = 2020), 0) AS BIGINT) AS g20, CAST(coalesce(sum(n_b) FILTER (WHERE stat_year = 2020), 0) AS BIGINT) AS b20, CAST(coalesce(sum(n_a) FILTER (WHERE stat_year = 2020), 0) AS BIGINT) AS a20,
  avg(hdi) AS hdi, avg(lka) AS lka, sum(sub_area) FILTER (WHERE stat_year = 2020) AS area, min(nullif(continent, 'Unknown')) AS continent FROM un WHERE hybas_id IS NOT NULL GROUP BY hybas_id""",
}


def basin_table(spark: SparkSession, d: str) -> DataFrame:
    """One wide row per basin: e10 … a20, hdi, lka, area (0 or no units: null), continent. One shuffle; counts are partial first."""
    u = units(spark, d).where("hybas_id IS NOT NULL")
    counts = [F.coalesce(F.sum(F.when(F.col("stat_year") == 2000 + y, F.col(f"n_{t}"))), F.lit(0)).alias(f"{t}{y}") for y in (10, 15, 20) for t in "egba"]
    return u.groupBy("hybas_id").agg(*counts, F.avg("hdi").alias("hdi"), F.avg("lka").alias("lka"), F.sum(F.when(F.col("stat_year") == 2020, F.col("sub_area"))).alias("area"), F.min(F.when(F.col("continent") != "Unknown", F.col("continent"))).alias("continent"))


def dim(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A literal table of fixed size."""
    return spark.createDataFrame(rows, schema)


__all__ = ["Catalog", "basin_table", "basins", "dams", "dim", "layer", "reaches", "settled", "table", "units", "with_views"]
