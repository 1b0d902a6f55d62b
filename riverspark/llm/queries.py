"""Queries of the problems tagged llm, over whole tables and whole texts. Those of texts have no SQL: tests hold them against brute force."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverspark.llm.leakage import leaks
from riverspark.llm.mixing import mix, shares, source_name
from riverspark.llm.quantiles import cell_counts, cell_of, cell_percentiles, merge_counts, percentiles, read_parts, value_counts, value_of, write_part
from riverspark.llm.reading import formula_table, reading_levels
from riverspark.plans.problems import DOF_SQL, UNITS_SQL, dof_rows
from riverspark.session import shared_folder
from riverspark.sources.tables import measured

#: The path of the tokenizer is a parameter.
TOKENIZER = os.environ.get("RIVERSPARK_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


SHARES = [0.05, 0.25, 0.5, 0.75, 0.95]
#: Stated errors: half a step for hdi_ix_sav and dof_all, 0.1 % of the value for dis_av_cms.
HDI_STEP, DOF_STEP, DIS_RELATIVE = 0.0001, 0.0001, 0.001


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per basin and year, and per continent and year: all measures and groupings in one pass over long, narrow rows."""
    errors = {"hdi_ix_sav": {"step": HDI_STEP}, "dof_all": {"step": DOF_STEP}, "dis_av_cms": {"relative": DIS_RELATIVE}}
    pairs = [(n, by) for n in errors for by in ("hybas_id", "continent")]  # a row's code is its place here

    def long(rows: DataFrame, names: list[str]) -> DataFrame:
        each = []
        for k, (n, by) in enumerate(pairs):
            if n in names:
                ids = (F.col("hybas_id"), F.lit(None).cast("string")) if by == "hybas_id" else (F.lit(None).cast("long"), F.col("continent"))
                each.append(F.struct(F.lit(k).alias("code"), ids[0].alias("basin"), ids[1].alias("region"), cell_of(F.col(n), **errors[n]).alias("cell")))
        return rows.select(F.coalesce("snap_year", F.lit(-1)).alias("snap_year"), F.inline(F.array(*each)))

    units = _read(spark, d, "basin_units").select("unit_id", "hybas_id", "continent", F.col("stat_year").alias("snap_year"), measured("hdi_ix_sav").alias("hdi_ix_sav")).distinct()
    rows = long(dof_rows(spark, d), ["dof_all", "dis_av_cms"]).unionByName(long(units, ["hdi_ix_sav"]))
    keys = ["code", "basin", "region", "snap_year"]
    found = cell_percentiles(cell_counts(rows, keys), keys, SHARES)
    value, measure, grouped, group = (F.lit(None).cast(t) for t in ("double", "string", "string", "string"))
    for k, (n, by) in enumerate(pairs):
        here = F.col("code") == k
        value, measure, grouped = F.when(here, value_of(F.col("cell"), **errors[n])).otherwise(value), F.when(here, n).otherwise(measure), F.when(here, by).otherwise(grouped)
        group = F.when(here, F.col("basin").cast("string") if by == "hybas_id" else F.col("region")).otherwise(group)
    year = F.when(F.col("snap_year") != -1, F.col("snap_year"))
    return found.select(measure.alias("measure"), grouped.alias("grouped_by"), group.alias("group_id"), year.alias("snap_year"), "p", F.round(value, 6).alias("value"), "n")


def p2_merged_days(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of dof_all over all snapshots, combined from the parts that the separate snapshots left in the shared folder."""
    folder = f"{shared_folder(spark).rstrip('/')}/parts-{uuid.uuid4().hex}"
    years = ("2010", "2015", "2020")
    for y in years:
        write_part(value_counts(dof_rows(spark, d).where(F.col("snap_year") == int(y)), ["continent"], F.col("dof_all"), step=DOF_STEP), folder, y)
    whole = merge_counts(*read_parts(spark, folder, years), groups=["continent"])
    return percentiles(whole, ["continent"], SHARES, step=DOF_STEP).withColumn("value", F.round("value", 6))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(_read(spark, d, "documents"), _read(spark, d, "eval_items"))


def p6_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Per test item in how many documents it leaked."""
    found = p6_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return _read(spark, d, "eval_items").select("item_id", "suite").join(found, "item_id", "left").na.fill(0, ["n_docs"])


def p7_mixture(spark: SparkSession, d: str, tokenizer: str = TOKENIZER) -> DataFrame:
    return mix(_read(spark, d, "documents"), _read(spark, d, "mix_targets"), tokenizer)


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(p7_mixture(spark, d), _read(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    levels = reading_levels(_read(spark, d, "documents"), _read(spark, d, "read_levels"))
    return levels.where("english AND share_5 > 0.5").select("doc_id").distinct()


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    levels = reading_levels(_read(spark, d, "documents"), _read(spark, d, "read_levels"))
    return levels.select("doc_id", "english", "n_words", "level", *[F.round(f"share_{k}", 4).alias(f"share_{k}") for k in range(1, 6)], F.round("unfamiliar", 4).alias("unfamiliar"), F.round("sentence_words", 3).alias("sentence_words"))


def p8_formula(spark: SparkSession, d: str) -> DataFrame:
    """The coefficients of the reading levels."""
    return formula_table(_read(spark, d, "documents"), _read(spark, d, "read_levels")).withColumn("coefficient", F.round("coefficient", 4))


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents per source and level."""
    docs = _read(spark, d, "documents")
    levels = reading_levels(docs, _read(spark, d, "read_levels")).select("doc_id", "level")
    return docs.select("doc_id", source_name("source").alias("source")).join(levels, "doc_id").groupBy("source", "level").agg(F.count(F.lit(1)).alias("n_docs"))


QUERIES = {f.__name__: f for f in (p2_percentiles, p2_merged_days, p6_found, p6_leaked_items, p7_mixture, p7_shares, p8_found, p8_levels, p8_formula, p8_profile)}


def _rank_sql(measure: str, by: str, source: str, value: str) -> str:
    shares = ", ".join(f"({p}::DOUBLE)" for p in SHARES)
    return f"""SELECT '{measure}' AS measure, '{by}' AS grouped_by, CAST({by} AS VARCHAR) AS group_id, snap_year, p, round({value}, 6) AS value, n FROM (
  SELECT {by}, snap_year, {measure} AS v, row_number() OVER (PARTITION BY {by}, snap_year ORDER BY {measure}) AS k, count(*) OVER (PARTITION BY {by}, snap_year) AS n FROM {source} WHERE {measure} IS NOT NULL
) r JOIN (VALUES {shares}) s(p) ON k = greatest(1, CAST(ceil(p * n - 1e-9) AS BIGINT))"""


def _step(step: float) -> str:
    return f"round(v / {step}::DOUBLE) * {step}::DOUBLE"


_BASE = "ln(1 + 2 * 0.001::DOUBLE / (1 - 0.001::DOUBLE))"
_LOG = f"CASE WHEN abs(v) < 1e-9 THEN 0.0 ELSE sign(v) * exp((ceil(ln(greatest(abs(v), 1e-9) / 1e-9) / {_BASE})) * {_BASE}) * 1e-9 * (1 - 0.001::DOUBLE) END"

ORACLES = {
    "p2_percentiles": f"WITH {DOF_SQL}, {UNITS_SQL} " + " UNION ALL ".join(_rank_sql(m, by, src, v) for m, src, v in (("hdi_ix_sav", "bu", _step(HDI_STEP)), ("dof_all", "dl", _step(DOF_STEP)), ("dis_av_cms", "dl", _LOG)) for by in ("hybas_id", "continent")),
    "p2_merged_days": f"WITH {DOF_SQL} SELECT group_id AS continent, p, value, n FROM (" + _rank_sql("dof_all", "continent", "(SELECT continent, 0 AS snap_year, dof_all FROM dl)", _step(DOF_STEP)) + ")",
}
