"""Percentiles by cumulative frequencies, with a stated error and mergeable parts.

A value v is replaced by the middle of its cell; cells are `step` wide (absolute error at most step/2) or grow with |v|
(relative error at most `relative`). Cells are in order, so the p-th value of the cells is the cell of the p-th value: the
error bound holds for every percentile. What a partition, snapshot or day leaves behind is its (group, cell, count)
table, stored by write_part; tables are combined by adding counts, and nothing is lost by that.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riverspark.session import cut

TINY = 1e-9


def cell_of(value: Column, step: float | None = None, relative: float | None = None) -> Column:
    """The cell's number, which grows with the value; null for null and NaN. Infinities get the outermost cells, with step beyond 9e17 steps, with relative beyond 1e298."""
    if (step is None) == (relative is None):
        raise ValueError("give either step or relative")
    v = F.when(~F.isnan(value), value.cast("double"))
    if step is not None:
        return F.when(F.abs(v) < 9e17 * step, F.round(v / F.lit(step)).cast("long")).when(v > 0, F.lit(2**62)).otherwise(F.when(v.isNotNull(), F.lit(-(2**62))))
    base = math.log1p(2 * relative / (1 - relative))
    size = F.least(F.abs(v), F.lit(1e298))
    k = F.ceil(F.ln(F.greatest(size, F.lit(TINY)) / F.lit(TINY)) / F.lit(base)).cast("long") + 1
    return F.when(v.isNull(), F.lit(None).cast("long")).when(F.abs(v) < TINY, F.lit(0).cast("long")).when(v > 0, k).otherwise(-k)


def value_of(cell: Column, step: float | None = None, relative: float | None = None) -> Column:
    """The value that stands for a cell."""
    if step is not None:
        return cell * F.lit(float(step))
    base = math.log1p(2 * relative / (1 - relative))
    top = F.exp((F.abs(cell) - 1) * F.lit(base)) * F.lit(TINY)
    return F.when(cell == 0, F.lit(0.0)).otherwise(F.signum(cell.cast("double")) * top * F.lit(1 - relative))


def value_counts(df: DataFrame, groups: list[str], value: Column, step: float | None = None, relative: float | None = None) -> DataFrame:
    """(groups, cell, n): the mergeable part. Counts are combined before the shuffle, and a hot group spreads over its cells.

    Rows without a value (null, NaN) don't count; null groups are a group. Repeated rows count each time: remove repeats
    first where they are no observations. An empty input gives an empty table.
    """
    return cell_counts(df.select(*groups, cell_of(value, step, relative).alias("cell")), groups)


def cell_counts(df: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, cell, n) of rows that have their cell already; rows without one don't count."""
    return df.where(F.col("cell").isNotNull()).groupBy(*groups, "cell").agg(F.count(F.lit(1)).alias("n"))


def merge_counts(*parts: DataFrame, groups: list[str]) -> DataFrame:
    """Parts of several days, partitions or finer groups as one part."""
    whole = parts[0].select(*groups, "cell", "n")
    for p in parts[1:]:
        whole = whole.unionByName(p.select(*groups, "cell", "n"))
    return whole.groupBy(*groups, "cell").agg(F.sum("n").alias("n"))


def write_part(counts: DataFrame, folder: str, name: str) -> None:
    """Keeps what a day or snapshot leaves behind, as a table `name` of the folder; one that is there already is replaced."""
    counts.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def read_parts(spark: SparkSession, folder: str, names: Iterable[str]) -> list[DataFrame]:
    """The tables of write_part, to be combined by merge_counts."""
    return [spark.read.parquet(f"{folder.rstrip('/')}/{n}") for n in names]


def percentiles(counts: DataFrame, groups: list[str], shares: list[float], step: float | None = None, relative: float | None = None) -> DataFrame:
    """(groups, p, value, n) from a table of value_counts.

    Counts are range-sorted by group and cell, which evens out groups of any size. Running sums are taken inside a range,
    and a group's offset in it (the sum over the ranges before, from the far smaller table of ranges' totals) is added.
    The value of p is the first cell whose cumulated count reaches max(1, ceil(p*n)). n is the number of values. counts
    has each (groups, cell) once, as value_counts and merge_counts give it; the ranges are written to the shared folder, so
    a task that runs again finds the same ones. The windows and the join share one shuffle of the counts.
    """
    found = cell_percentiles(counts, groups, shares)
    return found.select(*groups, "p", value_of(F.col("cell"), step, relative).alias("value"), "n")


def cell_percentiles(counts: DataFrame, groups: list[str], shares: list[float]) -> DataFrame:
    """(groups, p, cell, n): percentiles as cells, so that groups of differently cut values can share one pass."""
    if any(not 0 <= p <= 1 for p in shares) or not shares:
        raise ValueError("shares must lie in [0, 1]")
    # null-safe keys, as a plain value and a mark where nulls can occur, so that sums, windows and the join share one partitioning
    plain, marks = {}, {}
    for i, g in enumerate(groups):
        kind = counts.schema[g]
        plain[f"_g{i}"] = F.coalesce(F.col(g), F.lit("" if kind.dataType.simpleString() == "string" else 0).cast(kind.dataType)) if kind.nullable else F.col(g)
        if kind.nullable:
            marks[f"_null{i}"] = F.col(g).isNull()
    names = [*plain, *marks]
    slim = counts.select(*[x.alias(n) for n, x in (plain | marks).items()], "cell", "n")
    c = cut(slim.repartitionByRange(*names, "cell").withColumn("_block", F.spark_partition_id()), "counts")
    totals = c.groupBy(*names, "_block").agg(F.sum("n").alias("_t"))
    ordered = Window.partitionBy(*names).orderBy("_block")
    offsets = totals.select(
        *names, "_block",
        F.coalesce(F.sum("_t").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.sum("_t").over(Window.partitionBy(*names)).alias("_all"),
    )
    inner = Window.partitionBy(*names, "_block").orderBy("cell")
    running = c.withColumn("_run", F.sum("n").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    cum = running.join(offsets, [*names, "_block"]).withColumn("_to", F.col("_run") + F.col("_offset")).withColumn("_from", F.col("_to") - F.col("n"))
    rank = lambda p: F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * F.col("_all") - F.lit(1e-9)))
    hits = F.filter(F.array(*[F.struct(F.lit(float(p)).alias("p"), rank(p).alias("r")) for p in shares]), lambda x: (x["r"] > F.col("_from")) & (x["r"] <= F.col("_to")))
    picked = cum.withColumn("_hit", F.explode(hits))
    back = [(F.when(~F.col(f"_null{i}"), F.col(f"_g{i}")) if f"_null{i}" in marks else F.col(f"_g{i}")).alias(g) for i, g in enumerate(groups)]
    return picked.select(*back, F.col("_hit.p").alias("p"), "cell", F.col("_all").alias("n"))
