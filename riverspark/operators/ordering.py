"""Global order without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverspark.session import cut


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """df range-sorted by order, with the number of the range in _part; written down, so a task that runs again finds the same ranges."""
    return cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")


def running_sum(df: DataFrame, groups: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df with name: the sum of value over the rows before, in the order within the group; 0 for the first.

    Ranges of the whole order have their own running sums, and a group's offset in a range comes from the ranges before
    (a row per group and range), so a group of any size is spread. Null groups are one group; nulls count as 0.
    """
    keys = [F.col(c).asc_nulls_last() for c in (*groups, *order)]
    ranged = _ranged(df, keys)
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_part", *groups).agg(F.sum(value).alias("_n"))
    offsets = sizes.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)], F.coalesce(F.sum("_n").over(before(*groups).orderBy("_part")), F.lit(0)).alias("_off"))
    own = ranged.withColumn("_r", F.coalesce(F.sum(value).over(before("_part", *groups).orderBy(*keys[len(groups) :])), F.lit(0)))
    same = F.col("_part") == F.col("_p")
    for k, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_g{k}"))
    return own.join(offsets, same).withColumn(name, F.col("_r") + F.col("_off")).select(*df.columns, name)


def next_match(df: DataFrame, groups: list[str], order: str, match: Column, name: str) -> DataFrame:
    """df with name: the order value of the next row of the group that matches, null without one. order is unique within a group; groups are not null."""
    ranged = _ranged(df.withColumn("_at", F.when(match, F.col(order))), [F.col(c).asc_nulls_last() for c in (*groups, order)])
    # from the far end on, so that the frame only grows
    after = lambda by, at: Window.partitionBy(*by).orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, -1)
    firsts = ranged.groupBy("_part", *groups).agg(F.min("_at").alias("_first"))
    later = firsts.select("_part", *groups, F.min("_first").over(after(groups, "_part")).alias("_later"))
    own = ranged.withColumn("_own", F.min("_at").over(after(["_part", *groups], order)))
    return own.join(later, ["_part", *groups]).withColumn(name, F.coalesce("_own", "_later")).select(*df.columns, name)


def ranks(df: DataFrame, order: Column, name: str) -> DataFrame:
    """df with name: 1 plus the number of rows before it; rows that tie share a rank."""
    placed = positions(df.withColumn("_key", order), ["_key"])
    first = placed.groupBy(F.col("_key").alias("_k")).agg(F.min("pos").alias(name))
    return placed.join(first, F.col("_key").eqNullSafe(F.col("_k"))).select(*df.columns, name)


def quantiles(df: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(groups, a column per name of shares): exact quantiles with linear interpolation, as F.percentile gives them.

    Values are range-sorted by group and counted off, so no group, and no aggregation buffer, holds all values of one.
    Null and NaN values don't count; null groups are one group.
    """
    held = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*groups, F.col(value).cast("double").alias("_v"))
    p = positions(held, [*groups, "_v"])
    sizes = p.groupBy(*groups).agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    named = sizes.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)], "_first", "_n")
    same = F.lit(True)
    for k, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_g{k}"))
    j = p.join(named if groups else F.broadcast(named), same).withColumn("_r", F.col("pos") - F.col("_first"))
    parts = []
    for n, share in shares.items():
        at = F.lit(float(share)) * (F.col("_n") - 1)
        weight = F.when(F.col("_r") == F.floor(at), 1 - (at - F.floor(at))).when(F.col("_r") == F.floor(at) + 1, at - F.floor(at))
        parts.append(F.sum(weight * F.col("_v")).alias(n))
    return j.groupBy(*groups).agg(*parts)


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """df with pos, 1, 2, … in the order of some columns (nulls last); rows that tie fall in any order.

    Rows are range-sorted; each range numbers its own, and the ranges' sizes, a row each, give the offsets. The ranges
    are written down first, so a task that runs again numbers the same rows.
    """
    keys = [F.col(c).asc_nulls_last() for c in order]
    ranged = _ranged(df, keys)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    own = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)))
    return own.join(F.broadcast(offsets), "_part").withColumn("pos", F.col("_r") + F.col("_off")).drop("_part", "_r", "_off")
