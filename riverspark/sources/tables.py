"""Table access: lazy Parquet scans, column checks and the "no value" forms."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The sentinel for a missing measurement and the one for a missing river.
NO_VALUE, NO_RIVER = -999.0, -1


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def require_columns(df: DataFrame, names: Iterable[str], where: str = "input") -> DataFrame:
    """df, or ValueError that lists what it lacks."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"{where} lacks column(s) {', '.join(missing)}")
    return df


def measured(value: Column | str, sentinel: float = NO_VALUE) -> Column:
    """A double with null, NaN and the sentinel all as null."""
    c = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.when(~F.isnan(c) & (c != F.lit(sentinel)), c)


def latest(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """One row per key, from the rows with the latest order value; ties fall to the largest struct, so the result doesn't depend on row order.

    An aggregate, not a window: rows of a hot key are combined before the shuffle.
    """
    picked = F.max(F.struct(F.col(order), *[F.col(c) for c in columns])).alias("_last")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in columns])
