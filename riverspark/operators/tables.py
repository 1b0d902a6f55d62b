"""Joins and checks on whole tables by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed_replace(df: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """df with columns taken from source (unique by keys) where it has the key, null included; other rows keep theirs."""
    if missing := [c for c in [*keys, *columns] if c not in source.columns or c not in df.columns]:
        raise ValueError(f"lacking column(s) {', '.join(missing)}")
    s = source.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_found"))
    j = df.join(s, keys, "left")
    return j.select(*[F.when(F.col("_found"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, with side a or b; repeated rows count each time."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def copy_by_key(df: DataFrame, source: DataFrame, key: str, value: str, over: float = 0.0) -> DataFrame:
    """df with value copied from source (unique by key); rows without a partner, or with null there, get `over`."""
    s = source.select(key, F.col(value).alias("_new"))
    return df.drop(value).join(s, key, "left").withColumn(value, F.coalesce("_new", F.lit(over))).drop("_new")
