"""Named layers of a folder; absent ones are tolerated."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_layers(spark: SparkSession, folder: str, names: Mapping[str, str]) -> dict[str, DataFrame | None]:
    """name -> lazy table, or None where the folder has none."""
    out: dict[str, DataFrame | None] = {}
    for name, file in names.items():
        try:
            out[name] = spark.read.parquet(f"{folder}/{file}.parquet")
        except AnalysisException:
            out[name] = None
    return out


def layer_overview(spark: SparkSession, layers: Mapping[str, DataFrame | None]) -> DataFrame:
    """(layer, present, n)."""
    whole = None
    for name, df in layers.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("layer"), F.lit(True).alias("present"), "n") if df is not None else spark.range(1).select(F.lit(name).alias("layer"), F.lit(False).alias("present"), F.lit(0).cast("long").alias("n"))
        whole = one if whole is None else whole.unionByName(one)
    return whole
