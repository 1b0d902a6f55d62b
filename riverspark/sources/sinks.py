"""Writers: safe column names, and stores that resume."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame


def safe_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with col_1, col_2, … for names that aren't ASCII, and safe -> original."""
    names, k = {}, 0
    for c in df.columns:
        if c.isascii():
            names[c] = c
        else:
            k += 1
            while f"col_{k}" in df.columns:
                k += 1
            names[f"col_{k}"] = c
    return df.toDF(*names), names


def write_missing(df: DataFrame, path: str, part: str) -> None:
    """Appends the partitions of df that the store at path lacks; finished ones are skipped."""
    try:
        done = df.sparkSession.read.parquet(path).select(part).distinct()
        df = df.join(done.withColumn(part, done[part].cast(df.schema[part].dataType)), part, "left_anti")
    except AnalysisException:
        pass
    df.repartition(part).write.mode("append").partitionBy(part).parquet(path)
