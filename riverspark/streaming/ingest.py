"""Incremental ingest: new files of a folder are read as a stream, and each micro-batch is merged into a store once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def ingest(spark: SparkSession, source: str, schema: StructType, store: str, progress: str, part: str, glob: str | None = None) -> None:
    """Takes in what the folder `source` has beyond the last call, into the store by `part`, then ends.

    A batch writes its own folder (batch=n) and replaces it if it runs again, so a lost driver or a retried batch
    leaves no row twice. `progress` keeps what is done. An empty folder, or one without new files, changes nothing.
    """
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").partitionBy(part).parquet(f"{store}/batch={n}")

    query = reader.parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()


def daily_counts(events: DataFrame, time: str, by: str, late: str = "1 day") -> DataFrame:
    """Rows per day and group of a stream, with the sum of `value`; rows later than `late` are dropped by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
