"""Incremental counterparts of batch scans."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riverspark.plans.base import Catalog, table
from riverspark.session import shared_folder
from riverspark.streaming.ingest import daily_counts, ingest

C = Catalog()


@C.add("SELECT first_year, count(*) AS n, count(DISTINCT dam_id) AS dams FROM dams GROUP BY 1")
def str1_incremental_ingest(spark, d):
    """Dams taken in as a stream; a second call finds nothing new."""
    folder = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    schema = table(spark, d, "dams").schema
    for _ in range(2):
        ingest(spark, f"{d}/dams.parquet" if _is_folder(spark, f"{d}/dams.parquet") else d, schema, f"{folder}/store", f"{folder}/progress", "first_year", None if _is_folder(spark, f"{d}/dams.parquet") else "dams.parquet")
    return spark.read.schema(schema).parquet(f"{folder}/store").groupBy("first_year").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dam_id").alias("dams"))


@C.add("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def str2_daily_counts(spark, d):
    """Daily counts of the event stream, gathered by a memory sink: all days, as the stream ends."""
    path = f"{d}/events.parquet"
    reader = spark.readStream.schema(table(spark, d, "events").schema)
    stream = reader.parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", "events.parquet").parquet(d)
    name = f"daily_{uuid.uuid4().hex}"
    q = daily_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{shared_folder(spark)}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.to_date("w.start").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


def _is_folder(spark, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
