"""Streams: files that arrive are turned into index rows batch by batch; and event-time windows with late data.

The second is an extension: it shows the corpus's events table as a stream with a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleanery.functions import text as T
from gleanery.functions import units


def ingest(spark: SparkSession, folder: str, schema: StructType, target: str, checkpoint: str, per_batch: int = 100, key: str = "path", text: str = "text"):
    """Index what has arrived in a folder of parquet files since the last call, in batches of files, each written once.

    A batch goes to a folder of its number, so a batch that is run again after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        units.terms(batch, [key], T.index_tokens(text)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def windowed_events(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window start, event_type, n, total of a stream or table of events; rows later than the watermark are dropped by a stream."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_once(frame: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    query = frame.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
