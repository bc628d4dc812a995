"""Event-time windows over streams: a watermark bounds the state, and says what is late.

The watermark is the greatest time of the micro-batches so far less `delay`. A window's row is written once, by the first micro-batch
after the watermark has passed its end; windows that are open at the end of a run stay in the state, and the next run goes on with them.
Late-data rule: a row is dropped if its window ended by the watermark that the micro-batch before its own had; up to then it counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, the oldest first; all that are there in one micro-batch unless bounded."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def tumbling(events: DataFrame, time: str, keys: list[str], width: str, delay: str, aggregates: dict[str, Column]) -> DataFrame:
    """One row for every key and window of `width`: keys, starts, ends, aggregates. Rows without a time are in no window."""
    cut = events.withWatermark(time, delay).groupBy(F.window(time, width).alias("_w"), *keys)
    return cut.agg(*[e.alias(n) for n, e in aggregates.items()]).select(*keys, F.col("_w.start").alias("starts"), F.col("_w.end").alias("ends"), *aggregates)


def sessions(events: DataFrame, time: str, keys: list[str], gap: str, delay: str, aggregates: dict[str, Column]) -> DataFrame:
    """One row for every session of a key: rows that follow one another within less than `gap`. It ends a gap after its last row."""
    cut = events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("_w"), *keys)
    return cut.agg(*[e.alias(n) for n, e in aggregates.items()]).select(*keys, F.col("_w.start").alias("starts"), F.col("_w.end").alias("ends"), *aggregates)


def run(result: DataFrame, path: str, checkpoint: str) -> int:
    """Takes what the source has now into the table at path, and returns the number of micro-batches.

    A restart goes on where the checkpoint ends: what was taken is not taken again, and a batch that was cut off is repeated as a
    whole, whose files count only once, for the sink keeps a log of them.
    """
    q = result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return len(q.recentProgress)
