"""Streaming forms: chunks of documents as they arrive, and windowed counts of events.

A file stream sees a new file once and no changes or deletions, so the snapshot comparison stays the way to synchronise;
this is for append-only feeds. Each micro-batch's rows are written under its number, so one that is run again replaces its
own rows and nothing is doubled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvine.operators import chunking


def append_chunks(documents: DataFrame, target: str, checkpoint: str, key: str = "doc_id", text: str = "text", parser: str = "markdown") -> StreamingQuery:
    """Chunk a stream of documents into ``target``, exactly once per micro-batch; ends when what is there is read."""

    def write(batch: DataFrame, number: int) -> None:
        pieces = chunking.chunked(batch, text, [key], parser)
        pieces.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", value: str = "value", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per window and kind; rows later than ``late`` behind the newest are left out, in batch form none."""
    stamped = events.withColumn("_at", F.col(time).cast("timestamp"))
    counted = stamped.withWatermark("_at", late).groupBy(F.window("_at", window).alias("w"), kind).agg(F.count("*").alias("events"), F.sum(value).alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), kind, "events", "total")
