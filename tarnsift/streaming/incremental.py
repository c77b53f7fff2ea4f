"""Streaming extensions: idle sessions and incremental de-duplication, with batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

IDLE = "300 seconds"


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = IDLE) -> DataFrame:
    """Per key the sessions that end after ``gap`` without an event: key, start, end, n.

    Works on a batch and, after ``watermarked``, on a stream in append mode; there a session
    comes out once the watermark has passed its end.
    """
    # A cast would drop the watermark of a column that is a timestamp already.
    at = F.col(ts) if isinstance(events.schema[ts].dataType, TimestampType) else F.col(ts).cast("timestamp")
    w = F.session_window(at, gap)
    rows = events.groupBy(key, w.alias("w")).agg(F.count("*").alias("n"))
    return rows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def watermarked(events: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def first_files(files: DataFrame, key: str = "file_hash", ts: str | None = None) -> DataFrame:
    """Each file once: by watermark on a stream, by key on a batch."""
    if files.isStreaming:
        if not ts:
            raise ValueError("a stream needs its time column")
        return watermarked(files, ts).dropDuplicatesWithinWatermark([key])
    return files.dropDuplicates([key])
