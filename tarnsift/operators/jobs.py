"""Job tracking: an append-only log of events and the state that it implies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the message of jobs that a restart found unfinished.
RESTARTED = "Server restarted while job was in progress"


def latest(events: DataFrame) -> DataFrame:
    """Per job its last status, and the last of each other field that isn't null; progress of a
    completed job is 100."""
    at = F.struct("ts", "event_id")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at))
    state = events.groupBy("job_id").agg(
        F.max_by("status", at).alias("status"), last("error_message").alias("error_message"),
        last("progress_pct").alias("progress_pct"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"),
    )
    return state.withColumn("progress_pct", F.when(F.col("status") == "completed", 100.0).otherwise(F.col("progress_pct")))


def fail_in_flight(state: DataFrame, message: str = RESTARTED) -> DataFrame:
    """After a restart: queued and processing jobs are failed, with ``message`` if they have none."""
    open_ = F.col("status").isin("queued", "processing")
    error = F.when(open_, F.coalesce("error_message", F.lit(message))).otherwise(F.col("error_message"))
    return state.withColumn("error_message", error).withColumn("status", F.when(open_, "failed").otherwise(F.col("status")))


def listed(state: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    if not 1 <= limit <= 500:
        raise ValueError("limit must be 1 to 500")
    rows = state if status is None else state.where(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), "job_id").limit(limit)
