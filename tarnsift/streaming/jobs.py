"""Job states kept on a stream of events, with a timer that fails jobs left open.

The state of a job is what ``operators.jobs.latest`` makes of its events so far, whatever order
they come in: each field goes with the time and number of the event that set it. A queued or
processing job for which no event came within ``timeout`` is failed once the watermark has passed
that time, as ``fail_in_flight`` fails those that a restart found open; a later event counts on.
The stream's state store must be one with timers (RocksDB).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

from tarnsift.operators.jobs import RESTARTED

OPEN = ("queued", "processing")
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Each field beside when it was set: microseconds and event number.
_STATE = (
    "status string, status_us long, status_no long, error_message string, error_us long, error_no long, "
    "progress_pct double, progress_us long, progress_no long, created_us long, updated_us long, timer_ms long"
)
ROW = "job_id {0}, status string, error_message string, progress_pct double, created_at timestamp, updated_at timestamp"
_FIELDS = ("status", "error_message", "progress_pct")


class Job:
    """The state of one job."""

    def __init__(self, state: tuple | None):
        s = state or (None, None, None) * 3 + (None, None, None)
        self.at = {f: s[3 * k : 3 * k + 3] for k, f in enumerate(_FIELDS)}
        self.created, self.updated, self.timer = s[9:12]

    def add(self, us: int, no: int, values: dict) -> None:
        for f, v in values.items():
            old, t, n = self.at[f]
            if v is not None and (t is None or (us, no) >= (t, n)):
                self.at[f] = (v, us, no)
        self.created = us if self.created is None else min(self.created, us)
        self.updated = us if self.updated is None else max(self.updated, us)

    @property
    def open(self) -> bool:
        return self.at["status"][0] in OPEN

    def state(self) -> tuple:
        return (*(x for f in _FIELDS for x in self.at[f]), self.created, self.updated, self.timer)

    def row(self, key) -> pd.DataFrame:
        status, error, progress = (self.at[f][0] for f in _FIELDS)
        times = [pd.Timestamp(us, unit="us") for us in (self.created, self.updated)]
        return pd.DataFrame({
            "job_id": [key], "status": [status], "error_message": [error],
            "progress_pct": [100.0 if status == "completed" else progress], "created_at": times[:1], "updated_at": times[1:],
        })


class Tracker(StatefulProcessor):
    def __init__(self, timeout_ms: int, message: str):
        self.timeout_ms, self.message = timeout_ms, message

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", _STATE)

    def _save(self, job: Job) -> None:
        due = -(-job.updated // 1000) + self.timeout_ms if job.open else None
        if due != job.timer:
            if job.timer is not None:
                self.handle.deleteTimer(job.timer)
            if due is not None:
                self.handle.registerTimer(due)
            job.timer = due
        self.job.update(job.state())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        job = Job(self.job.get() if self.job.exists() else None)
        for df in rows:
            times = (df["ts"].astype("datetime64[us]").astype("int64")).tolist()
            values = df[list(_FIELDS)].astype(object).where(df[list(_FIELDS)].notna(), None).to_dict("records")
            for us, no, v in zip(times, df["event_id"].tolist(), values, strict=True):
                job.add(us, no, v)
        self._save(job)
        yield job.row(key[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job = Job(self.job.get())
        job.timer = None
        if not job.open:
            self._save(job)
            return
        # As of the last event: any later one counts more.
        _, us, no = job.at["status"]
        job.at["status"] = ("failed", us, no)
        if job.at["error_message"][0] is None:
            job.at["error_message"] = (self.message, us, no)
        self._save(job)
        yield job.row(key[0])

    def close(self) -> None:
        pass


def tracked(events: DataFrame, timeout: timedelta = timedelta(hours=6), late: str = "1 hour", message: str = RESTARTED) -> DataFrame:
    """A stream of job states (update mode) from a stream of ``events``: job_id, event_id, ts, status,
    error_message, progress_pct."""
    kind = events.schema["job_id"].dataType.simpleString()
    rows = events.select("job_id", "event_id", events["ts"].cast("timestamp").alias("ts"), *_FIELDS).withWatermark("ts", late)
    tracker = Tracker(int(timeout.total_seconds() * 1000), message)
    return rows.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=tracker, outputStructType=ROW.format(kind), outputMode="Update", timeMode="EventTime"
    )


def with_timers(spark: SparkSession) -> SparkSession:
    """``spark``, its streams' state in a store that has timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark
