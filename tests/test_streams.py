"""Streams against batches: job states with timers, restarts, and upserts by micro-batch."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnsift.operators import jobs as J
from tarnsift.operators import upsert as U
from tarnsift.sources import fixtures as S
from tarnsift.streaming import jobs as T
from tarnsift.streaming import sink

STATE = ["job_id", "status", "error_message", "progress_pct", "created_at", "updated_at"]


def plain(rows):
    return sorted(tuple(None if pd.isna(x) else x for x in r) for r in rows)


@pytest.fixture
def timers(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield T.with_timers(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def run(spark, folder, schema, kept, checkpoint, **more):
    """What is new in ``folder`` goes through the stream; the last state of each job stays in ``kept``."""

    def each(batch, _):
        for r in batch.collect():
            kept[r.job_id] = tuple(r[c] for c in STATE)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = T.tracked(stream, **more).writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint)
    q.trigger(availableNow=True).start().awaitTermination(300)


def test_jobs_on_a_stream_are_those_of_the_batch(timers, sf, tmp_path):
    spark = timers
    events = S.jobs(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).cache()
    cuts = events.approxQuantile("event_id", [0.3, 0.6], 0.0)
    parts = [events.where(F.col("event_id") <= cuts[0]), events.where(f"event_id > {cuts[0]} AND event_id <= {cuts[1]}"), events.where(F.col("event_id") > cuts[1])]
    kept, folder = {}, f"{tmp_path}/in"
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(folder)
        # Each time a new query from the checkpoint of the last.
        run(spark, folder, events.schema, kept, f"{tmp_path}/state", timeout=timedelta(days=400))
        so_far = events if k == 2 else events.where(F.col("event_id") <= cuts[k])
        assert plain(kept.values()) == plain(tuple(r) for r in J.latest(so_far).select(*STATE).collect())
    assert {r[1] for r in kept.values()} > {"failed"}


def test_timers_fail_what_is_left_open(timers, sf, tmp_path):
    spark = timers
    events = S.jobs(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    last = events.agg(F.max("ts")).first()[0]
    folder, kept = f"{tmp_path}/in", {}
    events.coalesce(1).write.parquet(folder)
    # One job of another time brings the watermark forward.
    end = [(10**9, -1, last + timedelta(days=900), "completed", None, None)]
    spark.createDataFrame(end, events.schema).coalesce(1).write.mode("append").parquet(folder)
    run(spark, folder, events.schema, kept, f"{tmp_path}/state", timeout=timedelta(days=60))
    run(spark, folder, events.schema, kept, f"{tmp_path}/state", timeout=timedelta(days=60))
    kept.pop(-1)
    want = J.fail_in_flight(J.latest(events)).select(*STATE)
    assert plain(kept.values()) == plain(tuple(r) for r in want.collect())
    assert J.latest(events).where(F.col("status").isin(*T.OPEN)).count() > 3


def test_a_job_goes_on_after_its_timer(timers, tmp_path):
    spark = timers
    t = datetime(2024, 1, 1)
    schema = "event_id long, job_id string, ts timestamp, status string, error_message string, progress_pct double"
    batches = [
        [(1, "a", t, "queued", None, None), (2, "a", t + timedelta(hours=1), None, None, 5.0), (3, "b", t, "completed", None, None)],
        [(4, "z", t + timedelta(days=2), "completed", None, None)],
        [(5, "z", t + timedelta(days=2), "completed", None, None)],
        [(6, "a", t + timedelta(days=2), "processing", None, 7.0)],
    ]
    folder, kept = f"{tmp_path}/in", {}
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        run(spark, folder, spark.createDataFrame([], schema).schema, kept, f"{tmp_path}/state", timeout=timedelta(hours=3), late="1 minute")
        seen.append(kept["a"][1:4])
    assert seen[0] == ("queued", None, 5.0) and seen[2] == ("failed", J.RESTARTED, 5.0)
    assert seen[3] == ("processing", J.RESTARTED, 7.0) and kept["b"][1:4] == ("completed", None, 100.0)


def edges(seed, n=60):
    r = random.Random(seed)
    return [(r.randrange(8), r.randrange(8), r.randrange(1, 4), r.choice(["x", "y", None])) for _ in range(n)]


SCHEMA = "src long, dst long, support_count long, context string"


def merged(spark):
    ends = spark.range(8)
    return lambda old, new: U.edges(old, new, ends.toDF("src"), ends.toDF("dst"))


def files(path):
    return {p: (p.stat().st_mtime_ns, p.stat().st_size) for p in Path(path).rglob("part-*.parquet")}


def test_batches_upsert_what_they_touch_and_no_batch_counts_twice(spark, tmp_path):
    path, merge, empty = f"{tmp_path}/edges", merged(spark), spark.createDataFrame([], SCHEMA)
    whole = empty
    for k, rows in enumerate([edges(1), edges(2), [(1, 2, 5, "z")]]):
        batch = spark.createDataFrame(rows, SCHEMA)
        before = files(path)
        n = sink.upsert_batch(batch, k, path, ["src", "dst"], merge, empty, 16)
        after = files(path)
        assert n == len({r[0] for r in batch.select(sink.bucket(["src", "dst"], 16)).collect()})
        assert k < 2 or (n == 1 and len(before.items() - after.items()) == 1)
        again = files(path)
        assert sink.upsert_batch(batch, k, path, ["src", "dst"], merge, empty, 16) == 0 and files(path) == again
        whole = merge(whole, batch)
        assert plain(sink.read(spark, path).collect()) == plain(whole.collect())


def test_a_batch_cut_off_between_folders_is_finished(spark, tmp_path):
    path, merge, empty = f"{tmp_path}/edges", merged(spark), spark.createDataFrame([], SCHEMA)
    first, second = (spark.createDataFrame(edges(k), SCHEMA) for k in (3, 4))
    sink.upsert_batch(first, 0, path, ["src", "dst"], merge, empty, 16)
    # The second batch got as far as some of its folders.
    some = second.where(sink.bucket(["src", "dst"], 16) < 8)
    sink.upsert_batch(some, 1, path, ["src", "dst"], merge, empty, 16)
    sink.upsert_batch(second, 1, path, ["src", "dst"], merge, empty, 16)
    assert plain(sink.read(spark, path).collect()) == plain(merge(merge(empty, first), second).collect())


def test_a_stream_upserts_and_goes_on(spark, tmp_path):
    path, merge, empty = f"{tmp_path}/edges", merged(spark), spark.createDataFrame([], SCHEMA)
    whole = empty
    for k in range(3):
        batch = spark.createDataFrame(edges(10 + k), SCHEMA)
        batch.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rows = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        sink.upsert_stream(rows, path, f"{tmp_path}/state", ["src", "dst"], merge, empty, 8).awaitTermination(300)
        whole = merge(whole, batch)
    assert plain(sink.read(spark, path).collect()) == plain(whole.collect())
    assert sink.read(spark, f"{tmp_path}/none", SCHEMA).count() == 0
