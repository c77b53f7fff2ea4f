"""Upserts by micro-batch: a batch reads and writes only the key partitions that it touches.

A table lies in folders by bucket of its key. A batch finds its buckets, merges their old rows with
its own by one of the batch upserts, and replaces these folders and no other. Every row has the
number of the batch that wrote its folder last; a folder that a batch, or a later one, has written
already is left alone when the batch comes again, so a stream that is restarted within a batch adds
nothing twice, though folders are replaced one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnsift.sources.shared import drop, hadoop, shared_dir, stage

PARTS = 64
_BUCKET, _BATCH = "kb", "kb_batch"
#: Old and new rows to those of the table.
Merge = Callable[[DataFrame, DataFrame], DataFrame]


def bucket(key: Sequence[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The table's rows; where there is none yet, no row of ``schema``."""
    fs, p = hadoop(spark, path)
    if schema and not fs.exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path).drop(_BUCKET, _BATCH)


def upsert_batch(batch: DataFrame, batch_id: int, path: str, key: Sequence[str], merge: Merge, empty: DataFrame, parts: int = PARTS) -> int:
    """Merge one batch into the table at ``path`` and tell how many folders it replaced. ``empty``
    has the table's columns and no row."""
    spark, base = batch.sparkSession, shared_dir(batch.sparkSession)
    new = stage(batch.withColumn(_BUCKET, bucket(key, parts)), f"{base}/new")
    touched = {r[0] for r in new.select(_BUCKET).distinct().collect()}  # ``parts`` at most
    fs, p = hadoop(spark, path)
    old = None
    if fs.exists(p):
        old = spark.read.schema(_schema(empty)).parquet(path).where(F.col(_BUCKET).isin(sorted(touched)))
        # A row of each folder tells the batch that wrote it.
        done = {r[0] for r in old.groupBy(_BUCKET).agg(F.max(_BATCH).alias("b")).where(F.col("b") >= batch_id).collect()}
        touched -= done
        old = old.where(F.col(_BUCKET).isin(sorted(touched)))
    if touched:
        rows = new.where(F.col(_BUCKET).isin(sorted(touched))).drop(_BUCKET)
        made = merge(old.select(*empty.columns) if old is not None else empty, rows).select(*empty.columns)
        made = made.withColumns({_BATCH: F.lit(batch_id).cast("long"), _BUCKET: bucket(key, parts)})
        # What is read is what is replaced, so the merge is written elsewhere first.
        made = stage(made, f"{base}/made").hint("rebalance", F.col(_BUCKET))
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(path)
    drop(spark, base)
    return len(touched)


def _schema(empty: DataFrame) -> str:
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in empty.schema.fields)
    return f"{cols}, {_BATCH} long, {_BUCKET} int"


def upsert_stream(rows: DataFrame, path: str, checkpoint: str, key: Sequence[str], merge: Merge, empty: DataFrame, parts: int = PARTS) -> StreamingQuery:
    """Start a stream of ``rows`` into the table at ``path``: what is there is merged and it ends."""

    def each(batch: DataFrame, batch_id: int) -> None:
        upsert_batch(batch, batch_id, path, key, merge, empty, parts)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
