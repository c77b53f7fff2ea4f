"""What the training-data operators share: folders, tables between stages, label folds."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsift.sources.shared import drop, shared_dir, stage

# Words are runs of anything but space and the ASCII control blanks \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
#: Rows of an Arrow batch between Spark and a Python worker.
BATCH = 1000


def slices(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches in parts of few rows, so that few texts are Python objects at a time. At the end
    the worker, which may idle for long, gives freed memory back."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    trim()


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, its session sending Arrow batches of BATCH rows unless it was told another number
    than Spark's default: texts are long, and ten thousand of them are tens of MB on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key) == "10000":
        df.sparkSession.conf.set(key, str(BATCH))
    return df


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the quarter of the documents whose labels no model may learn from."""
    return F.coalesce(
        F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False)
    )


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and y of the labels that a model may learn from: one row per document."""
    return (
        labels.where(F.col(label).isNotNull() & ~held_out() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )


def sample_texts(
    docs: DataFrame, ids: DataFrame, most: dict[int, int], max_chars: int
) -> list[tuple[str, int]]:
    """Whole texts of a bounded sample of ``ids`` (doc_id, y), lowest hash of doc_id first, in
    one pass over the texts.

    At most ``most[y]`` rows of class ``y``, and of each class only as many as stay within its
    share of ``max_chars`` characters. Both bounds are parameters and count rows, not doc_ids, so
    what reaches the driver doesn't grow with the corpus or with a popular doc_id; rows of one
    doc_id and text count once.
    """
    spark, base = docs.sparkSession, shared_dir(docs.sparkSession)
    picked = None
    for y, n in most.items():
        part = ids.where(F.col("y") == y).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(n)
        picked = part if picked is None else picked.unionByName(part)
    text = F.coalesce("text", F.lit(""))
    # ``picked`` has sum(most) rows of three numbers at most.
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(picked), "doc_id")
    rows = stage(rows.select("doc_id", "y", "h", "text", F.xxhash64("text").alias("t"), F.length("text").alias("n")), f"{base}/sample")
    keep: list[tuple[int, int]] = []
    for y, n in most.items():
        left = max_chars // len(most)
        keys = rows.where(F.col("y") == y).select("h", "doc_id", "t", "n").distinct()
        for r in keys.orderBy("h", "doc_id", "t").limit(n).collect():
            if r.n <= left:
                left -= r.n
                keep.append((r.doc_id, r.t))
    got = []
    if keep:
        wanted = spark.createDataFrame(sorted(set(keep)), "doc_id long, t long")
        one = rows.join(F.broadcast(wanted), ["doc_id", "t"], "left_semi").groupBy("doc_id", "t", "y").agg(F.first("text").alias("text"))
        got = [(r.text, r.y) for r in sorted(one.collect(), key=lambda r: (r.doc_id, r.text))]
    drop(spark, base)
    return got
