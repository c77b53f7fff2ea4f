"""Token ids in files: canonical length-limited Huffman codes, decoded by table in blocks.

Writing: texts are encoded once and their ids kept in a table; the global counts of ids (at
most one number per vocabulary entry) give code lengths by package-merge, limited to LIMIT
bits, and canonical codes follow from the lengths alone. The documents are then dealt in
ranges of doc_id and sorted, and each range is written as segments: whole documents, their
ids as one bit stream with the bit offset of every BLOCK-th id as a checkpoint. A segment
with the code lengths is all that a reader needs.

Reading: the checkpoints make blocks independent, so all blocks of a segment are decoded in
step, one table look-up each per id.

File format, in a Parquet table ``segments`` (part, seq, ids, blob) beside ``lengths`` (blob:
one byte per id, its code length, 0 for none). Blob, little-endian: magic ``TSIF``, u32
version, u64 documents, u64 ids, u64 blocks, u64 payload words; then per document i64 doc_id,
u8 is-null and u64 ids; per block u64 bit offset; then the payload as big-endian u32 words.

Defined cases: a null text counts as empty and is stored as its end id; a null doc_id comes
first; rows that repeat a doc_id stand by number of ids, then by their checksum; a very long
text is one document, whole in its segment; an empty table gives an empty result; further columns are dropped.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnsift.llm.common import drop, shared_dir, slices, small_batches, stage
from tarnsift.llm.tokens import coder

END = 1
LIMIT = 18
BLOCK = 512
#: A segment is closed once it has so many ids.
SEGMENT = 1 << 19
#: Segments whose starts are broadcast at most; a longer list is joined.
LISTED = 500_000
MAGIC, VERSION = b"TSIF", 1
_HEAD = struct.Struct("<4sIQQQQ")


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 where counts is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    limit = max(limit, int(np.ceil(np.log2(n))))
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    level, packages = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([leaf, packages])
        at = np.argsort(both, kind="stable")
        level.append(at < n)
        both = both[at]
        packages = both[0 : len(both) // 2 * 2 : 2] + both[1::2]
    lengths, take = np.zeros(n, np.uint8), 2 * n - 2
    for is_leaf in reversed(level):
        leaves = int(is_leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


class Codes:
    """Canonical codes of code lengths: ids in order of (length, id) get ascending codes."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        ids = np.flatnonzero(lengths)
        order = ids[np.argsort(self.lengths[ids], kind="stable")]
        size = self.lengths[order]
        self.bits = int(size.max()) if len(size) else 1
        span = np.int64(1) << (self.bits - size)
        first = np.cumsum(span) - span
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (first >> (self.bits - size)).astype(np.uint64)
        fill = (1 << self.bits) - int(span.sum())
        self.symbol = np.concatenate([np.repeat(order, span), np.zeros(fill, np.int64)]).astype(np.uint32)
        self.step = np.concatenate([np.repeat(size, span), np.ones(fill, np.int64)]).astype(np.int64)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The payload as u32 words, first bit highest, and the bit offset of each block."""
        size = self.lengths[ids]
        end = np.cumsum(size)
        at = end - size
        words = int(end[-1] + 31) // 32 if len(ids) else 0
        value = self.codes[ids] << (64 - (at & 31) - size).astype(np.uint64)
        # Codes share no bit, so adding is or-ing, and sums below 2**32 are exact in doubles.
        w = at >> 5
        out = np.bincount(w, (value >> np.uint64(32)).astype(np.float64), words + 1)
        out += np.bincount(w + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), words + 1)
        return out[:words].astype(np.uint32), at[::BLOCK].astype(np.uint64)

    def decode(self, words: np.ndarray, blocks: np.ndarray, n: int) -> np.ndarray:
        """``n`` ids; all blocks advance together."""
        if not n:
            return np.zeros(0, np.uint32)
        spare = BLOCK * self.bits // 32 + 2
        w = np.concatenate([words.astype(np.uint64), np.zeros(spare, np.uint64)])
        pair = (w[:-1] << np.uint64(32)) | w[1:]
        at = blocks.astype(np.int64)
        out = np.empty((min(BLOCK, n), len(at)), np.uint32)
        mask, top = np.uint64((1 << self.bits) - 1), 64 - self.bits
        for k in range(len(out)):
            i = (pair[at >> 5] >> (top - (at & 31)).astype(np.uint64)) & mask
            i = i.astype(np.int64)
            out[k] = self.symbol[i]
            at = at + self.step[i]
        return out.T.ravel()[:n] if len(at) > 1 else out[:n, 0]


def segment(codes: Codes, doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    words, blocks = codes.encode(np.concatenate(ids))
    n = [len(x) for x in ids]
    head = _HEAD.pack(MAGIC, VERSION, len(ids), sum(n), len(blocks), len(words))
    return b"".join([
        head,
        np.array([0 if i is None else i for i in doc_ids], "<i8").tobytes(),
        np.array([i is None for i in doc_ids], "u1").tobytes(),
        np.array(n, "<u8").tobytes(),
        blocks.astype("<u8").tobytes(),
        words.astype(">u4").tobytes(),
    ])


def parse(codes: Codes, blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ids per document, and all ids of a segment."""
    magic, version, docs, n, blocks, words = _HEAD.unpack_from(blob)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a segment of this format")
    at = _HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(blob, kind, count, at)
        at += x.nbytes
        return x

    doc_ids, null, lens = take("<i8", docs), take("u1", docs), take("<u8", docs)
    marks, payload = take("<u8", blocks), take(">u4", words)
    return (
        [None if z else int(i) for i, z in zip(doc_ids, null, strict=True)],
        lens.astype(np.int64),
        codes.decode(payload.astype(np.uint32), marks, n),
    )


def _encoded(docs: DataFrame, path: str, end: int) -> DataFrame:
    """doc_id, n, crc and ids (u16 or u32, whichever holds the vocabulary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        last = np.array([end], "<u4").tobytes()
        small = c.tokenizer.get_vocab_size() <= 1 << 16
        for batch in slices(batches):
            n, crc, kept = [], [], []
            for ids in c.encode(batch.column("text").to_pylist()):
                ids += last
                n.append(len(ids) // 4)
                crc.append(crc32(ids))
                kept.append(np.frombuffer(ids, "<u4").astype("<u2").tobytes() if small else ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "n", "crc", "ids"],
            )

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n long, crc long, ids binary")


def _kind(n: int, ids: bytes) -> str:
    return "<u2" if len(ids) == 2 * n else "<u4"


def _counts(encoded: DataFrame) -> DataFrame:
    """id, n over all documents; each task sends at most one row per vocabulary entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in slices(batches):
            n, ids = sum(batch.column("n").to_pylist()), b"".join(batch.column("ids").to_pylist())
            c = np.bincount(np.frombuffer(ids, _kind(n, ids)))
            if len(c) > len(total):
                total = np.concatenate([total, np.zeros(len(c) - len(total), np.int64)])
            total[: len(c)] += c
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    return encoded.select("n", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, out: str, end: int = END) -> None:
    """Write the ids of ``docs`` under the folder ``out``, in ascending doc_id order."""
    spark = docs.sparkSession
    encoded = stage(_encoded(docs, path, end), f"{out}/encoded")
    found = _counts(encoded).collect()  # no more rows than the vocabulary has entries
    counts = np.zeros(max([r.id for r in found], default=0) + 1, np.int64)
    counts[[r.id for r in found]] = [r.n for r in found]
    lengths = code_lengths(counts).tobytes()
    spark.createDataFrame([(bytearray(lengths),)], "blob binary").coalesce(1).write.parquet(f"{out}/lengths")
    held = spark.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(np.frombuffer(held.value, np.uint8))
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([size], pa.int64()), pa.array([segment(codes, doc_ids, ids)], pa.binary())],
                names=["part", "seq", "ids", "blob"],
            )

        for batch in slices(batches):
            for i, n, x in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids")), strict=True):
                doc_ids.append(i)
                ids.append(np.frombuffer(x, _kind(n, x)))
                size += n
                if size >= SEGMENT:
                    yield close()
                    doc_ids, ids, size, seq = [], [], 0, seq + 1
        if ids:
            yield close()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("doc_id", "n", "crc")
    dealt = encoded.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The blobs are coded already.
    dealt.select("doc_id", "n", "ids").mapInArrow(run, "part int, seq int, ids long, blob binary").write.option(
        "compression", "none"
    ).parquet(f"{out}/segments")
    drop(spark, f"{out}/encoded")


def read(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (u32 binary)."""
    return _read(spark, out, with_ids=True)


def _read(spark: SparkSession, out: str, with_ids: bool) -> DataFrame:
    blob = bytes(spark.read.schema("blob binary").parquet(f"{out}/lengths").first().blob)
    segs = spark.read.schema("part int, seq int, ids long, blob binary").parquet(f"{out}/segments")
    # Ids before a segment: those of the parts before, of which there are no more than shuffle
    # partitions, and those before it in its part.
    sizes = segs.select("part", "seq", "ids")
    before = lambda w, n: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    parts = sizes.groupBy("part").agg(F.sum("ids").alias("n")).withColumn("base", before(Window.orderBy("part"), "n"))
    starts = sizes.withColumn("own", before(Window.partitionBy("part").orderBy("seq"), "ids")).join(parts, "part")
    starts = starts.select("part", "seq", (F.col("base") + F.col("own")).alias("first"))
    few = sizes.limit(LISTED + 1).count() <= LISTED
    segs = segs.select("part", "seq", "blob").join(F.broadcast(starts) if few else starts, ["part", "seq"])
    held = spark.sparkContext.broadcast(blob)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(np.frombuffer(held.value, np.uint8))
        for batch in batches:
            for first, b in zip(batch.column("first").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                doc_ids, n, ids = parse(codes, b)
                at = np.cumsum(n) - n
                raw = memoryview(ids.astype("<u4").tobytes())
                cut = [raw[4 * a : 4 * (a + k)] for a, k in zip(at.tolist(), n.tolist(), strict=True)]
                last = pa.array([bytes(x) for x in cut], pa.binary()) if with_ids else pa.array([crc32(x) for x in cut], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(at + first), pa.array(n), last],
                    names=["doc_id", "start", "n_tokens", "ids" if with_ids else "ids_crc32"],
                )

    last = "ids binary" if with_ids else "ids_crc32 long"
    return segs.select("first", "blob").mapInArrow(run, f"doc_id long, start long, n_tokens long, {last}")


def op7(docs: DataFrame, path: str) -> DataFrame:
    out = shared_dir(docs.sparkSession)
    write(docs, path, out)
    return _read(docs.sparkSession, out, with_ids=False)
