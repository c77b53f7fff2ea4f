"""Best-fit packing of token sequences by hierarchical residual packing.

Leaves of equal size (LEAF items dealt round robin, so no key can make one hot) are packed by
best-fit decreasing. Nearly full bins are final. Underfull bins become the items of the next
round: FAN children meet in a parent, which packs their bins by best fit again, up to one root.

What goes up is bounded without loss. Best fit leaves at most one bin of a node at most half
full, since two such would have shared a bin. So a parent sees at most FAN of them, and a bin
more than half full can only take one in. Of the bins of one fill above one half, a parent can
thus use no more than FAN; any others are final. A node sends up at most FAN * LENGTH / 2 + 1
rows, whatever its leaves held.

Where a round's bins went is followed from the root down by joins of small tables of merges.

Defined cases: a null text counts as empty and packs as its end id alone; rows that repeat, or
share a null or other doc_id, are packed each by itself; a very long text is cut into pieces in
its task; items of equal length pack in any order; an empty table gives an empty result; further
columns are dropped by ``pieces`` and pass through ``pack`` whatever their names, except that
sequence_id and offset are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnsift.llm.common import drop, shared_dir, slices, small_batches, stage, trim
from tarnsift.llm.tokens import coder, u32

LENGTH = 1024
END = 2
#: Items of a leaf; children of a parent; a bin with no more room than SLACK is full enough.
LEAF = 32_768
FAN = 8
SLACK = 4
#: Merges that are broadcast at most; a longer list is joined.
LISTED = 500_000


def best_fit(sizes: list[int], room: int) -> tuple[list[int], list[int], list[int]]:
    """Best fit in the order given: bin and offset of each size, and the bins' fills.

    Bins are kept by residual, and the residuals in use as the bits of one number, so the
    least residual that is enough is one shift and one lowest bit away.
    """
    by_room: list[list[int]] = [[] for _ in range(room + 1)]
    mask = 0
    where, offset, fill = [], [], []
    for s in sizes:
        fits = mask >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            k = by_room[r].pop()
            if not by_room[r]:
                mask &= ~(1 << r)
        else:
            r, k = room, len(fill)
            fill.append(0)
        where.append(k)
        offset.append(fill[k])
        fill[k] += s
        if left := r - s:
            by_room[left].append(k)
            mask |= 1 << left
    return where, offset, fill


def carried(fill: list[int], length: int) -> list[int]:
    """The bins that go up to the parent."""
    out, of = [], {}
    for k, f in enumerate(fill):
        if length - f <= SLACK:
            continue
        of[f] = of.get(f, 0) + 1
        if 2 * f <= length or of[f] <= FAN:
            out.append(k)
    return out


def pieces(docs: DataFrame, path: str, end: int = END, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of at most ``length`` ids.

    Only documents that are longer are cut; all their pieces but the first are full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = u32([end])
        for batch in slices(batches):
            out: list[tuple] = []
            ids_of = coder(path).encode(batch.column("text").to_pylist())
            for i, ids in zip(batch.column("doc_id").to_pylist(), ids_of, strict=True):
                ids += last
                n = len(ids) // 4
                at = 0
                for k in range(-(-n // length)):
                    size = (n % length or length) if k == 0 else length
                    out.append((i, k, at, size, crc32(memoryview(ids)[4 * at : 4 * (at + size)])))
                    at += size
            cols = zip(*out, strict=True) if out else ((),) * 5
            kinds = (batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        coder(path).forget()
        trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def _leaves(items: DataFrame, leaves: int, length: int, size_of: str) -> DataFrame:
    """``items`` with __bin, __offset and, on the first of a bin that goes up, __fill."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got)
        size = t.column(size_of).to_numpy()
        order = np.argsort(-size, kind="stable")
        where, offset, fill = best_fit(size[order].tolist(), length)
        leaf = TaskContext.get().partitionId()
        up = np.zeros(len(fill), np.int64)
        k = carried(fill, length)
        up[k] = np.array(fill, np.int64)[k]
        b, o = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        b[order], o[order] = where, offset
        t = t.append_column("__bin", pa.array(b + (leaf << 32)))
        t = t.append_column("__offset", pa.array(o))
        t = t.append_column("__fill", pa.array(np.where(o == 0, up[b], 0)))
        yield from t.to_batches(max_chunksize=10_000)

    more = [T.StructField(c, T.LongType()) for c in ("__bin", "__offset", "__fill")]
    return items.repartition(leaves).mapInArrow(run, T.StructType([*items.schema.fields, *more]))


def _round(bins: DataFrame, level: int, length: int) -> DataFrame:
    """One tree level: (bin, fill) to merges (bin, target, shift) and what goes up (target null)."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["fill", "bin"], ascending=[False, True])
        ids = df["bin"].tolist()
        where, offset, fill = best_fit(df["fill"].tolist(), length)
        first = {}
        for i, k in zip(ids, where, strict=True):
            first.setdefault(k, i)
        rows = [(i, first[k], o, 0) for i, k, o in zip(ids, where, offset, strict=True) if first[k] != i]
        rows += [(first[k], None, 0, fill[k]) for k in carried(fill, length)]
        return pd.DataFrame(rows, columns=["bin", "target", "shift", "fill"]).astype({"target": "Int64"})

    node = F.shiftright(F.shiftright("bin", 32), level * (FAN.bit_length() - 1))
    return bins.groupBy(node.alias("node")).applyInPandas(run, "bin long, target long, shift long, fill long")


def pack(items: DataFrame, length: int = LENGTH, leaf: int = LEAF) -> DataFrame:
    """``items`` (with a long column length, 1 to ``length``) with sequence_id and offset.

    Each round's result is written to the shared folder and read back.
    """
    spark = items.sparkSession
    base = shared_dir(spark)
    items = items.drop("sequence_id", "offset")
    # Columns by place, so that none clashes with the operator's own.
    names = items.columns
    kept = [f"c{k}" for k in range(len(names))]
    items = stage(items.toDF(*kept), f"{base}/items")
    leaves = max(1, -(-items.count() // leaf))
    packed = stage(_leaves(items, leaves, length, f"c{names.index('length')}"), f"{base}/leaves")
    drop(spark, f"{base}/items")
    bins = packed.where("__fill > 0").select(F.col("__bin").alias("bin"), F.col("__fill").alias("fill"))
    rounds: list[DataFrame] = []
    level, nodes = 0, leaves
    while nodes > 1:
        level, nodes = level + 1, -(-nodes // FAN)
        rounds.append(stage(_round(bins, level, length), f"{base}/round{level}"))
        bins = rounds[-1].where("target is null").select("bin", "fill")
    # From the root down: where a bin's target went in later rounds, the bin went with it.
    moved = spark.createDataFrame([], "bin long, target long, shift long")
    for level in range(len(rounds), 0, -1):
        here = rounds[level - 1].where("target is not null").select("bin", "target", "shift")
        later = moved.toDF("target", "last", "more")
        went = here.join(later, "target", "left").selectExpr("bin", "coalesce(last, target) AS target", "shift + coalesce(more, 0L) AS shift")
        moved = stage(moved.unionByName(went), f"{base}/moved{level}")
    few = moved.limit(LISTED + 1).count() <= LISTED
    moved = moved.toDF("__bin", "__target", "__shift")
    done = packed.join(F.broadcast(moved) if few else moved, "__bin", "left").selectExpr(
        *kept, "coalesce(__target, __bin) AS sequence_id", "__offset + coalesce(__shift, 0L) AS offset"
    )
    drop(spark, *[f"{base}/round{k + 1}" for k in range(len(rounds))], *[f"{base}/moved{k + 1}" for k in range(1, len(rounds))])
    return done.toDF(*names, "sequence_id", "offset")


def op6(docs: DataFrame, path: str) -> DataFrame:
    return pack(pieces(docs, path)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
