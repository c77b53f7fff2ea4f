"""The prefix trie of conversations: level-order tries by shard, upper levels merged apart.

Turns are dealt in ranges of (conv_id, turn), so a conversation however long is no task's burden;
one that goes over a range's end is carried on by a row per range. A turn is 128 bits of the
SHA-256 of role and text; a prefix is known by the XOR of its turns' bits mixed with their place, so
prefixes can be made range by range, and equal prefixes are one node once they are grouped.

Nodes with more than LIGHT turns below are the upper levels. What hangs below them is cut into
shards, one for each uppermost other node: a task takes whole shards, sets their nodes in level
order, writes the shape as a LOUDS bit vector beside arrays of labels, and goes through the levels
from the last to the first, adding each node's figures to its parent's (``np.add.at``). Upper nodes
are merged in Spark: each value is put where its first member's path passes, summed from the end
of each path, and added up by node.

Rebuilding: conversation c takes the first h turns of conversation c - c % STRIDE, h being
crc32(c) % HEADS, and its own from the h-th on.

Defined cases: a null role or text is empty; a null turn comes first, and turns of one number are in
order of role and text; repeated rows are turns of their own; rows of a null conv_id belong to no
conversation and are left out; an empty table has no node, not even a root; further columns are
dropped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnsift.llm.common import drop, shared_dir, slices, stage

STRIDE, HEADS = 100, 6
#: Turns of a range; turns below a node that isn't an upper one; nodes of a task.
ROWS, LIGHT, FOREST = 200_000, 20_000, 100_000
#: Upper nodes that are broadcast at most; a longer list is joined.
LISTED = 200_000
#: Neighbouring conv_ids hashed in one row, and levels summed in one group.
BLOCK = 4096
_KEY = ["depth", "f1", "f2"]
_ROW = "conv_id long, part int, depth long, size long, f1 long, f2 long, p1 long, p2 long, chars long"


def _mix(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows ``x`` of two uint64, each mixed with its place ``at``."""
    lane = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
    x = x + (at.astype(np.uint64)[:, None] + np.uint64(1)) * lane
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lanes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 2)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


class Louds:
    """An ordered tree as bits: for each node in level order a one for each child, then a zero.
    Nodes are numbered in that order, the root 0."""

    def __init__(self, degrees: np.ndarray):
        self.n = len(degrees)
        size = self.n + int(degrees.sum())
        bits = np.ones(size, np.uint8)
        bits[np.cumsum(degrees + 1) - 1] = 0
        self.words = np.packbits(np.pad(bits, (0, -size % 64)), bitorder="little").view("<u8").astype(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Where the ``k``-th one or zero stands, from 0."""
        at = np.arange(len(self.before), dtype=np.int64)
        before = self.before if one else 64 * at - self.before
        word = np.searchsorted(before, k, side="right") - 1
        held = self.words[word] if one else ~self.words[word]
        left = (k - before[word]).astype(np.int64)
        place = np.zeros(len(k), np.int64)
        for step in (32, 16, 8, 4, 2, 1):  # halve the word: does the lower part have enough?
            low = np.bitwise_count(held & np.uint64((1 << step) - 1)).astype(np.int64)
            up = left >= low
            left -= np.where(up, low, 0)
            place += np.where(up, step, 0)
            held = np.where(up, held >> np.uint64(step), held)
        return 64 * word + place

    def ends(self, nodes: np.ndarray) -> np.ndarray:
        """For each node the number of nodes up to its last child's, which the ones before its zero tell."""
        return self._select(nodes, False) - nodes + 1

    def degree(self, nodes: np.ndarray) -> np.ndarray:
        last = np.where(nodes > 0, self.ends(np.maximum(nodes - 1, 0)), 1)
        return self.ends(nodes) - last

    def parent(self, nodes: np.ndarray) -> np.ndarray:
        """Parents of nodes other than the root: the zeros before the node's own one."""
        return self._select(nodes - 1, True) - (nodes - 1)

    def levels(self) -> list[tuple[int, int]]:
        out, lo, hi = [], 0, 1
        while lo < hi:
            out.append((lo, hi))
            lo, hi = hi, int(self.ends(np.array([hi - 1]))[0])
        return out


def level_order(level: np.ndarray, parent: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Nodes in level order, siblings together and by label. ``parent``: -1 for the tops, which are
    of level 1."""
    order = np.empty(len(level), np.int64)
    rank = np.empty(len(level), np.int64)
    by = np.argsort(level, kind="stable")
    cuts = np.flatnonzero(np.diff(level[by])) + 1
    done = 0
    for at in np.split(by, cuts) if len(by) else []:
        above = np.where(parent[at] >= 0, rank[np.maximum(parent[at], 0)], -1)
        at = at[np.lexsort((label[at], above))]
        rank[at] = np.arange(done, done + len(at))
        order[done : done + len(at)] = at
        done += len(at)
    return order


def rollups(tree: Louds, own: np.ndarray) -> np.ndarray:
    """Leaves and the sum of ``own`` in the subtree of each node."""
    nodes = np.arange(tree.n)
    total = np.stack([(tree.degree(nodes) == 0).astype(np.int64), own], axis=1)
    for lo, hi in reversed(tree.levels()[1:]):
        np.add.at(total, tree.parent(np.arange(lo, hi)), total[lo:hi])
    return total


def _forest(table: pa.Table) -> pa.Table:
    """The nodes of a task's shards with their figures; ``top`` nodes lack their parent's id."""
    col = lambda c: table.column(c).to_numpy()
    keys = list(zip(col("f1").tolist(), col("f2").tolist(), strict=True))
    at = {k: i for i, k in enumerate(keys)}
    level = col("depth") - col("top") + 1
    parent = np.array([-1 if v == 1 else at[k] for v, k in zip(level.tolist(), zip(col("p1").tolist(), col("p2").tolist()))], np.int64)
    order = level_order(level, parent, col("conv_id"))
    rank = np.empty(len(order) + 1, np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    rank[-1] = 0  # the root over all shards, where parent -1 leads
    tree = Louds(np.bincount(rank[parent], minlength=len(order) + 1))
    conv, n, chars = (col(c)[order] for c in ("conv_id", "n_convs", "chars"))
    total = rollups(tree, np.concatenate([[0], (n - 1) * chars]))
    nodes = np.arange(1, tree.n)
    above = tree.parent(nodes)
    top = above == 0
    return pa.table({
        "conv_id": conv, "depth": col("depth")[order], "f1": col("f1")[order], "f2": col("f2")[order],
        "p1": col("p1")[order], "p2": col("p2")[order], "top": top,
        "parent_conv_id": pa.array(conv[np.maximum(above - 1, 0)], mask=top),
        "n_convs": n, "n_children": tree.degree(nodes), "n_leaves": total[1:, 0], "saved_tokens": total[1:, 1],
    })


_NODE = (
    "conv_id long, depth long, f1 long, f2 long, p1 long, p2 long, top boolean, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long"
)


def _turns(conversations: DataFrame, path: str) -> DataFrame:
    """conv_id, part, at, x, chars: turns by their order (at), dealt in ranges (part)."""
    spark = conversations.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(conversations.count() / ROWS))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    said = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return stage(dealt.select(
        "conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"),
        F.unhex(F.substring(F.sha2(said, 256), 1, 32)).alias("x"), F.length("text").cast("long").alias("chars"),
    ), path)


def _seeds(turns: DataFrame, stride: int, heads: int, path: str) -> DataFrame:
    """For each conversation h, k (turns taken), size, what they add up to (c1, c2), and ``path``,
    the rows of its nodes up to depth k."""
    first = Window.partitionBy("conv_id").orderBy("at")
    lent = turns.where(F.col("conv_id") % stride == 0).withColumn("i", F.row_number().over(first)).where(F.col("i") < max(heads, 2))
    lent = lent.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("i", "x", "chars"))).alias("head"))
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = convs.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % heads).withColumn("base", F.col("conv_id") - F.col("conv_id") % stride)
    both = convs.join(lent, "base", "left").select("conv_id", "n", "h", F.slice("head", 1, F.col("h").cast("int")).alias("head"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            h, n = (batch.column(c).to_numpy() for c in ("h", "n"))
            taken = [x or [] for x in batch.column("head").to_pylist()]
            k = np.array([len(x) for x in taken], np.int64)
            size = k + np.maximum(n - h, 0)
            paths, carry = [], []
            for head, s in zip(taken, size.tolist(), strict=True):
                x = np.frombuffer(b"".join(t["x"] for t in head), np.uint64).reshape(-1, 2)
                f = np.bitwise_xor.accumulate(np.concatenate([np.zeros((1, 2), np.uint64), _mix(x, np.arange(len(x)))])).view(np.int64).tolist()
                above = [[0, 0], *f]
                chars = [0, *(t["chars"] for t in head)]
                paths.append([
                    {"depth": d, "size": s, "f1": f[d][0], "f2": f[d][1], "p1": above[d][0], "p2": above[d][1], "chars": c}
                    for d, c in enumerate(chars)
                ])
                carry.append(f[-1])
            c = np.array(carry, np.int64).reshape(-1, 2)
            kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("depth", "size", "f1", "f2", "p1", "p2", "chars")]))
            arrays = [batch.column("conv_id"), batch.column("h"), pa.array(k), pa.array(size), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(paths, kind)]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "h", "k", "size", "c1", "c2", "path"])

    row = "depth:long,size:long,f1:long,f2:long,p1:long,p2:long,chars:long"
    return stage(both.mapInArrow(run, f"conv_id long, h long, k long, size long, c1 long, c2 long, path array<struct<{row}>>"), path)


def _paths(turns: DataFrame, seeds: DataFrame, base: str) -> DataFrame:
    """A row for each conversation and node on its path (_ROW), of its own turns and those it took."""
    spark = turns.sparkSession
    # Only the first and the last conversation of a range go over its ends: two rows a range.
    ends = turns.groupBy("part").agg(F.min("conv_id").alias("lo"), F.max("conv_id").alias("hi")).collect()
    held: dict[int, int] = {}
    for r in ends:
        for c in {r.lo, r.hi}:
            held[c] = held.get(c, 0) + 1
    over = sorted(c for c, n in held.items() if n > 1)
    long = F.broadcast(spark.createDataFrame([(c,) for c in over], "conv_id long"))
    start: dict[tuple[int, int], int] = {}
    sizes = turns.join(long, "conv_id", "left_semi").groupBy("conv_id", "part").count().collect() if over else []
    total: dict[int, int] = {}
    for c, part, n in sorted(map(tuple, sizes)):
        start[c, part] = total.get(c, 0)
        total[c] = start[c, part] + n

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        conv, h, k, size = (table.column(c).to_numpy() for c in ("conv_id", "h", "k", "size"))
        part = table.column("part")[0].as_py()
        first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(conv))))
        had = np.array([start.get((c, part), 0) for c in conv[first].tolist()], np.int64)
        at = np.arange(len(conv)) - first[run] + had[run]
        keep = at >= h
        depth = at - h + k + 1
        m = _mix(_lanes(table.column("x")), depth - 1)
        m[~keep] = 0
        # XOR of all rows so far, less that of the rows before the run.
        all_ = np.bitwise_xor.accumulate(m)
        before = np.concatenate([np.zeros((1, 2), np.uint64), all_])[first]
        carry = np.stack([table.column(c).to_numpy() for c in ("c1", "c2")], axis=1).astype(np.int64).view(np.uint64)
        f = all_ ^ before[run] ^ carry
        p = f ^ m
        cols = (conv[keep], np.full(keep.sum(), part, np.int32), depth[keep], size[keep])
        hashes = [_signed(x[keep]) for x in (f[:, 0], f[:, 1], p[:, 0], p[:, 1])]
        names = ["conv_id", "part", "depth", "size", "f1", "f2", "p1", "p2", "chars"]
        return pa.table([*map(pa.array, cols), *hashes, pa.array(table.column("chars").to_numpy()[keep])], names=names)

    both = turns.join(seeds.select("conv_id", "h", "k", "size", "c1", "c2"), "conv_id")
    own = stage(both.groupBy("part").applyInArrow(walk, _ROW), f"{base}/own")
    if over:
        last = own.join(long, "conv_id", "left_semi").groupBy("conv_id", "part").agg(F.max_by(F.struct("f1", "f2"), "depth").alias("f"))
        carry = {r.conv_id: (r.c1, r.c2) for r in seeds.join(long, "conv_id", "left_semi").select("conv_id", "c1", "c2").collect()}
        runs = {(r.conv_id, r.part): r.f for r in last.collect()}
        more, sofar = [], {}
        for c, part in sorted(start):
            a = sofar.get(c, (0, 0))
            more.append((c, part, *a))
            if f := runs.get((c, part)):
                sofar[c] = tuple(x ^ y ^ z for x, y, z in zip(a, f, carry[c], strict=True))
        adds = F.broadcast(spark.createDataFrame(more, "conv_id long, part int, a1 long, a2 long"))
        zero = F.lit(0).cast("long")
        put = {c: F.col(c).bitwiseXOR(F.coalesce(f"a{c[1]}", zero)) for c in ("f1", "f2", "p1", "p2")}
        own = own.join(adds, ["conv_id", "part"], "left").withColumns(put).drop("a1", "a2")
    taken = seeds.select("conv_id", F.inline("path"))
    return own.drop("part").unionByName(taken)


def _sums(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, depth, leaves, saved, ...) with both summed from each depth to the path's
    end, by blocks of levels and then over the blocks of a path."""
    block = F.floor(F.col("depth") / BLOCK)
    rows = rows.withColumn("block", block)
    down = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth"))
    after = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.sum("leaves").alias("bl"), F.sum("saved").alias("bs"))
    zero = F.lit(0).cast("long")
    rest = blocks.select("conv_id", "block", *[F.coalesce(F.sum(c).over(after), zero).alias(c) for c in ("bl", "bs")])
    inner = rows.withColumns({"leaves": F.sum("leaves").over(down), "saved": F.sum("saved").over(down)})
    both = inner.join(rest, ["conv_id", "block"])
    return both.withColumns({"leaves": F.col("leaves") + F.col("bl"), "saved": F.col("saved") + F.col("bs")}).drop("block", "bl", "bs")


def _ends(rows: DataFrame) -> DataFrame:
    """_KEY and ends_sha256 of the nodes at which a conversation ends. Ids are joined in blocks of
    neighbours, and a node's blocks stream through one hash, which is sequential by nature."""
    last = rows.where("depth = size").select(*_KEY, "conv_id")
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    blocks = last.groupBy(*_KEY, F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            made: list[tuple] = []
            cols = [batch.column(c).to_pylist() for c in (*_KEY, "ids")]
            for d, a, b, part in zip(*cols, strict=True):
                if (d, a, b) == key:
                    sha.update(b"," + part.encode())
                else:
                    if key:
                        made.append((*key, sha.hexdigest()))
                    key, sha = (d, a, b), hashlib.sha256(part.encode())
            yield _hashed(made)
        if key:
            yield _hashed([(*key, sha.hexdigest())])

    dealt = blocks.repartition(*_KEY).sortWithinPartitions(*_KEY, "block")
    return dealt.mapInArrow(run, "depth long, f1 long, f2 long, ends_sha256 string")


def _hashed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.string()]
    arrays = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=[*_KEY, "ends_sha256"])


def trie(conversations: DataFrame, stride: int = STRIDE, heads: int = HEADS, light: int = LIGHT) -> DataFrame:
    """The nodes of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. With ``heads`` 1 conversations stay as they are."""
    spark, base = conversations.sparkSession, shared_dir(conversations.sparkSession)
    turns = _turns(conversations, f"{base}/turns")
    seeds = _seeds(turns, stride, heads, f"{base}/seeds")
    rows = _paths(turns, seeds, base)
    same = {c: F.max(c).alias(c) for c in ("p1", "p2", "chars")}
    nodes = rows.groupBy(*_KEY).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), *same.values(),
        F.sum(F.col("size") - F.col("depth") + 1).alias("weight"),
    )
    nodes = stage(nodes, f"{base}/nodes")
    is_upper: Column = (F.col("weight") > light) | (F.col("depth") == 0)
    upper = nodes.where(is_upper)
    few = upper.count() <= LISTED
    small = lambda df: F.broadcast(df) if few else df
    marked = rows.join(small(upper.select(*_KEY, F.lit(True).alias("upper"))), _KEY, "left")

    # Shards: on each path what the first node below the upper ones begins.
    shard = marked.where("upper IS NULL").groupBy("conv_id").agg(F.min("depth").alias("top"), F.min_by(F.struct("f1", "f2"), "depth").alias("shard"))
    below = nodes.where(~is_upper).join(shard, "conv_id")
    n = nodes.count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / FOREST))
    below = below.withColumn("task", F.pmod(F.xxhash64("shard"), F.lit(tasks)).cast("int")).drop("shard", "weight")
    lower = stage(below.groupBy("task").applyInArrow(_forest, _NODE), f"{base}/lower")

    # Upper nodes: what hangs below each, then sums along the paths of first members.
    hung = lower.where("top").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(
        F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"),
    )
    kin = upper.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(F.count("*").alias("near"))
    zero = F.lit(0).cast("long")
    got = upper.join(hung, _KEY, "left").join(kin, _KEY, "left")
    got = got.withColumns({c: F.coalesce(c, zero) for c in ("kids", "leaves", "saved", "near")})
    got = got.withColumn("n_children", F.col("kids") + F.col("near")).withColumns({
        "leaves": F.col("leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0),
        "saved": F.col("saved") + (F.col("n_convs") - 1) * F.col("chars"),
    })
    got = stage(got, f"{base}/merged")
    first = marked.where("upper").select("conv_id", *_KEY).join(small(got.select("conv_id").distinct()), "conv_id", "left_semi")
    put = first.join(small(got.select("conv_id", *_KEY, "leaves", "saved")), ["conv_id", *_KEY], "left").fillna(0, ["leaves", "saved"])
    total = _sums(put).groupBy(*_KEY).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    above = small(got.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("above")))
    high = got.select("conv_id", *_KEY, "p1", "p2", "n_convs", "n_children").join(total, _KEY).withColumn("parent_conv_id", F.lit(None).cast("long"))
    # An upper node's parent, and that of a shard's first node, is an upper one.
    both = high.withColumn("top", F.col("depth") > 0).unionByName(lower)
    tops = both.where("top").join(above, ["depth", "p1", "p2"]).withColumn("parent_conv_id", F.col("above")).drop("above")
    all_ = both.where(~F.col("top")).unionByName(tops)
    ended = _ends(rows)
    found = all_.join(ended, _KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
    made = stage(found, f"{base}/made")
    drop(spark, *[f"{base}/{t}" for t in ("turns", "seeds", "own", "nodes", "lower", "merged")])
    return made


def op13(conversations: DataFrame) -> DataFrame:
    return trie(conversations.select("conv_id", "turn", "role", "text"))
