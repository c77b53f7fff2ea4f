"""SimHash near-dedup by a binary trie self-join, and its connected components.

Fingerprints: one 64-bit hash per 3-word shingle votes on every bit. Equal fingerprints are
one entry from here on, however many documents have them.

Join: distinct fingerprints are the leaves of a binary trie. Pairs of nodes are traversed
together, a bit at a time; a pair carries the number of bits in which its two paths differ and
is dropped as soon as that is over the budget. Of the two halves of two fingerprints within
RADIUS bits, one differs in at most RADIUS // 2; so there are two tries, each with one half in
front and that smaller budget along it, and the traversal stays narrow where it is widest.

The trie's first levels are dealt to tasks: a task is a pair of prefixes within the budget of
the front half, and a fingerprint goes to the pairs of its own. Groups of more than CROWD rows
are salted into blocks, and each pair of blocks is a task, so no task grows with a cluster of
near copies. A task sends on no more links than join its fingerprints into trees, and skips
pairs of nodes whose leaves are already joined, so a cluster isn't expanded into its pairs.

Components: alternating large-star and small-star rounds over the links, each written to the
shared folder, until nothing changes. Nothing is collected but two numbers a round.

Defined cases: a null or empty text has the fingerprint zero and is linked like any other; a
text of fewer than three words is one shingle; rows that repeat are one entry; rows that share
a doc_id are separate but have equal ids, and a null doc_id is never chosen as component id
unless all are null; a very long text is votes like any other; an empty table gives an empty
result; further columns are dropped.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnsift.llm.common import drop, shared_dir, stage
from tarnsift.llm.simhash import as_hex, vote, words

RADIUS = 3
SHINGLE = 3
#: Fingerprints that a task should hold; beyond CROWD a group is salted.
GROUP = 2_000
CROWD = 40_000
#: Pairs of nodes expanded at a time, pairs of leaves compared outright, and at a time.
CHUNK = 100_000
SMALL = 64
PAIRS = 400_000
#: Crowded groups that are broadcast at most; a longer list is joined.
LISTED = 100_000


def shingle_hashes(words: str, k: int = SHINGLE) -> Column:
    """XXH64 (seed 42) of each ``k``-word shingle; of fewer words, of all; of none, none."""
    n = F.size(words)
    many = F.transform(
        F.sequence(F.lit(1), n - (k - 1)),
        lambda i: F.xxhash64(F.concat_ws(" ", *[F.element_at(words, i + j) for j in range(k)])),
    )
    return (
        F.when(n >= k, many)
        .when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", words))))
        .otherwise(F.array().cast("array<bigint>"))
    )


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, columns ``more`` and fingerprint, a row for each of ``docs``."""
    keys = ["doc_id", *more]
    cut = docs.select(F.monotonically_increasing_id().alias("__row"), *keys, words(F.col("text")).alias("__w"))
    hashed = cut.select("__row", *keys, shingle_hashes("__w").alias("__h"))
    return vote(hashed, ["__row", *keys], "__h", weighted=False).select(*keys, "fingerprint")


class Joined:
    """Union-find over positions, with roots known for all after ``settle``."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.root = np.arange(n)
        self.changes = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join each a and b; ``links`` keeps those that joined two components."""
        ra, rb = self.root[a], self.root[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        far = lo != hi
        if not far.any():
            return
        a, b = a[far], b[far]
        codes, at = np.unique(lo[far] * len(self.root) + hi[far], return_index=True)
        for code, k in zip(codes.tolist(), at.tolist(), strict=True):
            i, j = self.find(code // len(self.root)), self.find(code % len(self.root))
            if i != j:
                self.parent[max(i, j)] = min(i, j)
                self.links.append((int(a[k]), int(b[k])))
        p = np.array(self.parent)
        while True:
            q = p[p]
            if (q == p).all():
                break
            p = q
        self.parent, self.root = p.tolist(), p
        self.changes = np.concatenate([[0], np.cumsum(p[1:] != p[:-1])])

    def same(self, lo1, hi1, lo2, hi2) -> np.ndarray:
        """Whether all leaves of two ranges are in one component."""
        c, r = self.changes, self.root
        return (c[lo1] == c[hi1 - 1]) & (c[lo2] == c[hi2 - 1]) & (r[lo1] == r[lo2])


def _few(at: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Positions ``at`` in runs of about PAIRS in ``size``."""
    if not len(at):
        return []
    run = (np.cumsum(size[at]) - 1) // PAIRS
    return np.split(at, np.flatnonzero(np.diff(run)) + 1)


def trie_pairs(
    values: np.ndarray, radius: int, joined: Joined, front: int | None = None, depth: int = 0, cut: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions that join sorted distinct ``values`` (rows of uint64, first bit highest)
    within ``radius`` differing bits into trees, beyond what ``joined`` has joined before. All
    values agree in the first ``depth`` bits or differ only across ``cut``; with ``front`` no more
    bits than that differ in the first 32; with ``cut`` pairs are between the values before it
    and those from it on."""
    n, bits = len(values), 64 * values.shape[1]
    front = radius if front is None else front
    zero, had = np.array([0]), len(joined.links)
    # (depth, ranges of the two nodes, differing bits)
    stack = [(depth, zero, zero + (cut or n), zero + cut, zero + n, zero)] if n > 1 and cut < n else []
    while stack:
        depth, a0, a1, b0, b1, d = stack.pop()
        live = ~joined.same(a0, a1, b0, b1)
        a0, a1, b0, b1, d = (x[live] for x in (a0, a1, b0, b1, d))
        small = ((a1 - a0) * (b1 - b0) <= SMALL) | (depth == bits)
        for part in _few(np.flatnonzero(small), (a1 - a0) * (b1 - b0)):
            na, nb = (a1 - a0)[part], (b1 - b0)[part]
            size = na * nb
            which = np.repeat(np.arange(len(size)), size)
            k = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            i, j = a0[part][which] + k // nb[which], b0[part][which] + k % nb[which]
            x = values[i] ^ values[j]
            ok = (i != j) & (np.bitwise_count(x).sum(1) <= radius)
            if front < radius:
                ok &= np.bitwise_count(x[:, 0] >> np.uint64(32)) <= front
            joined.join(i[ok], j[ok])
        a0, a1, b0, b1, d = (x[~small] for x in (a0, a1, b0, b1, d))
        if not len(d):
            continue
        # Where the next bit turns to one in each node.
        bit = (values[:, depth // 64] >> np.uint64(63 - depth % 64)) & np.uint64(1)
        ones = np.concatenate([[0], np.cumsum(bit)]).astype(np.int64)
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        budget = front if depth < 32 else radius
        own = (a0 == b0) & (a1 == b1)
        parts = [
            (a0, am, b0, bm, d, am > a0), (am, a1, bm, b1, d, a1 > am),
            (a0, am, bm, b1, d + 1, d < budget), (am, a1, b0, bm, d + 1, (d < budget) & ~own),
        ]
        cols = [[], [], [], [], []]
        for *p, on in parts:
            on = on & (p[1] > p[0]) & (p[3] > p[2])
            for c, x in zip(cols, p, strict=True):
                c.append(x[on])
        nxt = [np.concatenate(c) for c in cols]
        for s in range(0, len(nxt[0]), CHUNK):
            stack.append((depth + 1, *(x[s : s + CHUNK] for x in nxt)))
    new = np.array(joined.links[had:], np.int64).reshape(-1, 2)
    return new[:, 0], new[:, 1]


def trie_links(values: np.ndarray, front: int, radius: int = RADIUS, cut: int = 0) -> np.ndarray:
    """Roots of the components of sorted distinct ``values`` (uint64) under links of at most
    ``front`` differing bits in the upper 32 and ``radius`` in all, as ``trie_pairs`` finds them."""
    joined = Joined(len(values))
    trie_pairs(values[:, None], radius, joined, front, cut=cut)
    return joined.root


def _turn(x: np.ndarray) -> np.ndarray:
    return (x << np.uint64(32)) | (x >> np.uint64(32))


def salted(rows: DataFrame, crowd: int) -> DataFrame:
    """``rows`` (grp, v) as grp, s, t, v: groups of more than ``crowd`` rows are dealt into blocks
    by hash, and every pair of blocks (s, t) is a group; others are (0, 0)."""
    crowds = rows.groupBy("grp").count().where(F.col("count") > crowd)
    crowds = crowds.select("grp", F.ceil(F.col("count") / crowd).cast("int").alias("salts"))
    few = crowds.limit(LISTED + 1).count() <= LISTED
    rows = rows.join(F.broadcast(crowds) if few else crowds, "grp", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    salt = F.pmod(F.xxhash64("v"), F.col("salts")).cast("int")
    rows = rows.withColumn("salt", salt).select(
        "grp", "v", "salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("with")
    )
    return rows.select("grp", F.least("salt", "with").alias("s"), F.greatest("salt", "with").alias("t"), "v")


def links(entries: DataFrame, count: int, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints that join all within ``radius`` bits.

    ``entries``: distinct column fingerprint; ``count``: its number of rows.
    """
    front = radius // 2
    bits = min(16, max(4, math.ceil(math.log2(max(2, count) / GROUP)) if count > GROUP else 4))
    turned = F.shiftleft("fingerprint", 32).bitwiseOR(F.shiftrightunsigned("fingerprint", 32))
    rows = entries.select(
        F.inline(F.array(
            F.struct(F.lit(0).alias("trie"), F.col("fingerprint").alias("v")),
            F.struct(F.lit(1).alias("trie"), turned.alias("v")),
        ))
    )
    # Prefixes within the front budget: flips of at most ``front`` of the first ``bits`` bits.
    flips = [m for m in range(1 << bits) if m.bit_count() <= front] if bits <= 10 or front > 1 else [0, *(1 << k for k in range(bits))]
    own = F.shiftrightunsigned("v", 64 - bits)
    other = own.bitwiseXOR(F.col("flip"))
    pair = F.least(own, other) * (1 << bits) + F.greatest(own, other)
    rows = rows.withColumn("flip", F.explode(F.array(*[F.lit(m).cast("long") for m in flips])))
    rows = rows.select(((pair * 2) + F.col("trie")).alias("grp"), "v")
    rows = salted(rows, CROWD)

    def run(df: pd.DataFrame) -> pd.DataFrame:
        v = np.unique(df["v"].to_numpy().view(np.uint64))
        pair = int(df["grp"].iloc[0]) >> 1
        p, q = pair >> bits, pair & ((1 << bits) - 1)
        cut = int(np.searchsorted(v, np.uint64(q << (64 - bits)))) if p != q else 0
        root = trie_links(v, front, radius, cut) if p == q or 0 < cut < len(v) else np.arange(len(v))
        at = np.flatnonzero(root != np.arange(len(v)))
        a, b = v[at], v[root[at]]
        if int(df["grp"].iloc[0]) & 1:
            a, b = _turn(a), _turn(b)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return rows.groupBy("grp", "s", "t").applyInPandas(run, "a long, b long")


def components(edges: DataFrame, base: str) -> DataFrame:
    """node, root: the smallest node reachable, for each node of ``edges`` (a, b).

    Large-star: each node's larger neighbours are tied to the smallest node next to it.
    Small-star: each node's smaller neighbours and itself are. The links that both leave
    unchanged are stars. Every round is written, so a lost executor costs one round.
    """

    def ordered(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(df: DataFrame) -> tuple[int, int]:
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r.n, int(r.h or 0)

    now = stage(ordered(edges), f"{base}/links0")
    last, k = state(now), 0
    while last[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(ordered(large), f"{base}/large{k}")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = stage(ordered(small), f"{base}/links{k + 1}")
        drop(edges.sparkSession, f"{base}/links{k}", f"{base}/large{k}")
        k, was, last = k + 1, last, state(now)
        if was == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _rooted(fps: DataFrame, base: str, radius: int, *first: Column) -> DataFrame:
    """fingerprint, columns ``first`` (aggregates of its rows) and root, of distinct fingerprints."""
    entries = stage(fps.groupBy("fingerprint").agg(*first), f"{base}/entries")
    tied = components(links(entries.select("fingerprint"), entries.count(), radius), f"{base}/components")
    rooted = entries.join(tied.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    rooted = stage(rooted.withColumn("root", F.coalesce("root", "fingerprint")), f"{base}/rooted")
    drop(fps.sparkSession, f"{base}/entries", f"{base}/components")
    return rooted


def classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (long) and component_id, a row for each of ``docs``."""
    base = shared_dir(docs.sparkSession)
    fps = stage(fingerprints(docs), f"{base}/fingerprints")
    # Per distinct fingerprint its root, then the smallest doc_id of the root.
    rooted = _rooted(fps, base, radius, F.min("doc_id").alias("first"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    found = rooted.join(ids, "root").select("fingerprint", "component_id")
    return fps.join(found, "fingerprint").select("doc_id", "fingerprint", "component_id")


def op10(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")
