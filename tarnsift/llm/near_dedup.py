"""Near-dedup of texts: SimHash over five-word shingles, similarity 0.8 or more, by trie self-join.

Two texts are near if the Jaccard similarity of their sets of SHINGLE-word shingles is SIMILAR or
more. A fingerprint of WIDTH bits tells where to look: of shingle sets with Jaccard J, a bit differs
with probability arccos(2J / (1 + J)) / pi, so 77.6 +- 8.1 of 512 bits at 0.8. Fingerprints that
differ in RADIUS bits or fewer (two standard deviations and a quarter more than 0.8 has) tie their
texts loosely; only texts whose shingle sets were compared are ever linked.

Tries: no trie of one bit order could find 96 differing bits of 512 without visiting nearly all
pairs of nodes. So there are several, each with the bits in an order of its own, and no error is
allowed along its first levels, as many as leave GROUP fingerprints to a node. Those levels are
dealt to tasks; below, pairs of nodes are traversed together and their differing bits add up,
first under the budget NEAR, which joins most copies, and then under RADIUS. The number of tries
follows from the number of fingerprints, so that MISSED of the pairs of similarity 0.8 at most never
meet, and far fewer of nearer pairs: at 0.85 under 2 %, at 0.9 under 0.2 %. This is the operator's
one loss, besides pairs that RADIUS cuts (1.2 % at 0.8), and it is a loss only where no loose tie to
a third text brings both into one component.

Linking: within each component of loose ties all pairs count, met or not. A task takes the shingle
sets of whole components. One text after another is compared with all that aren't joined to it yet,
until all that weren't compared with everything are joined: exact, and few comparisons for copies.
A component of more than MEMBERS texts or SHINGLES shingles is cut in blocks by hash: each block is
joined with the first one, and what isn't joined to the most then is compared, block by block, with
all others. That is exact too, whatever the component's size.

Groups of more than CROWD rows are salted into blocks as in ``trie_dedup``, tasks send on trees
rather than pairs, equal fingerprints are one entry, and components are large-star and small-star
rounds. Nothing but counts is collected.

Defined cases: a null or empty text has the fingerprint zero and no shingle, and such texts are
one group; a text of fewer than SHINGLE words is one shingle; rows are told apart by doc_id and
text, so rows of different texts that share a doc_id, or have none, are judged one by one, and of
equal rows one stays, any of them; the first of a group by doc_id stays, null last; a very long
text is one row; an empty table gives an empty result; further columns stay, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnsift.llm.common import drop, shared_dir, slices, stage, trim
from tarnsift.llm.trie_dedup import Joined, components, salted, trie_pairs

SHINGLE = 5
SIMILAR = 0.8
WIDTH = 512
NEAR, RADIUS = 64, 96
#: Fingerprints at a node below the dealt levels; share of pairs of similarity SIMILAR not met.
GROUP = 2_000
MISSED = 0.05
CROWD = 10_000
#: Texts and shingles of a block of a component, at most (an only text may have more).
MEMBERS, SHINGLES = 2_000, 2_000_000
_WORDS = WIDTH // 64
_KEY = "shingles of word"
_BYTES = 2_000_000


def differing(similar: float) -> float:
    """The probability that a bit differs between shingle sets of that Jaccard similarity."""
    return math.acos(2 * similar / (1 + similar)) / math.pi


def tries(count: int) -> tuple[int, int]:
    """Dealt levels and number of tries for ``count`` fingerprints."""
    levels = max(0, math.ceil(math.log2(max(1, count / GROUP))))
    if not levels:
        return 0, 1
    meet = (1 - differing(SIMILAR)) ** levels
    return levels, math.ceil(math.log(MISSED) / math.log(1 - meet))


def order_of(trie: int) -> np.ndarray:
    """The order of bits of a trie, the same in every task."""
    return np.random.default_rng(trie + 1).permutation(WIDTH)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts and their number in each text; those of a
    text stand together, ascending."""
    cut = [t.lower().split() for t in texts]  # of bytes: A-Z and ASCII blanks only
    n = np.array([len(c) for c in cut], np.int64)
    words = np.empty(int(n.sum()), object)
    words[:] = [w for c in cut for w in c]
    h = hash_array(words, hash_key=_KEY, categorize=False)
    first = np.cumsum(n) - n
    size = np.minimum(n, SHINGLE)
    count = np.where(n > 0, n - size + 1, 0)
    of = np.repeat(np.arange(len(texts)), count)
    at = np.repeat(first, count) + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    made = np.zeros(len(of), np.uint64)
    for k in range(SHINGLE):
        there = k < size[of]
        made = np.where(there, _mix(made + h[np.where(there, at + k, 0)]) if len(h) else made, made)
    by = np.lexsort((made, of))
    of, made = of[by], made[by]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (made[1:] != made[:-1])
    return made[new], np.bincount(of[new], minlength=len(texts))


def simhash(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """WIDTH votes of each text's shingles, as rows of bytes."""
    out = np.zeros((len(count), WIDTH // 8), np.uint8)
    has = np.flatnonzero(count)
    if not len(has):
        return out
    votes = np.stack([_mix(hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for k in range(_WORDS)], axis=1)
    # Counters of eight bits hold 255 votes: a text is summed in blocks of as many.
    n = count[has]
    blocks = -(-n // 255)
    first = np.cumsum(n) - n
    nth = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = np.repeat(first, blocks) + 255 * nth
    bits = np.empty((len(has), WIDTH // 8, 8), bool)
    lane = np.uint64(0x0101010101010101)
    for j in range(8):
        sums = np.add.reduceat((votes >> np.uint64(j)) & lane, at, axis=0).view(np.uint8)
        total = np.add.reduceat(sums, np.cumsum(blocks) - blocks, axis=0, dtype=np.int64)
        bits[:, :, j] = 2 * total > n[:, None]
    out[has] = np.packbits(bits, axis=2, bitorder="little")[:, :, 0]
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut to few bytes of text, with the texts."""
    for batch in slices(batches):
        texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and size < _BYTES:
                size += len(texts[b])
                b += 1
            yield batch.slice(a, b - a), texts[a:b]
            a = b


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, key, fp (binary) and n, the number of shingles, of docs with doc_id, key and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _chunks(batches):
            h, n = shingles(texts)
            fp = pa.array([x.tobytes() for x in simhash(h, n)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), fp, pa.array(n)], names=["doc_id", "key", "fp", "n"])
        trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "key", "text").mapInArrow(run, f"doc_id {kind}, key binary, fp binary, n long")


def ties(entries: DataFrame, count: int) -> DataFrame:
    """Trees (a, b) over fingerprints within RADIUS, of ``count`` distinct ones (fp)."""
    levels, many = tries(count)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(levels, dtype=np.int64)
        for batch in slices(batches, 5000):
            raw = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint8).reshape(-1, WIDTH // 8)
            bits = np.unpackbits(raw, axis=1)
            for t in range(many):
                grp = (bits[:, order_of(t)[:levels]] @ weights) * many + t
                yield pa.RecordBatch.from_arrays([pa.array(grp), batch.column("fp")], names=["grp", "v"])

    def run(df: pd.DataFrame) -> pd.DataFrame:
        raw = np.array(sorted(set(df["v"])), object)
        trie = int(df["grp"].iloc[0]) % many
        bits = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8).reshape(-1, WIDTH // 8), axis=1)
        turned = np.packbits(bits[:, order_of(trie)], axis=1)
        by = np.lexsort(turned.T[::-1])
        values = turned[by].view(">u8").astype(np.uint64)
        joined = Joined(len(values))
        for radius in (NEAR, RADIUS):
            trie_pairs(values, radius, joined, depth=levels)
        i, j = np.array(joined.links, np.int64).reshape(-1, 2).T
        return pd.DataFrame({"a": raw[by[i]], "b": raw[by[j]]})

    rows = salted(entries.select("fp").mapInArrow(deal, "grp long, v binary"), CROWD)
    return rows.groupBy("grp", "s", "t").applyInPandas(run, "a binary, b binary")


def settle(h: np.ndarray, n: np.ndarray, label: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Labels of sets after all near pairs are joined that have an ``asked`` set.

    ``h``: the shingles of all sets, one set after another; ``n``: their numbers. ``label`` joins
    sets before. A set that was compared with all others needs no more; once the others that may
    need it are joined, all is settled.
    """
    label, m = label.copy(), len(n)
    starts = np.cumsum(n) - n
    _, ids = np.unique(h, return_inverse=True)
    marks = np.zeros(int(ids.max(initial=-1)) + 1, bool)
    of = np.repeat(np.arange(m), n)
    done = np.zeros(m, bool)
    while True:
        left = np.flatnonzero(~done)
        open_ = left[asked[left]]
        if not len(open_) or (label[left] == label[open_[0]]).all():
            return label
        # The least joined first: most are settled by the time the large groups are come to.
        _, group = np.unique(label[left], return_inverse=True)
        size = np.bincount(group)[group][asked[left]]
        p = open_[np.argmin(size) if done.any() else np.argmax(size)]
        done[p] = True
        other = left[(label[left] != label[p]) & (n[left] >= SIMILAR * n[p]) & (SIMILAR * n[left] <= n[p])]
        if not len(other):
            continue
        own = ids[starts[p] : starts[p] + n[p]]
        marks[own] = True
        if 4 * n[other].sum() < len(ids):
            which = np.repeat(np.arange(len(other)), n[other])
            at = starts[other][which] + np.arange(len(which)) - np.repeat(np.cumsum(n[other]) - n[other], n[other])
            both = np.bincount(which[marks[ids[at]]], minlength=len(other))
        else:
            both = np.bincount(of[marks[ids]], minlength=m)[other]
        marks[own] = False
        near = other[both >= SIMILAR * (n[p] + n[other] - both)]
        label[np.isin(label, label[near])] = label[p]


def _settled(table: pa.Table) -> pa.Table:
    """Links (a, b) of the near texts of whole components, or of two blocks of one: of each text to
    the least of those it is joined with. ``asked`` texts are compared, those of one ``part``
    (a component's root) with each other."""
    part = table.column("part").to_pylist()
    by = sorted(range(len(part)), key=lambda i: part[i])
    fp, raw, was, asked = (table.column(c).to_pylist() for c in ("fp", "h", "was", "asked"))
    a, b, lo = [], [], 0
    while lo < len(by):
        hi = lo
        while hi < len(by) and part[by[hi]] == part[by[lo]]:
            hi += 1
        # A block that is met with itself comes twice, once asked.
        mine = list({fp[i]: i for i in sorted(by[lo:hi], key=lambda i: asked[i])}.values())
        sets = [np.frombuffer(raw[i] or b"", np.uint64) for i in mine]
        _, label = np.unique(np.array([was[i] for i in mine], object), return_inverse=True)
        got = settle(np.concatenate(sets), np.array([len(x) for x in sets]), label, np.array([asked[i] for i in mine]))
        first: dict[int, int] = {}
        for k in sorted(range(len(mine)), key=lambda k: fp[mine[k]]):
            r = first.setdefault(int(got[k]), k)
            if r != k:
                a.append(fp[mine[r]])
                b.append(fp[mine[k]])
        lo = hi
    return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def linked(members: DataFrame, docs: DataFrame, base: str) -> DataFrame:
    """Trees (a, b) over all near fingerprints of each loose component. ``members``: fp, k (the key
    of a row that has it), n and root; ``docs``: key, text."""
    spark = members.sparkSession

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _chunks(batches):
            h, n = shingles(texts)
            cut = np.split(h, np.cumsum(n)[:-1])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([x.tobytes() for x in cut], pa.binary())], names=["key", "h"])
        trim()

    size = members.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    blocks = F.ceil(F.greatest(F.col("m") / MEMBERS, F.col("total") / SHINGLES)).cast("int")
    size = size.where("m > 1").select("root", "m", "total", F.greatest(blocks, F.lit(1)).alias("blocks"))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = stage(members.join(size, "root").withColumn("block", block), f"{base}/dealt")
    one = docs.join(dealt.select(F.col("k").alias("key")).distinct(), "key", "left_semi").dropDuplicates(["key"])
    of = one.mapInArrow(sets, "key binary, h binary").withColumnRenamed("key", "k")
    held = stage(dealt.join(of, "k").select("fp", "root", "blocks", "block", "total", "h"), f"{base}/sets")

    # Whole components, many to a task, by what they hold.
    total = held.where("blocks = 1").agg(F.coalesce(F.sum(F.length("h")), F.lit(0)).alias("n")).first().n
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / (8 * SHINGLES)))
    task = F.pmod(F.xxhash64("root"), F.lit(tasks)).cast("int")
    row = ("fp", "h", F.col("root").alias("part"), F.col("fp").alias("was"), F.lit(True).alias("asked"))
    found = stage(held.where("blocks = 1").select(task.alias("task"), *row).groupBy("task").applyInArrow(_settled, "a binary, b binary"), f"{base}/whole")
    big = held.where("blocks > 1")
    if not big.limit(1).count():
        return found
    # Each block of a large component with its first one.
    to = F.when(F.col("block") > 0, F.array("block")).otherwise(F.sequence(F.lit(1), F.col("blocks") - 1))
    first = big.select("root", F.explode(to).alias("t"), *row)
    met0 = stage(first.groupBy("root", "t").applyInArrow(_settled, "a binary, b binary"), f"{base}/first")
    # What isn't joined to the most by now, with all blocks.
    tied = components(met0, f"{base}/tied").withColumnsRenamed({"node": "fp", "root": "now"})
    now = stage(big.select("fp", "root", "block", "blocks").join(tied, "fp", "left").withColumn("now", F.coalesce("now", "fp")), f"{base}/now")
    most = now.groupBy("root", "now").count().groupBy("root").agg(F.max_by("now", F.struct("count", "now")).alias("most"))
    now = now.join(most, "root").select("fp", "now", (F.col("now") != F.col("most")).alias("asked"))
    rest = big.join(now, "fp").select("fp", "h", "root", "block", "blocks", F.col("root").alias("part"), F.col("now").alias("was"), "asked")
    # The texts left over of a block (s) meet all texts of every block (t).
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    some = rest.where("asked").select("root", "block").distinct().groupBy("root").agg(F.collect_set("block").alias("open"))
    left = rest.where("asked").select("root", F.col("block").alias("s"), F.explode(every).alias("t"), "fp", "h", "part", "was", "asked")
    all_ = rest.join(some, "root").select("root", F.explode("open").alias("s"), F.col("block").alias("t"), "fp", "h", "part", "was", F.lit(False).alias("asked"))
    met = all_.unionByName(left).groupBy("root", "s", "t").applyInArrow(_settled, "a binary, b binary")
    return found.unionByName(met0).unionByName(met)


def _key(doc_id: Column, text: Column) -> Column:
    """What tells rows apart: a digest of doc_id and text, nulls apart from empty ones."""
    parts = [F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), text.isNull().cast("string"), F.coalesce(text, F.lit(""))]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def groups(docs: DataFrame) -> DataFrame:
    """key of each distinct row (doc_id, text), its fp, and head, the key of the first of its
    group of near texts."""
    base = shared_dir(docs.sparkSession)
    keyed = docs.select("doc_id", _key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    fps = stage(fingerprints(keyed), f"{base}/fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    entries = stage(fps.groupBy("fp").agg(F.min(place).alias("first"), F.max("n").alias("n")), f"{base}/entries")
    loose = components(ties(entries, entries.count()), f"{base}/loose").withColumnRenamed("node", "fp")
    members = entries.select("fp", F.col("first.key").alias("k"), "n").join(loose, "fp")
    # A component's least fingerprint is its root and no node of its own.
    roots = loose.select("root").distinct().select(F.col("root").alias("fp"), "root")
    members = members.unionByName(entries.select("fp", F.col("first.key").alias("k"), "n").join(roots, "fp"))
    near = stage(linked(members, keyed.select("key", "text"), base), f"{base}/near")
    tied = components(near, f"{base}/components")
    rooted = entries.join(tied.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stage(rooted, f"{base}/rooted")
    heads = rooted.groupBy("root").agg(F.min("first").alias("head")).select("root", F.col("head.key").alias("head"))
    done = fps.select("key", "fp").join(rooted.join(heads, "root").select("fp", "head"), "fp").select("key", "fp", "head")
    done = stage(done, f"{base}/groups")
    made = "fingerprints entries loose dealt sets whole first tied now near components rooted"
    drop(docs.sparkSession, *[f"{base}/{t}" for t in made.split()])
    return done


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near texts: that of the smallest doc_id, null last."""
    name = "key"
    while name in docs.columns:
        name += "_"
    rows = groups(docs)
    gone = rows.where("key <> head").select(F.col("key").alias(name)).distinct()
    twice = rows.where("key = head").groupBy("key").count().where("count > 1").select(F.col("key").alias(name))
    kept = docs.withColumn(name, _key(F.col("doc_id"), F.col("text"))).join(gone, name, "left_anti")
    if twice.limit(1).count():
        more = kept.join(twice, name, "left_semi").dropDuplicates([name])
        kept = kept.join(twice, name, "left_anti").unionByName(more)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
