"""SimHash fingerprints and search within a Hamming radius, in built-in expressions only.

Each term of a text votes with its weight on the signed bits of its hash, and a fingerprint bit
is 1 where the weight of the ones is over half. A fingerprint has 128 bits, two hashes of 64:
likeness is a mean over bits, so twice as many halve its variance. Terms are exploded and summed
within their task: a lane-packed sum holds two bit counters of 32 bits, so 32 sums are 64
counters, and one row of sums per document and hash is all that is left.

Search keeps tables permuted by blocks: the bits are cut in BLOCKS blocks, and of two
fingerprints within RADIUS at least BLOCKS - RADIUS are equal. One table per pair of blocks,
keyed by them, therefore finds all; a match counts only in the first table that has it.

Defined cases: a null text counts as empty; texts without a word have the fingerprint zero,
texts of one word that word's; equal texts have equal fingerprints; rows that share a doc_id, or
null, are separate, in order of a hash of their texts; a null doc_id comes first; a very long
text is votes like any other, summed where it is; of an empty table nothing comes;
further columns are dropped.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnsift.llm.common import BLANK_RUN, shared_dir, stage

RADIUS = 3
#: Half of the blocks are cut from either 64 bits; two at least are left by RADIUS bits.
BLOCKS = 6
WIDTH = 128
_LANES = 0x0000000100000001
_LOW = 0xFFFFFFFF


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, BLANK_RUN, -1), "")


def pair_terms(words: str, half: int = 0) -> Column:
    """Neighbouring words as (hash, weight), the weight being their length; ``half`` chooses
    one of independent hashes. ``words`` must name a column of the frame below."""
    salt = [F.lit(half)] * (half > 0)
    n = F.size(words)
    pairs = F.zip_with(
        F.slice(words, 1, F.greatest(n - 1, F.lit(0))),
        F.slice(words, 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.struct(F.xxhash64(*salt, a, b).alias("h"), (F.length(a) + F.length(b)).cast("long").alias("w")),
    )
    one = F.transform(words, lambda a: F.struct(F.xxhash64(*salt, a).alias("h"), F.length(a).cast("long").alias("w")))
    return F.when(n > 1, pairs).otherwise(one)


def vote(df: DataFrame, keys: list[str], terms: str, weighted: bool) -> DataFrame:
    """``keys`` with fingerprint (long), of the rows that share them.

    ``terms``: array of hashes, or with ``weighted`` of (h, w). The weights of a document may
    sum to 2**31 - 1. Rows of one key are best in one partition: then one row is shuffled.
    """
    rows = df.select(*keys, F.explode_outer(terms).alias("__t"))
    h, w = (F.col("__t.h"), F.col("__t.w")) if weighted else (F.col("__t"), F.lit(1).cast("long"))
    votes = [F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_LANES)) for j in range(32)]
    sums = [F.sum(v * w if weighted else v).alias(f"__s{j}") for j, v in enumerate(votes)]
    total = F.sum(w) if weighted else F.count("__t")
    summed = rows.groupBy(*keys).agg(*sums, total.alias("__n"))
    bits = []
    for j in range(32):
        s = F.col(f"__s{j}")
        for k, x in ((j, s.bitwiseAND(F.lit(_LOW))), (j + 32, F.shiftrightunsigned(s, 32))):
            one = (1 << k) - (1 << 64 if k == 63 else 0)
            bits.append(F.when(2 * x > F.col("__n"), F.lit(one).cast("long")).otherwise(F.lit(0).cast("long")))
    while len(bits) > 1:
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2], strict=True)]
    return summed.select(*keys, bits[0].alias("fingerprint"))


def differing(a: str, b: str) -> Column:
    """Bits in which fingerprints ``a`` and ``b`` differ, columns of (hi, lo)."""
    return sum(
        (F.bit_count(F.col(f"{a}.{k}").bitwiseXOR(F.col(f"{b}.{k}"))) for k in ("hi", "lo")), F.lit(0)
    )


def likeness(a: str, b: str) -> Column:
    return 1 - differing(a, b) / float(WIDTH)


def as_hex(fp: Column) -> Column:
    """64 bits as 16 hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _blocks() -> list[tuple[str, int, int]]:
    """Half, shift and width of each block."""
    n = BLOCKS // 2
    edges = [64 * k // n for k in range(n + 1)]
    return [(half, a, b - a) for half in ("lo", "hi") for a, b in zip(edges, edges[1:])]


def within(queries: DataFrame, index: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp of each query and n_within, the rows of ``index`` within ``radius`` bits of it.

    ``queries``: distinct fp (hi, lo); ``index``: distinct fp with n rows each, so equal texts,
    however many, are one entry.
    """
    if radius > BLOCKS - 2:
        raise ValueError(f"radius must be {BLOCKS - 2} or less")
    blocks = _blocks()
    pairs = list(combinations(range(BLOCKS), 2))

    def block(fp: str, k: int) -> Column:
        half, shift, width = blocks[k]
        return F.shiftrightunsigned(f"{fp}.{half}", shift).bitwiseAND(F.lit((1 << width) - 1))

    def keyed(df: DataFrame, *more: str) -> DataFrame:
        def key(t: int) -> Column:
            i, j = pairs[t]
            return F.struct(F.lit(t).alias("t"), (F.shiftleft(block("fp", i), blocks[j][2]) + block("fp", j)).alias("k"))

        return df.select("fp", *more, F.inline(F.array(*[key(t) for t in range(len(pairs))])))

    q = keyed(queries).withColumnRenamed("fp", "q")
    first = F.lit(False)
    for t, (i, j) in enumerate(pairs):
        sure = F.col("t") == t
        for k in range(j):
            if k != i:
                sure = sure & (block("q", k) != block("fp", k))
        first = first | sure
    found = q.join(keyed(index, "n"), ["t", "k"]).where((differing("q", "fp") <= radius) & first)
    return found.groupBy(F.col("q").alias("fp")).agg(F.sum("n").alias("n_within"))


def with_next(docs: DataFrame) -> DataFrame:
    """part, rn, sentinel, doc_id, text, next_text: each document with the next one's text.

    Documents are dealt in ranges of doc_id; one that takes up several ranges, as null may, is
    cut by the hash of its texts. The first row of a range is also sent, as a sentinel, to the
    range before it (of the first range: to the last). Within a range the next row is then the
    next document, so no task sees more than a range.
    """
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("key"))
    share = [k / parts for k in range(1, parts)]
    cut = rows.agg(F.percentile_approx("key", share, max(10_000, 10 * parts)).alias("b")).first().b or []
    bounds = F.array(*[F.lit(b).cast("long") for b in cut]).cast("array<bigint>")
    # A key with m bounds takes up m ranges of its hashes, from that of its first bound on.
    mine = F.size(F.filter(bounds, lambda b: b == F.col("key")))
    slice_of = F.least(mine - 1, F.floor((F.col("h") / 2.0**64 + 0.5) * mine).cast("int"))
    part = F.size(F.filter(bounds, lambda b: b < F.col("key"))) + F.when(mine > 0, 1 + slice_of).otherwise(0)
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("part", part if cut else F.lit(0))
    # One row per range: no more than ``parts``.
    first = sorted((r.part, tuple(r.f)) for r in rows.groupBy("part").agg(F.min(F.struct("key", "h")).alias("f")).collect())
    sent = [(*f, first[i - 1][0]) for i, (_, f) in enumerate(first)]
    ends = spark.createDataFrame(sent, "key long, h long, before int")
    # Equal rows that are first are sent once.
    heads = rows.join(F.broadcast(ends), ["key", "h"]).dropDuplicates(["before"])
    both = rows.withColumn("sentinel", F.lit(False)).unionByName(
        heads.select("doc_id", "text", "key", "h", F.col("before").alias("part"), F.lit(True).alias("sentinel"))
    )
    order = Window.partitionBy("part").orderBy("sentinel", "key", "h", "text")
    return both.select(
        "part", F.row_number().over(order).alias("rn"), "sentinel", "doc_id", "text",
        F.coalesce(F.lead("text").over(order), F.lit("")).alias("next_text"),
    )


def fingerprints(docs: DataFrame, keys: list[str], texts: dict[str, str]) -> DataFrame:
    """``keys``, which must tell rows apart, and a fingerprint (hi, lo) of each of ``texts``
    (name to column); null for a null text."""
    cut = docs.select(*keys, *[F.when(F.col(c).isNotNull(), words(F.col(c))).alias(f"__w{k}") for k, c in enumerate(texts.values())])
    kinds = [(k, half) for k in range(len(texts)) for half in (0, 1)]
    terms = cut.select(*keys, *[pair_terms(f"__w{k}", half).alias(f"__t{k}{half}") for k, half in kinds])
    rows = terms.select(
        *keys,
        F.inline(F.array_compact(F.array(*[
            F.when(F.col(f"__t{k}{half}").isNotNull(), F.struct(F.lit(2 * k + half).alias("__kind"), F.col(f"__t{k}{half}").alias("__terms")))
            for k, half in kinds
        ]))),
    )
    fps = vote(rows, [*keys, "__kind"], "__terms", weighted=True)
    side = lambda n: F.max(F.when(F.col("__kind") == n, F.col("fingerprint")))
    wide = fps.groupBy(*keys).agg(*[side(2 * k + half).alias(f"__f{k}{half}") for k, half in kinds])
    made = [
        F.when(F.col(f"__f{k}0").isNotNull(), F.struct(F.col(f"__f{k}1").alias("hi"), F.col(f"__f{k}0").alias("lo"))).alias(name)
        for k, name in enumerate(texts)
    ]
    return wide.select(*keys, *made)


def op4(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    kept = "substring(text, 1, length(text) - int(floor(length(text) / 4)))"
    taken = "substring(next_text, 1, int(floor(length(text) / 4)))"
    rows = with_next(docs).select(
        "part", "rn", "sentinel", "doc_id", F.length("text").cast("long").alias("n_chars"), "text",
        F.when(~F.col("sentinel"), F.concat(F.expr(kept), F.expr(taken))).alias("edited"),
    )
    keys = ["part", "rn", "sentinel", "doc_id", "n_chars", "edited_sha256"]
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    wide = fingerprints(rows, keys, {"fp": "text", "efp": "edited"})
    wide = wide.withColumn("nfp", F.lead("fp").over(Window.partitionBy("part").orderBy("rn"))).where(~F.col("sentinel"))
    made = stage(wide.select("doc_id", "n_chars", "edited_sha256", "fp", "efp", "nfp"), f"{shared_dir(docs.sparkSession)}/made")
    index = made.groupBy("fp").agg(F.count("*").alias("n"))
    asked = (F.pmod("doc_id", F.lit(100)) == 0) & F.col("doc_id").isNotNull()
    near = within(made.where(asked).select("fp").distinct(), index, radius)
    text = lambda c: F.concat(as_hex(F.col(f"{c}.hi")), as_hex(F.col(f"{c}.lo")))
    return made.join(near, "fp", "left").select(
        "doc_id", "n_chars", "edited_sha256", text("fp").alias("fingerprint"), text("efp").alias("edited_fingerprint"),
        likeness("fp", "efp").alias("near_edited"), likeness("fp", "nfp").alias("near_next"),
        F.when(asked, F.col("n_within")).alias("n_within"),
    )
