"""Queries over all of their input, against brute force: no text, pair or row is left out."""

import math
import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tarnsift.operators import retrieval as R
from tarnsift.plans import retrieval
from tarnsift.plans.all import QUERIES
from tarnsift.sources import fixtures as S


@pytest.fixture
def long_texts(spark, tmp_path):
    """Documents of which some have the word asked for only after 2000 characters."""
    texts = ["common word " * n + end for n, end in ((300, "zebra"), (5, "zebra"), (700, "zebra zebra"), (400, "gnu"), (3, ""))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr(
        "*", "'en' AS lang", "'s' AS source", "cast(length(text) AS long) AS n_chars"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    vecs = [(k, [1.0, 0.0], 0) for k in range(len(texts))]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path), texts


def test_fused_search_indexes_whole_texts(spark, long_texts):
    folder, texts = long_texts
    tokens = [re.findall(r"\w+", t) for t in texts]
    chunks, pages = retrieval.fused(spark, folder)
    got = {r.chunk_id: r.score for r in R.bm25(chunks, ["zebra"]).collect()}
    has = [k for k, t in enumerate(tokens) if "zebra" in t]
    idf = math.log(1 + (len(texts) - len(has) + 0.5) / (len(has) + 0.5))
    mean = sum(map(len, tokens)) / len(tokens)
    tf = {k: tokens[k].count("zebra") for k in has}
    want = {k: idf * n / (n + 1.2 * (0.25 + 0.75 * len(tokens[k]) / mean)) for k, n in tf.items()}
    assert got == pytest.approx(want, abs=1e-6) and len(has) == 3
    assert pages.first().tokens == sum(tokens, [])


def test_projection_has_every_pair_that_shares_an_entity(spark, sf):
    pages = {}
    for r in S.mention(spark, sf).collect():
        pages.setdefault(r.entity_key, set()).add(r.page_id)
    want = Counter(pair for p in pages.values() for pair in combinations(sorted(p), 2))
    got = {(r.src, r.dst): r.weight for r in QUERIES["g13_projection"](spark, sf).collect()}
    assert got == want and 1 in want.values()
    parent = {n: n for pair in want for n in pair}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in want:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert dict(QUERIES["g13_components"](spark, sf).collect()) == {n: find(n) for n in parent}
    assert {r.page_id for r in QUERIES["g14_detect"](spark, sf).collect()} <= set(parent)


def test_sets_and_counts_take_whole_tables(spark, sf, tmp_path):
    """With a part that no line has, so one entity is without mentions."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    more = part.limit(1).withColumn("p_partkey", F.lit(999_999).cast("long"))
    part.unionByName(more).write.parquet(f"{tmp_path}/part.parquet")
    for t in ("lineitem", "orders"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    folder = str(tmp_path)
    parts = {r.p_partkey: r.p_type for r in part.unionByName(more).collect()}
    lines = {(r.l_orderkey, r.l_partkey) for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect()}
    orders = {r.o_orderkey for r in spark.read.parquet(f"{sf}/orders.parquet").collect()}
    n = Counter(e for _, e in lines)
    assert dict(QUERIES["j2_left_counts"](spark, folder).collect()) == {e: n[e] for e in parts} and 0 in [n[e] for e in parts]
    left = [r[0] for r in QUERIES["u2_difference"](spark, folder).collect()]
    assert sorted(left) == sorted(orders - {p for p, _ in lines}) and left
    both = Counter(t for e, t in parts.items() if e in n)
    assert dict(QUERIES["u3_intersection"](spark, folder).collect()) == both
