"""Ranking operators: BM25, phrases, dense search, late interaction, fusion, reranking.

Scores are rounded to PLACES before anything is ranked on them and ids break ties, so every
order is total and repeats exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnsift.functions import vectors as V

K1, B = 1.2, 0.75
RRF_K = 60
PLACES = 6
#: Hits of a request that are broadcast at most; a longer list is joined.
FEW = 10_000


def term_weight(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def saturation(tf: Column, length: Column, mean: Column) -> Column:
    return tf / (tf + K1 * (1 - B + B * length / mean))


def phrase_count(tokens: str, phrase: Sequence[str]) -> Column:
    """How often the words of ``phrase`` stand in ``tokens`` next to each other."""
    m = len(phrase)
    at = F.sequence(F.lit(1), F.size(tokens) - (m - 1))
    hits = F.filter(at, lambda i: F.slice(tokens, i, m) == F.array(*map(F.lit, phrase)))
    # Few texts hold the words in a row at all, and only those are counted position by position.
    near = F.contains(F.array_join(tokens, " "), F.lit(" ".join(phrase)))
    return F.when((F.size(tokens) >= m) & near, F.size(hits)).otherwise(F.lit(0))


def _equals(term: str) -> Callable[[Column], Column]:
    return lambda x: x == F.lit(term)


def bm25(docs: DataFrame, terms: Sequence[str], phrase: Sequence[str] = (), boost: float = 4.0) -> DataFrame:
    """``docs`` (any columns, with an array ``tokens``) that match, with ``score``.

    ``score``: BM25 of ``terms``; with ``phrase`` also its occurrences, weighted by ``boost``
    and its words' weights. Term counts are taken within each row, so only one row of counts
    per task is shuffled for the weights.
    """
    terms = list(dict.fromkeys(terms))
    kept = [c for c in docs.columns if c != "tokens"]
    tf = [F.size(F.filter("tokens", _equals(t))).alias(f"__tf{k}") for k, t in enumerate(terms)]
    own = phrase_count("tokens", phrase) if phrase else F.lit(0)
    return bm25_counts(docs.select(*kept, F.size("tokens").alias("__len"), own.alias("__ptf"), *tf), terms, phrase, boost)


def bm25_counts(rows: DataFrame, terms: Sequence[str], phrase: Sequence[str] = (), boost: float = 4.0) -> DataFrame:
    """``bm25`` of rows that have been counted: beside any columns __len, __ptf (the phrase's) and, by place of
    the term, __tf."""
    counted = {"__len", "__ptf", *(f"__tf{k}" for k in range(len(terms)))}
    kept = [c for c in rows.columns if c not in counted]
    # One row: as many figures as the request has terms.
    stats = rows.agg(
        F.count("*").cast("double").alias("__n"), F.avg("__len").alias("__mean"),
        *[F.count(F.when(F.col(f"__tf{k}") > 0, 1)).cast("double").alias(f"__df{k}") for k in range(len(terms))],
    )
    both = rows.crossJoin(F.broadcast(stats))
    weight = {t: term_weight(F.col("__n"), F.col(f"__df{k}")) for k, t in enumerate(terms)}
    parts = [weight[t] * saturation(F.col(f"__tf{k}"), F.col("__len"), F.col("__mean")) for k, t in enumerate(terms)]
    if phrase:
        whole = reduce(lambda a, b: a + b, [weight[t] for t in phrase if t in weight], F.lit(0.0))
        parts.append(boost * whole * saturation(F.col("__ptf"), F.col("__len"), F.col("__mean")))
    score = F.round(reduce(lambda a, b: a + b, parts, F.lit(0.0)), PLACES)
    return both.select(*kept, score.alias("score")).where("score > 0")


def bm25_batch(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, id, score, rank: the top ``k`` of each of ``queries`` (query_id, terms).

    ``docs``: id, tokens. Postings of other terms are dropped by a join with the request's
    terms, whose number the request bounds.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    words = asked.select("term").distinct()
    stats = docs.agg(F.count("*").cast("double").alias("n"), F.avg(F.size("tokens")).alias("mean"))
    each = docs.select("id", F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
    tf = each.join(F.broadcast(words), "term", "left_semi").groupBy("term", "id", "length").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    part = term_weight(F.col("n"), F.col("df")) * saturation(F.col("tf"), F.col("length"), F.col("mean"))
    weighed = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats)).select("term", "id", part.alias("part"))
    hits = weighed.join(F.broadcast(asked), "term").groupBy("query_id", "id").agg(F.round(F.sum("part"), PLACES).alias("score"))
    return top(hits, k, F.desc("score"), "id", by=["query_id"])


def top(df: DataFrame, k: int, *order: Column | str, by: Sequence[str] = ()) -> DataFrame:
    """The first ``k`` rows in ``order`` with their rank, overall or within ``by``."""
    if by:
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    # The limit leaves k rows, so ranking them in one task is small.
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def knn(vecs: DataFrame, q: Sequence[float], k: int, key: str = "chunk_id", scale: str = "unit", vector: str = "v") -> DataFrame:
    """The ``k`` vectors nearest to ``q`` by cosine of unit vectors, with score and rank.
    ``scale``: ``unit`` for (1 + cos) / 2, ``raw`` for the cosine."""
    cos = V.dot(vector, q)
    score = F.round(V.unit_score(cos) if scale == "unit" else cos, PLACES)
    return top(vecs.withColumn("score", score).drop(vector), k, F.desc("score"), key)


def maxsim(vecs: DataFrame, queries: Sequence[Sequence[float]], key: str = "page_id", vector: str = "v") -> DataFrame:
    """``key`` and score: over the query's vectors the sum of the largest product with any of
    the row's vectors; each task keeps one maximum per key and query vector."""
    best = [F.max(V.dot(vector, q)).alias(f"__q{k}") for k, q in enumerate(queries)]
    found = vecs.groupBy(key).agg(*best) if best else vecs.select(key).distinct()
    total = reduce(lambda a, b: a + b, [F.col(f"__q{k}") for k in range(len(queries))], F.lit(0.0))
    return found.select(key, F.round(total, PLACES).alias("score"))


def rrf(lists: Sequence[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (``key``, rank): every row adds 1 / (k + rank) to
    its key. src_priority and first_rank tell where the key came first, for ties."""
    rows = reduce(DataFrame.unionByName, [df.select(key, "rank").withColumn("src", F.lit(i)) for i, df in enumerate(lists)])
    fused = rows.groupBy(key).agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf"), F.min(F.struct("src", "rank")).alias("f")
    )
    return fused.select(key, "rrf", F.col("f.src").alias("src_priority"), F.col("f.rank").alias("first_rank"))


Scorer = Callable[[str, list[str]], list[float]]


def overlap(query: str, texts: list[str]) -> list[float]:
    """A deterministic scorer: the share of the query's words that a text has."""
    q = set(query.lower().split())
    return [len(q & set(t.lower().split())) / max(len(q), 1) for t in texts]


def rerank(df: DataFrame, query: str, text: str = "text", pool: int = 50, scorer: Scorer = overlap, longest: int = 1800) -> DataFrame:
    """``df`` (with rank) with rerank_score in its first ``pool`` rows and a new place: the pool
    by its scores, then the others as they were."""
    schema = T.StructType([*df.schema.fields, T.StructField("rerank_score", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            scores = scorer(query, [(t or "")[:longest] for t in b[text]]) if len(b) else []
            yield b.assign(rerank_score=pd.Series(scores, index=b.index, dtype="float64"))

    scored = df.where(F.col("rank") <= pool).mapInPandas(run, schema).withColumn("rerank_score", F.round("rerank_score", PLACES))
    # The window sorts the pool and the hits after it: ``df`` is what a request was cut to before.
    # Ranks may have gaps, so the tail is counted too.
    tail = df.where(F.col("rank") > pool).withColumn("rerank_score", F.lit(None).cast("double"))
    w = Window.orderBy(F.desc_nulls_last("rerank_score"), "rank")
    return scored.unionByName(tail).withColumn("place", F.row_number().over(w))
