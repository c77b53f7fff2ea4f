"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; the other side is unlabelled web text. The
share of good documents in it, the class prior, is estimated from scores alone: no set of
documents can hold a larger share of the positives than of the unlabelled rows over the
prior, so the least ratio of the two shares bounds it. The classifier then minimises the
non-negative unbiased risk

    prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)])

with the logistic loss, whose minimiser gives the probability of being good: that is the score.

Features are shares of symbols, capitals, repeats, lines and function words, cut at fixed
bounds. Training takes a bounded sample of positives and of unlabelled rows to the driver
(MAX_DOCS of each, MAX_CHARS in all: parameters); scoring is one map stage over all rows with
fewer than a hundred weights broadcast, no shuffle.

Defined cases: a null text counts as empty, and empty texts get the features of no words;
repeated rows score alike, a null doc_id scores like any other and is never trained on, a very
long text is one row; without trusted positives every score is 0.5; an empty table gives
an empty result; further columns pass through ``score``, except that one named score is
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnsift.llm.common import held_out, labelled, sample_texts, slices, small_batches
from tarnsift.llm.quality_rules import STOP_WORDS

MAX_DOCS = 4000
MAX_CHARS = 20_000_000
THRESHOLD = 0.7

_SYMBOLS = str.maketrans("", "", "#*$%&<>|@^~\\=+_{}[]")
_DIGITS = str.maketrans("", "", "0123456789")
_STOP = frozenset(STOP_WORDS)

#: Figure and the bounds at which it is cut; each cut is one feature.
CUTS: tuple[tuple[str, tuple[float, ...]], ...] = (
    ("words", (1, 3, 5, 10, 20, 50, 100, 300, 1000)),
    ("symbols_per_word", (0.001, 0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8)),
    ("bars_per_word", (0.001, 0.01, 0.05, 0.1, 0.25, 0.5)),
    ("marks_per_word", (0.005, 0.02, 0.05, 0.1, 0.3, 0.7, 1.2)),
    ("digit_share", (0.005, 0.02, 0.05, 0.15, 0.3)),
    ("capital_words", (0.02, 0.05, 0.1, 0.2, 0.4, 0.7)),
    ("equal_neighbours", (0.001, 0.005, 0.02, 0.05, 0.1, 0.2, 0.4)),
    ("distinct_share", (0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.75, 0.9)),
    ("repeated_lines", (0.01, 0.05, 0.1, 0.2, 0.4)),
    ("stop_share", (0.01, 0.03, 0.06, 0.1, 0.15, 0.25, 0.4)),
    ("word_length", (2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 10.0, 14.0)),
    ("words_per_line", (2.0, 5.0, 10.0, 20.0, 50.0, 150.0)),
)
_BOUNDS = [np.array(b) for _, b in CUTS]
N_FEATURES = sum(map(len, _BOUNDS))


def figures(text: str | None) -> tuple[float, ...]:
    """The figures of CUTS, in its order."""
    t = text or ""
    words = t.split()
    n = len(words)
    k = max(n, 1)
    lines = [x for x in t.split("\n") if x.strip()]
    chars = max(len(t), 1)
    return (
        n,
        (len(t) - len(t.translate(_SYMBOLS))) / k,
        t.count("|") / k,
        (t.count("!") + t.count("?")) / k,
        (len(t) - len(t.translate(_DIGITS))) / chars,
        sum(map(str.isupper, words)) / k,
        sum(map(eq, words, words[1:])) / k,
        len(set(words)) / k,
        (len(lines) - len(set(lines))) / max(len(lines), 1),
        sum(map(_STOP.__contains__, map(str.lower, words))) / k,
        sum(map(len, words)) / k,
        n / max(len(lines), 1),
    )


def features(texts: list[str | None]) -> np.ndarray:
    """One row of 0/1 features per text."""
    if not texts:
        return np.zeros((0, N_FEATURES), np.float32)
    f = np.array([figures(t) for t in texts])
    return np.concatenate([f[:, [j]] >= b for j, b in enumerate(_BOUNDS)], axis=1).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def _adam(grad, n: int, steps: int, rate: float) -> np.ndarray:
    w, m, v = np.zeros(n), np.zeros(n), np.zeros(n)
    for k in range(1, steps + 1):
        g = grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def estimate_prior(pos: np.ndarray, unl: np.ndarray, least_mass: float = 0.7) -> float:
    """The least ratio of unlabelled share to positive share over upper sets of a score that
    tells positives from unlabelled rows, over sets with ``least_mass`` of the positives.

    Each half of the rows is judged by a score learnt from the other, so that chance
    differences learnt by heart don't count.
    """

    def learnt(p: np.ndarray, u: np.ndarray) -> np.ndarray:
        def grad(w: np.ndarray) -> np.ndarray:
            gp = -p.T @ _sigmoid(-(p @ w)) / len(p)
            return gp + u.T @ _sigmoid(u @ w) / len(u) + 1e-3 * w

        return _adam(grad, p.shape[1], 200, 0.05)

    if min(len(pos), len(unl)) < 4:
        return 0.5
    found = []
    for k in (0, 1):
        w = learnt(pos[k::2], unl[k::2])
        sp, su = np.sort(pos[1 - k :: 2] @ w), np.sort(unl[1 - k :: 2] @ w)
        cut = np.unique(np.quantile(sp, np.linspace(0, 1 - least_mass, 51)))
        share_p = 1 - np.searchsorted(sp, cut) / len(sp)
        share_u = 1 - np.searchsorted(su, cut) / len(su)
        found.append((share_u / share_p).min())
    return float(np.clip(np.mean(found), 0.02, 0.98))


def fit(pos: list[str], unl: list[str], steps: int = 400, rate: float = 0.05, l2: float = 1e-3) -> Model:
    """Minimise the non-negative risk by full-batch Adam. Where the unlabelled part falls
    below zero, the step goes against it instead."""
    if not pos or not unl:
        return Model(np.zeros(N_FEATURES), 0.0, 0.5)
    one = lambda x: np.hstack([x, np.ones((len(x), 1), np.float32)])
    p, u = one(features(pos)).astype(np.float64), one(features(unl)).astype(np.float64)
    prior = estimate_prior(p, u)

    def grad(w: np.ndarray) -> np.ndarray:
        zp, zu = p @ w, u @ w
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_rest = u.T @ _sigmoid(zu) / len(u) - prior * (p.T @ _sigmoid(zp)) / len(p)
        g_pos = -prior * (p.T @ _sigmoid(-zp)) / len(p)
        return (g_pos + g_rest if rest >= 0 else -g_rest) + l2 * np.append(w[:-1], 0)

    w = _adam(grad, p.shape[1], steps, rate)
    return Model(w[:-1], float(w[-1]), prior)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> Model:
    """Positives: labelled good outside the held-out fold. Unlabelled: documents without any
    label; where there are none, all labelled documents outside the fold, label unseen."""
    known = labelled(labels, label)
    free = docs.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    free = free.join(labels.select("doc_id"), "doc_id", "left_anti").withColumn("y", F.lit(0))
    got = sample_texts(docs, known.where("y = 1").unionByName(free), {1: max_docs, 0: max_docs}, max_chars)
    pos, unl = ([t for t, y in got if y == k] for k in (1, 0))
    if pos and not unl:
        unl = [t for t, _ in sample_texts(docs, known.withColumn("y", F.lit(0)), {0: max_docs}, max_chars // 2)]
    return fit(pos, unl)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score, the probability of being good."""
    docs = small_batches(docs).drop("score")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = held.value.score(features(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
