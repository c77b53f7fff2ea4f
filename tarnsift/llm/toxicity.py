"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence gets a probability from a linear model over
hashed features of its words (the word and its leading 4, 5 and 6 characters, so inflected
forms share evidence); a document's score is their noisy-or, 1 - prod(1 - p). Only document
labels are used, and evidence never counts against: weights stay at zero or above, so a
sentence without offence stays near the low bias and long clean texts don't add up. The gradient
of the document's likelihood spreads over its sentences in proportion to their probabilities, so
the model learns by itself which sentences offend, and ``locate`` returns them.

Training takes a bounded sample (MAX_DOCS per class, MAX_CHARS in all; both are parameters)
to the driver. Scoring is one map stage over the scan with the weights broadcast (WEIGHTS
floats: a fixed size), no shuffle.

Defined cases: a null or empty text has no sentence and scores 0; repeated rows score alike; a
null doc_id scores like any other and is never trained on; a very long text is one row; without labels of both classes every score is below 1e-9; an empty table gives an empty result; further
columns pass through ``score``, except that columns named like its own are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnsift.llm.common import held_out, labelled, sample_texts, slices, small_batches

WEIGHTS = 1 << 18
PREFIXES = (4, 5, 6)
MAX_DOCS = {0: 3000, 1: 2000}
MAX_CHARS = 16_000_000
THRESHOLD = 0.3
#: Words that a worker keeps weighed; beyond it the memo starts anew.
MEMO = 300_000
SENTENCE = re.compile(r"[.!?\n]+")
EDGE = "\"'`.,;:!?()[]{}<>*#$%&|_-=+/\\~^«»“”‘’…"


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word; none for bare punctuation."""
    w = word.strip(EDGE)
    if not w:
        return []
    return [crc32(b"w" + w.encode("utf-8", "replace")) % WEIGHTS] + [
        crc32(f"{n}{w[:n]}".encode("utf-8", "replace")) % WEIGHTS for n in PREFIXES if len(w) > n
    ]


def sentences(text: str | None) -> list[str]:
    return [s for s in SENTENCE.split(text or "") if s.strip()]


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scorer(self):
        """A function from a sentence to its probability, with a bounded memo of words."""
        weights, bias = self.weights, self.bias

        class Memo(dict):
            def __missing__(self, word: str) -> float:
                if len(self) >= MEMO:
                    self.clear()
                x = self[word] = float(sum(weights[i] for i in features(word)))
                return x

        weigh = Memo().__getitem__

        def logit(sentence: str) -> float:
            return bias + sum(map(weigh, set(sentence.lower().split())))

        return logit


def fit(rows: list[tuple[str, int]], epochs: int = 80, rate: float = 0.15, l2: float = 1e-5, min_docs: int = 3) -> Model:
    """Maximise the noisy-or likelihood of document labels by full-batch Adam, with weights
    held at zero or above. A word counts once in a sentence."""
    if len({y for _, y in rows}) < 2:
        return Model(np.zeros(WEIGHTS, np.float32), -50.0)
    vocab: dict[str, int] = {}
    tokens: list[int] = []
    starts: list[int] = []
    bag: list[int] = []
    labels: list[int] = []
    for text, y in rows:
        for s in sentences(text.lower()):
            if ws := sorted(set(s.split())):
                starts.append(len(tokens))
                bag.append(len(labels))
                tokens.extend(vocab.setdefault(w, len(vocab)) for w in ws)
        labels.append(y)
    if not tokens:
        return Model(np.zeros(WEIGHTS, np.float32), -50.0)
    tok, at, of = np.array(tokens, np.int32), np.array(starts), np.array(bag)
    y = np.array(labels)
    # Features of each distinct word, filled up with a feature that weighs nothing.
    feats = np.full((len(vocab), 1 + len(PREFIXES)), WEIGHTS, np.int32)
    for w, k in vocab.items():
        f = features(w)
        feats[k, : len(f)] = f
    # Features of fewer than min_docs sample documents can't be learnt from.
    doc_of = np.repeat(of, np.diff(np.append(at, len(tok))))
    pairs = np.unique(doc_of.astype(np.int64) * len(vocab) + tok) % len(vocab)
    seen = np.bincount(feats[pairs].ravel(), minlength=WEIGHTS + 1)
    feats[seen[feats] < min_docs] = WEIGHTS
    b, bias = np.zeros(WEIGHTS + 1), -8.0
    m, v, mb, vb = np.zeros_like(b), np.zeros_like(b), 0.0, 0.0
    for step in range(1, epochs + 1):
        theta = b[feats].sum(1)
        z = np.clip(bias + np.add.reduceat(theta[tok], at), -30, 30)
        p = 1 / (1 + np.exp(-z))
        log_q = -np.bincount(of, np.logaddexp(0, z), minlength=len(y))
        q = np.exp(np.minimum(log_q, -1e-9))
        pull = np.where(y == 1, -q / (1 - q), 1.0)
        dz = pull[of] * p / len(y)
        g_word = np.bincount(tok, np.repeat(dz, np.diff(np.append(at, len(tok)))), minlength=len(vocab))
        g = np.bincount(feats.ravel(), np.repeat(g_word, feats.shape[1]), minlength=WEIGHTS + 1) + l2 * b
        g[WEIGHTS] = 0
        gb = dz.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
        b -= rate * (m / fix1) / (np.sqrt(v / fix2) + 1e-8)
        np.maximum(b, 0, out=b)
        bias -= rate * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-8)
    return Model(b[:WEIGHTS].astype(np.float32), float(bias))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: dict[int, int] | None = None, max_chars: int = MAX_CHARS) -> Model:
    return fit(sample_texts(docs, labelled(labels, label), most or MAX_DOCS, max_chars))


OWN = T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("worst_sentence", T.IntegerType()),
    T.StructField("worst_score", T.DoubleType()),
])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score (noisy-or of its sentences), worst_sentence (its index from 0,
    -1 for none) and worst_score (its probability)."""
    names = [f.name for f in OWN]
    docs = small_batches(docs).drop(*names)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logit = held.value.scorer()
        exp, log1p = np.exp, np.log1p
        for batch in slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                z = np.array([logit(s) for s in sentences(text)])
                if not len(z):
                    out.append((0.0, -1, 0.0))
                    continue
                z = np.clip(z, -700, 30)
                loss = np.where(z > 0, z + log1p(exp(-np.abs(z))), log1p(exp(np.minimum(z, 0)))).sum()
                k = int(z.argmax())
                out.append((float(-np.expm1(-loss)), k, float(1 / (1 + exp(-z[k])))))
            s, k, w = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(s, pa.float64()), pa.array(k, pa.int32()), pa.array(w, pa.float64())],
                names=[*batch.schema.names, *names],
            )

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *OWN.fields]))


def locate(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The offending sentences: doc_id, sentence (index), text, score >= ``least``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logit = held.value.scorer()
        for batch in slices(batches):
            found = [
                (i, k, s.strip(), p)
                for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
                for k, s in enumerate(sentences(text))
                if (p := 1 / (1 + np.exp(-min(30, max(-30, logit(s)))))) >= least
            ]
            cols = zip(*found, strict=True) if found else ((), (), (), ())
            kinds = (batch.schema.field("doc_id").type, pa.int32(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "sentence", "text", "score"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, sentence int, text string, score double")


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "worst_sentence",
        "worst_score",
    )
