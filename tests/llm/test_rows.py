"""Null and shared doc_ids and repeated rows in every operator; scores and fingerprints by brute force."""

import math
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest
import xxhash

from tarnsift.llm import bpe, packing, quality_pu, quality_rules, sharding, simhash, substring_dedup, token_store, toxicity, trie_dedup
from tests.llm.cases import awkward, docs, prose, words
from tests.llm.test_dedup import lower
from tests.llm.test_models import corpus  # noqa: F401  a fixture

A, B = prose(41, 60), prose(42, 60)
ROWS = [(None, A, "en", "s", 1), (None, A, "en", "s", 1), (5, A, "en", "s", 1), (5, A, "en", "s", 1), (5, B, "en", "s", 1), (None, None, None, None, None), (7, "", "en", "s", 0)]


def operators(labels):
    byte, word = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
    return {
        "op1": (lambda d: toxicity.op1(d, labels), ("score", "predicted")),
        "op2": (quality_rules.op2, ("n_words", "kept")),
        "op3": (lambda d: bpe.op3(d, byte), ("n_tokens", "ids_sha256", "decoded_sha256")),
        "op4": (simhash.op4, ("n_chars", "fingerprint")),
        "op5": (substring_dedup.op5, ("n_words",)),
        "op6": (lambda d: packing.op6(d, byte), ("length", "ids_crc32")),
        "op7": (lambda d: token_store.op7(d, word), ("n_tokens", "ids_crc32")),
        "op8": (lambda d: quality_pu.op8(d, labels), ("score", "predicted")),
        "op9": (sharding.op9, ()),
        "op10": (trie_dedup.op10, ("fingerprint", "component_id")),
    }


@pytest.mark.parametrize("name", [f"op{k}" for k in range(1, 11)])
def test_null_and_shared_ids_and_repeated_rows(spark, name):
    labels = spark.createDataFrame([(5, 1, 0), (7, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    op, same = operators(labels)[name]
    rows = op(docs(spark, ROWS)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, *_ in ROWS)
    # One value for text A (four rows), one for B, one for no text (two rows).
    if same:
        n = sorted(Counter(tuple(r[c] for c in same) for r in rows).values())
        assert sum(n) == 7 and max(n) >= 4 and len(n) <= 3


def test_scores_are_the_noisy_or_of_sentences(spark, corpus):  # noqa: F811
    model = toxicity.train(*corpus)

    def score(text):
        left = 1.0
        for s in toxicity.sentences(text):
            z = model.bias
            for w in set(s.lower().split()):
                z += sum(float(model.weights[i]) for i in toxicity.features(w))
            left *= 1 - 1 / (1 + math.exp(-max(min(z, 30), -700)))
        return 1 - left

    d = corpus[0].unionByName(docs(spark))
    text = {r.doc_id: r.text for r in d.collect()}
    got = toxicity.score(d, model).collect()
    assert len(got) == d.count()
    assert [r.score for r in got] == pytest.approx([score(r.text) for r in got], abs=1e-6)
    by_query = {r.doc_id: r.score for r in toxicity.op1(*corpus).collect()}
    assert all(s == pytest.approx(score(text[i]), abs=1e-6) for i, s in by_query.items() if i % 10)


def test_quality_scores_are_the_logistic_of_the_cut_figures(corpus):  # noqa: F811
    model = quality_pu.train(*corpus)
    at = [(k, b) for k, (_, bounds) in enumerate(quality_pu.CUTS) for b in bounds]
    text = {r.doc_id: r.text for r in corpus[0].collect()}
    for r in quality_pu.op8(*corpus).collect():
        f = quality_pu.figures(text[r.doc_id])
        z = model.bias + sum(float(w) for (k, b), w in zip(at, model.weights, strict=True) if f[k] >= b)
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(min(z, 30), -30))), abs=1e-6)


def test_the_quality_model_minimises_its_risk(corpus):  # noqa: F811
    """No weight or bias moved a little lowers the non-negative risk by much."""
    text = {r.doc_id: r.text for r in corpus[0].collect()}
    pos = [t for i, t in text.items() if i % 7 and i % 3]
    unl = [t for i, t in text.items() if i % 3 == 0]
    model = quality_pu.fit(pos, unl)
    p, u = quality_pu.features(pos), quality_pu.features(unl)

    def risk(w, b):
        loss = lambda x, sign: float((1 / len(x)) * sum(math.log1p(math.exp(-sign * max(min(z, 30), -30))) for z in x @ w + b))
        rest = loss(u, -1) - model.prior * loss(p, -1)
        return model.prior * loss(p, 1) + max(0.0, rest) + 5e-4 * float(w @ w)

    least = risk(model.weights, model.bias)
    assert all(risk(model.weights, model.bias + d) > least - 0.01 for d in (-2, -0.5, 0.5, 2))
    assert risk(model.weights * 0.5, model.bias) > least - 0.01 and risk(model.weights * 0, 0.0) > least


def test_fingerprints_are_weighted_votes(spark):
    def bits(text, half):
        w = words(lower(text))
        terms = list(zip(w, w[1:])) if len(w) > 1 else [(x,) for x in w]
        ones, total = [0] * 64, 0
        for t in terms:
            h = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42) if half else 42
            for x in t:
                h = xxhash.xxh64_intdigest(x.encode(), h)
            weight = sum(map(len, t))
            total += weight
            for k in range(64):
                ones[k] += weight * (h >> k & 1)
        return sum(1 << k for k in range(64) if 2 * ones[k] > total)

    got = {r.doc_id: r.fingerprint for r in simhash.op4(docs(spark)).collect()}
    assert got == {i: f"{bits(t, 1):016x}{bits(t, 0):016x}" for i, t, *_ in awkward()}


def test_one_sampled_doc_id_may_have_any_number_of_rows(spark):
    from tarnsift.llm.common import sample_texts

    d = spark.createDataFrame([(1, f"{k} " + "x" * 1000) for k in range(500)] + [(2, None), (2, None), (3, "y")], "doc_id long, text string")
    ids = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, y int")
    got = sample_texts(d, ids, {1: 3, 0: 3}, 5_000)
    assert sum(y == 1 for _, y in got) <= 3 and sum(len(t) for t, _ in got) <= 5_000 and ("y", 0) in got


def test_nothing_stays_in_the_shared_folder_but_what_results_read(spark):
    base = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    base.mkdir(exist_ok=True)
    for name, (op, _) in operators(spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int")).items():
        had = set(base.iterdir())
        op(docs(spark, ROWS)).collect()
        left = {p.name for d in set(base.iterdir()) - had for p in d.iterdir() if not p.name.startswith(".")}
        assert left <= {"made", "done-first", "done-again", "leaves", "moved1", "lengths", "segments", "fingerprints", "rooted"}, name
