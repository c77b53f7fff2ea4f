"""Toxicity and quality: held-out accuracy on a planted corpus, and the defined cases."""

import random
from zlib import crc32

import pytest

from tarnsift.llm import quality_pu, toxicity
from tests.llm.cases import docs, empty, prose

BAD = ["grolm", "vrexed", "snarfy", "blatzen"]


@pytest.fixture(scope="module")
def corpus(spark):
    rows, labels = [], []
    r = random.Random(5)
    for k in range(600):
        text = prose(k, r.randint(20, 120))
        toxic, junk = k % 5 == 0, k % 7 == 0
        if toxic:
            at = text.split(" ")
            for _ in range(2):
                at.insert(r.randrange(len(at)), r.choice(BAD) + r.choice(["", "er", "ing"]))
            text = " ".join(at)
        if junk:
            text = " ".join(w + r.choice(["###", "$$$", "%%%"]) for w in text.split())
        rows.append((k, text, "en", "s", len(text)))
        if k % 3:
            labels.append((k, int(not junk), int(toxic)))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held(i):
    return crc32(str(i).encode()) % 4 == 2


def test_toxicity_on_the_held_out_fold(corpus):
    rows = toxicity.op1(*corpus).collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    out = [(r.predicted, int(r.doc_id % 5 == 0)) for r in rows if r.held_out]
    assert sum(p == y for p, y in out) / len(out) > 0.95


def test_toxic_sentences_are_located(spark, corpus):
    model = toxicity.train(*corpus)
    df = docs(spark, [(1, "A quiet line. You grolm and blatzen grolm snarfy! Another quiet line.", "en", "s", 1)])
    found = toxicity.locate(df, model).collect()
    assert [(r.doc_id, r.sentence) for r in found] == [(1, 1)]


def test_labels_of_the_held_out_fold_are_not_read(spark, corpus):
    d, labels = corpus
    flipped = labels.selectExpr(
        "doc_id", *[f"IF(crc32(cast(doc_id AS string)) % 4 = 2, 1 - {c}, {c}) AS {c}" for c in ("quality", "toxic")]
    )
    for op in (toxicity.op1, quality_pu.op8):
        a, b = ({r.doc_id: r.score for r in op(d, x).collect()} for x in (labels, flipped))
        assert a == b


def test_quality_on_the_held_out_fold(corpus):
    rows = quality_pu.op8(*corpus).collect()
    out = [(r.predicted, int(r.doc_id % 7 != 0)) for r in rows if r.held_out]
    assert sum(p == y for p, y in out) / len(out) > 0.95
    assert all(r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.7) for r in rows)


def test_the_prior_is_near_the_share_of_good_documents(corpus):
    assert quality_pu.train(*corpus).prior == pytest.approx(6 / 7, abs=0.12)


@pytest.mark.parametrize("module", [toxicity, quality_pu])
def test_awkward_rows(spark, corpus, module):
    model = module.train(*corpus)
    df = docs(spark).selectExpr("*", "'x' AS score", "1 AS `odd name`")
    out = module.score(df, model)
    rows = out.collect()
    assert len(rows) == df.count() and all(r.score is not None and 0 <= r.score <= 1 for r in rows)
    assert "odd name" in out.columns and out.columns.count("score") == 1
    assert module.score(empty(spark), model).count() == 0


@pytest.mark.parametrize("op", [toxicity.op1, quality_pu.op8])
def test_without_labels(spark, op):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scores = [r.score for r in op(docs(spark), none).collect()]
    assert max(scores) - min(scores) < 1e-9
    assert op(empty(spark), none).count() == 0
