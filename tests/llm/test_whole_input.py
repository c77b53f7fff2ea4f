"""Training-data operators over all of their input: no document is lost, no sample falls short."""

from collections import Counter

import corpus_pipeline
from tarnsift.llm import near_dedup, toxicity
from tests.llm.cases import prose


def test_near_dedup_keeps_different_texts_of_null_or_shared_ids(spark):
    a, b, c, d = (prose(50 + k, 60) for k in range(4))
    rows = [(None, a), (None, b), (None, b), (1, c), (1, d), (2, d), (None, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, near_dedup.keep_first(df).collect()), key=str)
    assert got == sorted([(None, a), (None, b), (1, c), (1, d)], key=str)


def test_pipeline_toxicity_fills_its_sample_from_documents_left(spark, tmp_path, monkeypatch):
    labels = [(k, k % 2, k % 2) for k in range(400)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(k, f"word {k}") for k in range(100)], "doc_id long, text string")
    monkeypatch.setattr(toxicity, "MAX_DOCS", {0: 20, 1: 20})
    seen = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda rows: seen.append(rows) or fit(rows))
    corpus_pipeline.clean(spark, docs, str(tmp_path))
    assert Counter(y for _, y in seen[0]) == {0: 20, 1: 20}
