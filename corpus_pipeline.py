"""A corpus pipeline of the training-data operators: each stage works on what the last kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsift.llm import near_dedup, packing, quality_rules, substring_dedup, toxicity
from tarnsift.llm.common import drop, shared_dir, stage, table
from tarnsift.llm.queries import tokenizer


def where_kept(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], kept: Column) -> DataFrame:
    """The rows of ``docs`` that ``kept`` takes of what ``judge`` adds; columns other than text
    are out of the way by then, so none clashes with what is added."""
    names = [c if c == "text" else f"__column{k}" for k, c in enumerate(docs.columns)]
    return judge(docs.toDF(*names)).where(kept).select(*names).toDF(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table keeps. A null or empty text has no words and goes;
    repeated rows, and rows that share a doc_id or have none, are judged one by one; a text is
    judged whole however long; further columns stay, whatever their names."""
    return where_kept(docs, quality_rules.apply_rules, F.col("kept"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold, by a model of the labels outside the
    held-out fold. A null or empty text scores 0 and stays; repeated rows, and rows that share a
    doc_id or have none, are judged one by one; without labels of both classes all stay."""
    # The sample's bounds count only labels of documents that are still there.
    labels = table(spark, sf_dir, "labels").join(docs.select("doc_id"), "doc_id", "left_semi")
    model = toxicity.train(docs, labels)
    return where_kept(docs, lambda d: toxicity.score(d, model), F.col("score") < toxicity.THRESHOLD)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near texts, of similarity 0.8 or more in five-word shingles:
    the one of least doc_id, null last. Rows are told apart by doc_id and text; empty and null
    texts are one group; equal rows are one."""
    return near_dedup.keep_first(docs).select(*docs.columns)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the words of passages that an earlier one has; n_chars follows.
    A null or empty text stays as it is; rows that share a doc_id, or have none, are parts of one
    document, and equal rows among them lose the same; shorter texts than a window lose nothing."""
    left = substring_dedup.rewrite(docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences: a null or empty text is its end
    id alone, equal rows are packed each by itself, longer texts than a sequence are cut."""
    return packing.op6(docs, tokenizer("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("toxicity", clean),
    ("simhash_near_dedup", distinct),
    ("substring_dedup", unrepeated),
    ("best_fit_packing", packed),
]

#: Learned scores, XXH64 and tokenisation have no SQL: tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; each is written as Parquet and read again."""
    docs, base = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (name, step) in enumerate(STAGES):
        docs = stage(step(spark, docs, sf_dir), f"{base}/{k}-{name}")
        if k:
            drop(spark, f"{base}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
