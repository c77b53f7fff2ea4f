"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnsift.llm import (
    bpe,
    conversation_trie,
    fill_middle,
    license_scan,
    packing,
    quality_pu,
    quality_rules,
    sharding,
    simhash,
    substring_dedup,
    token_store,
    toxicity,
    trie_dedup,
)
from tarnsift.llm.common import table


def tokenizer(name: str) -> str:
    """Where the installed package of public vocabulary files has ``name``."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op1(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op2(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op3(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op4(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.op5(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op6(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.op7(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_pu.op8(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op9(table(spark, sf_dir, "documents"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_dedup.op10(table(spark, sf_dir, "documents"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.op11(table(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.op12(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.op13(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_toxicity,
        op2_quality_rules,
        op3_bpe,
        op4_fingerprints,
        op5_substring_dedup,
        op6_packing,
        op7_token_store,
        op8_quality_classifier,
        op9_sharding,
        op10_simhash_dedup,
        op11_license_scan,
        op12_fill_middle,
        op13_conversation_trie,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": quality_rules.sql(),
        "op5_substring_dedup": substring_dedup.sql(),
        "op12_fill_middle": fill_middle.sql(),
    }
