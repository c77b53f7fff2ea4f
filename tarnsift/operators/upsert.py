"""Upserts: each merges old and new rows into a new version whose key is unique."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assert_unique(df: DataFrame, *key: str) -> DataFrame:
    """``df``, once it is known that no key repeats."""
    again = df.groupBy(*key).count().where("count > 1").limit(1).count()
    if again:
        raise ValueError(f"{', '.join(key)} is not unique")
    return df


def register(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Documents by file_hash: those that exist keep their doc_id, others are added once."""
    new = incoming.join(existing.select("file_hash"), "file_hash", "left_anti")
    new = new.groupBy("file_hash").agg(F.min("doc_id").alias("doc_id"))
    old = existing.groupBy("file_hash").agg(F.min("doc_id").alias("doc_id"))
    return old.withColumn("added", F.lit(False)).unionByName(new.withColumn("added", F.lit(True)))


def missing_pages(pages: DataFrame, existing: DataFrame) -> DataFrame:
    """Pages of documents that have none yet."""
    return pages.join(existing.select("doc_id"), "doc_id", "left_anti")


def repaired(old: Column, new: Column) -> Column:
    """An enum on match: ``unknown`` and ``other`` give way to the new value. A null stays, since
    the test against a list with a null isn't true for it."""
    return F.when(old.isin("unknown", "other"), F.coalesce(new, old)).otherwise(old)


def nodes(old: DataFrame, new: DataFrame, key: str, enum: str, value: str, alias: str) -> DataFrame:
    """Nodes merged by ``key``: enum repaired, first value that isn't null, aliases united (sorted)."""
    o = old.select(key, F.col(enum).alias("oe"), F.col(value).alias("ov"), F.col(alias).alias("oa"), F.lit(True).alias("o"))
    n = new.select(key, F.col(enum).alias("ne"), F.col(value).alias("nv"), F.col(alias).alias("na"))
    both = o.join(n, key, "full")
    none = F.array().cast("array<string>")
    return both.select(
        key, F.when(F.col("o"), repaired(F.col("oe"), F.col("ne"))).otherwise(F.col("ne")).alias(enum),
        F.coalesce("ov", "nv").alias(value),
        F.sort_array(F.array_union(F.coalesce("oa", none), F.coalesce("na", none))).alias(alias),
    )


def union_tags(old: DataFrame, new: DataFrame, key: str, tags: str) -> DataFrame:
    n = new.select(key, F.col(tags).alias("__new"))
    none = F.array().cast("array<string>")
    both = old.select(key, tags).join(n, key, "full")
    return both.select(key, F.sort_array(F.array_union(F.coalesce(tags, none), F.coalesce("__new", none))).alias(tags))


def edges(old: DataFrame, new: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges (src, dst, support_count, context) added up; new ones need both ends. The context of
    an old edge stays, else the least of the new."""
    ok = new.join(sources, "src", "left_semi").join(targets, "dst", "left_semi")
    rows = old.withColumn("age", F.lit(0)).unionByName(ok.withColumn("age", F.lit(1)))
    first = F.min(F.when(F.col("context").isNotNull(), F.struct("age", "context")))["context"]
    return rows.groupBy("src", "dst").agg(F.sum("support_count").alias("support_count"), first.alias("context"))


def chunks(old: DataFrame, new: DataFrame, kept: Sequence[str] = ("page_number", "chunk_index"), replaced: Sequence[str] = ("text",)) -> DataFrame:
    """Chunks by chunk_id: on match ``kept`` columns stay and ``replaced`` ones are the new. Of rows
    that share an id the least counts, so ids are unique."""
    cols = [*kept, *replaced]
    one = lambda df: df.groupBy("chunk_id").agg(F.min(F.struct(*cols)).alias("c")).select("chunk_id", "c.*")
    n = one(new).withColumnsRenamed({c: f"n_{c}" for c in cols})
    both = one(old).join(n, "chunk_id", "full")
    a = [F.coalesce(c, f"n_{c}").alias(c) for c in kept]
    return both.select("chunk_id", *a, *[F.coalesce(f"n_{c}", c).alias(c) for c in replaced])


def dedup_pages(pages: DataFrame, visual: str, embedded: str, dependents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The best page of each (document, number), and the dependents (page_id, ...) of pages left."""
    from tarnsift.operators.basic import best_pages

    kept = best_pages(pages, visual, embedded)
    return kept, dependents.join(kept.select("page_id"), "page_id", "left_semi")


def apply_tags(old: DataFrame, new: DataFrame, mode: str = "merge") -> DataFrame:
    """(doc_id, tag) rows: ``merge`` adds to what a document has, ``replace`` takes its place."""
    if mode not in ("merge", "replace"):
        raise ValueError("mode is merge or replace")
    rest = old if mode == "merge" else old.join(new.select("doc_id"), "doc_id", "left_anti")
    return rest.select("doc_id", "tag").unionByName(new.select("doc_id", "tag")).distinct()


def tagged_collection(docs: DataFrame, proposed: DataFrame, overwrite: bool = False) -> DataFrame:
    """Bulk tagging sets a collection only where it is the default, unless told to overwrite."""
    both = docs.join(proposed.select("doc_id", F.col("collection").alias("__new")), "doc_id", "left")
    free = F.coalesce("collection", F.lit("default")) == "default"
    take = F.col("__new").isNotNull() & (F.lit(overwrite) | free)
    return both.withColumn("collection", F.when(take, F.col("__new")).otherwise(F.col("collection"))).drop("__new")


def delete_documents(ids: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the documents; chunks go with their document."""
    return {name: df.join(ids, "doc_id", "left_anti") for name, df in tables.items()}


def clear_when(df: DataFrame, column: str, when: Column) -> DataFrame:
    return df.withColumn(column, F.when(~when, F.col(column)))


def backfill(df: DataFrame, column: str, value: Column) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), value))


def first_seen(df: DataFrame, key: str, *order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def create_names(existing: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """Categories or tags with ``names`` added, each once."""
    new = existing.sparkSession.createDataFrame([(n,) for n in names], f"{key} string")
    return existing.select(key).unionByName(new).distinct()


def delete_names(existing: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    return existing.where(~F.col(key).isin(list(names)))
