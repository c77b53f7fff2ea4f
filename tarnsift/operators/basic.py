"""Filters, counts, orders and de-duplication over documents, pages and entities."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filters(collection: str | None = None, category: str | None = None, document_ids: Sequence[int] | None = None, source_type: str | None = None) -> Column:
    """The conjunction of the conditions that are given; none gives true."""
    terms = [
        F.coalesce("collection", F.lit("default")) == collection if collection is not None else None,
        F.col("category") == category if category is not None else None,
        F.col("doc_id").isin(list(document_ids)) if document_ids is not None else None,
        F.col("source_type") == source_type if source_type is not None else None,
    ]
    return reduce(lambda a, b: a & b, [t for t in terms if t is not None], F.lit(True))


def all_of(carried: DataFrame, key: str, value: str, wanted: Sequence[str]) -> DataFrame:
    """Keys that carry every wanted value."""
    hits = carried.where(F.col(value).isin(list(wanted))).select(key, value).distinct()
    return hits.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == len(set(wanted))).select(key)


def contains(c: str, part: str) -> Column:
    return F.contains(F.lower(c), F.lit(part.lower()))


def any_term(name: str, aliases: str, terms: Sequence[str]) -> Column:
    """Whether any term is part of the name or of an alias."""
    hit = lambda x: reduce(lambda a, b: a | b, [F.contains(F.lower(x), F.lit(t)) for t in terms], F.lit(False))
    return F.coalesce(hit(F.col(name)), F.lit(False)) | F.coalesce(F.exists(aliases, hit), F.lit(False))


#: Characters of the pieces by which names and terms meet.
GRAM = 3


def _grams(size: int) -> Callable[[Column], Column]:
    """The pieces of ``size`` characters of a text; of size 0 the empty one."""

    def of(text: Column) -> Column:
        if not size:
            return F.array(F.lit(""))
        n = F.length(text) - (size - 1)
        every = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(size)))
        return F.when(n > 0, every).otherwise(F.array().cast("array<string>"))

    return of


def term_join(entities: DataFrame, terms: DataFrame) -> DataFrame:
    """Each entity (name, common_names) with each of ``terms`` (term) that is part of its name or
    of an alias, in any case.

    A term is looked for by one of its pieces of GRAM characters, the one that fewest names have (a
    shorter term by itself), so candidates are found by an equi-join, and are then compared.
    Entities of the same names are looked at once. Null terms and names are part of nothing; the
    empty term is part of every name.
    """
    names = F.transform(F.array_append(F.coalesce("common_names", F.array().cast("array<string>")), F.col("name")), F.lower)
    keyed = entities.withColumn("__names", F.array_compact(names))
    asked = terms.select(F.lower("term").alias("term")).where("term IS NOT NULL").distinct()
    size = F.least(F.length("term"), F.lit(GRAM))
    sizes = [r.n for r in asked.select(size.alias("n")).distinct().collect()]
    lists = keyed.select("__names").distinct()
    pieces = [F.flatten(F.transform("__names", _grams(k))) for k in sizes] or [F.array().cast("array<string>")]
    rows = lists.select("__names", F.explode(F.array_distinct(F.concat(*pieces))).alias("gram"))
    count = rows.groupBy("gram").agg(F.count("*").alias("n"))
    own = reduce(lambda c, k: c.when(size == k, _grams(k)(F.col("term"))), sizes, F.when(F.lit(False), F.array().cast("array<string>")))
    key = asked.select("term", F.explode(F.array_distinct(own)).alias("gram")).join(count, "gram", "left")
    # A piece that no name has comes first: such a term is part of none.
    key = key.groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), F.col("gram"))).alias("gram"))
    hits = rows.join(key, "gram").where(F.exists("__names", lambda x: F.contains(x, F.col("term")))).select("__names", "term")
    return keyed.join(hits, "__names").drop("__names")


def is_or_alias(value: str, key: str, aliases: str, title: str | None = None) -> Column:
    same = (F.col(key) == value) | F.coalesce(F.array_contains(aliases, value), F.lit(False))
    return same | (F.col(title) == value) if title else same


def collections(docs: DataFrame) -> DataFrame:
    return docs.groupBy(F.coalesce("collection", F.lit("default")).alias("collection")).agg(
        F.count("*").alias("document_count"), F.sum("page_count").cast("long").alias("total_pages")
    )


def placed(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df``, which a limit has cut to few rows, with each row's place in ``order``."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def mention_counts(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Every entity with the number of pages that mention it, counted before the join."""
    n = mentions.groupBy("entity_key").agg(F.countDistinct("page_id").alias("page_mentions"))
    return entities.join(n, "entity_key", "left").na.fill(0, ["page_mentions"])


def degrees(nodes: DataFrame, edges: DataFrame, key: str, name: str = "degree") -> DataFrame:
    return nodes.join(edges.groupBy(key).agg(F.count("*").alias(name)), key, "left").na.fill(0, [name])


def known_hashes(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """Of the asked file hashes those that exist, with their first document."""
    hits = docs.join(asked.select("file_hash").distinct(), "file_hash", "left_semi")
    return hits.groupBy("file_hash").agg(F.min("doc_id").alias("doc_id"))


def duplicate_groups(df: DataFrame, *keys: str) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return g.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("extras"))


def best_pages(pages: DataFrame, visual: str, embedded: str) -> DataFrame:
    """Of pages that share document and number, the one with most embeddings, then least id."""
    rank = 2 * F.col(visual).cast("int") + F.col(embedded).cast("int")
    w = Window.partitionBy("doc_id", "page_number").orderBy(rank.desc(), "page_id")
    return pages.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def paged(df: DataFrame, order: Sequence[Column | str], limit: int = 50, offset: int = 0, most: int = 500) -> DataFrame:
    if not 1 <= limit <= most or offset < 0:
        raise ValueError(f"limit must be 1 to {most} and offset 0 or more")
    return df.orderBy(*order).offset(offset).limit(limit)


def label_counts(tables: dict[str, DataFrame], pinned: Sequence[str] = ("Document", "Page")) -> DataFrame:
    """Rows per label: pinned labels first, then by count and name."""
    counts = [df.agg(F.lit(label).alias("label"), F.count("*").alias("n")) for label, df in tables.items()]
    # One row per label.
    rows = reduce(DataFrame.unionByName, counts)
    pin = reduce(lambda c, p: c.when(F.col("label") == p[1], p[0]), enumerate(pinned), F.when(F.lit(False), 0)).otherwise(len(pinned))
    w = Window.orderBy(pin, F.desc("n"), "label")
    return rows.withColumn("place", F.row_number().over(w))


def first_seen(lists: Sequence[DataFrame], key: str, rank: str) -> DataFrame:
    """The union of ranked lists with each key once, from the first list that has it."""
    rows = reduce(DataFrame.unionByName, [df.select(key, rank).withColumn("source", F.lit(k)) for k, df in enumerate(lists)])
    best = rows.groupBy(key).agg(F.min(F.struct("source", rank)).alias("b"))
    return best.select(key, "b.source", f"b.{rank}")


def sample_texts(chunks: DataFrame, pages: DataFrame, most: int = 10, longer: int = 100) -> DataFrame:
    """Per document its first chunks of more than ``longer`` characters; where it has none, its first pages."""
    from tarnsift.functions.clean import strip

    long = chunks.where(F.length("text") > longer)
    w = Window.partitionBy("doc_id").orderBy("page_number", "chunk_index")
    a = long.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).selectExpr("doc_id", "n", "text AS sample")
    rest = pages.where(F.length(strip(F.col("extracted_text"))) > longer).join(long.select("doc_id"), "doc_id", "left_anti")
    b = rest.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number"))).where(F.col("n") <= most)
    return a.unionByName(b.selectExpr("doc_id", "n", "extracted_text AS sample"))


def citation_offset(cited: DataFrame, sources: Sequence[int]) -> DataFrame:
    """Per answer the commonest offset from a cited page to the nearest source page, if it has
    two votes or more; ties go to the smaller offset."""
    near = F.array_min(F.transform(F.lit(sorted(sources)), lambda s: F.struct(F.abs(s - F.col("cited")).alias("d"), s.alias("page"))))
    votes = cited.groupBy("answer", (near["page"] - F.col("cited")).alias("o")).agg(F.count("*").alias("votes"))
    w = Window.partitionBy("answer").orderBy(F.desc("votes"), F.abs("o"), "o")
    top = votes.withColumn("n", F.row_number().over(w)).where("n = 1")
    return top.select("answer", F.when(F.col("votes") >= 2, F.col("o")).alias("page_offset"), "votes")
