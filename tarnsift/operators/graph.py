"""Property-graph operators over mention and edge tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnsift.functions.text import chain
from tarnsift.operators.basic import is_or_alias, mention_counts


def governed(entities: DataFrame, edges: DataFrame, targets: DataFrame, name: str, limit: int = 50) -> DataFrame:
    """Targets of the entities that ``name`` means, strongest edge first."""
    found = entities.where(is_or_alias(name, "name", "common_names")).select(F.col("entity_key").alias("src"))
    hits = edges.join(found, "src", "left_semi").join(targets, "dst")
    return hits.select("src", "dst", "code", "support_count").orderBy(F.desc("support_count"), "code", "src").limit(limit)


def governing(entities: DataFrame, edges: DataFrame, target: int, limit: int = 50) -> DataFrame:
    """Entities with an edge to ``target``."""
    hits = edges.where(F.col("dst") == target).join(entities.withColumnRenamed("entity_key", "src"), "src")
    return hits.select("src", "name", "support_count").orderBy(F.desc("support_count"), "name", "src").limit(limit)


def entity_card(entities: DataFrame, mentions: DataFrame, name: str) -> DataFrame:
    """One entity that ``name`` means, with its page mentions."""
    one = entities.where(is_or_alias(name, "name", "common_names")).orderBy("entity_key").limit(1)
    few = mentions.join(F.broadcast(one.select("entity_key")), "entity_key", "left_semi")
    return mention_counts(one, few)


def collected(nodes: DataFrame, edges: DataFrame, key: str, value: str, name: str, most: int | None = None) -> DataFrame:
    """``nodes`` with the sorted distinct values of their edges joined by ``|``; empty for none.
    The edges are gathered before the join, so several such lists don't multiply."""
    got = F.sort_array(F.collect_set(F.col(value)))
    got = F.slice(got, 1, most) if most else got
    lists = edges.groupBy(key).agg(F.array_join(got.cast("array<string>"), "|").alias(name))
    return nodes.join(lists, key, "left").withColumn(name, F.coalesce(name, F.lit("")))


def explore(edges: DataFrame, start: str, depth: int = 1, limit: int = 500) -> DataFrame:
    """node, path (edge types joined by ``>``) and distance of what is 1 to ``depth`` steps from
    ``start``, edges taken either way and each at most once in a path: the first ``limit`` by
    distance, node and path.

    ``edges``: src, dst, rel. It goes level by level and stops at the one that fills ``limit``, for
    nearer rows come first. From each end of a path only the first ``limit`` edges by node and type
    are followed (and ``depth`` more, as some may be used): a hub with more fills the limit by
    itself, so the ends that a further level starts from are no more than ``limit`` allows.
    """
    if not 1 <= depth <= 3:
        raise ValueError("depth must be 1 to 3")
    spark, kind = edges.sparkSession, edges.schema["src"].dataType.simpleString()
    one = edges.select("src", "dst", "rel", F.concat_ws("~", "src", "rel", "dst").alias("id"))
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel", "id"))
    schema = f"node {kind}, ids array<string>, path string"
    ends = spark.createDataFrame([(start, [], "")], schema)
    order = Window.partitionBy("src").orderBy("dst", "rel", "id")
    rows: list[tuple] = []
    for k in range(1, depth + 1):
        # ``limit`` paths at most end in other nodes, each by one of a few ways.
        near = both.join(F.broadcast(ends.select(F.col("node").alias("src")).distinct()), "src", "left_semi").distinct()
        near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit + depth)
        step = near.join(F.broadcast(ends), near["src"] == ends["node"]).where(~F.array_contains("ids", F.col("id")))
        path = F.when(F.col("path") == "", F.col("rel")).otherwise(F.concat_ws(">", "path", "rel"))
        step = step.select(F.col("dst").alias("node"), F.array_append("ids", F.col("id")).alias("ids"), path.alias("path"))
        found = step.where(F.col("node") != start).select("node", "path").distinct().orderBy("node", "path").limit(limit - len(rows))
        rows += [(r.node, r.path, k) for r in found.collect()]
        if len(rows) == limit or k == depth:
            break
        ends = spark.createDataFrame(step.distinct().collect(), schema)
    return spark.createDataFrame(rows, f"node {kind}, path string, distance int")


def two_hop(seeds: DataFrame, first: DataFrame, second: DataFrame, limit: int = 50) -> DataFrame:
    """Reasoning chains: seeds (name, label) over ``first`` (name, rel, hop, hop_label), and over
    ``second`` (hop, rel2, hop2, hop2_label) where it goes on."""
    one = seeds.join(first, "name").join(second, "hop", "left")
    cut = one.orderBy("name", "hop", F.asc_nulls_first("hop2")).limit(limit)
    text = chain(F.col("name"), F.col("label"), F.col("rel"), F.col("hop"), F.col("hop_label"), F.col("rel2"), F.col("hop2"), F.col("hop2_label"))
    return cut.select("name", "hop", "hop2", text.alias("chain"))


def seed_entities(mentions: DataFrame, pages: DataFrame, limit: int = 20) -> DataFrame:
    """The entities that most of ``pages`` mention."""
    hits = mentions.join(pages, "page_id", "left_semi").groupBy("entity_key").agg(F.countDistinct("page_id").alias("page_hits"))
    return hits.orderBy(F.desc("page_hits"), "entity_key").limit(limit)


def explore_pages(mentions: DataFrame, pages: DataFrame, edges: DataFrame, back: DataFrame, max_pages: int = 20) -> DataFrame:
    """Pages found from ``pages`` through the graph: those that mention a seed entity, then those
    that mention an entity reached by an edge and back (``edges`` src, dst; ``back`` dst, src2).

    page_id, reason (direct or discovered) and place; direct pages come first, cut to ``max_pages``.
    """
    seeds = seed_entities(mentions, pages).select("entity_key")
    direct = mentions.join(F.broadcast(seeds), "entity_key", "left_semi").select("page_id").distinct()
    direct = direct.orderBy("page_id").limit(2 * max_pages).withColumn("reason", F.lit("direct"))
    hops = edges.join(F.broadcast(seeds.withColumnRenamed("entity_key", "src")), "src", "left_semi").select("dst").distinct().orderBy("dst").limit(50)
    found = back.join(F.broadcast(hops), "dst", "left_semi").select(F.col("src2").alias("entity_key")).distinct()
    found = found.join(seeds, "entity_key", "left_anti").orderBy("entity_key").limit(20)
    hop_pages = mentions.join(F.broadcast(found), "entity_key", "left_semi").select("page_id").distinct().orderBy("page_id").limit(max_pages)
    rows = direct.unionByName(hop_pages.join(direct, "page_id", "left_anti").withColumn("reason", F.lit("discovered")))
    w = Window.orderBy(F.when(F.col("reason") == "direct", 0).otherwise(1), "page_id")
    # At most three times max_pages rows.
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max_pages)


def cross_references(edges: DataFrame, start: str, limit: int = 50) -> DataFrame:
    """src and dst of what ``start`` refers to, and of what that refers to in turn."""
    own = edges.where(F.col("src") == start).select("src", "dst")
    onward = edges.join(own.select(F.col("dst").alias("src")), "src").select("src", "dst")
    return onward.unionByName(own).orderBy("src", "dst").limit(limit)


def requirements(entities: DataFrame, edges: DataFrame, name: str, limit: int = 50) -> DataFrame:
    """The distinct targets of the entities that ``name`` means, joined by ``|``."""
    found = entities.where(is_or_alias(name, "name", "common_names")).select("entity_key", "name")
    mine = edges.withColumnRenamed("src", "entity_key").join(found.select("entity_key"), "entity_key", "left_semi")
    return collected(found, mine, "entity_key", "dst", "standards").orderBy("entity_key").limit(limit)


def page_entities(pages: DataFrame, mentions: dict[str, DataFrame], page_id: int, limit: int = 50) -> DataFrame:
    """A page with the entities of each kind that it mentions; ``mentions``: by kind, page_id and
    entity. Each kind is gathered by itself, so kinds don't multiply."""
    out = pages.where(F.col("page_id") == page_id).select("page_id", "page_number")
    for kind, edges in mentions.items():
        out = collected(out, edges.where(F.col("page_id") == page_id), "page_id", "entity", kind)
    return out.limit(limit)


def entity_pages(entities: DataFrame, mentions: DataFrame, pages: DataFrame, documents: DataFrame, name: str, limit: int = 50) -> DataFrame:
    """The pages that mention what ``name`` means, with their documents, by title and number."""
    found = entities.where(is_or_alias(name, "name", "common_names")).select("entity_key")
    hits = mentions.join(found, "entity_key", "left_semi").select("page_id", "context")
    both = hits.join(pages, "page_id").join(documents.select("doc_id", "title"), "doc_id")
    return both.select("doc_id", "title", "page_number", "context").orderBy("title", "page_number", "context").limit(limit)


#: Template, its required parameters; the service answers 400 without them.
TEMPLATES: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = {
    "material_standards": (governed, ("entities", "edges", "targets", "name")),
    "process_materials": (governing, ("entities", "edges", "target")),
    "standard_cross_references": (cross_references, ("edges", "start")),
    "material_properties": (entity_card, ("entities", "mentions", "name")),
    "equipment_requirements": (requirements, ("entities", "edges", "name")),
    "page_entities": (page_entities, ("pages", "mentions", "page_id")),
    "entity_pages": (entity_pages, ("entities", "mentions", "pages", "documents", "name")),
    "entity_explore": (explore, ("edges", "start")),
}


def template(query_type: str, parameters: dict, limit: int | None = None) -> DataFrame:
    """Dispatch by template name after a check of its parameters."""
    if query_type not in TEMPLATES:
        raise ValueError(f"unknown query_type {query_type}")
    run, required = TEMPLATES[query_type]
    if missing := [p for p in required if p not in parameters]:
        raise ValueError(f"missing parameters: {', '.join(missing)}")
    return run(**parameters, **({"limit": limit} if limit and query_type != "material_properties" else {}))
