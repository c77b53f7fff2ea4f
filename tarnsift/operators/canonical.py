"""Entity canonicalisation: a plan of merges, and its application to nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnsift.functions.clean import canonical


def plan(nodes: DataFrame, mentions: DataFrame, label: str = "Material", min_mentions: int = 0, key: Column | None = None) -> DataFrame:
    """Groups of distinct names with one canonical form: canonical, winner, losers (sorted),
    total_mentions and conflicts (how many values the group's uns_number has beyond one).

    ``nodes``: entity_key, name, uns_number; ``mentions``: entity_key, page_id. The winner has
    most mentions, then equals the canonical form, then comes first by name. ``key`` replaces
    the canonical form.
    """
    n = mentions.groupBy("entity_key").agg(F.countDistinct("page_id").alias("m"))
    form = key if key is not None else canonical(F.col("name"), label)
    rows = nodes.join(n, "entity_key", "left").select(
        form.alias("canonical"), "name", "uns_number", F.coalesce("m", F.lit(0).cast("long")).alias("m")
    )
    names = rows.groupBy("canonical", "name").agg(F.sum("m").alias("m"))
    w = Window.partitionBy("canonical").orderBy(F.desc("m"), (F.col("name") == F.col("canonical")).desc(), "name")
    ranked = names.withColumn("k", F.row_number().over(w))
    groups = ranked.groupBy("canonical").agg(
        F.count("*").alias("n"), F.max(F.when(F.col("k") == 1, F.col("name"))).alias("winner"),
        F.sort_array(F.collect_set(F.when(F.col("k") > 1, F.col("name")))).alias("losers"), F.sum("m").alias("total_mentions"),
    )
    uns = rows.groupBy("canonical").agg((F.countDistinct("uns_number") - 1).alias("conflicts"))
    merged = groups.where((F.col("n") > 1) & (F.col("total_mentions") >= min_mentions) & (F.col("canonical") != ""))
    return merged.join(uns, "canonical").select("canonical", "winner", "losers", "total_mentions", "conflicts")


def mapping(planned: DataFrame) -> DataFrame:
    """loser and winner names."""
    return planned.select(F.explode("losers").alias("loser"), "winner")


def missing(planned: DataFrame, nodes: DataFrame) -> DataFrame:
    """Names of the plan that the graph doesn't have: a plan with any is stale."""
    names = planned.select(F.explode(F.array_append("losers", F.col("winner"))).alias("name")).distinct()
    return names.join(nodes.select("name"), "name", "left_anti")


def vote(nodes: DataFrame, mentions: DataFrame, group: str, value: str) -> DataFrame:
    """Per group the value with most weight, a node's weight being its mentions or one; ties go
    to the value of the earliest node."""
    n = mentions.groupBy("entity_key").agg(F.countDistinct("page_id").alias("m"))
    rows = nodes.join(n, "entity_key", "left").where(F.col(value).isNotNull())
    weight = F.greatest(F.coalesce("m", F.lit(0)), F.lit(1))
    sums = rows.groupBy(group, value).agg(F.sum(weight).alias("weight"), F.min("entity_key").alias("first"))
    w = Window.partitionBy(group).orderBy(F.desc("weight"), "first")
    return sums.withColumn("k", F.row_number().over(w)).where("k = 1").select(group, value, "weight")


def merge_nodes(nodes: DataFrame, merges: DataFrame, rename: DataFrame | None = None) -> DataFrame:
    """name and aliases of the nodes left: losers go, and their names join the winner's
    aliases. ``rename``: winner and canonical, for plans that rename winners too."""
    to = nodes.select("name").distinct().join(merges, F.col("name") == F.col("loser"), "left")
    rows = to.select(F.coalesce("winner", "name").alias("winner"), F.when(F.col("winner").isNotNull(), F.col("name")).alias("alias"))
    left = rows.groupBy("winner").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
    if rename is not None:
        left = left.join(rename, "winner", "left").withColumn("winner", F.coalesce("canonical", "winner")).drop("canonical")
    return left.withColumnRenamed("winner", "name")


def redirect(edges: DataFrame, merges: DataFrame, end: str, preserve: bool) -> DataFrame:
    """``edges`` (src, dst, support_count, context) with losers at ``end`` replaced by winners.

    Redirected edges that then coincide become one. ``preserve`` sums support and keeps the
    least context, as for outgoing edges; without it a redirected edge has neither, as for
    incoming ones, unless the winner had the edge already.
    """
    j = edges.join(merges, edges[end] == merges["loser"], "left")
    moved = F.col("winner").isNotNull()
    ends = {c: (F.coalesce("winner", c) if c == end else F.col(c)).alias(c) for c in ("src", "dst")}
    if preserve:
        own = [F.col("support_count"), F.col("context")]
    else:
        own = [F.when(~moved, F.col(c)).alias(c) for c in ("support_count", "context")]
    rows = j.select(*ends.values(), *[c.alias(n) for c, n in zip(own, ("support_count", "context"), strict=True)])
    return rows.groupBy("src", "dst").agg(F.sum("support_count").alias("support_count"), F.min("context").alias("context"))
