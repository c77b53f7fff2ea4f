"""Upserts, canonicalisation, cleanup and jobs as queries, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsift.functions import clean as C
from tarnsift.operators import canonical as K
from tarnsift.operators import jobs as J
from tarnsift.operators import schema as H
from tarnsift.operators import upsert as U
from tarnsift.plans.registry import query
from tarnsift.plans.relational import _CLASSIFY, _QTY, canonical_sql, strip_sql
from tarnsift.sources import fixtures as S
from tarnsift.sources.tables import table
from tarnsift.streaming.incremental import first_files, sessions


@query("""
WITH o AS (SELECT * FROM v_document WHERE doc_id % 3 = 0), n AS (SELECT * FROM v_document WHERE doc_id % 3 > 0)
SELECT file_hash, min(doc_id) AS doc_id, false AS added FROM o GROUP BY 1
UNION ALL SELECT file_hash, min(doc_id), true FROM n WHERE file_hash NOT IN (SELECT file_hash FROM o) GROUP BY 1""")
def m1_register(spark: SparkSession, d: str) -> DataFrame:
    docs = S.document(spark, d).select("doc_id", "file_hash")
    return U.register(docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 > 0"))


@query("SELECT doc_id, page_number FROM v_page WHERE doc_id NOT IN (SELECT doc_id FROM v_page WHERE doc_id % 4 = 0 AND page_number = 1)")
def m2_missing_pages(spark: SparkSession, d: str) -> DataFrame:
    p = S.page(spark, d).select("doc_id", "page_number")
    return U.missing_pages(p, p.where("doc_id % 4 = 0 AND page_number = 1"))


_NODE = """
n AS (SELECT name, CASE entity_key % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN NULL ELSE material_type END AS kind,
  CASE WHEN entity_key % 7 > 0 THEN uns_number END AS uns, entity_key, 'alias ' || entity_key AS alias FROM v_variant),
f AS (SELECT *, row_number() OVER (PARTITION BY name, {0} ORDER BY entity_key) AS k FROM n)"""


def node_rows(spark: SparkSession, d: str) -> DataFrame:
    return S.variant(spark, d).selectExpr(
        "name", "CASE entity_key % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN NULL ELSE material_type END AS kind",
        "CASE WHEN entity_key % 7 > 0 THEN uns_number END AS uns", "entity_key", "array('alias ' || entity_key) AS aliases",
    )


@query(f"""
WITH {_NODE.format('entity_key < 300')},
o AS (SELECT * FROM f WHERE k = 1 AND entity_key < 300), w AS (SELECT * FROM f WHERE k = 1 AND entity_key >= 300)
SELECT coalesce(o.name, w.name) AS name, CASE WHEN o.name IS NULL THEN w.kind WHEN o.kind IN (NULL, 'unknown', 'other') THEN coalesce(w.kind, o.kind) ELSE o.kind END AS kind,
  coalesce(o.uns, w.uns) AS uns, array_to_string(list_sort(list_filter([o.alias, w.alias], lambda x: x IS NOT NULL)), '|') AS aliases
FROM o FULL JOIN w ON o.name = w.name""")
def m3_entity_upsert(spark: SparkSession, d: str) -> DataFrame:
    n = node_rows(spark, d)
    old = U.first_seen(n.where("entity_key < 300"), "name", "entity_key")
    new = U.first_seen(n.where("entity_key >= 300"), "name", "entity_key")
    return U.nodes(old, new, "name", "kind", "uns", "aliases").withColumn("aliases", F.array_join("aliases", "|"))


@query("""
SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, array_to_string(list_sort(list_distinct(list_concat(
  CASE WHEN o.p_partkey IS NULL THEN [] ELSE [o.p_type, 'old'] END, CASE WHEN n.p_partkey IS NULL THEN [] ELSE [n.p_type, n.p_brand] END))), '|') AS tags
FROM (SELECT * FROM part WHERE p_partkey % 3 > 0) o FULL JOIN (SELECT * FROM part WHERE p_partkey % 2 > 0) n ON o.p_partkey = n.p_partkey""")
def m5_tag_union(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    old = p.where("p_partkey % 3 > 0").selectExpr("p_partkey", "array(p_type, 'old') AS tags")
    new = p.where("p_partkey % 2 > 0").selectExpr("p_partkey", "array(p_type, p_brand) AS tags")
    return U.union_tags(old, new, "p_partkey", "tags").withColumn("tags", F.array_join("tags", "|"))


@query("""
WITH o AS (SELECT l_partkey AS src, l_suppkey AS dst, count(*) AS support_count, min(l_returnflag) AS context, 0 AS age FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1, 2),
n AS (SELECT l_partkey AS src, l_suppkey AS dst, count(*) AS support_count, min(l_linestatus) AS context, 1 AS age FROM lineitem
  WHERE l_orderkey % 2 = 1 AND l_partkey % 10 < 8 AND l_suppkey % 10 > 0 GROUP BY 1, 2)
SELECT src, dst, sum(support_count)::BIGINT AS support_count, (list(context ORDER BY age, context))[1] AS context FROM (FROM o UNION ALL FROM n) GROUP BY 1, 2""")
def m6_edge_upsert(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumnsRenamed({"l_partkey": "src", "l_suppkey": "dst"})
    cut = lambda rows, c: rows.groupBy("src", "dst").agg(F.count("*").alias("support_count"), F.min(c).alias("context"))
    old, new = cut(li.where("l_orderkey % 2 = 0"), "l_returnflag"), cut(li.where("l_orderkey % 2 = 1"), "l_linestatus")
    sources = table(spark, d, "part").where("p_partkey % 10 < 8").selectExpr("p_partkey AS src")
    targets = table(spark, d, "supplier").where("s_suppkey % 10 > 0").selectExpr("s_suppkey AS dst")
    return U.edges(old, new, sources, targets)


@query("""
WITH c AS (SELECT chunk_id, page_number, chunk_index, text, row_number() OVER (PARTITION BY chunk_id, page_number < 4, page_number > 2 ORDER BY page_number, chunk_index, text) AS k FROM v_chunk),
o AS (SELECT * FROM c WHERE page_number < 4 AND k = 1), n AS (SELECT chunk_id, page_number + 1 AS page_number, chunk_index + 1 AS chunk_index, text || '!' AS text FROM c WHERE page_number > 2 AND k = 1)
SELECT coalesce(o.chunk_id, n.chunk_id) AS chunk_id, coalesce(o.page_number, n.page_number) AS page_number,
  coalesce(o.chunk_index, n.chunk_index) AS chunk_index, coalesce(n.text, o.text) AS text FROM o FULL JOIN n ON o.chunk_id = n.chunk_id""")
def m7_chunk_upsert(spark: SparkSession, d: str) -> DataFrame:
    c = S.chunk(spark, d).select("chunk_id", "page_number", "chunk_index", "text")
    old = c.where("page_number < 4")
    new = c.where("page_number > 2").select("chunk_id", (F.col("page_number") + 1).alias("page_number"), (F.col("chunk_index") + 1).alias("chunk_index"), F.concat("text", F.lit("!")).alias("text"))
    return U.chunks(old, new)


_NAMES = """
c AS (SELECT {key} AS canonical, v.name, v.uns_number, coalesce(m, 0) AS m FROM v_variant v
  LEFT JOIN (SELECT entity_key, count(DISTINCT page_id) AS m FROM v_mention GROUP BY 1) x USING (entity_key)),
n AS (SELECT canonical, name, sum(m)::BIGINT AS m FROM c GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY m DESC, name = canonical DESC, name) AS k FROM n),
p AS (SELECT canonical, max(CASE WHEN k = 1 THEN name END) AS winner, list_sort(list(name) FILTER (k > 1)) AS losers, sum(m)::BIGINT AS total_mentions
  FROM r GROUP BY 1 HAVING count(*) > 1 AND canonical <> ''),
u AS (SELECT canonical, count(DISTINCT uns_number) - 1 AS conflicts FROM c GROUP BY 1)"""
_PLAN = _NAMES.format(key=canonical_sql("v.name", "Equipment"))
_MERGES = "g AS (SELECT unnest(losers) AS loser, winner FROM p)"


def planned(spark: SparkSession, d: str) -> DataFrame:
    return K.plan(S.variant(spark, d), S.mention(spark, d), "Equipment")


@query(f"WITH {_PLAN} SELECT canonical, winner, array_to_string(losers, '|') AS losers, total_mentions, conflicts FROM p JOIN u USING (canonical)")
def m8_plan(spark: SparkSession, d: str) -> DataFrame:
    return planned(spark, d).withColumn("losers", F.array_join("losers", "|"))


@query(f"""
WITH {_PLAN}, {_MERGES}, t AS (SELECT DISTINCT v.name, g.winner FROM v_variant v LEFT JOIN g ON g.loser = v.name)
SELECT coalesce(winner, name) AS name, coalesce(array_to_string(list_sort(list(name) FILTER (winner IS NOT NULL)), '|'), '') AS aliases FROM t GROUP BY 1""")
def m9_apply_nodes(spark: SparkSession, d: str) -> DataFrame:
    left = K.merge_nodes(S.variant(spark, d), K.mapping(planned(spark, d)))
    return left.select("name", F.array_join("aliases", "|").alias("aliases"))


@query(f"""
WITH {_PLAN}, {_MERGES}, e AS (SELECT v.name AS src, dst::VARCHAR AS dst, support_count, 'c' || dst % 3 AS context FROM v_governed_by JOIN v_variant v ON v.entity_key = v_governed_by.src),
z AS (SELECT coalesce(winner, src) AS src, dst, support_count, context FROM e LEFT JOIN g ON g.loser = e.src)
SELECT src, dst, sum(support_count)::BIGINT AS support_count, min(context) AS context FROM z GROUP BY 1, 2""")
def m9_apply_edges(spark: SparkSession, d: str) -> DataFrame:
    v = S.variant(spark, d).select(F.col("entity_key").alias("src"), "name")
    e = S.governed_by(spark, d).join(v, "src").selectExpr("name AS src", "string(dst) AS dst", "support_count", "'c' || dst % 3 AS context")
    return K.redirect(e, K.mapping(planned(spark, d)), "src", preserve=True)


@query(f"""
WITH {_PLAN}, {_MERGES}, e AS (SELECT page_id AS src, v.name AS dst, support_count, context FROM v_mention JOIN v_variant v USING (entity_key)),
z AS (SELECT src, coalesce(winner, dst) AS dst, CASE WHEN winner IS NULL THEN support_count END AS support_count, CASE WHEN winner IS NULL THEN context END AS context
  FROM e LEFT JOIN g ON g.loser = e.dst)
SELECT src, dst, coalesce(sum(support_count), 0)::BIGINT AS support_count, coalesce(min(context), '') AS context FROM z GROUP BY 1, 2""")
def m9_apply_mentions(spark: SparkSession, d: str) -> DataFrame:
    v = S.variant(spark, d).select("entity_key", F.col("name").alias("dst"))
    e = S.mention(spark, d).join(v, "entity_key").select(F.col("page_id").alias("src"), "dst", "support_count", "context")
    return K.redirect(e, K.mapping(planned(spark, d)), "dst", preserve=False).na.fill({"support_count": 0, "context": ""})


@query(f"""
WITH {_PLAN}, {_MERGES}, t AS (SELECT DISTINCT v.name, g.winner FROM v_variant v LEFT JOIN g ON g.loser = v.name),
l AS (SELECT coalesce(winner, name) AS winner, coalesce(array_to_string(list_sort(list(name) FILTER (winner IS NOT NULL)), '|'), '') AS aliases FROM t GROUP BY 1)
SELECT coalesce(p.canonical, l.winner) AS name, aliases FROM l LEFT JOIN p ON p.winner = l.winner""")
def m10_rename(spark: SparkSession, d: str) -> DataFrame:
    plan = planned(spark, d)
    left = K.merge_nodes(S.variant(spark, d), K.mapping(plan), plan.select("winner", "canonical"))
    return left.select("name", F.array_join("aliases", "|").alias("aliases"))


_LOWER = _NAMES.format(key="lower(" + strip_sql("v.name") + ")")


@query(f"WITH {_LOWER} SELECT canonical, winner, array_to_string(losers, '|') AS losers, total_mentions, conflicts FROM p JOIN u USING (canonical)")
def m11_normalize(spark: SparkSession, d: str) -> DataFrame:
    plan = K.plan(S.variant(spark, d), S.mention(spark, d), key=F.lower(C.strip(F.col("name"))))
    return plan.withColumn("losers", F.array_join("losers", "|"))


@query("""
WITH r AS (SELECT doc_id, page_number, page_id, row_number() OVER (PARTITION BY doc_id, page_number
  ORDER BY 2 * (page_id % 3 > 0)::INT + (page_id % 2 > 0)::INT DESC, page_id) AS n FROM v_kg_page)
SELECT page_id, entity_key FROM v_mention WHERE page_id IN (SELECT page_id FROM r WHERE n = 1)""")
def m12_dedup_pages(spark: SparkSession, d: str) -> DataFrame:
    p = S.kg_page(spark, d).withColumns({"visual": F.col("page_id") % 3 > 0, "embedded": F.col("page_id") % 2 > 0})
    return U.dedup_pages(p, "visual", "embedded", S.mention(spark, d).select("page_id", "entity_key"))[1]


@query(f"""
WITH q AS (SELECT p_partkey, {_QTY} AS raw, {strip_sql('(' + _QTY + ')')} AS s FROM part)
SELECT p_partkey, CASE WHEN {_CLASSIFY} <> 'garbage' THEN raw END AS hardness, {_CLASSIFY} = 'garbage' AS cleaned FROM q""")
def m13_cleanup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.expr(_QTY).alias("hardness"))
    bad = C.classify_numeric(F.col("hardness")) == "garbage"
    return U.clear_when(rows.withColumn("cleaned", bad), "hardness", F.col("cleaned"))


@query("""
WITH o AS (SELECT DISTINCT doc_id, tag FROM v_kg_page), n AS (SELECT doc_id, 'new' AS tag FROM v_kg_document WHERE doc_id % 3 = 0)
SELECT doc_id, tag, 'merge' AS mode FROM (FROM o UNION FROM n)
UNION ALL SELECT doc_id, tag, 'replace' FROM (SELECT * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION FROM n)""")
def m14_apply_tags(spark: SparkSession, d: str) -> DataFrame:
    old = S.kg_page(spark, d).select("doc_id", "tag").distinct()
    new = S.kg_document(spark, d).where("doc_id % 3 = 0").select("doc_id", F.lit("new").alias("tag"))
    a, b = (U.apply_tags(old, new, m).withColumn("mode", F.lit(m)) for m in ("merge", "replace"))
    return a.unionByName(b)


@query("""
SELECT doc_id, collection FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND coalesce(c, 'default') = 'default' THEN 'bulk' ELSE c END AS collection
 FROM (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN collection END AS c FROM v_document))""")
def m14_bulk_collection(spark: SparkSession, d: str) -> DataFrame:
    docs = S.document(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("collection")).alias("collection"))
    return U.tagged_collection(docs, docs.where("doc_id % 2 = 0").select("doc_id", F.lit("bulk").alias("collection")))


@query("""
SELECT 'document' AS kind, count(*) AS n FROM v_document WHERE doc_id % 10 > 0 UNION ALL SELECT 'page', count(*) FROM v_page WHERE doc_id % 10 > 0
UNION ALL SELECT 'chunk', count(*) FROM v_chunk WHERE doc_id % 10 > 0""")
def m15_delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    docs = S.document(spark, d).select("doc_id")
    left = U.delete_documents(docs.where("doc_id % 10 = 0"), document=docs, page=S.page(spark, d), chunk=S.chunk(spark, d))
    counts = [df.agg(F.lit(name).alias("kind"), F.count("*").alias("n")) for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


_STATE = """
s AS (SELECT job_id, arg_max(status, (ts, event_id)) AS status, arg_max(error_message, (ts, event_id)) FILTER (error_message IS NOT NULL) AS error_message,
  arg_max(progress_pct, (ts, event_id)) FILTER (progress_pct IS NOT NULL) AS p, min(ts) AS created_at, max(ts) AS updated_at FROM v_jobs GROUP BY 1),
j AS (SELECT job_id, status, error_message, CASE WHEN status = 'completed' THEN 100.0 ELSE p END::DOUBLE AS progress_pct, created_at, updated_at FROM s)"""


@query(f"WITH {_STATE} SELECT * FROM j")
def m17_job_latest(spark: SparkSession, d: str) -> DataFrame:
    return J.latest(S.jobs(spark, d))


@query(f"""
WITH {_STATE} SELECT job_id, CASE WHEN status IN ('queued', 'processing') THEN 'failed' ELSE status END AS status,
 CASE WHEN status IN ('queued', 'processing') THEN coalesce(error_message, '{J.RESTARTED}') ELSE error_message END AS error_message FROM j""")
def s15_restart(spark: SparkSession, d: str) -> DataFrame:
    return J.fail_in_flight(J.latest(S.jobs(spark, d))).select("job_id", "status", "error_message")


@query("""
WITH n AS (SELECT v.*, greatest(coalesce(m, 0), 1) AS w FROM v_variant v LEFT JOIN (SELECT entity_key, count(DISTINCT page_id) AS m FROM v_mention GROUP BY 1) USING (entity_key)
  WHERE material_type IS NOT NULL),
s AS (SELECT uns_number, material_type, sum(w)::BIGINT AS weight, min(entity_key) AS f FROM n GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY uns_number ORDER BY weight DESC, f) AS k FROM s)
SELECT uns_number, material_type, weight FROM r WHERE k = 1""")
def a14_vote(spark: SparkSession, d: str) -> DataFrame:
    return K.vote(S.variant(spark, d), S.mention(spark, d), "uns_number", "material_type")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 300 SECONDS THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start FROM s GROUP BY user_id, k""")
def e1_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = sessions(table(spark, d, "events"))
    return s.select("user_id", "n", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"))


@query("SELECT DISTINCT file_hash FROM v_document")
def e2_incremental_dedup(spark: SparkSession, d: str) -> DataFrame:
    return first_files(S.document(spark, d)).select("file_hash")


@query(f"""
WITH {_PLAN}, w AS (SELECT DISTINCT unnest(list_append(losers, winner)) AS name FROM p)
SELECT name FROM w WHERE name NOT IN (SELECT name FROM v_variant WHERE entity_key % 2 = 0)""")
def u4_missing(spark: SparkSession, d: str) -> DataFrame:
    return K.missing(planned(spark, d), S.variant(spark, d).where("entity_key % 2 = 0"))


@query("""
WITH f AS (SELECT 'f_' || substr(sha1(lower(p_name) || '|' || p_type), 1, 20) AS formula_id, p_name AS name, p_type AS expression, p_partkey FROM part)
SELECT formula_id, (list(name ORDER BY p_partkey))[1] AS name, (list(expression ORDER BY p_partkey))[1] AS expression, count(*) AS support_count FROM f GROUP BY 1""")
def m4_formula_upsert(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "part").select(C.formula_id(F.col("p_name"), F.col("p_type")).alias("formula_id"), F.col("p_name").alias("name"), F.col("p_type").alias("expression"), "p_partkey")
    first = lambda c: F.min_by(c, "p_partkey").alias(c)
    return f.groupBy("formula_id").agg(first("name"), first("expression"), F.count("*").alias("support_count"))


@query("""
SELECT category, n, CASE WHEN category = 'BUILDING' THEN NULL ELSE 'BUILDING' END AS parent FROM
 (SELECT category, count(*) AS n FROM v_kg_document WHERE category <> 'MACHINERY' GROUP BY 1 UNION ALL SELECT 'EMPTY', 0)""")
def m16_categories(spark: SparkSession, d: str) -> DataFrame:
    names = S.kg_document(spark, d).select("category").distinct()
    names = U.create_names(names, "category", ["EMPTY", "BUILDING"])
    names = U.delete_names(names, "category", ["MACHINERY"])
    n = S.kg_document(spark, d).groupBy("category").agg(F.count("*").alias("n"))
    parent = F.when(F.col("category") != "BUILDING", F.lit("BUILDING"))
    return names.join(n, "category", "left").na.fill(0, ["n"]).select("category", "n", parent.alias("parent"))


@query("""
SELECT page_id, coalesce(CASE WHEN page_id % 3 > 0 THEN page_id % 2 = 0 END, length(extracted_text) < 20) AS is_blank,
  CASE WHEN doc_id % 4 > 0 THEN page_id ELSE -1 END AS vectors FROM v_page""")
def m18_backfill(spark: SparkSession, d: str) -> DataFrame:
    p = S.page(spark, d).select("page_id", "doc_id", F.when(F.col("page_id") % 3 > 0, F.col("page_id") % 2 == 0).alias("is_blank"), F.col("page_id").alias("vectors"), "extracted_text")
    filled = U.backfill(p, "is_blank", F.length("extracted_text") < 20)
    return U.clear_when(filled, "vectors", F.col("doc_id") % 4 == 0).na.fill(-1, ["vectors"]).select("page_id", "is_blank", "vectors")


#: Rules by table: those of a graph's nodes and edges, over the tables that stand for them.
SCHEMA = {
    "document": (H.Rule("unique", ("file_hash",)), H.Rule("required", ("doc_id", "file_hash", "collection")), H.Rule("values", ("category",), ("en", "fr"))),
    "material": (H.Rule("unique", ("entity_key",)), H.Rule("required", ("name", "material_type")), H.Rule("type", ("uns_number",), "int")),
    "line": (H.Rule("unique", ("l_orderkey", "l_linenumber")), H.Rule("values", ("l_returnflag",), ("A", "N")), H.Rule("type", ("l_linestatus",), "int")),
}
_REPEATED = "(SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM {0} GROUP BY {1} HAVING count(*) > 1))"


@query(f"""
SELECT 'document' AS kind, 'unique(file_hash)' AS rule, {_REPEATED.format('v_document', 'file_hash')} AS n
UNION ALL SELECT 'document', 'required(doc_id, file_hash, collection)', count(*) FROM v_document WHERE doc_id IS NULL OR file_hash IS NULL OR collection IS NULL
UNION ALL SELECT 'document', 'values(category)', count(*) FROM v_document WHERE category NOT IN ('en', 'fr')
UNION ALL SELECT 'material', 'unique(entity_key)', {_REPEATED.format('v_variant', 'entity_key')}
UNION ALL SELECT 'material', 'required(name, material_type)', count(*) FROM v_variant WHERE name IS NULL OR material_type IS NULL
UNION ALL SELECT 'material', 'type(uns_number)', count(*) FROM v_variant WHERE uns_number IS NOT NULL AND try_cast(uns_number AS INT) IS NULL
UNION ALL SELECT 'line', 'unique(l_orderkey, l_linenumber)', {_REPEATED.format('lineitem', 'l_orderkey, l_linenumber')}
UNION ALL SELECT 'line', 'values(l_returnflag)', count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')
UNION ALL SELECT 'line', 'type(l_linestatus)', count(*) FROM lineitem WHERE try_cast(l_linestatus AS INT) IS NULL""")
def m19_schema(spark: SparkSession, d: str) -> DataFrame:
    tables = {"document": S.document(spark, d), "material": S.variant(spark, d), "line": table(spark, d, "lineitem")}
    parts = [H.report(df, SCHEMA[kind]).select(F.lit(kind).alias("kind"), "rule", "n") for kind, df in tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
