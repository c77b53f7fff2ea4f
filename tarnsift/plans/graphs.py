"""Graph and community queries, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsift.operators import basic as B
from tarnsift.operators import community as M
from tarnsift.operators import graph as G
from tarnsift.operators import search as Q
from tarnsift.plans.registry import query
from tarnsift.sources import fixtures as S
from tarnsift.sources.tables import table


def standards(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").selectExpr("s_suppkey AS dst", "s_name AS code")


@query("""
WITH m AS (SELECT entity_key AS src FROM v_material WHERE name = 'SMALL RING' OR list_contains(common_names, 'SMALL RING'))
SELECT src, dst, s_name AS code, support_count FROM v_governed_by JOIN m USING (src) JOIN supplier ON s_suppkey = dst
ORDER BY support_count DESC, code, src LIMIT 50""")
def g1_material_standards(spark: SparkSession, d: str) -> DataFrame:
    return G.governed(S.material(spark, d), S.governed_by(spark, d), standards(spark, d), "SMALL RING")


@query("""
SELECT src, name, support_count FROM v_governed_by JOIN v_material ON entity_key = src WHERE dst = 5 ORDER BY support_count DESC, name, src LIMIT 50""")
def g2_process_materials(spark: SparkSession, d: str) -> DataFrame:
    return G.governing(S.material(spark, d).select("entity_key", "name"), S.governed_by(spark, d), 5)


@query("SELECT b.src, b.dst FROM v_references a JOIN v_references b ON b.src = a.dst WHERE a.src = 'S1' UNION ALL SELECT src, dst FROM v_references WHERE src = 'S1'")
def g3_standard_cross_references(spark: SparkSession, d: str) -> DataFrame:
    e = S.references(spark, d)
    own = e.where("src = 'S1'")
    return e.join(own.select(F.col("dst").alias("src")), "src").select("src", "dst").unionByName(own)


@query("""
WITH m AS (SELECT * FROM v_material WHERE name = 'small ring 0' OR list_contains(common_names, 'small ring 0') ORDER BY entity_key LIMIT 1)
SELECT m.entity_key, name, material_type, uns_number, (SELECT count(DISTINCT page_id) FROM v_mention x WHERE x.entity_key = m.entity_key) AS page_mentions FROM m""")
def g4_material_properties(spark: SparkSession, d: str) -> DataFrame:
    card = G.entity_card(S.material(spark, d), S.mention(spark, d), "small ring 0")
    return card.select("entity_key", "name", "material_type", "uns_number", "page_mentions")


@query("""
SELECT m.entity_key, coalesce(array_to_string(list_sort(list_distinct(list(g.dst) FILTER (g.dst IS NOT NULL))), '|'), '') AS standards
FROM v_material m LEFT JOIN v_governed_by g ON g.src = m.entity_key GROUP BY 1""")
def g5_equipment_requirements(spark: SparkSession, d: str) -> DataFrame:
    nodes = S.material(spark, d).select("entity_key")
    edges = S.governed_by(spark, d).withColumnRenamed("src", "entity_key")
    return G.collected(nodes, edges, "entity_key", "dst", "standards")


@query("""
WITH p AS (SELECT page_id FROM v_kg_page),
a AS (SELECT page_id, array_to_string(list_sort(list_distinct(list(entity_key))), '|') AS materials FROM v_mention GROUP BY 1),
b AS (SELECT l_orderkey AS page_id, array_to_string(list_sort(list_distinct(list(l_suppkey))), '|') AS standards FROM lineitem GROUP BY 1)
SELECT page_id, coalesce(materials, '') AS materials, coalesce(standards, '') AS standards FROM p LEFT JOIN a USING (page_id) LEFT JOIN b USING (page_id)""")
def g6_page_entities(spark: SparkSession, d: str) -> DataFrame:
    pages = S.kg_page(spark, d).select("page_id")
    line = table(spark, d, "lineitem").selectExpr("l_orderkey AS page_id", "l_partkey", "l_suppkey")
    both = G.collected(pages, line, "page_id", "l_partkey", "materials")
    return G.collected(both, line, "page_id", "l_suppkey", "standards")


@query("""
SELECT m.page_id, d.title, p.page_number FROM v_mention m JOIN v_kg_page p USING (page_id) JOIN v_kg_document d USING (doc_id) WHERE m.entity_key = 5""")
def g7_entity_pages(spark: SparkSession, d: str) -> DataFrame:
    hits = S.mention(spark, d).where("entity_key = 5").select("page_id")
    return hits.join(S.kg_page(spark, d), "page_id").join(S.kg_document(spark, d).select("doc_id", "title"), "doc_id").select("page_id", "title", "page_number")


@query("""
WITH m AS (SELECT entity_key FROM v_material WHERE name = 'small ring 0' OR list_contains(common_names, 'small ring 0'))
SELECT doc_id, title, page_number, context FROM v_mention JOIN m USING (entity_key) JOIN v_kg_page USING (page_id) JOIN v_kg_document USING (doc_id)
ORDER BY title, page_number, context LIMIT 500""")
def g8_entity_pages(spark: SparkSession, d: str) -> DataFrame:
    frames = {"entities": S.material(spark, d), "mentions": S.mention(spark, d), "pages": S.kg_page(spark, d), "documents": S.kg_document(spark, d)}
    return G.template("entity_pages", frames | {"name": "small ring 0"}, 500)


@query("""
WITH m AS (SELECT entity_key, name FROM v_material WHERE name = 'SMALL RING' OR list_contains(common_names, 'SMALL RING'))
SELECT m.entity_key, name, coalesce(array_to_string(list_sort(list_distinct(list(g.dst) FILTER (g.dst IS NOT NULL))), '|'), '') AS standards
FROM m LEFT JOIN v_governed_by g ON g.src = m.entity_key GROUP BY 1, 2 ORDER BY 1 LIMIT 500""")
def g8_equipment_requirements(spark: SparkSession, d: str) -> DataFrame:
    return G.template("equipment_requirements", {"entities": S.material(spark, d), "edges": S.governed_by(spark, d), "name": "SMALL RING"}, 500)


@query("""
SELECT page_id, page_number,
  (SELECT array_to_string(list_sort(list_distinct(list(l_partkey))), '|') FROM lineitem WHERE l_orderkey = page_id) AS materials,
  (SELECT array_to_string(list_sort(list_distinct(list(l_suppkey))), '|') FROM lineitem WHERE l_orderkey = page_id) AS standards
FROM v_kg_page WHERE page_id = (SELECT min(l_orderkey) FROM lineitem)""")
def g8_page_entities(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    one = line.agg(F.min("l_orderkey")).first()[0]
    kinds = {k: line.select(F.col("l_orderkey").alias("page_id"), F.col(c).alias("entity")) for k, c in (("materials", "l_partkey"), ("standards", "l_suppkey"))}
    return G.template("page_entities", {"pages": S.kg_page(spark, d), "mentions": kinds, "page_id": one})


@query("""
SELECT src, dst FROM (SELECT b.src, b.dst FROM v_references a JOIN v_references b ON b.src = a.dst WHERE a.src = 'S2'
  UNION ALL SELECT src, dst FROM v_references WHERE src = 'S2') ORDER BY 1, 2 LIMIT 500""")
def g8_cross_references(spark: SparkSession, d: str) -> DataFrame:
    return G.template("standard_cross_references", {"edges": S.references(spark, d), "start": "S2"}, 500)


_EDGE = """
e AS (SELECT src, dst, CASE WHEN dst LIKE 'N%' THEN 'IN_NATION' ELSE 'IN_REGION' END AS rel, src || '~' || dst AS id FROM v_references),
s AS (SELECT src, dst, rel, id FROM e UNION ALL SELECT dst, src, rel, id FROM e),
p1 AS (SELECT dst AS node, [id] AS ids, rel AS path FROM s WHERE src = 'S1'),
p2 AS (SELECT s.dst AS node, list_append(ids, id) AS ids, path || '>' || rel AS path FROM p1 JOIN s ON s.src = node WHERE NOT list_contains(ids, id)),
p3 AS (SELECT s.dst AS node, list_append(ids, id) AS ids, path || '>' || rel AS path FROM p2 JOIN s ON s.src = node WHERE NOT list_contains(ids, id))"""


def _explore_sql(depth: int) -> str:
    parts = " UNION ALL ".join(f"SELECT node, path, {k} AS distance FROM p{k}" for k in range(1, depth + 1))
    return f"WITH {_EDGE} SELECT DISTINCT node, path, distance FROM ({parts}) WHERE node <> 'S1' ORDER BY distance, node, path LIMIT 500"


def _explore(spark: SparkSession, d: str, depth: int) -> DataFrame:
    rel = F.when(F.col("dst").startswith("N"), "IN_NATION").otherwise("IN_REGION").alias("rel")
    return G.explore(S.references(spark, d).select("src", "dst", rel), "S1", depth)


@query(_explore_sql(1))
def g9_explore_d1(spark: SparkSession, d: str) -> DataFrame:
    return _explore(spark, d, 1)


@query(_explore_sql(2))
def g9_explore_d2(spark: SparkSession, d: str) -> DataFrame:
    return _explore(spark, d, 2)


@query(_explore_sql(3))
def g9_explore_d3(spark: SparkSession, d: str) -> DataFrame:
    return _explore(spark, d, 3)


@query("""
SELECT entity_key, name, (SELECT count(DISTINCT page_id) FROM v_mention m WHERE m.entity_key = e.entity_key) AS page_mentions
FROM v_material e ORDER BY page_mentions DESC, name LIMIT 100 OFFSET 20""")
def g10_entities(spark: SparkSession, d: str) -> DataFrame:
    n = B.mention_counts(S.material(spark, d).select("entity_key", "name"), S.mention(spark, d))
    return B.paged(n, [F.desc("page_mentions"), "name"], limit=100, offset=20)


@query("""
WITH c AS (SELECT 'Document' AS label, count(*) AS n FROM v_kg_document UNION ALL SELECT 'Page', count(*) FROM v_kg_page
 UNION ALL SELECT 'Material', count(*) FROM v_material UNION ALL SELECT 'Standard', count(*) FROM supplier UNION ALL SELECT 'Clause', count(*) FROM nation)
SELECT label, n, (SELECT sum(n) FROM c)::BIGINT AS total FROM c""")
def g12_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = B.label_counts({
        "Document": S.kg_document(spark, d), "Page": S.kg_page(spark, d), "Material": S.material(spark, d),
        "Standard": table(spark, d, "supplier"), "Clause": table(spark, d, "nation"),
    })
    return rows.crossJoin(F.broadcast(rows.agg(F.sum("n").alias("total")))).select("label", "n", "total")


_CHAIN = """name || ' (Material) → GOVERNED_BY → ' || hop || ' (Standard)' || CASE WHEN hop2 IS NOT NULL THEN ' → REFERENCES → ' || hop2 || ' (Clause)' ELSE '' END"""


@query(f"""
WITH a AS (SELECT 'M' || src AS name, 'S' || dst AS hop FROM v_governed_by WHERE src < 20),
z AS (SELECT name, a.hop, r.dst AS hop2 FROM a LEFT JOIN v_references r ON r.src = a.hop)
SELECT name, hop, hop2, {_CHAIN} AS chain FROM z ORDER BY name, hop, hop2 NULLS FIRST LIMIT 50""")
def j8_two_hop(spark: SparkSession, d: str) -> DataFrame:
    seeds = spark.range(20).selectExpr("'M' || id AS name", "'Material' AS label")
    first = S.governed_by(spark, d).where("src < 20").selectExpr("'M' || src AS name", "'GOVERNED_BY' AS rel", "'S' || dst AS hop", "'Standard' AS hop_label")
    second = S.references(spark, d).selectExpr("src AS hop", "'REFERENCES' AS rel2", "dst AS hop2", "'Clause' AS hop2_label")
    return G.two_hop(seeds, first, second)


@query("""
SELECT entity_key, count(DISTINCT page_id) AS page_hits FROM v_mention WHERE page_id < 200 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def a9_seed_entities(spark: SparkSession, d: str) -> DataFrame:
    return G.seed_entities(S.mention(spark, d), spark.range(200).withColumnRenamed("id", "page_id"))


@query("""
WITH seeds AS (SELECT entity_key FROM (SELECT entity_key, count(DISTINCT page_id) AS h FROM v_mention WHERE page_id < 20 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)),
direct AS (SELECT DISTINCT page_id FROM v_mention WHERE entity_key IN (SELECT entity_key FROM seeds) ORDER BY 1 LIMIT 40),
hops AS (SELECT DISTINCT dst FROM v_governed_by WHERE src IN (SELECT entity_key FROM seeds) ORDER BY 1 LIMIT 50),
found AS (SELECT DISTINCT src AS entity_key FROM v_governed_by WHERE dst IN (SELECT dst FROM hops) AND src NOT IN (SELECT entity_key FROM seeds) ORDER BY 1 LIMIT 20),
more AS (SELECT DISTINCT page_id FROM v_mention WHERE entity_key IN (SELECT entity_key FROM found) ORDER BY 1 LIMIT 20),
u AS (SELECT page_id, 'direct' AS reason, 0 AS k FROM direct UNION ALL SELECT page_id, 'discovered', 1 FROM more WHERE page_id NOT IN (SELECT page_id FROM direct)),
r AS (SELECT page_id, reason, row_number() OVER (ORDER BY k, page_id)::INT AS place FROM u)
SELECT * FROM r WHERE place <= 20""")
def r12_explore_pages(spark: SparkSession, d: str) -> DataFrame:
    g = S.governed_by(spark, d)
    pages = spark.range(20).withColumnRenamed("id", "page_id")
    return G.explore_pages(S.mention(spark, d), pages, g.select("src", "dst"), g.select("dst", F.col("src").alias("src2")), 20)


_PAIRS = "SELECT a.page_id AS src, b.page_id AS dst, count(*) AS weight FROM v_mention a JOIN v_mention b ON a.entity_key = b.entity_key AND a.page_id < b.page_id GROUP BY 1, 2"


@query(_PAIRS)
def g13_projection(spark: SparkSession, d: str) -> DataFrame:
    return M.project(S.mention(spark, d))


@query(f"""
WITH RECURSIVE p AS ({_PAIRS}), e AS (SELECT src, dst FROM p UNION ALL SELECT dst, src FROM p),
r(node, component) USING KEY (node) AS (
  SELECT src, src FROM e GROUP BY 1
  UNION SELECT e.dst, min(r.component) FROM r JOIN e ON e.src = r.node JOIN recurring.r AS o ON o.node = e.dst
  WHERE r.component < o.component GROUP BY 1)
SELECT node, component FROM r""")
def g13_components(spark: SparkSession, d: str) -> DataFrame:
    return M.connected(M.stars(S.mention(spark, d)))


@query()
def g14_detect(spark: SparkSession, d: str) -> DataFrame:
    return M.detect_shared(S.mention(spark, d))


# A fixed membership of two levels.
_MEMBERS = "SELECT page_id, 0 AS level, page_id % 97 AS community_id FROM v_kg_page UNION ALL SELECT page_id, 1, 1000 + page_id % 97 % 7 FROM v_kg_page WHERE page_id % 5 > 0"


def members(spark: SparkSession, d: str) -> DataFrame:
    p = S.kg_page(spark, d)
    return p.selectExpr("page_id", "0 AS level", "page_id % 97 AS community_id").unionByName(
        p.where("page_id % 5 > 0").selectExpr("page_id", "1 AS level", "1000 + page_id % 97 % 7 AS community_id")
    )


@query("""
WITH m AS (SELECT page_id, page_id % 50 AS community_id FROM v_page),
r AS (SELECT m.community_id, row_number() OVER (PARTITION BY m.community_id ORDER BY page_id) AS k,
  '[' || title || ' p.' || page_number || '] ' || substr(extracted_text, 1, 800) AS t FROM m JOIN v_page USING (page_id))
SELECT community_id, count(*)::INT AS n_pages, string_agg(t, chr(10) || chr(10) ORDER BY k) AS sample FROM r WHERE k <= 20 GROUP BY 1""")
def g15_samples(spark: SparkSession, d: str) -> DataFrame:
    p = S.page(spark, d)
    return M.sample_texts(p.selectExpr("page_id", "page_id % 50 AS community_id"), p)


@query(f"""
WITH m AS ({_MEMBERS}), n AS (SELECT community_id, entity_key, count(DISTINCT page_id) AS pages FROM m JOIN v_mention USING (page_id) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY pages DESC, entity_key)::INT AS place FROM n)
SELECT * FROM r WHERE place <= 20""")
def a10_profile(spark: SparkSession, d: str) -> DataFrame:
    return M.profile(members(spark, d), S.mention(spark, d).select("page_id", "entity_key"))


@query(f"""
WITH m AS ({_MEMBERS}), c AS (SELECT page_id, level, community_id AS child FROM m), p AS (SELECT page_id, level - 1 AS level, community_id AS parent FROM m),
s AS (SELECT level, child, count(DISTINCT page_id) AS n FROM c GROUP BY 1, 2),
o AS (SELECT level, child, parent, count(DISTINCT page_id) AS overlap FROM c JOIN p USING (page_id, level) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY level, child ORDER BY overlap DESC, parent) AS k FROM o)
SELECT level, child, parent, overlap FROM r JOIN s USING (level, child) WHERE k = 1 AND overlap >= greatest(1, n // 2)""")
def j13_parents(spark: SparkSession, d: str) -> DataFrame:
    return M.link_parents(members(spark, d))


@query(f"""
WITH m AS ({_MEMBERS}) SELECT level, community_id, count(DISTINCT page_id) AS page_count FROM m WHERE level = 0 GROUP BY 1, 2
ORDER BY level, page_count DESC, community_id LIMIT 50""")
def g11_list(spark: SparkSession, d: str) -> DataFrame:
    return M.listed(members(spark, d), level=0)


@query("""
WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '' WHEN s_suppkey % 3 = 1 THEN NULL ELSE 'x' END AS summary FROM supplier)
SELECT s_suppkey, CASE WHEN coalesce(summary, '') = '' THEN '0.0|0.0' ELSE '1.0|2.0' END AS v FROM s""")
def g16_summary_vector(spark: SparkSession, d: str) -> DataFrame:
    s = F.expr("CASE WHEN s_suppkey % 3 = 0 THEN '' WHEN s_suppkey % 3 = 1 THEN NULL ELSE 'x' END")
    v = M.summary_vector(s, F.array(F.lit(1.0), F.lit(2.0)), 2)
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(v.cast("array<string>"), "|").alias("v"))


@query(f"""
WITH a AS (SELECT 'M' || src AS name, 'S' || dst AS hop FROM v_governed_by WHERE src < 20),
z AS (SELECT DISTINCT {_CHAIN} AS chain FROM (SELECT name, a.hop, r.dst AS hop2 FROM a LEFT JOIN v_references r ON r.src = a.hop) ORDER BY 1 LIMIT 5),
m AS (SELECT entity_key, count(DISTINCT page_id) AS hits FROM v_mention WHERE page_id < 200 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6),
g AS (SELECT dst, sum(support_count) AS hits FROM v_governed_by WHERE src < 20 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6),
t AS (SELECT collection, count(*) AS n FROM v_document GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2)
SELECT 0 AS part, row_number() OVER (ORDER BY chain)::INT AS place, '  • ' || chain AS line FROM z
UNION ALL SELECT 1, 1, 'Related materials: ' || string_agg('M' || entity_key, ', ' ORDER BY hits DESC, entity_key) FROM m
UNION ALL SELECT 2, 1, 'Related standards: ' || string_agg('S' || dst, ', ' ORDER BY hits DESC, dst) FROM g
UNION ALL SELECT 3, row_number() OVER (ORDER BY n DESC, collection)::INT, '  ' || substr(collection || ' has ' || n || ' documents', 1, 300) FROM t""")
def r11_graph_lines(spark: SparkSession, d: str) -> DataFrame:
    seeds = spark.range(20).selectExpr("'M' || id AS name", "'Material' AS label")
    governed = S.governed_by(spark, d).where("src < 20")
    first = governed.selectExpr("'M' || src AS name", "'GOVERNED_BY' AS rel", "'S' || dst AS hop", "'Standard' AS hop_label")
    second = S.references(spark, d).selectExpr("src AS hop", "'REFERENCES' AS rel2", "dst AS hop2", "'Clause' AS hop2_label")
    chains = G.two_hop(seeds, first, second, 1_000_000).select(F.lit(0).alias("place"), "chain").distinct()
    hits = G.seed_entities(S.mention(spark, d), spark.range(200).withColumnRenamed("id", "page_id"), 6)
    names = {
        "materials": B.placed(hits, F.desc("page_hits"), "entity_key").selectExpr("place", "'M' || entity_key AS name"),
        "standards": B.placed(governed.groupBy("dst").agg(F.sum("support_count").alias("n")).orderBy(F.desc("n"), "dst").limit(6), F.desc("n"), "dst").selectExpr("place", "'S' || dst AS name"),
    }
    groups = S.document(spark, d).groupBy("collection").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "collection").limit(2)
    topics = B.placed(groups, F.desc("n"), "collection").selectExpr("place", "collection || ' has ' || n || ' documents' AS summary")
    return Q.graph_lines(chains, names, topics)
