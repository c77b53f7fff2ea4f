"""Relational and scalar queries, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsift.functions import clean as C
from tarnsift.functions import text as X
from tarnsift.functions import vectors as V
from tarnsift.operators import basic as B
from tarnsift.operators import chunks as K
from tarnsift.operators import search as Q
from tarnsift.plans.registry import query
from tarnsift.sources import fixtures as S
from tarnsift.sources.tables import image_file, image_path, orphans, table

_STRIP = r"regexp_replace({0}, '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g')"


def strip_sql(c: str) -> str:
    return _STRIP.format(c)


@query("""
WITH d AS (SELECT CASE WHEN doc_id % 7 = 0 THEN NULL ELSE collection END AS c, page_count FROM v_document)
SELECT coalesce(c, 'default') AS collection, count(*) AS document_count, sum(page_count)::BIGINT AS total_pages FROM d GROUP BY 1""")
def a1_collections(spark: SparkSession, d: str) -> DataFrame:
    docs = S.document(spark, d).withColumn("collection", F.when(F.col("doc_id") % 7 != 0, F.col("collection")))
    return B.collections(docs)


@query("SELECT doc_id, title FROM v_document WHERE coalesce(collection, 'default') = 'src1' AND category = 'en'")
def f1_filter_all(spark: SparkSession, d: str) -> DataFrame:
    return S.document(spark, d).where(B.filters(collection="src1", category="en")).select("doc_id", "title")


@query("""
SELECT doc_id FROM v_kg_page WHERE tag IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY doc_id HAVING count(DISTINCT tag) = 3""")
def f2_all_of_tags(spark: SparkSession, d: str) -> DataFrame:
    return B.all_of(S.kg_page(spark, d), "doc_id", "tag", ["1-URGENT", "2-HIGH", "5-LOW"])


@query("""
SELECT doc_id, title FROM v_kg_document d WHERE EXISTS (SELECT 1 FROM v_kg_page p WHERE p.doc_id = d.doc_id AND p.tag = '1-URGENT')
""")
def f3_any_category(spark: SparkSession, d: str) -> DataFrame:
    carry = S.kg_page(spark, d).where("tag = '1-URGENT'").select("doc_id")
    return S.kg_document(spark, d).join(carry, "doc_id", "left_semi").select("doc_id", "title")


@query("SELECT doc_id, title FROM v_document WHERE coalesce(CASE WHEN doc_id % 5 > 0 THEN collection END, 'default') = 'default'")
def f4_default_collection(spark: SparkSession, d: str) -> DataFrame:
    docs = S.document(spark, d).withColumn("collection", F.when(F.col("doc_id") % 5 > 0, F.col("collection")))
    return docs.where(B.filters(collection="default")).select("doc_id", "title")


@query("SELECT page_id, page_number FROM v_page WHERE contains(lower(extracted_text), lower('THE Of'))")
def f5_contains(spark: SparkSession, d: str) -> DataFrame:
    return S.page(spark, d).where(B.contains("extracted_text", "THE Of")).select("page_id", "page_number")


@query("""
SELECT entity_key, name FROM v_material WHERE len(list_filter(['ring', 'gear'], lambda t: contains(lower(name), t)
  OR len(list_filter(common_names, lambda a: contains(lower(a), t))) > 0)) > 0""")
def f6_term_any(spark: SparkSession, d: str) -> DataFrame:
    return S.material(spark, d).where(B.any_term("name", "common_names", ["ring", "gear"])).select("entity_key", "name")


@query("SELECT entity_key, name FROM v_material WHERE name = 'SMALL RING' OR list_contains(common_names, 'SMALL RING')")
def f7_alias_equal(spark: SparkSession, d: str) -> DataFrame:
    return S.material(spark, d).where(B.is_or_alias("SMALL RING", "name", "common_names")).select("entity_key", "name")


@query(f"""
WITH p AS (SELECT page_id, length({strip_sql('extracted_text')}) AS n,
  CASE WHEN page_id % 3 = 0 THEN NULL ELSE page_id % 5 END AS vectors, CASE WHEN page_id % 4 = 0 THEN 'x' END AS emb FROM v_page)
SELECT page_id, n > 0 AND emb IS NULL AS needs_embedding, coalesce(vectors, 0) = 0 AND n > 20 AS needs_vectors FROM p""")
def f8_unprocessed(spark: SparkSession, d: str) -> DataFrame:
    p = S.page(spark, d).select(
        "page_id", F.length(C.strip(F.col("extracted_text"))).alias("n"),
        F.when(F.col("page_id") % 3 != 0, F.col("page_id") % 5).alias("vectors"),
        F.when(F.col("page_id") % 4 == 0, "x").alias("emb"),
    )
    return p.select(
        "page_id", ((F.col("n") > 0) & F.col("emb").isNull()).alias("needs_embedding"),
        ((F.coalesce("vectors", F.lit(0)) == 0) & (F.col("n") > 20)).alias("needs_vectors"),
    )


@query("SELECT page_id, doc_id FROM v_kg_page p WHERE NOT EXISTS (SELECT 1 FROM v_mention m WHERE m.page_id = p.page_id)")
def f9_anti_pattern(spark: SparkSession, d: str) -> DataFrame:
    return S.kg_page(spark, d).join(table(spark, d, "lineitem").selectExpr("l_orderkey AS page_id"), "page_id", "left_anti").select("page_id", "doc_id")


@query(f"""
WITH k AS (SELECT doc_id, page_number, chunk_index, text FROM v_chunk WHERE length(text) > 100),
a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, chunk_index) AS n FROM k),
b AS (SELECT doc_id, page_number, extracted_text, row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS n
  FROM v_page WHERE length({strip_sql('extracted_text')}) > 100 AND doc_id NOT IN (SELECT doc_id FROM k))
SELECT doc_id, n::INT AS n, text AS sample FROM a WHERE n <= 10
UNION ALL SELECT doc_id, n::INT, extracted_text FROM b WHERE n <= 10""")
def f11_sample_text(spark: SparkSession, d: str) -> DataFrame:
    return B.sample_texts(S.chunk(spark, d), S.page(spark, d))


@query(f"""
SELECT page_id, CASE WHEN length({strip_sql('extracted_text')}) > 20 THEN false ELSE coalesce((page_id % 10)::DOUBLE < 5.0, false) END AS is_blank
FROM v_page""")
def f12_blank(spark: SparkSession, d: str) -> DataFrame:
    return S.page(spark, d).select("page_id", X.is_blank(F.col("extracted_text"), F.col("page_id") % 10).alias("is_blank"))


_CLASS = f"CASE WHEN length({strip_sql('extracted_text')}) >= 50 THEN 'digital_native' ELSE 'scanned' END"


@query(f"SELECT page_id, {_CLASS} AS source_type FROM v_page")
def f13_page_source(spark: SparkSession, d: str) -> DataFrame:
    return S.page(spark, d).select("page_id", X.page_class(F.col("extracted_text")).alias("source_type"))


@query(f"""
WITH p AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN {_CLASS} = 'digital_native' THEN 1 ELSE 0 END) AS k FROM v_page GROUP BY 1)
SELECT doc_id, CASE WHEN n = 0 THEN 'unknown' WHEN k >= 0.9 * n THEN 'digital_native' WHEN n - k >= 0.9 * n THEN 'scanned' ELSE 'hybrid' END AS source_type
FROM p""")
def f14_doc_source(spark: SparkSession, d: str) -> DataFrame:
    p = S.page(spark, d).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum((X.page_class(F.col("extracted_text")) == "digital_native").cast("int")).alias("k")
    )
    return p.select("doc_id", X.document_class(F.col("k"), F.col("n")).alias("source_type"))


@query("""
SELECT page_id, '/images/' || file_hash || '/' || page_number AS image_url,
  '/images/' || file_hash || '/' || page_number || '/reduced' AS reduced_url FROM v_page""")
def f16_urls(spark: SparkSession, d: str) -> DataFrame:
    p, h, n = S.page(spark, d), F.col("file_hash"), F.col("page_number")
    return p.select("page_id", image_path(h, n).alias("image_url"), image_path(h, n, True).alias("reduced_url"))


@query("""
SELECT d.doc_id, d.title, p.page_number, c.chunk_id FROM v_document d JOIN v_page p USING (doc_id) JOIN v_chunk c ON c.page_id = p.page_id
WHERE d.category = 'de'""")
def j1_traversal(spark: SparkSession, d: str) -> DataFrame:
    docs = S.document(spark, d).where("category = 'de'").select("doc_id", "title")
    pages, chunks = S.page(spark, d).select("doc_id", "page_id", "page_number"), S.chunk(spark, d).select("page_id", "chunk_id")
    return docs.join(pages, "doc_id").join(chunks, "page_id").select("doc_id", "title", "page_number", "chunk_id")


@query("""
SELECT m.entity_key, count(DISTINCT x.page_id) AS page_mentions FROM v_material m
LEFT JOIN v_mention x ON x.entity_key = m.entity_key GROUP BY 1""")
def j2_left_counts(spark: SparkSession, d: str) -> DataFrame:
    return B.mention_counts(S.material(spark, d).select("entity_key"), S.mention(spark, d))


@query("SELECT page_id FROM v_kg_page p WHERE EXISTS (SELECT 1 FROM v_mention m WHERE m.page_id = p.page_id AND m.support_count > 1)")
def j4_semi(spark: SparkSession, d: str) -> DataFrame:
    return S.kg_page(spark, d).join(S.mention(spark, d).where("support_count > 1"), "page_id", "left_semi").select("page_id")


@query("SELECT entity_key, name FROM v_material e WHERE NOT EXISTS (SELECT 1 FROM v_governed_by g WHERE g.src = e.entity_key AND g.support_count > 1)")
def j5_anti(spark: SparkSession, d: str) -> DataFrame:
    strong = S.governed_by(spark, d).where("support_count > 1").select(F.col("src").alias("entity_key"))
    return S.material(spark, d).join(strong, "entity_key", "left_anti").select("entity_key", "name")


@query("SELECT file_hash, min(doc_id) AS doc_id FROM v_document WHERE file_hash IN (SELECT file_hash FROM v_document WHERE doc_id % 3 = 0) GROUP BY 1")
def j14_known_hash(spark: SparkSession, d: str) -> DataFrame:
    docs = S.document(spark, d).select("doc_id", "file_hash")
    return B.known_hashes(docs, docs.where("doc_id % 3 = 0").select("file_hash"))


@query("SELECT c.doc_id, count(p.page_id) AS degree FROM v_kg_document c LEFT JOIN v_kg_page p USING (doc_id) GROUP BY 1")
def a2_degree(spark: SparkSession, d: str) -> DataFrame:
    return B.degrees(S.kg_document(spark, d).select("doc_id"), S.kg_page(spark, d), "doc_id")


@query("""
SELECT entity_key, count(DISTINCT page_id) AS page_mentions FROM v_mention GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100""")
def a3_mentions(spark: SparkSession, d: str) -> DataFrame:
    counts = S.mention(spark, d).groupBy("entity_key").agg(F.countDistinct("page_id").alias("page_mentions"))
    return counts.orderBy(F.desc("page_mentions"), "entity_key").limit(100)


@query("""
SELECT page_id, round(max(s), 6) AS score, arg_max(chunk_id, round(s, 6) * 1e9 - chunk_id) AS best_chunk FROM
 (SELECT page_id, chunk_id, list_dot_product(v, (SELECT v FROM v_vec WHERE vec_id = 0)) AS s FROM v_vec) GROUP BY 1""")
def a5_best_chunk(spark: SparkSession, d: str) -> DataFrame:
    s = S.vec(spark, d).select("page_id", "chunk_id", F.round(V.dot("v", S.first_vector(spark, d)), 6).alias("s"))
    best = F.max_by("chunk_id", F.struct("s", -F.col("chunk_id"))).alias("best_chunk")
    return s.groupBy("page_id").agg(F.max("s").alias("score"), best)


@query("""
SELECT page_id, array_to_string(list_sort(list_distinct(list(entity_key)))[1:10], '|') AS entities FROM v_mention GROUP BY 1""")
def a6_collect_sliced(spark: SparkSession, d: str) -> DataFrame:
    ids = F.slice(F.sort_array(F.collect_set("entity_key")), 1, 10)
    return S.mention(spark, d).groupBy("page_id").agg(F.array_join(ids.cast("array<string>"), "|").alias("entities"))


@query("""
SELECT material_type, array_to_string(list_sort(list_distinct(list_transform(flatten(list(common_names)), lambda x: lower(x)))), '|') AS aliases
FROM v_material GROUP BY 1""")
def a7_flat_aliases(spark: SparkSession, d: str) -> DataFrame:
    each = S.material(spark, d).select("material_type", F.explode("common_names").alias("a"))
    return each.groupBy("material_type").agg(F.array_join(F.sort_array(F.collect_set(F.lower("a"))), "|").alias("aliases"))


@query(f"""
SELECT doc_id, count(DISTINCT page_id) AS pages, count(DISTINCT CASE WHEN length({strip_sql('extracted_text')}) > 100 THEN page_id END) AS long_pages,
  count(DISTINCT CASE WHEN contains(extracted_text, ',') THEN page_id END) AS comma_pages FROM v_page GROUP BY 1""")
def a8_conditional_distinct(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("extracted_text")
    return S.page(spark, d).groupBy("doc_id").agg(
        F.countDistinct("page_id").alias("pages"),
        F.countDistinct(F.when(F.length(C.strip(t)) > 100, F.col("page_id"))).alias("long_pages"),
        F.countDistinct(F.when(t.contains(","), F.col("page_id"))).alias("comma_pages"),
    )


@query("""
WITH g AS (SELECT file_hash, count(*) AS n FROM v_document GROUP BY 1 HAVING count(*) > 1)
SELECT count(*) AS groups, coalesce(sum(n - 1), 0)::BIGINT AS extras FROM g""")
def a11_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return B.duplicate_groups(S.document(spark, d), "file_hash")


@query("""
WITH o AS (SELECT l_partkey AS src, l_suppkey AS dst, l_returnflag AS context, l_shipdate AS day, l_orderkey AS k, l_linenumber AS ln, l_quantity AS q FROM lineitem)
SELECT src, dst, count(*) AS support_count, (list(context ORDER BY day, k, ln, q, context))[1] AS context FROM o GROUP BY 1, 2""")
def a12_support(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "lineitem").selectExpr(
        "l_partkey AS src", "l_suppkey AS dst", "l_returnflag AS context", "struct(l_shipdate, l_orderkey, l_linenumber, l_quantity, l_returnflag) AS at"
    )
    return o.groupBy("src", "dst").agg(F.count("*").alias("support_count"), F.min_by("context", "at").alias("context"))


@query("""
SELECT uns_number, array_to_string(list_sort(list_distinct(flatten(list(common_names)))), '|') AS common_names FROM v_material GROUP BY 1""")
def a13_alias_union(spark: SparkSession, d: str) -> DataFrame:
    each = S.material(spark, d).select("uns_number", F.explode("common_names").alias("a"))
    return each.groupBy("uns_number").agg(F.array_join(F.sort_array(F.collect_set("a")), "|").alias("common_names"))


@query("""
SELECT CASE WHEN length(text) < 80 THEN 'short' WHEN contains(text, '|') THEN 'table' ELSE 'paragraph' END AS chunk_type, count(*) AS n
FROM v_chunk GROUP BY 1""")
def a15_chunk_types(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    kind = F.when(F.length(t) < 80, "short").when(t.contains("|"), "table").otherwise("paragraph")
    return S.chunk(spark, d).groupBy(kind.alias("chunk_type")).agg(F.count("*").alias("n"))


@query("""
SELECT src, sum(CASE WHEN dst LIKE 'N%' THEN 1 ELSE 0 END)::BIGINT AS in_nation, sum(CASE WHEN dst LIKE 'R%' THEN 1 ELSE 0 END)::BIGINT AS in_region
FROM v_references GROUP BY 1""")
def a16_edge_types(spark: SparkSession, d: str) -> DataFrame:
    e = S.references(spark, d).withColumn("rel", F.when(F.col("dst").startswith("N"), "in_nation").otherwise("in_region"))
    return e.groupBy("src").pivot("rel", ["in_nation", "in_region"]).count().na.fill(0)


@query("SELECT (SELECT count(*) FROM v_document) AS documents, (SELECT count(*) FROM v_page) AS pages")
def a17_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.document(spark, d).agg(F.count("*").alias("documents"), F.sum("page_count").cast("long").alias("pages"))


@query("""
SELECT doc_id, count(c.chunk_id) AS chunks FROM v_document LEFT JOIN v_chunk c USING (doc_id) GROUP BY 1""")
def a18_chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    return B.degrees(S.document(spark, d).select("doc_id"), S.chunk(spark, d), "doc_id", "chunks")


@query("""
WITH r AS (SELECT doc_id, page_number, page_id, row_number() OVER (PARTITION BY doc_id, page_number
  ORDER BY 2 * (page_id % 3 > 0)::INT + (page_id % 2 > 0)::INT DESC, page_id) AS n FROM v_kg_page)
SELECT doc_id, page_number, page_id FROM r WHERE n = 1""")
def w2_best_page(spark: SparkSession, d: str) -> DataFrame:
    p = S.kg_page(spark, d).withColumns({"visual": F.col("page_id") % 3 > 0, "embedded": F.col("page_id") % 2 > 0})
    return B.best_pages(p, "visual", "embedded").select("doc_id", "page_number", "page_id")


@query("SELECT doc_id, title FROM v_document ORDER BY doc_id DESC LIMIT 50 OFFSET 100")
def t2_paging(spark: SparkSession, d: str) -> DataFrame:
    return B.paged(S.document(spark, d).select("doc_id", "title"), [F.desc("doc_id")], limit=50, offset=100)


@query("""
WITH c AS (SELECT 'Document' AS label, count(*) AS n FROM v_kg_document UNION ALL SELECT 'Page', count(*) FROM v_kg_page
 UNION ALL SELECT 'Material', count(*) FROM v_material UNION ALL SELECT 'Standard', count(*) FROM supplier)
SELECT label, n, row_number() OVER (ORDER BY CASE label WHEN 'Document' THEN 0 WHEN 'Page' THEN 1 ELSE 2 END, n DESC, label)::INT AS place FROM c""")
def t4_pinned_order(spark: SparkSession, d: str) -> DataFrame:
    return B.label_counts({
        "Document": S.kg_document(spark, d), "Page": S.kg_page(spark, d), "Material": S.material(spark, d),
        "Standard": table(spark, d, "supplier"),
    })


@query("""
WITH a AS (SELECT page_id, min(chunk_id) AS r, 0 AS p FROM v_vec WHERE label < 5 GROUP BY 1),
b AS (SELECT page_id, min(chunk_id) AS r, 1 AS p FROM v_vec WHERE label >= 3 GROUP BY 1),
u AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY p, r) AS n FROM (FROM a UNION ALL FROM b))
SELECT page_id, p AS source, r AS rank FROM u WHERE n = 1""")
def u1_union_dedup(spark: SparkSession, d: str) -> DataFrame:
    v = S.vec(spark, d)
    lists = [v.where(c).groupBy("page_id").agg(F.min("chunk_id").alias("rank")) for c in ("label < 5", "label >= 3")]
    return B.first_seen(lists, "page_id", "rank")


@query("SELECT DISTINCT page_id FROM v_kg_page p WHERE NOT EXISTS (SELECT 1 FROM v_mention m WHERE m.page_id = p.page_id)")
def u2_difference(spark: SparkSession, d: str) -> DataFrame:
    return S.kg_page(spark, d).select("page_id").distinct().join(S.mention(spark, d), "page_id", "left_anti")


@query("SELECT material_type, count(*) AS shared FROM v_material a WHERE EXISTS (SELECT 1 FROM v_mention m WHERE m.entity_key = a.entity_key) GROUP BY 1")
def u3_intersection(spark: SparkSession, d: str) -> DataFrame:
    seen = S.mention(spark, d).select("entity_key")
    return S.material(spark, d).join(seen, "entity_key", "left_semi").groupBy("material_type").agg(F.count("*").alias("shared"))


@query("SELECT DISTINCT dst FROM v_references")
def u5_distinct(spark: SparkSession, d: str) -> DataFrame:
    return S.references(spark, d).select("dst").distinct()


@query("SELECT * FROM v_kg_document WHERE doc_id = 42")
def s2_key_lookup(spark: SparkSession, d: str) -> DataFrame:
    return S.kg_document(spark, d).where("doc_id = 42")


@query("SELECT page_id, doc_id, tag FROM v_kg_page WHERE page_id IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 490000)")
def s3_hydrate(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "orders").where("o_totalprice > 490000").selectExpr("o_orderkey AS page_id")
    return S.kg_page(spark, d).join(ids, "page_id", "left_semi").select("page_id", "doc_id", "tag")


@query("SELECT vec_id FROM v_vec WHERE len(CASE WHEN vec_id % 11 = 0 THEN v[1:32] ELSE v END) <> 64")
def s7_stale_dim(spark: SparkSession, d: str) -> DataFrame:
    v = S.vec(spark, d).withColumn("v", F.when(F.col("vec_id") % 11 == 0, F.slice("v", 1, 32)).otherwise(F.col("v")))
    return v.where(F.size("v") != 64).select("vec_id")


@query("SELECT page_id, url, length(extracted_text) AS n_chars FROM v_html")
def s8_html_text(spark: SparkSession, d: str) -> DataFrame:
    return S.html(spark, d).select("page_id", "url", F.length("extracted_text").cast("long").alias("n_chars"))


_SIDE = "CASE WHEN {s} THEN {f} WHEN least(floor(w * 0.5), floor(h * 0.5)) < 400 THEN ceil(floor({f} * 0.5) * (400.0::DOUBLE / least(floor(w * 0.5), floor(h * 0.5)))) ELSE floor({f} * 0.5) END"


@query(f"""
WITH p AS (SELECT p_partkey, (p_size * 37 + 150)::DOUBLE AS w, (p_size * 53 + 100)::DOUBLE AS h FROM part)
SELECT p_partkey, ({_SIDE.format(s='w < 400 OR h < 400', f='w')})::BIGINT AS new_w, ({_SIDE.format(s='w < 400 OR h < 400', f='h')})::BIGINT AS new_h FROM p""")
def s10_resize(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").selectExpr("p_partkey", "double(p_size * 37 + 150) AS w", "double(p_size * 53 + 100) AS h")
    w, h = X.reduced_size(F.col("w"), F.col("h"), 50, 400)
    return p.select("p_partkey", w.alias("new_w"), h.alias("new_h"))


@query("SELECT doc_id, file_hash FROM v_document")
def s12_file_hash(spark: SparkSession, d: str) -> DataFrame:
    return S.document(spark, d).select("doc_id", "file_hash")


@query("""
WITH f AS (SELECT doc_id, 'upload_' || doc_id || '.pdf' AS path, n_chars AS size FROM documents),
j AS (SELECT 'upload_' || job_id || '.pdf' AS path FROM v_jobs WHERE status IN ('queued', 'processing'))
SELECT count(*) AS deleted, sum(size)::BIGINT AS freed FROM f WHERE path NOT IN (SELECT path FROM j)""")
def s20_orphan_files(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "documents").selectExpr("'upload_' || doc_id || '.pdf' AS path", "n_chars AS size")
    j = S.jobs(spark, d).selectExpr("'upload_' || job_id || '.pdf' AS path", "status")
    return orphans(f, j).agg(F.count("*").alias("deleted"), F.sum("size").alias("freed"))


# Scalar functions.

_SNIP = "replace(" + strip_sql("{0}") + ", chr(10), ' ')"


def snippet_sql(c: str) -> str:
    s = _SNIP.format(c)
    return f"CASE WHEN length({s}) > 240 THEN substr({s}, 1, 240) || '…' ELSE {s} END"


@query(f"SELECT page_id, {snippet_sql('extracted_text')} AS snippet FROM v_page")
def x1_snippet(spark: SparkSession, d: str) -> DataFrame:
    return S.page(spark, d).select("page_id", X.snippet(F.col("extracted_text")).alias("snippet"))


def context_sql(c: str, at: str, n: str) -> str:
    lo, hi = f"greatest({at} - 81, 0)", f"least({at} - 1 + {n} + 120, length({c}))"
    part = _SNIP.format(f"substr({c}, {lo} + 1, {hi} - {lo})")
    return f"CASE WHEN {at} > 0 THEN CASE WHEN {lo} > 0 THEN '...' ELSE '' END || {part} || CASE WHEN {hi} < length({c}) THEN '...' ELSE '' END ELSE {snippet_sql(c)} END"


@query(f"SELECT page_id, {context_sql('extracted_text', 'a', '4')} AS snippet FROM (SELECT *, strpos(lower(extracted_text), 'tion') AS a FROM v_page)")
def x2_context_snippet(spark: SparkSession, d: str) -> DataFrame:
    return S.page(spark, d).select("page_id", X.context_snippet(F.col("extracted_text"), "Tion").alias("snippet"))


_NAME = "'  ' || replace(p_name, ' ', '   ') || chr(9)"


@query(f"SELECT p_partkey, {strip_sql(f'''regexp_replace({_NAME}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')''')} AS name FROM part")
def x6_norm_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr("p_partkey", "'  ' || replace(p_name, ' ', '   ') || '\t' AS n").select(
        "p_partkey", C.norm_name(F.col("n")).alias("name")
    )


def _norm_sql(c: str) -> str:
    return strip_sql(f"regexp_replace({c}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')")


_LEAK = "regexp_matches(lower({0}), '" + "|".join(C.PROMPT_SIGNATURES) + "')"
_DEBRIS = "regexp_matches({0}, '[{{}}\\[\\]\"]')"
_VALUE = "CASE doc_id % 6 WHEN 0 THEN substr(text, 1, 60) WHEN 1 THEN substr(text, 1, 200) WHEN 2 THEN 'Output JSON only ' || lang WHEN 3 THEN '[' || lang WHEN 4 THEN 'a, b, c, ' || source ELSE substr(text, 20, 78) END"


@query(f"""
WITH n AS (SELECT doc_id, {_norm_sql(_VALUE)} AS s FROM documents)
SELECT doc_id, CASE WHEN length(s) > 80 OR {_DEBRIS.format('s')} OR {_LEAK.format('s')} OR regexp_matches(s, '[a-z]\\. [A-Z]')
  OR length(s) - length(replace(s, ',', '')) >= 3 THEN '' ELSE s END AS name FROM n""")
def x7_entity_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", C.entity_name(F.expr(_VALUE)).alias("name"))


@query(f"""
WITH n AS (SELECT doc_id, {_norm_sql(_VALUE)} AS s FROM documents)
SELECT doc_id, CASE WHEN s = '' OR length(s) > 150 OR {_DEBRIS.format('s')} OR {_LEAK.format('s')}
  OR length(s) - length(replace(s, ',', '')) >= 5 THEN NULL ELSE s END AS title FROM n""")
def x9_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", C.standard_title(F.expr(_VALUE)).alias("title"))


_QTY = """CASE p_partkey % 10 WHEN 0 THEN p_size || ' ksi' WHEN 1 THEN p_size || '-' || (p_size + 9) || ' HB' WHEN 2 THEN 'QT: ' || p_size || ' HB'
 WHEN 3 THEN ', yield: ' || p_size WHEN 4 THEN 'various' WHEN 5 THEN '{' || p_size || '}' WHEN 6 THEN 'as supplied in the annealed condition, see ' || p_size
 WHEN 7 THEN NULL WHEN 8 THEN '  ' || p_retailprice || '  ' ELSE p_size || ' to ' || (p_size + 5) || ' HRC' END"""
_UNQ = _DEBRIS.format("s") + " OR starts_with(s, ',') OR NOT regexp_matches(s, '[0-9]') OR regexp_matches(s, '[^0-9]{{31,}}')".replace("{{", "{").replace("}}", "}")


@query(f"""
WITH q AS (SELECT p_partkey, {strip_sql('(' + _QTY + ')')} AS s FROM part)
SELECT p_partkey, CASE WHEN s <> '' AND NOT ({_UNQ}) AND NOT {_LEAK.format('s')} THEN s END AS quantity FROM q""")
def x10_quantity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", C.quantity(F.expr(_QTY)).alias("quantity"))


_TAGS = "' Big ' || p_name || '!,' || upper(p_name) || ',' || p_type || '--' || ',, ' || p_brand || ',' || p_name"


@query(rf"""
WITH t AS (SELECT p_partkey, list_filter(list_transform(string_split({_TAGS}, ','), lambda x:
  regexp_replace(regexp_replace(regexp_replace(lower({strip_sql('x')}), '[ \t\n\r\f\x0B]+', '-', 'g'), '[^a-z0-9-]+', '', 'g'), '^-+|-+$', '', 'g')),
  lambda x: x <> '' AND length(x) <= 60) AS ts FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(ts)), '|') AS tags FROM t""")
def x12_topic_tags(spark: SparkSession, d: str) -> DataFrame:
    tags = C.topic_tags(F.split(F.expr(_TAGS), ","))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.sort_array(tags), "|").alias("tags"))


@query("""
SELECT p_partkey, replace(replace(lower(p_name || '-' || p_brand), ' ', '_'), '-', '_') AS collection, replace(lower(p_name || '-' || p_brand), ' ', '-') AS tag FROM part""")
def x13_tag_norm(spark: SparkSession, d: str) -> DataFrame:
    v = F.concat_ws("-", "p_name", "p_brand")
    return table(spark, d, "part").select("p_partkey", C.collection_name(v).alias("collection"), C.tag_name(v).alias("tag"))


_FORMULA = "CASE p_partkey % 6 WHEN 0 THEN 'TiN' WHEN 1 THEN 'Al2O3' WHEN 2 THEN 'AISI' WHEN 3 THEN 'SUS304' WHEN 4 THEN 'Fe' || p_size || 'C' ELSE p_name END"
_IS_FORMULA = "(regexp_matches({0}, '[A-Z]') AND regexp_matches({0}, '[a-z]') AND regexp_matches({0}, '^([A-Z][a-z]?[0-9]*)+$'))"


@query(f"SELECT p_partkey, {_IS_FORMULA.format('s')} AS is_formula FROM (SELECT p_partkey, {_FORMULA} AS s FROM part)")
def x14_formula_guard(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", C.is_formula(F.expr(_FORMULA)).alias("is_formula"))


def canonical_sql(c: str, label: str) -> str:
    s = strip_sql(f"coalesce({c}, '')")
    out = strip_sql(f"regexp_replace(lower({s}), '[ \\t\\n\\r\\f\\x0B_\\-]+', ' ', 'g')")
    for many, one in C.PLURALS[label].items():
        out = f"regexp_replace({out}, '\\b{many}\\b', '{one}', 'g')"
    return f"CASE WHEN {_IS_FORMULA.format(s)} THEN {s} ELSE {out} END"


@query(f"SELECT entity_key, {canonical_sql('name', 'Equipment')} AS canonical FROM v_variant")
def x15_canonical(spark: SparkSession, d: str) -> DataFrame:
    return S.variant(spark, d).select("entity_key", C.canonical(F.col("name"), "Equipment").alias("canonical"))


_NUM = r"-?[0-9]+(\.[0-9]+)?"
_END = r"[ \t]*[A-Za-z]{0,6}[ \t]*$"
_CLASSIFY = f"""CASE WHEN s IS NULL OR s = '' THEN 'null' WHEN {_UNQ} THEN 'garbage'
  WHEN regexp_matches(s, '^{_NUM}{_END}') OR regexp_matches(s, '^{_NUM}[ \\t]*(-|–|—|[tT][oO])[ \\t]*{_NUM}{_END}') THEN 'clean' ELSE 'loose' END"""


@query(f"SELECT p_partkey, {_CLASSIFY} AS class FROM (SELECT p_partkey, {strip_sql('(' + _QTY + ')')} AS s FROM part)")
def x16_classify_numeric(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", C.classify_numeric(F.expr(_QTY)).alias("class"))


@query("SELECT doc_id, list_max(list_transform(regexp_split_to_array(text, '[0-9]'), lambda x: length(x)))::INT AS run FROM documents")
def x17_nondigit_run(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", C.longest_nondigit_run(F.col("text")).alias("run"))


@query("SELECT chunk_id, page_id, chunk_index FROM v_chunk")
def x18_chunk_id(spark: SparkSession, d: str) -> DataFrame:
    return S.chunk(spark, d).select("chunk_id", "page_id", "chunk_index")


@query("""
SELECT p_partkey, 'f_' || substr(sha1(lower(p_name) || '|' || p_type || ' = ' || p_size), 1, 20) AS formula_id,
  't_' || substr(sha1(lower(p_name)), 1, 20) AS table_id FROM part""")
def x19_formula_id(spark: SparkSession, d: str) -> DataFrame:
    expression = F.expr("p_type || '  =  ' || p_size")
    return table(spark, d, "part").select(
        "p_partkey", C.formula_id(F.upper("p_name"), expression).alias("formula_id"), C.table_id(F.col("p_name")).alias("table_id")
    )


@query("SELECT page_id, count(*) AS chunks, max(chunk_index) AS last_index FROM v_chunk GROUP BY 1")
def x20_chunks(spark: SparkSession, d: str) -> DataFrame:
    return S.chunk(spark, d).groupBy("page_id").agg(F.count("*").alias("chunks"), F.max("chunk_index").alias("last_index"))


@query("""
SELECT chunk_id, CASE WHEN length(text) < 300 THEN text ELSE substr(text, 1, 240) END AS summary FROM v_chunk""")
def x21_summary(spark: SparkSession, d: str) -> DataFrame:
    return S.chunk(spark, d).select("chunk_id", X.summary_or_text(F.lit(None).cast("string"), F.col("text")).alias("summary"))


@query("SELECT chunk_id, substr(text, 1, 240) || chr(10) || chr(10) || substr(text, 1, 2000) AS embed_input FROM v_chunk")
def x22_embed_input(spark: SparkSession, d: str) -> DataFrame:
    return S.chunk(spark, d).select("chunk_id", X.embed_input(F.substring("text", 1, 240), F.col("text")).alias("embed_input"))


@query("""
SELECT vec_id, round(list_sum(list_transform(w, lambda x: x * x)), 6) AS norm2, round(w[1], 6) AS first FROM
 (SELECT vec_id, list_transform(v, lambda x: x * 3 / sqrt(list_sum(list_transform(v, lambda y: 9 * y * y)))) AS w FROM v_vec)""")
def x25_l2_norm(spark: SparkSession, d: str) -> DataFrame:
    w = S.vec(spark, d).select("vec_id", V.l2_normalize(F.transform("v", lambda x: x * 3)).alias("w"))
    return w.select("vec_id", F.round(V.dot("w", F.col("w")), 6).alias("norm2"), F.round(F.col("w")[0], 6).alias("first"))


_ANSWER = "'See [#' || (p_partkey % 50 + 3) || ', #' || (p_partkey % 50 + 4) || '] and [Pages ' || (p_partkey % 40 + 2) || '] but not [x' || p_size || '].'"


@query(r"""
WITH a AS (SELECT p_partkey, regexp_extract_all(%s, '\[(?:#\s*\d+(?:\s*[,\-–]\s*#?\s*\d+)*|Pages?\s+[^\]]+)\]') AS cs FROM part),
c AS (SELECT p_partkey, unnest(cs) AS cite FROM a)
SELECT p_partkey, cite, array_to_string(regexp_extract_all(cite, '\d+'), '|') AS pages FROM c""" % _ANSWER)
def x29_citations(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "part").select("p_partkey", F.explode(X.citations(F.expr(_ANSWER))).alias("cite"))
    return c.select("p_partkey", "cite", F.array_join(X.cited_pages(F.col("cite")).cast("array<string>"), "|").alias("pages"))


@query("""
WITH s AS (SELECT * FROM (VALUES (5), (9), (14), (30)) t(page)), c AS (SELECT p_partkey % 20 AS answer, p_size AS cited FROM part),
o AS (SELECT answer, cited, (SELECT page - cited FROM s ORDER BY abs(page - cited), page LIMIT 1) AS off FROM c),
v AS (SELECT answer, off, count(*) AS votes FROM o GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY answer ORDER BY votes DESC, abs(off), off) AS n FROM v)
SELECT answer, coalesce(CASE WHEN votes >= 2 THEN off END::VARCHAR, '') AS page_offset, votes FROM r WHERE n = 1""")
def a19_offset_vote(spark: SparkSession, d: str) -> DataFrame:
    cited = table(spark, d, "part").selectExpr("p_partkey % 20 AS answer", "p_size AS cited")
    voted = B.citation_offset(cited, [5, 9, 14, 30])
    return voted.withColumn("page_offset", F.coalesce(F.col("page_offset").cast("string"), F.lit("")))


@query("""
WITH l AS (SELECT unnest(['Equipment', 'Category', 'Process', 'Analysis', 'Box', 'Material', 'Day', 'Hash']) AS label)
SELECT label, CASE WHEN label IN ('Equipment', 'Hardware', 'Software') THEN label
 WHEN regexp_matches(label, '(?i)[^aeiou]y$') THEN substr(label, 1, length(label) - 1) || 'ies'
 WHEN regexp_matches(label, '(?i)(s|x|ch|sh|z|ss)$') THEN label || 'es' ELSE label || 's' END AS plural FROM l""")
def x30_pluralize(spark: SparkSession, d: str) -> DataFrame:
    names = ["Equipment", "Category", "Process", "Analysis", "Box", "Material", "Day", "Hash"]
    labels = spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("label"))
    return labels.select("label", C.pluralize(F.col("label")).alias("plural"))


_CSV = "' a ,' || p_name || ',, ' || p_type || ' ,'"


@query(f"""
SELECT p_partkey, array_to_string(list_filter(list_transform(string_split({_CSV}, ','), lambda x: {strip_sql('x')}), lambda x: x <> ''), '|') AS items FROM part""")
def x31_csv_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.array_join(X.csv_list(F.expr(_CSV)), "|").alias("items"))


@query("""
SELECT p_partkey, round(least(99.0, 75 + 24.0 * p_size / 50), 6)::DOUBLE AS visual, round(least(99.0, 88 + 11.0 * p_size / 50), 6)::DOUBLE AS entity FROM part""")
def x32_progress(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size").cast("double")
    return table(spark, d, "part").select(
        "p_partkey", F.round(X.visual_progress(n, F.lit(50.0)), 6).alias("visual"), F.round(X.entity_progress(n, F.lit(50.0)), 6).alias("entity")
    )


@query("""
SELECT s_suppkey, 'Supplier ' || s_suppkey || ' (Standard) → REFERENCES → NATION_' || s_nationkey || ' (Clause)' ||
 CASE WHEN s_suppkey % 2 = 0 THEN ' → REFERENCES → R (Clause)' ELSE '' END AS chain FROM supplier""")
def x33_chain(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", X.chain(
        F.expr("'Supplier ' || s_suppkey"), F.lit("Standard"), F.lit("REFERENCES"), F.expr("'NATION_' || s_nationkey"), F.lit("Clause"),
        F.lit("REFERENCES"), F.when(F.col("s_suppkey") % 2 == 0, "R"), F.lit("Clause"),
    ).alias("chain"))


@query("""
SELECT item_id, CASE WHEN len(ts) <= 3 THEN '"' || array_to_string(ts, ' ') || '"' ELSE array_to_string(list_filter(ts, lambda t: length(t) >= 2), ' OR ') END AS query
FROM (SELECT item_id, string_split(CASE WHEN item_id % 2 = 0 THEN array_to_string(string_split(query, ' ')[1:3], ' ') ELSE query END, ' ') AS ts FROM v_query)""")
def x4_query_mode(spark: SparkSession, d: str) -> DataFrame:
    q = S.query(spark, d)
    ts = F.split(F.when(F.col("item_id") % 2 == 0, F.array_join(F.slice(F.split("query", " "), 1, 3), " ")).otherwise(F.col("query")), " ")
    q = q.select("item_id", ts.alias("ts"))
    phrase = F.concat(F.lit('"'), F.array_join("ts", " "), F.lit('"'))
    terms = F.array_join(F.filter("ts", lambda t: F.length(t) >= 2), " OR ")
    return q.select("item_id", F.when(F.size("ts") <= 3, phrase).otherwise(terms).alias("query"))




_KIND = "CASE WHEN length(text) < 80 THEN 'short' WHEN contains(text, '|') THEN 'table' ELSE 'paragraph' END"


@query(f"SELECT chunk_id FROM v_chunk WHERE {_KIND} = 'table'")
def f10_chunk_type(spark: SparkSession, d: str) -> DataFrame:
    return S.chunk(spark, d).where(f"{_KIND} = 'table'").select("chunk_id")


@query("SELECT doc_id, page_number, page_id, title FROM v_page ORDER BY doc_id, page_number LIMIT 200")
def f15_page_list(spark: SparkSession, d: str) -> DataFrame:
    return B.paged(S.page(spark, d).select("doc_id", "page_number", "page_id", "title"), ["doc_id", "page_number"], limit=200, most=1000)


@query("""
SELECT item_id, CASE WHEN len(ws) > 0 THEN '"' || q || '"^4 OR (' || array_to_string(ws, ' OR ') || ')' ELSE '"' || q || '"' END AS query
FROM (SELECT item_id, query AS q, list_filter(string_split(query, ' '), lambda w: length(w) >= 2) AS ws FROM v_query)""")
def x3_keyword_query(spark: SparkSession, d: str) -> DataFrame:
    return S.query(spark, d).select("item_id", X.keyword_query(F.col("query")).alias("query"))


_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)


@query(f"""
SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(string_split(query, ' '), lambda t: length(t) >= 4 AND t NOT IN ({_STOP})))), '|') AS terms,
  array_to_string(list_filter(string_split(query, ' '), lambda t: length(t) >= 3), '|') AS graph_terms FROM v_query""")
def x5_query_terms(spark: SparkSession, d: str) -> DataFrame:
    ts = F.split("query", " ")
    long = F.filter(ts, lambda t: (F.length(t) >= 4) & ~t.isin(*X.STOPWORDS))
    return S.query(spark, d).select(
        "item_id", F.array_join(F.sort_array(F.array_distinct(long)), "|").alias("terms"),
        F.array_join(F.filter(ts, lambda t: F.length(t) >= 3), "|").alias("graph_terms"),
    )


_CAPPED = ", ".join(f"CASE WHEN length(s) > {n} THEN '' ELSE s END AS {name}" for name, n in C.MAX_LEN.items())


@query(f"""
WITH n AS (SELECT p_partkey, p_name || ' ' || repeat('x', p_size * 3) AS s FROM part) SELECT p_partkey, {_CAPPED} FROM n""")
def x8_field_caps(spark: SparkSession, d: str) -> DataFrame:
    s = F.expr("p_name || ' ' || repeat('x', p_size * 3)")
    return table(spark, d, "part").select("p_partkey", *[C.entity_name(s, n).alias(name) for name, n in C.MAX_LEN.items()])


@query(f"""
SELECT doc_id, substr(text, 1, 500) AS context, CASE WHEN {strip_sql('text')} <> '' AND length({strip_sql('text')}) <= 500 THEN {strip_sql('text')} END AS description,
  array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: {strip_sql('x')}), lambda x: x <> '' AND length(x) <= 200)[1:20], '|') AS variables FROM documents""")
def x11_validators(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", C.context(t).alias("context"), C.bounded_text(t).alias("description"),
        F.array_join(C.variables(F.split(t, ",", -1)), "|").alias("variables"),
    )


@query("SELECT item_id, 'search_query: ' || query AS q, 'search_document: ' || query AS d, query AS plain FROM v_query")
def x26_prefixes(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("query")
    return S.query(spark, d).select("item_id", X.query_text(q, True).alias("q"), X.document_text(q, True).alias("d"), X.query_text(q, False).alias("plain"))


@query("SELECT vec_id, round(list_dot_product(v, (SELECT v FROM v_vec WHERE vec_id = 0)), 6) AS d FROM v_vec")
def x23_dot(spark: SparkSession, d: str) -> DataFrame:
    return S.vec(spark, d).select("vec_id", F.round(V.dot("v", S.first_vector(spark, d)), 6).alias("d"))


@query("""
WITH t AS (SELECT DISTINCT unnest(string_split(query, ' ')) AS term FROM v_query), n AS (
  SELECT entity_key, unnest(list_append(common_names, name)) AS x FROM v_material)
SELECT DISTINCT entity_key, term FROM n JOIN t ON contains(lower(x), term)""")
def j7_term_join(spark: SparkSession, d: str) -> DataFrame:
    terms = S.query(spark, d).select(F.explode(F.split("query", " ")).alias("term"))
    return B.term_join(S.material(spark, d), terms).select("entity_key", "term")


@query("""
SELECT page_id, '/images/' || file_hash || '/' || page_number || '/reduced' AS served,
  'page_' || lpad(page_number::VARCHAR, greatest(4, length(page_number::VARCHAR))::INT, '0') || '.png' AS file FROM v_page""")
def s18_image_files(spark: SparkSession, d: str) -> DataFrame:
    number = F.col("page_number")
    return S.page(spark, d).select("page_id", image_path(F.col("file_hash"), number, reduced=True).alias("served"), image_file(number).alias("file"))


@query("SELECT page_id, count(*)::INT AS k, round(sum(list_sum(list_transform(v, lambda x: x::FLOAT::DOUBLE))), 6) AS total FROM v_vec GROUP BY 1")
def s19_multi_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Multi-vectors through their bytes and back."""
    m = S.vec(spark, d).groupBy("page_id").agg(F.collect_list("v").alias("m")).select("page_id", F.size("m").alias("k"), V.to_binary("m").alias("b"))
    back = m.select("page_id", F.size(V.from_binary("b", "k")).alias("k"), F.flatten(V.from_binary("b", "k")).alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return back.select("page_id", "k", F.round(total, 6).alias("total"))


@query()
def x24_projection(spark: SparkSession, d: str) -> DataFrame:
    """Vectors projected to 16 figures; the matrix has no SQL."""
    return S.vec(spark, d).select("vec_id", V.random_projection("v", 16).alias("p"))


@query("SELECT event_id, props AS object FROM events")
def x28_first_object(spark: SparkSession, d: str) -> DataFrame:
    """The object out of a fenced answer with more text and braces behind it."""
    fence = F.concat(F.lit("```json\nthe object: "), F.col("props"), F.lit(' and {"more": "}"}\n```'))
    return table(spark, d, "events").select("event_id", X.first_json_object(fence).alias("object"))


STRUCTURAL = r"""
a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<head>.*?</head>', '', 'g'),
    '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '<br[^>]*>', ' ', 'g'), '</?(a|b|i|em|strong|span|meta|!DOCTYPE)([ ][^>]*)?>', '', 'g') AS h FROM pages),
t AS (SELECT page_id, unnest(regexp_extract_all(h, '<(/?[a-z0-9]+)[^>]*>([^<]*)', 1)) AS tag, unnest(regexp_extract_all(h, '<(/?[a-z0-9]+)[^>]*>([^<]*)', 2)) AS raw,
  unnest(range(0, len(regexp_extract_all(h, '<(/?[a-z0-9]+)[^>]*>([^<]*)', 1)))) AS i FROM a),
x AS (SELECT page_id, i, CASE tag WHEN 'h1' THEN 'heading' WHEN 'li' THEN 'list' ELSE 'text' END AS chunk_type,
  trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(raw, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \t\n\r\f\v]+', ' ', 'g')) AS text FROM t),
k AS (SELECT * FROM x WHERE text <> '' AND (chunk_type <> 'text' OR length(text) >= 40)),
s AS (SELECT *, (row_number() OVER w - 1)::INT AS chunk_index,
  last_value(CASE WHEN chunk_type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above
  FROM k WINDOW w AS (PARTITION BY page_id ORDER BY i))"""


@query(f"""WITH {STRUCTURAL}
SELECT page_id, chunk_index, chunk_type, CASE WHEN chunk_type = 'heading' THEN '' ELSE coalesce(above, '') END AS section, text FROM s""")
def s11_structural(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page_number"), "html")
    got = K.structural(pages)
    return got.select(F.col("doc_id").alias("page_id"), "chunk_index", "chunk_type", F.array_join("section_path", " / ").alias("section"), "text")


@query(f"""WITH {STRUCTURAL}
SELECT page_id, chunk_index, concat_ws(chr(10), CASE WHEN length(text) > 300 THEN 'Relevant chunk summary: ' || substr(text, 1, 240) END,
  CASE WHEN chunk_type <> 'heading' AND above IS NOT NULL THEN 'Section: ' || above END, CASE WHEN chunk_type <> 'text' THEN 'Chunk type: ' || chunk_type END) AS hint FROM s""")
def r11_chunk_hints(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page_number"), "html")
    got = K.structural(pages)
    summary = F.when(F.length("text") > 300, F.substring("text", 1, 240))
    hint = Q.chunk_hint(summary, F.col("section_path"), F.col("chunk_type"))
    return got.select(F.col("doc_id").alias("page_id"), "chunk_index", hint.alias("hint"))
