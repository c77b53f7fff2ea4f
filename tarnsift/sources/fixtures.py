"""The views that queries run on, made from the driver's tables.

VIEWS has each view's SQL for the oracle; ``with_views`` puts those that a query needs, and
what they need, before it. The functions of the same names build the same views in Spark, in
one pass over each text where a view only cuts texts up.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsift.operators.chunks import line_chunks
from tarnsift.sources.tables import table

TOKEN = "[^\\p{L}\\p{N}]+"

VIEWS: dict[str, str] = {
    "v_document": """
      SELECT doc_id, 'doc_' || doc_id AS title, sha256(text) AS file_hash, source AS collection, lang AS category,
        text, n_chars, (len(string_split(text, chr(10))) + 4) // 5 AS page_count, strlen(text) AS file_size_bytes
      FROM documents""",
    "v_page": """
      SELECT doc_id, file_hash, title, collection, category, i + 1 AS page_number,
        doc_id * 100000 + i + 1 AS page_id, array_to_string(ls[i * 5 + 1:i * 5 + 5], chr(10)) AS extracted_text
      FROM (SELECT *, unnest(range(0, page_count)) AS i FROM
        (SELECT doc_id, file_hash, title, collection, category, page_count, string_split(text, chr(10)) AS ls FROM v_document))""",
    "v_chunk": """
      SELECT doc_id, file_hash, title, collection, category, page_number, page_id, chunk_index, text,
        'ch_' || substr(sha1(file_hash || '|' || page_number || '|' || chunk_index || '|' || substr(text, 1, 200)), 1, 20) AS chunk_id
      FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY p) - 1 AS chunk_index FROM
        (SELECT doc_id, file_hash, title, collection, category, page_number, page_id,
           unnest(string_split(extracted_text, chr(10))) AS text,
           unnest(range(0, len(string_split(extracted_text, chr(10))))) AS p FROM v_page)
        WHERE length(regexp_replace(text, '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g')) >= 40)""",
    "v_vec": "SELECT vec_id, vec_id AS chunk_id, vec_id // 5 AS page_id, embedding::DOUBLE[] AS v, label FROM embeddings",
    "v_page_vec": """
      SELECT page_id, list(x ORDER BY i) AS v FROM (SELECT page_id, i, avg(x) AS x FROM
        (SELECT page_id, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM v_vec) GROUP BY 1, 2) GROUP BY 1""",
    "v_html": """
      SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(html,
        '(?s)<script.*?</script>', ' ', 'g'), '(?s)<style.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS extracted_text
      FROM pages""",
    "v_kg_document": "SELECT c_custkey AS doc_id, c_name AS title, c_mktsegment AS category FROM customer",
    "v_kg_page": "SELECT o_orderkey AS page_id, o_custkey AS doc_id, o_orderpriority AS tag, year(o_orderdate) AS page_number FROM orders",
    "v_mention": """
      SELECT l_orderkey AS page_id, l_partkey AS entity_key, count(*)::BIGINT AS support_count,
        min(l_returnflag) AS context FROM lineitem GROUP BY 1, 2""",
    "v_typed_mention": """
      SELECT *, CASE context WHEN 'A' THEN 'MENTIONS_MATERIAL' WHEN 'N' THEN 'REFERENCES_STANDARD' ELSE 'DESCRIBES_PROCESS' END AS type
      FROM v_mention""",
    "v_governed_by": "SELECT l_partkey AS src, l_suppkey AS dst, count(*)::BIGINT AS support_count FROM lineitem GROUP BY 1, 2",
    "v_references": """
      SELECT 'S' || s_suppkey AS src, 'N' || s_nationkey AS dst FROM supplier
      UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation""",
    "v_material": """
      SELECT p_partkey AS entity_key, p_name || ' ' || p_partkey AS name, p_type AS material_type, p_brand AS uns_number,
        [p_name, upper(p_name)] AS common_names FROM part""",
    "v_variant": """
      SELECT p_partkey AS entity_key, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name)
        WHEN 2 THEN replace(p_name, ' ', '-') ELSE p_name || 's' END AS name,
        CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END AS material_type,
        p_brand AS uns_number FROM part""",
    "v_query": """
      SELECT item_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'),
        lambda x: x <> '')[1:8], ' ') AS query FROM benchmark""",
    "v_jobs": """
      SELECT event_id, user_id AS job_id, ts, CASE event_type WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing'
        WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status,
        CASE WHEN event_type = 'error' THEN 'value ' || value END AS error_message,
        CASE WHEN event_type IN ('view', 'click') THEN value END AS progress_pct FROM events""",
}


def with_views(body: str) -> str:
    """``body``, a SELECT or more after WITH, after the views that it names."""
    need: list[str] = []

    def add(sql: str) -> None:
        for v in VIEWS:
            if v not in need and re.search(rf"\b{v}\b", sql):
                add(VIEWS[v])
                if v not in need:
                    need.append(v)

    add(body)
    views = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in need)
    body = body.strip()
    if not views:
        return body
    for word in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(word):
            return f"{word}{views},\n{body[len(word):]}"
    return f"WITH {views}\n{body}"


def document(spark: SparkSession, d: str, docs: DataFrame | None = None) -> DataFrame:
    """Documents, of the table or of some of its files (``docs``, with their uri)."""
    t = F.col("text")
    docs = table(spark, d, "documents") if docs is None else docs
    return docs.select(
        "doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("title"),
        F.sha2(t, 256).alias("file_hash"), F.col("source").alias("collection"), F.col("lang").alias("category"),
        "text", "n_chars", F.expr("(size(split(text, '\n', -1)) + 4) div 5").alias("page_count"),
        F.octet_length(t).cast("long").alias("file_size_bytes"), *[c for c in ("uri",) if c in docs.columns],
    )


def page(spark: SparkSession, d: str, docs: DataFrame | None = None) -> DataFrame:
    """Pages of five lines, cut within each document's row."""
    rows = document(spark, d, docs)
    keys = ["doc_id", "file_hash", "title", "collection", "category", *[c for c in ("uri",) if c in rows.columns]]
    lines = rows.select(*keys, "page_count", F.split("text", "\n", -1).alias("ls"))
    parts = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("page_count") - 1),
        lambda i: F.array_join(F.slice("ls", (i * 5 + 1).cast("int"), 5), "\n"),
    )
    cut = lines.select(*keys, F.posexplode(parts).alias("i", "extracted_text"))
    number = F.col("i").cast("long") + 1
    return cut.select(
        *keys, number.alias("page_number"), (F.col("doc_id") * 100000 + number).alias("page_id"), "extracted_text"
    )


def chunk(spark: SparkSession, d: str) -> DataFrame:
    return line_chunks(page(spark, d))


def vec(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        "vec_id", F.col("vec_id").alias("chunk_id"), F.expr("vec_id div 5").alias("page_id"),
        F.col("embedding").cast("array<double>").alias("v"), "label",
    )


def page_vec(spark: SparkSession, d: str) -> DataFrame:
    """A vector for each page: the mean of its chunks'."""
    at = vec(spark, d).select("page_id", F.posexplode("v").alias("i", "x")).groupBy("page_id", "i").agg(F.avg("x").alias("x"))
    return at.groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda z: z["x"]).alias("v"))


def html(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("html")
    for pattern in ("(?s)<script.*?</script>", "(?s)<style.*?</style>", "<[^>]*>"):
        t = F.regexp_replace(t, pattern, " ")
    return table(spark, d, "pages").select("page_id", "url", t.alias("extracted_text"))


def kg_document(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("category")
    )


def kg_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("page_id"), F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("tag"),
        F.year("o_orderdate").cast("long").alias("page_number"),
    )


def mention(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page_id"), F.col("l_partkey").alias("entity_key")).agg(
        F.count("*").alias("support_count"), F.min("l_returnflag").alias("context")
    )


def typed_mention(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("context") == "A", "MENTIONS_MATERIAL").when(F.col("context") == "N", "REFERENCES_STANDARD")
    return mention(spark, d).withColumn("type", kind.otherwise("DESCRIBES_PROCESS"))


def governed_by(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(
        F.count("*").alias("support_count")
    )


def references(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").selectExpr("'S' || s_suppkey AS src", "'N' || s_nationkey AS dst")
    return s.unionByName(table(spark, d, "nation").selectExpr("'N' || n_nationkey AS src", "'R' || n_regionkey AS dst"))


def material(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("entity_key"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"),
        F.col("p_type").alias("material_type"), F.col("p_brand").alias("uns_number"),
        F.array("p_name", F.upper("p_name")).alias("common_names"),
    )


def variant(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    n = F.col("p_name")
    name = F.when(k == 0, n).when(k == 1, F.upper(n)).when(k == 2, F.replace(n, F.lit(" "), F.lit("-"))).otherwise(F.concat(n, F.lit("s")))
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("entity_key"), name.alias("name"),
        F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")).alias("material_type"), F.col("p_brand").alias("uns_number"),
    )


def query(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), TOKEN, -1), lambda x: x != "")
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.slice(words, 1, 8), " ").alias("query"))


def first_query(spark: SparkSession, d: str) -> str:
    """The request text that single-query retrieval is run with."""
    return query(spark, d).orderBy("item_id").first().query


def first_vector(spark: SparkSession, d: str) -> list[float]:
    return vec(spark, d).orderBy("vec_id").first().v


def jobs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(
        "event_id", "user_id AS job_id", "ts",
        """CASE event_type WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing' WHEN 'signup' THEN 'queued'
           WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status""",
        "CASE WHEN event_type = 'error' THEN 'value ' || value END AS error_message",
        "CASE WHEN event_type IN ('view', 'click') THEN value END AS progress_pct",
    )
