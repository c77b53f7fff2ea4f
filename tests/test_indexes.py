"""Stored indexes: the results of a full scan, few blocks and lists read, and files that come and go."""

import random
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnsift.operators import retrieval as R
from tarnsift.operators import textindex
from tarnsift.operators.textindex import TextIndex
from tarnsift.operators.vectorindex import VectorIndex
from tarnsift.plans.all import QUERIES
from tarnsift.sources import fixtures as S
from tarnsift.sources.segments import Store, source_files


def words(seed, n):
    """Texts of which most have the common words and few a rare one."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    weight = [1 / (k + 1) for k in range(400)]
    out = []
    for k in range(n):
        t = r.choices(vocabulary, weight, k=r.randint(0, 60)) + ["common"] * r.randint(0, 3)
        r.shuffle(t)
        out.append(t + (["rare", "common", "end"] if k % 501 == 7 else []))
    return out


def write(spark, folder, name, seed, first, n):
    """A file of documents under ``folder``."""
    rows = [(first + k, t) for k, t in enumerate(words(seed, n))]
    spark.createDataFrame(rows, "id long, tokens array<string>").coalesce(1).write.parquet(f"{folder}/tmp-{name}")
    part = next(Path(f"{folder}/tmp-{name}").glob("part-*.parquet"))
    part.rename(f"{folder}/{name}.parquet")
    shutil.rmtree(f"{folder}/tmp-{name}")
    return rows


def index_of(spark, folder, root):
    df = spark.read.parquet(folder)
    rows = lambda some: spark.read.parquet(*some).select("id", "tokens", F.col("_metadata.file_path").alias("uri"))
    return TextIndex.refresh(Store(spark, root), source_files(df), rows), df


def same(got, want):
    got = [(r.id, r.score) for r in got]
    return [i for i, _ in got] == [i for i, _ in want] and [x for _, x in got] == pytest.approx([x for _, x in want])


def check(spark, index, df, k=10, most=9):
    """The top hits of several requests are those of a scan."""
    asked = [["rare", "common", "w3"], ["w0", "w1"], ["w3", "w399", "w50"], ["none"], []]
    for terms in asked[:most]:
        want = [(r.id, r.score) for r in R.top(R.bm25(df, terms), k, F.desc("score"), "id").collect()] if terms else []
        assert same(index.top(terms, k).orderBy("rank").collect(), want)
    for phrase in (["rare", "common", "end"], ["common", "common"], ["w0", "w1", "w0"], ["none", "w0"])[:most]:
        terms = [t for t in phrase if t != "end"]
        want = [(r.id, r.score) for r in R.top(R.bm25(df, terms, phrase), k, F.desc("score"), "id").collect()]
        assert same(index.top(terms, k, phrase).orderBy("rank").collect(), want)


def written(root):
    return {p: p.stat().st_mtime_ns for p in Path(root).rglob("*") if p.is_file()}


@pytest.fixture(autouse=True)
def never_whole(monkeypatch):
    """Ranges are chosen by their bounds however few there are."""
    monkeypatch.setattr(textindex, "WHOLE", 0)


def test_text_index_follows_its_files(spark, tmp_path, monkeypatch):
    folder, root = tmp_path / "docs", tmp_path / "index"
    folder.mkdir()
    write(spark, folder, "a", 1, 0, 700)
    write(spark, folder, "b", 2, 10_000, 300)
    index, df = index_of(spark, str(folder), str(root))
    assert (index.n, index.mean) == (1000, pytest.approx(df.agg(F.avg(F.size("tokens"))).first()[0]))
    check(spark, index, df)
    with monkeypatch.context() as m:
        m.setattr(textindex, "WHOLE", 16)
        check(spark, index, df, most=2)
    before = written(root)
    index_of(spark, str(folder), str(root))
    assert written(root) == before
    # Another application writes nothing either.
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
from pyspark.sql import SparkSession
from tests.test_indexes import index_of
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
index, _ = index_of(spark, {str(folder)!r}, {str(root)!r})
print("found", index.top(["rare"], 5).count())
"""
    assert "found 3" in subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300).stdout
    assert written(root) == before
    # A file more is a segment more; the first one isn't touched.
    write(spark, folder, "c", 3, 20_000, 200)
    index, df = index_of(spark, str(folder), str(root))
    after = written(root)
    assert index.n == 1200 and {p: t for p, t in before.items() if "seg=" in str(p)}.items() <= after.items()
    check(spark, index, df, most=1)
    # A file less: its documents are gone, though the others of its segment stay.
    (folder / "a.parquet").unlink()
    index, df = index_of(spark, str(folder), str(root))
    assert index.n == 500
    check(spark, index, df, most=2)
    # A file written anew counts as another.
    (folder / "c.parquet").unlink()
    write(spark, folder, "c", 4, 20_000, 250)
    index, df = index_of(spark, str(folder), str(root))
    assert index.n == 550 and len(list((root / "segments").iterdir())) == 2
    check(spark, index, df, most=1)


def test_few_blocks_are_read_where_a_rare_word_decides(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    write(spark, folder, "a", 5, 0, 30_000)
    index, df = index_of(spark, str(folder), str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, ["rare", "common", "w0", "w1"]), (2, ["rare", "w2"])], "query_id int, terms array<string>")
    some, every = index.reading(asked, 10)
    assert every > 1000 and some < 0.3 * every
    got = {(r.query_id, r.id): r.score for r in index.search(asked).collect()}
    want = {(q, r.id): r.score for q, terms in asked.collect() for r in R.top(R.bm25(df, terms), 10, F.desc("score"), "id").collect()}
    assert got == pytest.approx(want)


def test_indexing_shuffles_blocks_once_and_scoring_meets_each_block_once(spark, tmp_path):
    """Not a row for each word of each text, nor one for each query and document (F1, F7 to F11)."""
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(words(8, 300))], "id long, tokens array<string>, file int")
    made = TextIndex._blocks(docs, 16, "bigint")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Generate" not in plan
    every = {(r.id, j, t) for r in docs.collect() for j, t in enumerate(["", *r.tokens])}
    got = set()
    for r in made.collect():
        assert (r.n, r.max_tf, r.min_len) == (len(r.ids), max(r.tfs), min(r.lengths)) and sum(r.tfs) == len(r.positions)
        at = iter(r.positions)
        got |= {(i, next(at), r.term) for i, n in zip(r.ids, r.tfs) for _ in range(n)}
    assert got == every
    index = TextIndex(made.withColumn("seg", F.lit(0)), 300.0, 10.0, 16)
    asked = spark.createDataFrame([(k, [f"w{k}", "common"]) for k in range(30)], "query_id int, terms array<string>")
    plan = index.search(asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "inline" not in plan and "explode" not in plan


def test_requests_in_pieces_and_small_tables(spark, tmp_path, monkeypatch):
    folder = tmp_path / "docs"
    folder.mkdir()
    write(spark, folder, "a", 9, 0, 900)
    index, df = index_of(spark, str(folder), str(tmp_path / "index"))
    rows = [(k, [f"w{k}", f"w{2 * k}", "common"], ["common", f"w{k}"]) for k in range(6)]
    asked = spark.createDataFrame(rows, "query_id int, terms array<string>, phrase array<string>")
    want = {(q, r.id): r.score for q, t, p in rows for r in R.top(R.bm25(df, t, p), 10, F.desc("score"), "id").collect()}
    for name, value in (("ASKED", 12), ("MANY", 1), ("TABLE", 1), ("HELD", 5), ("LISTED", 1)):
        monkeypatch.setattr(textindex, name, value)
    assert {(r.query_id, r.id): r.score for r in index.search(asked).collect()} == pytest.approx(want)


def test_searches_read_the_index_and_not_the_texts(spark, sf):
    files = QUERIES["s4_bm25"](spark, sf).inputFiles()
    assert any("tarnsift-index" in f for f in files) and not any("documents.parquet" in f for f in files)


def vectors(seed, n, dim=16, around=12):
    r = np.random.default_rng(seed)
    x = r.normal(size=(around, dim))[r.integers(around, size=n)] + 0.5 * r.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vector_index(spark, folder, root, **more):
    df = spark.read.parquet(folder)
    rows = lambda some: spark.read.parquet(*some).select("id", "v", F.col("_metadata.file_path").alias("uri"))
    return VectorIndex.refresh(Store(spark, root), source_files(df), rows, **more), df


def put(spark, folder, name, x, first):
    rows = [(first + k, [float(y) for y in v]) for k, v in enumerate(x)]
    spark.createDataFrame(rows, "id long, v array<double>").coalesce(1).write.parquet(f"{folder}/tmp-{name}")
    next(Path(f"{folder}/tmp-{name}").glob("part-*.parquet")).rename(f"{folder}/{name}.parquet")
    shutil.rmtree(f"{folder}/tmp-{name}")


def recall(index, df, asked, k=10):
    found = 0
    for q in asked:
        want = {r.id for r in R.knn(df, q, k, key="id").collect()}
        found += len(want & {r.id for r in index.knn(q, k).collect()})
    return found / (k * len(asked))


def test_vector_index_finds_neighbours_and_follows_its_files(spark, tmp_path):
    folder, root = tmp_path / "vecs", tmp_path / "index"
    folder.mkdir()
    x = vectors(1, 3000)
    put(spark, folder, "a", x[:2000], 0)
    put(spark, folder, "b", x[2000:], 2000)
    index, df = vector_index(spark, str(folder), str(root))
    assert index.rows.count() == 3000 and len(index.centroids) == 54
    assert index.probes < 30 and index.measured["recall"] >= 0.98
    asked = [[float(y) for y in v] for v in vectors(1, 3020)[3000:]]
    assert recall(index, df, asked) >= 0.95
    # All lists: the exact way's rows and order.
    want = [(r.id, r.score) for r in R.knn(df, asked[0], 20, key="id").collect()]
    assert [(r.id, r.score) for r in index.knn(asked[0], 20, probes=54).collect()] == want
    plan = index.knn(asked[0], 10, probes=2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    batch = index.batch(spark.createDataFrame(list(enumerate(asked)), "query_id long, q array<double>"), 10)
    assert {(r.query_id, r.id, r.score) for r in batch.collect()} == {(i, r.id, r.score) for i, q in enumerate(asked) for r in index.knn(q, 10).collect()}
    before = written(root)
    vector_index(spark, str(folder), str(root))
    assert written(root) == before
    put(spark, folder, "c", vectors(2, 300), 9000)
    (folder / "b.parquet").unlink()
    index, df = vector_index(spark, str(folder), str(root))
    assert {r.id for r in index.rows.select("id").collect()} == {*range(2000), *range(9000, 9300)}
    assert recall(index, df, asked[:5]) >= 0.9


def test_vector_queries_by_the_index(spark, sf):
    v = S.vec(spark, sf)
    got = {}
    for r in QUERIES["s5_ann"](spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.chunk_id)
    vec = {r.vec_id: r.v for r in v.where("vec_id % 100 = 0").collect()}
    assert set(got) == set(vec) and all(len(x) == 10 for x in got.values())
    share = [len(got[i] & {r.chunk_id for r in R.knn(v, q, 10).collect()}) / 10 for i, q in vec.items()]
    assert sum(share) / len(share) >= 0.95


def test_late_interaction_by_lists_is_the_exact_one(spark, tmp_path):
    folder = tmp_path / "vecs"
    folder.mkdir()
    x = vectors(7, 6000, around=40)
    rows = [(k, k // 6, [float(y) for y in v]) for k, v in enumerate(x)]
    spark.createDataFrame(rows, "id long, page_id long, v array<double>").write.parquet(f"{folder}/x.parquet")
    df = spark.read.parquet(f"{folder}/x.parquet")
    take = lambda some: spark.read.parquet(*some).select("id", "page_id", "v", F.col("_metadata.file_path").alias("uri"))
    index = VectorIndex.refresh(Store(spark, f"{tmp_path}/i"), source_files(df), take)
    r, same = np.random.default_rng(9), 0
    for k in range(20):
        asked = x[6 * k : 6 * k + 4] + 0.2 * r.normal(size=(4, x.shape[1]))
        asked = [[float(y) for y in v] for v in asked / np.linalg.norm(asked, axis=1, keepdims=True)]
        want = [p.page_id for p in R.top(R.maxsim(df, asked), 5, F.desc("score"), "page_id").collect()]
        same += [p.page_id for p in index.maxsim(asked, 5).collect()] == want
    assert same >= 19
    assert index.maxsim(asked, 1000, pool=20_000, probes=len(index.centroids)).count() == 1000


def test_late_query_is_the_exact_one(spark, sf):
    want = QUERIES["a20_maxsim"](spark, sf).orderBy(F.desc("score"), "page_id").limit(5).collect()
    assert [tuple(r) for r in QUERIES["a20_late_top"](spark, sf).select("page_id", "score").collect()] == [tuple(r) for r in want]


def test_awkward_vectors(spark, tmp_path):
    folder = tmp_path / "vecs"
    folder.mkdir()
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (None, [0.0, 1.0]), (4, [0.0, 0.0])]
    spark.createDataFrame(rows, "id long, v array<double>").write.parquet(f"{folder}/x.parquet")
    index, _ = vector_index(spark, f"{folder}/x.parquet", str(tmp_path / "i"))
    assert [(r.id, r.score) for r in index.knn([1.0, 0.0], 5, probes=9).collect()] == [(1, 1.0), (2, 1.0), (4, 0.5)]
    spark.createDataFrame([], "id long, v array<double>").write.parquet(f"{folder}/none.parquet")
    index, _ = vector_index(spark, f"{folder}/none.parquet", str(tmp_path / "j"))
    assert index.rows.count() == 0


def test_chunks_are_indexed_without_a_shuffle_and_pages_by_them(spark, tmp_path):
    """Neither blocks nor texts of pages are shuffled, and one index serves both (F6 to F9)."""
    folder = tmp_path / "docs"
    folder.mkdir()
    rows = write(spark, folder, "a", 11, 0, 700) + write(spark, folder, "b", 12, 1_003, 300)
    df = spark.read.parquet(str(folder))
    made = TextIndex._blocks(df.withColumn("file", F.lit(1)), 1, "bigint", bags=True)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    files = lambda some: spark.read.parquet(*some).select("id", "tokens", F.col("_metadata.file_path").alias("uri"))
    index = TextIndex.refresh(Store(spark, str(tmp_path / "index")), source_files(df), files, bags=True)
    whole = {}
    for i, t in rows:
        whole.setdefault(i // 5, []).extend(t)
    pages = spark.createDataFrame(list(whole.items()), "id long, tokens array<string>")
    for terms in (["rare", "common", "w3"], ["w0", "w1", "w0"], ["w399", "none"], ["none"], []):
        for found, texts in ((index, df), (textindex.GroupIndex(index, F.expr("id div 5")), pages)):
            want = [(r.id, r.score) for r in R.top(R.bm25(texts, terms), 10, F.desc("score"), "id").collect()] if terms else []
            assert same(found.top(terms, 10).orderBy("rank").collect(), want)
    with pytest.raises(ValueError):
        index.top(["w0"], 5, ["w0", "w1"])
    assert index.blocks.where("positions IS NOT NULL").isEmpty()


def test_fused_search_stores_one_index(spark, sf):
    QUERIES["r5_rrf"](spark, sf).collect()
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"), "tarnsift-index")
    assert any(p.name.startswith("chunks-") for p in root.iterdir()) and not any(p.name.startswith("fused-") for p in root.iterdir())


def test_blocks_of_a_range_meet_however_their_join_runs(spark, tmp_path):
    """The join with the ranges chosen isn't what deals blocks to scorers, as its tasks may be split (F2 to F5)."""
    folder = tmp_path / "docs"
    folder.mkdir()
    write(spark, folder, "a", 13, 0, 2_000)
    index, df = index_of(spark, str(folder), str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, ["common", "w0", "w1"])], "query_id int, terms array<string>")
    hits, words = index._asked(asked, 4.0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        best = index._best(hits, words, asked, 10, hits.select("file", "range"))
        plan = best._jdf.queryExecution().executedPlan().toString()
        between = plan[plan.index("MapInArrow") : plan.index("SortMergeJoin")]
        assert "Exchange hashpartitioning(xxhash64(" in between
        want = [(r.id, r.score) for r in R.top(R.bm25(df, ["common", "w0", "w1"]), 10, F.desc("score"), "id").collect()]
        assert same(best.orderBy("rank").collect(), want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
