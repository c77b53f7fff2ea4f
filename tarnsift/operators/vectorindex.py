"""An inverted-file index of vectors: lists by nearest centroid, few of which a request reads.

Centroids are learnt over all vectors by rounds of spherical k-means: tasks sum their vectors by
nearest centroid, so a round moves a row of sums for each task and centroid. Vectors are stored by
list, in folders by bucket of lists and sorted by list within, so a request reads the folders and
row groups of the lists nearest to it and scores what they hold exactly, as ``retrieval.knn`` does.
How many lists a request reads (``probes``) is measured once: for a bounded sample of vectors the
exact neighbours are found by a scan, and the fewest lists that hold the TARGET share of them are
taken. All vectors are indexed; ``knn`` stays as the exact way.

The index is a store of segments: new files of the source are put to the centroids there are,
files that are gone drop out. A null vector or id is not indexed; vectors count by direction, and
a zero vector is in the list of the first centroid.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsift.functions import vectors as V
from tarnsift.operators import retrieval as R
from tarnsift.sources.segments import Store, numbered

#: Lists, and bytes of their centroids, at most: tasks and driver hold them.
LISTS, MOST_BYTES = 4_096, 64 << 20
ROUNDS = 8
#: Folders of a segment at most.
BUCKETS = 256
#: Sampled requests, their neighbours, and the share of these that the lists read must hold.
SAMPLE, NEIGHBOURS, TARGET = 200, 10, 0.98


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one size as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def learn(vecs: DataFrame, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of ``vecs`` (v), as many as ``lists`` or fewer."""
    # The first ones are vectors of least hash: ``lists`` rows.
    first = vecs.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(lists).collect()
    centroids = _unit(np.array([r.v for r in first], np.float64)) if first else np.zeros((0, 0))
    for _ in range(rounds if len(centroids) > 1 else 0):

        def sums(batches: Iterator[pa.RecordBatch], c: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros_like(c), np.zeros(len(c), np.int64)
            for batch in batches:
                x = _unit(_matrix(batch.column("v")))
                if len(x):
                    near = (x @ c.T).argmax(1)
                    np.add.at(total, near, x)
                    n += np.bincount(near, minlength=len(c))
            has = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has].tolist(), pa.list_(pa.float64()))], names=["list", "s"])

        def add(df: pd.DataFrame) -> pd.DataFrame:
            # In order, as sums of floats depend on it.
            rows = sorted(map(tuple, df["s"]))
            return pd.DataFrame({"list": df["list"].iloc[:1], "s": [np.sum(rows, axis=0).tolist()]})

        found = vecs.select("v").mapInArrow(sums, "list long, s array<double>")
        moved = centroids.copy()
        # A row a centroid.
        for r in found.groupBy("list").applyInPandas(add, "list long, s array<double>").collect():
            moved[r.list] = r.s
        moved = _unit(moved)
        if np.allclose(moved, centroids, atol=1e-9):
            break
        centroids = moved
    return centroids


def assign(vecs: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vecs`` with the nearest centroid's number as ``list``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"))
            near = (x @ centroids.T).argmax(1) if x.size else np.zeros(len(x), np.int64)
            yield batch.append_column("list", pa.array(near.astype(np.int32), pa.int32()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vecs.schema.fields)
    return vecs.mapInArrow(run, f"{schema}, list int")


def exact(vecs: DataFrame, asked: Sequence[tuple[int, Sequence[float]]], k: int) -> DataFrame:
    """query_id, id, s: the ``k`` nearest of ``vecs`` (id, v) to each of a bounded list of requests,
    by one scan: each task sends on its own ``k``."""
    ids = np.array([i for i, _ in asked], np.int64)
    q = np.array([v for _, v in asked], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = []
        for batch in batches:
            x = _matrix(batch.column("v"))
            if not len(x):
                continue
            s = np.round(q @ x.T, R.PLACES)
            at = np.argsort(-s, axis=1, kind="stable")[:, :k]
            # Ties at the cut are settled by id over what the batch has.
            cut = np.take_along_axis(s, at[:, -1:], 1)
            which, col = np.nonzero(s >= cut)
            mine = batch.column("id").to_numpy()
            rows = pd.DataFrame({"query_id": ids[which], "id": mine[col], "s": s[which, col]})
            best = [pd.concat([*best, rows]).sort_values(["query_id", "s", "id"], ascending=[True, False, True]).groupby("query_id").head(k)]
        if best:
            yield pa.RecordBatch.from_pandas(best[0].reset_index(drop=True), preserve_index=False)

    found = vecs.select(F.col("id").cast("long").alias("id"), "v").mapInArrow(run, "query_id long, id long, s double")
    return R.top(found, k, F.desc("s"), "id", by=["query_id"])


@dataclass
class VectorIndex:
    """rows: bucket, list, file, id, v and what else is kept. centroids: one a list."""

    rows: DataFrame
    centroids: np.ndarray
    probes: int
    buckets: int
    measured: dict = field(default_factory=dict)

    @classmethod
    def refresh(cls, store: Store, files: dict[str, str], vecs: Callable[[list[str]], DataFrame], lists: int | None = None, rounds: int = ROUNDS) -> VectorIndex:
        """The index in ``store``, brought to ``files``. ``vecs``: id, v, uri and columns to keep of
        the rows of some files. Without ``lists`` there are about as many as the root of the number
        of vectors."""
        spark = store.spark
        meta_at = f"{store.root}/learnt"
        version, _ = store.entries()

        def rows_of(numbers: dict[str, int]) -> DataFrame:
            return numbered(vecs(list(numbers)).where("id IS NOT NULL AND v IS NOT NULL"), numbers).withColumn("v", F.col("v").cast("array<double>"))

        if not version:
            all_ = vecs(list(files)).where("id IS NOT NULL AND v IS NOT NULL").withColumn("v", F.col("v").cast("array<double>"))
            n, size = all_.agg(F.count("*"), F.max(F.size("v"))).first()
            most = min(LISTS, MOST_BYTES // (8 * max(size or 1, 1)))
            c = learn(all_, max(1, min(lists or math.isqrt(n), most)), rounds)
            buckets = min(BUCKETS, max(1, len(c)))
            row = (json.dumps({"centroids": c.tolist(), "buckets": buckets}),)
            spark.createDataFrame([row], "learnt string").coalesce(1).write.mode("overwrite").parquet(meta_at)
        learnt = json.loads(spark.read.schema("learnt string").parquet(meta_at).first().learnt)
        c, buckets = np.array(learnt["centroids"]), learnt["buckets"]

        def build(path: str, numbers: dict[str, int]) -> dict[int, tuple[int, float]]:
            put = assign(rows_of(numbers), c).withColumn("bucket", F.col("list") % buckets)
            # Small buckets share a task, and those of crowded lists are split.
            put = put.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "list")
            put.write.partitionBy("bucket").parquet(path)
            kept = spark.read.schema("file int, bucket int").parquet(path)
            return {r.file: (r.n, 0.0) for r in kept.groupBy("file").agg(F.count("*").alias("n")).collect()}

        entries = store.refresh(files, build)
        own = [f for f in vecs(list(files)).schema.fields if f.name not in ("v", "uri")]
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
        rows = store.read(f"{cols}, v array<double>, file int, list int, bucket int", entries)
        index = cls(rows, c, len(c), buckets)
        at = f"{store.root}/probes-{store.entries()[0]}"
        index.measured = index._measured(spark, at)
        index.probes = index.measured["probes"]
        return index

    def _measured(self, spark: SparkSession, at: str) -> dict:
        from tarnsift.sources.shared import hadoop

        fs, p = hadoop(spark, f"{at}/_SUCCESS")
        if not fs.exists(p):
            spark.createDataFrame([(json.dumps(self.measure()),)], "m string").coalesce(1).write.mode("overwrite").parquet(at)
        return json.loads(spark.read.schema("m string").parquet(at).first().m)

    def measure(self, sample: int = SAMPLE, k: int = NEIGHBOURS, target: float = TARGET) -> dict:
        """The fewest lists that hold ``target`` of the exact ``k`` neighbours of ``sample`` vectors
        of least hash, and that share (recall)."""
        picked = self.rows.select("id", "v").orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(sample).collect()
        if not picked:
            return {"probes": 1, "recall": 1.0}
        near = exact(self.rows, [(i, r.v) for i, r in enumerate(picked)], k)
        # ``sample`` * ``k`` rows of three numbers.
        few = near.select(F.col("query_id").alias("q"), F.col("id").cast("long").alias("id"))
        at = self.rows.select(F.col("id").cast("long").alias("id"), "list").join(F.broadcast(few), "id").select("q", "id", "list").collect()
        order = np.argsort(-(np.array([r.v for r in picked]) @ self.centroids.T), axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], 1)
        need = np.sort([int(place[r.q, r.list]) + 1 for r in at])
        probes = int(need[min(len(need) - 1, math.ceil(target * len(need)) - 1)])
        return {"probes": probes, "recall": float((need <= probes).mean())}

    def nearest_lists(self, q: Sequence[float], probes: int | None = None) -> list[int]:
        s = self.centroids @ np.asarray(q, np.float64)
        return sorted(np.argsort(-s, kind="stable")[: probes or self.probes].tolist())

    def knn(self, q: Sequence[float], k: int, key: str = "id", scale: str = "unit", probes: int | None = None) -> DataFrame:
        """As ``retrieval.knn``, of the vectors in the lists nearest to ``q``."""
        lists = self.nearest_lists(q, probes)
        return R.knn(self.held(lists).select(F.col("id").alias(key), "v"), q, k, key=key, scale=scale)

    def held(self, lists: Iterable[int]) -> DataFrame:
        """The rows of some lists: few folders, and few row groups of each."""
        lists = sorted(lists)
        return self.rows.where(F.col("bucket").isin(sorted({x % self.buckets for x in lists})) & F.col("list").isin(lists))

    def maxsim(self, queries: Sequence[Sequence[float]], k: int, pool: int = 100, probes: int | None = None, key: str = "page_id") -> DataFrame:
        """key, score, rank of the ``k`` best by late interaction, as ``retrieval.maxsim`` scores them.

        Keys are ranked first by the vectors in the lists nearest to each vector of the request (twice
        as many as a single request reads); for a vector of the request of which a key has none
        there, it counts with the worst centroid of those lists. The ``pool`` best are then scored
        by all that they have.
        """
        s = np.asarray(queries, np.float64).reshape(len(queries), -1) @ self.centroids.T if len(queries) else np.zeros((0, len(self.centroids)))
        near = np.argsort(-s, axis=1, kind="stable")[:, : probes or 2 * self.probes]
        least = [F.lit(float(s[i, near[i]].min())) for i in range(len(s))]
        best = [F.greatest(F.max(V.dot("v", q)), x) for q, x in zip(queries, least, strict=True)]
        rough = sum(best, F.lit(0.0))
        few = self.held(set(near.ravel().tolist())).groupBy(key).agg(rough.alias("rough")).orderBy(F.desc("rough"), key).limit(pool)
        small = F.broadcast(few.select(key)) if pool <= R.FEW else few.select(key)
        return R.top(R.maxsim(self.rows.join(small, key, "left_semi"), queries, key), k, F.desc("score"), key)

    def batch(self, queries: DataFrame, k: int = NEIGHBOURS, probes: int | None = None) -> DataFrame:
        """query_id, id, score, rank of the ``k`` nearest in the nearest lists of each of ``queries``
        (query_id, q): requests go to their lists, and lists of any length meet them by a join."""
        c, many = self.centroids, min(probes or self.probes, len(self.centroids))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column("q"))
                if len(x):
                    at = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :many]
                    yield b.append_column("lists", pa.array(at.astype(np.int32).tolist(), pa.list_(pa.int32())))

        kind = queries.schema["query_id"].dataType.simpleString()
        asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).where("q IS NOT NULL")
        asked = asked.mapInArrow(run, f"query_id {kind}, q array<double>, lists array<int>")
        asked = asked.select("query_id", "q", F.explode("lists").alias("list")).withColumn("bucket", F.col("list") % self.buckets)
        met = self.rows.join(asked, ["bucket", "list"]).select("query_id", "id", F.round(V.unit_score(V.dot("v", F.col("q"))), R.PLACES).alias("score"))
        return R.top(met, k, F.desc("score"), "id", by=["query_id"])
