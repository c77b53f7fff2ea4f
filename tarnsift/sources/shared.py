"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []


def hadoop(spark: SparkSession, path: str):
    """Hadoop's file system and path of ``path``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def folder_of(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``, and must. Only where that is unset on one
    machine, as in tests, a temporary folder is made; the session's settings stay as they are.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        # The JVM may have a checkpoint folder set by hand.
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = jdir.get() if jdir.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="tarnsift-"))
            atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
        base = f"file://{_own_folder[0]}"
    return base.rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the shared one; it goes when the driver ends."""
    path = f"{folder_of(spark)}/tarnsift-{uuid.uuid4().hex}"
    fs, p = hadoop(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        fs, p = hadoop(spark, path)
        fs.delete(p, True)


def stage(df: DataFrame, path: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table at ``path`` and read it back: lineage ends there."""
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
