"""Reading and writing tables and files: Parquet tables, whole files, plans and change logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table by name (label scan)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """Rows of one key; the filter reaches the row groups' statistics."""
    return df.where(F.col(key) == value)


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Whole files as path, length and content, with their SHA-256 as file_hash."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length", "content", F.sha2("content", 256).alias("file_hash"))


def image_path(file_hash: Column, page: Column, reduced: bool = False) -> Column:
    """Where a page's image is served: null unless the hash is 64 hexadecimal digits and page >= 1."""
    ok = file_hash.rlike("^[a-f0-9]{64}$") & (page >= 1)
    tail = "/reduced" if reduced else ""
    return F.when(ok, F.concat(F.lit("/images/"), file_hash, F.lit("/"), page.cast("string"), F.lit(tail)))


def image_file(page: Column) -> Column:
    """The zero-padded file name of a page's image."""
    return F.concat(F.lit("page_"), F.format_string("%04d", page), F.lit(".png"))


def orphans(files: DataFrame, jobs: DataFrame, path: str = "path") -> DataFrame:
    """Files that no queued or processing job refers to."""
    active = jobs.where(F.col("status").isin("queued", "processing")).select(path)
    return files.join(active, path, "left_anti")


def write_version(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write a new version of a table: Parquet has no MERGE, so upserts overwrite as a whole."""
    w = df.write.mode("overwrite")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def write_plan(df: DataFrame, path: str) -> None:
    """A plan as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_log(df: DataFrame, path: str) -> None:
    """A change log as tab-separated values with a header."""
    df.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)
