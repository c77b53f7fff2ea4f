"""Settings from a TOML file; what the file lacks, and a missing file, leave the defaults."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path

from pyspark.sql import SparkSession

ENV = "TARNSIFT_CONFIG"


@dataclass(frozen=True)
class Settings:
    embedding_dim: int = 1024
    native_text_least: int = 50
    text_batch: int = 32
    rerank_pool: int = 50
    shuffle_partitions: int | None = None
    time_zone: str = "UTC"

    @classmethod
    def load(cls, path: str | Path | None = None) -> Settings:
        """From ``path``, else from the file that the environment names."""
        path = path or os.environ.get(ENV)
        if not path or not Path(path).exists():
            return cls()
        table = tomllib.loads(Path(path).read_text(encoding="utf-8")).get("engine", {})
        if unknown := set(table) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return replace(cls(), **table)

    def apply(self, spark: SparkSession) -> SparkSession:
        spark.conf.set("spark.sql.session.timeZone", self.time_zone)
        if self.shuffle_partitions:
            spark.conf.set("spark.sql.shuffle.partitions", self.shuffle_partitions)
        return spark
