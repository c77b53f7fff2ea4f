"""A table's schema applied as it is written: keys, required fields, types and values.

Every row gets the names of the rules that it breaks. One write sends rows that break none to the
table and the others aside, and counts by rule are observed metrics of that write, so they cost
no pass of their own; only keys do, which are counted by a grouping. A report alone doesn't join them back. All rows of a repeated key break
its rule; a key with a null field is left to ``required``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

KINDS = ("unique", "required", "type", "values")


@dataclass(frozen=True)
class Rule:
    """``unique``: no two rows share the columns. ``required``: none is null. ``type``: what is there
    reads as type ``what``. ``values``: what is there is one of the list ``what``."""

    kind: str
    columns: tuple[str, ...]
    what: str | tuple | None = None

    @property
    def name(self) -> str:
        return f"{self.kind}({', '.join(self.columns)})"


def _breaks(rule: Rule) -> Column:
    cols = [F.col(f"`{c}`") for c in rule.columns]
    if rule.kind == "required":
        tests = [c.isNull() for c in cols]
    elif rule.kind == "type":
        tests = [c.isNotNull() & c.try_cast(rule.what).isNull() for c in cols]
    elif rule.kind == "values":
        tests = [c.isNotNull() & ~c.isin(list(rule.what)) for c in cols]
    else:
        raise ValueError(f"kind is one of {', '.join(KINDS)}")
    return reduce(lambda a, b: a | b, tests)


def flagged(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``df`` with ``violations``, the names of the rules that a row breaks."""
    broken = [F.when(_breaks(r), F.lit(r.name)) for r in rules if r.kind != "unique"]
    for k, r in enumerate(r for r in rules if r.kind == "unique"):
        again = df.groupBy(*[F.col(f"`{c}`") for c in r.columns]).count().where("count > 1")
        again = again.toDF(*[f"__key{k}_{i}" for i in range(len(r.columns))], f"__n{k}")
        same = reduce(lambda a, b: a & b, [F.col(f"`{c}`") == F.col(f"__key{k}_{i}") for i, c in enumerate(r.columns)])
        df = df.join(again, same, "left").drop(*[f"__key{k}_{i}" for i in range(len(r.columns))])
        broken.append(F.when(F.col(f"__n{k}").isNotNull(), F.lit(r.name)))
    out = df.withColumn("violations", F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>"))
    return out.drop(*[c for c in out.columns if c.startswith("__n")])


def report(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rule and the number of rows that break it, a row for each of ``rules``."""
    # No row needs its key's count back: repeated keys are counted by themselves, and each of the parts
    # joined is one row.
    plain = [F.count(F.when(_breaks(r), 1)).alias(f"n{k}") for k, r in enumerate(rules) if r.kind != "unique"]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *plain)
    for k, r in enumerate(rules):
        if r.kind == "unique":
            cols = [F.col(f"`{c}`") for c in r.columns]
            keys = df.select(*cols).where(reduce(lambda a, b: a & b, [c.isNotNull() for c in cols]))
            again = keys.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
            one = one.crossJoin(F.broadcast(again.agg(F.coalesce(F.sum("__n"), F.lit(0)).cast("long").alias(f"n{k}"))))
    return one.select(F.inline(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"n{k}").alias("n")) for k, r in enumerate(rules)])))


def apply(df: DataFrame, rules: Sequence[Rule], path: str) -> dict[str, int]:
    """Write ``df`` to the table at ``path``, rows that break a rule aside; the counts by rule."""
    seen = Observation()
    counts = [F.count(F.when(F.array_contains("violations", r.name), 1)).alias(f"n{k}") for k, r in enumerate(rules)]
    rows = flagged(df, rules).observe(seen, F.count(F.lit(1)).alias("rows"), *counts)
    rows.withColumn("accepted", (F.size("violations") == 0).cast("int")).write.mode("overwrite").partitionBy("accepted").parquet(path)
    got = seen.get
    return {"rows": got["rows"], **{r.name: got[f"n{k}"] for k, r in enumerate(rules)}}


def accepted(spark: SparkSession, path: str) -> DataFrame:
    """The table: rows that break no rule."""
    return spark.read.parquet(path).where("accepted = 1").drop("accepted", "violations")


def aside(spark: SparkSession, path: str) -> DataFrame:
    """Rows that were set aside, with the rules that they break."""
    return spark.read.parquet(path).where("accepted = 0").drop("accepted")
