"""Sharding by a permutation-filled lookup table.

Each shard has an order of preference over a prime number of slots: from an offset, in steps
of a skip, both taken from its name. Shards take turns; each claims the first slot of its
order that is still free, until the table is full. So all shards get equal shares to within
one slot, and taking a shard away moves little besides its own keys. A row goes to the slot
of its key's hash, and the table, whose size is SLOTS whatever the data, is broadcast: each
row is placed in constant time, without a shuffle.

Defined cases: a null key hashes as null does and has a place like any other; equal keys go
together; repeated rows and a very long text go where their key goes; one shard takes all, and
more shards than slots are refused; an empty table gives an empty result; further columns pass
through, except that slot and shard are replaced.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime, about a thousand times the usual number of shards.
SLOTS = 65_537
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def preference(name: str, slots: int = SLOTS) -> tuple[int, int]:
    """Offset and skip of a shard's order; a prime ``slots`` makes every skip visit all."""
    h = md5(name.encode("utf-8")).digest()
    return int.from_bytes(h[:8], "big") % slots, int.from_bytes(h[8:], "big") % (slots - 1) + 1


def fill(names: tuple[str, ...], slots: int = SLOTS) -> list[int]:
    """The table: the index in ``names`` of the shard that holds each slot."""
    if not names or len(set(names)) < len(names):
        raise ValueError("shards need distinct names")
    if len(names) > slots:
        raise ValueError(f"more shards than the {slots} slots")
    table = [-1] * slots
    at, skip = map(list, zip(*(preference(n, slots) for n in names), strict=True))
    free = slots
    while True:
        for k in range(len(names)):
            i = at[k]
            while table[i] >= 0:
                i = (i + skip[k]) % slots
            table[i] = k
            at[k] = (i + skip[k]) % slots
            free -= 1
            if not free:
                return table


def slot(*keys: str, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def table_frame(spark: SparkSession, named: dict[str, tuple[str, ...]], slots: int = SLOTS) -> DataFrame:
    """slot and one column of shard indices per entry of ``named``."""
    filled = [fill(names, slots) for names in named.values()]
    rows = [(i, *x) for i, x in enumerate(zip(*filled, strict=True))]
    return spark.createDataFrame(rows, "slot int, " + ", ".join(f"`{c}` int" for c in named))


def place(df: DataFrame, keys: tuple[str, ...], shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``df`` with slot and shard (an index in ``shards``)."""
    table = table_frame(df.sparkSession, {"shard": shards}, slots)
    return df.drop("slot", "shard").withColumn("slot", slot(*keys, slots=slots)).join(F.broadcast(table), "slot")


def op9(docs: DataFrame, shards: tuple[str, ...] = SHARDS) -> DataFrame:
    """Every document's shard, and its shard once the last one is taken away."""
    table = table_frame(docs.sparkSession, {"shard": shards, "shard_without_last": shards[:-1] or shards})
    placed = docs.select("doc_id").withColumn("slot", slot("doc_id"))
    return placed.join(F.broadcast(table), "slot").select("doc_id", "slot", "shard", "shard_without_last")
