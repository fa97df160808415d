"""Sharding by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a prime-sized table, ``offset + k * skip`` modulo the
size, both drawn from the MD5 of its name.  Shards take turns (as many claims a turn as their weight) and
claim the next slot of their permutation that is still free, until the table is full.  A key goes to the
shard that holds the slot of its hash: constant time, near-equal loads, and little movement when a shard
comes or goes.  The table has a fixed size, so it may be broadcast at any data size.  Rows are placed with
DataFrame functions only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65537


def build_table(names: Sequence[str], size: int = TABLE_SIZE, weights: Sequence[int] | None = None) -> list[int]:
    """Shard index of each slot.  ``size`` must be prime and at least the number of shards, names differ, and
    ``weights``, if given, are as many whole numbers from 0 on, not all 0; a shard of weight 0 gets no slot."""
    if not names or size < max(2, len(names)) or any(size % p == 0 for p in range(2, int(size**0.5) + 1)):
        raise ValueError("a prime table size of at least the number of shards is needed")
    if len(set(names)) < len(names):
        raise ValueError("shards need different names")
    weights = [1] * len(names) if weights is None else list(weights)
    if len(weights) != len(names) or any(w != int(w) or w < 0 for w in weights) or not any(weights):
        raise ValueError("a weight from 0 on for each shard, and one above 0, are needed")
    digest = [hashlib.md5(n.encode()).digest() for n in names]
    place = [int.from_bytes(d[:8], "big") % size for d in digest]
    skip = [int.from_bytes(d[8:], "big") % (size - 1) + 1 for d in digest]
    slots, free = [-1] * size, size
    while free:
        for i, w in enumerate(weights):
            for _ in range(min(w, free)):
                while slots[place[i]] >= 0:
                    place[i] = (place[i] + skip[i]) % size
                slots[place[i]], free = i, free - 1
    return slots


def slot_of(key: Column, size: int) -> Column:
    """Slot of a key's text: the first 60 bits of its MD5, modulo the table size.  A null key is ''."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def assign_shards(df: DataFrame, key: str, names: Sequence[str], size: int = TABLE_SIZE, weights: Sequence[int] | None = None, spread_by: str | None = None, spread: int = 1) -> DataFrame:
    """Add ``slot`` int and ``shard`` (name) to every row.

    Null keys go to one slot, that of the empty text; equal keys go to one shard, ties need no rule.  A key
    that holds a large share of the rows can be spread over up to ``spread`` slots by a second column,
    ``spread_by``.  Columns of ``df`` called slot or shard are replaced.  An empty table stays empty.
    """
    spark = df.sparkSession
    held = F.col(key).cast("string")
    if spread_by and spread > 1:
        held = F.concat(F.coalesce(held, F.lit("")), F.lit("#"), F.pmod(F.xxhash64(spread_by), F.lit(spread)).cast("string"))
    text = ",".join(map(str, build_table(names, size, weights)))
    lookup = spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("__slot", "__i")).select("__slot", F.element_at(F.array(*map(F.lit, names)), F.col("__i").cast("int") + 1).alias("shard"))
    return df.drop("slot", "shard").withColumn("slot", slot_of(held, size)).join(F.broadcast(lookup), F.col("slot") == F.col("__slot"), "left").drop("__slot")


def write_shards(df: DataFrame, path: str, key: str, names: Sequence[str], **more) -> None:
    """Write one folder per shard.  Rows are rebalanced by shard: a small shard is one task and one file, a large one
    is split over as many as its size needs, so the number of files follows the data and not tasks times shards."""
    assign_shards(df, key, names, **more).hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
