"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a prime-sized
table. The shards take turns; each claims the first slot in its order that is
still free. Every shard then owns nearly the same number of slots, and adding
or removing a shard moves few slots besides its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots: a prime, and over 100 times the shards, so that shares differ by under 1 %.
SLOTS = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """For each slot, the index of the shard that owns it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if not _is_prime(slots) or slots < len(shards):
        raise ValueError("slots must be a prime not below the number of shards")
    keys = [int.from_bytes(hashlib.md5(s.encode()).digest()[:8], "big") for s in shards]
    steps = [int.from_bytes(hashlib.md5(f"step {s}".encode()).digest()[:8], "big") for s in shards]
    offset, skip = [k % slots for k in keys], [k % (slots - 1) + 1 for k in steps]
    owner, turn, left = np.full(slots, -1, np.int32), [0] * len(shards), slots
    while left:
        for s in range(len(shards)):
            slot = (offset[s] + turn[s] * skip[s]) % slots
            while owner[slot] >= 0:
                turn[s] += 1
                slot = (offset[s] + turn[s] * skip[s]) % slots
            owner[slot] = s
            turn[s] += 1
            left -= 1
            if not left:
                break
    return owner


def slot_of(*keys: Column, slots: int = SLOTS) -> Column:
    """The slot of a key of one or more columns; null is a value of its own."""
    parts = [F.coalesce(F.concat(F.lit("v"), k.cast("string")), F.lit("n")) for k in keys]
    digest = F.md5(F.concat_ws("\x00", *parts))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def table_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    owner = lookup_table(shards, slots)
    rows = [(slot, int(s), shards[s]) for slot, s in enumerate(owner)]
    return spark.createDataFrame(rows, "slot int, shard int, shard_name string")


def _ways(value: str, n: int, owner: np.ndarray) -> list[int]:
    """Slots of ``n`` different shards (all shards, if fewer), in the value's own order."""
    start = int.from_bytes(hashlib.md5(f"way {value}".encode()).digest()[:8], "big") % len(owner)
    places = np.roll(np.arange(len(owner)), -start)
    _, first = np.unique(owner[places], return_index=True)
    return [int(x) for x in places[np.sort(first)[:n]]]


def shard(frame: DataFrame, keys: list[str], shards: list[str], slots: int = SLOTS, spread: dict | None = None) -> DataFrame:
    """Adds ``slot``, ``shard`` (index) and ``shard_name`` to each row.

    Rows of equal keys go to one shard. A column of the input with one of the
    three names is replaced. A null key has a slot of its own; repeated rows
    and ties go where their key goes; an empty table gives an empty result.

    ``spread`` names hot keys (first key column's value -> number of ways):
    their rows are dealt over slots of so many different shards by a hash of the
    whole row, so one key with a third of all rows doesn't fill one shard.

    The table has ``slots`` rows whatever the data, so it is always broadcast,
    and placing a row is one hash and one look-up, without a shuffle.
    """
    frame = frame.drop("slot", "shard", "shard_name")
    parts = [F.col(k) for k in keys]
    slot = slot_of(*parts, slots=slots)
    if spread:
        owner = lookup_table(shards, slots)
        deal = F.xxhash64(*frame.columns)
        for value, n in spread.items():
            ways = F.array(*[F.lit(x) for x in _ways(str(value), int(n), owner)])
            slot = F.when(parts[0].cast("string") == str(value), F.get(ways, F.pmod(deal, F.size(ways)).cast("int"))).otherwise(slot)
    table = table_frame(frame.sparkSession, shards, slots)
    return frame.withColumn("slot", slot).join(F.broadcast(table), "slot", "left").select(*frame.columns, "slot", "shard", "shard_name")


def hot_keys(frame: DataFrame, key: str, shards: int) -> dict[str, int]:
    """Keys with more rows than a shard's fair share, and the ways to spread each.

    At most ``shards`` keys can be that hot, so the collected rows are bounded.
    """
    total = frame.count()
    if not total:
        return {}
    rows = frame.groupBy(F.col(key).cast("string").alias("k")).count().filter(F.col("count") * shards > total).filter("k is not null").collect()
    return {r["k"]: -(-r["count"] * shards // total) for r in rows}
