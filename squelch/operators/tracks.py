"""Aircraft around a transmission: nearest vectors, rates along a track, positions in between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def nearest_in_time(rows: DataFrame, key: str, time: str, at: Column, tie: str) -> DataFrame:
    """The row of each key nearest to ``at``; the first by ``tie`` on ties."""
    gap = F.abs(F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(at.cast("timestamp")))
    best = F.min_by(F.struct("*"), F.struct(gap.alias("g"), F.col(tie).alias("t")))
    return rows.groupBy(F.col(key).alias("_k")).agg(best.alias("r")).select("r.*")


def with_successor(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Adds ``next_<column>`` of the following row of the same key."""
    w = W.partitionBy(key).orderBy(*order)
    return rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})


def positions_at(track: DataFrame, key: str, time: str, at: Column, gap_s: float = 1800.0) -> DataFrame:
    """lat and lon of each key at ``at``, on the line between the two points around it, if they are at most ``gap_s`` apart.

    ``time`` and ``at`` are seconds.
    """
    pairs = with_successor(track, key, [time], [time, "lat", "lon"])
    t0, t1 = F.col(time), F.col(f"next_{time}")
    around = pairs.filter((t0 <= at) & (at <= t1) & (t1 > t0) & (t1 - t0 <= gap_s))
    share = (at - t0) / (t1 - t0)
    found = around.select(key, t0.alias("t0"), (F.col("lat") + share * (F.col("next_lat") - F.col("lat"))).alias("lat"), (F.col("lon") + share * (F.col("next_lon") - F.col("lon"))).alias("lon"))
    return found.groupBy(key).agg(F.min_by("lat", "t0").alias("lat"), F.min_by("lon", "t0").alias("lon"))


def trails(rows: DataFrame, key: str, time: str, at: Column, points: int) -> DataFrame:
    """Each key's points as one ordered array, one for each second, thinned, times relative to ``at``."""
    from squelch.operators.relational import thinned

    second = rows.withColumn("offset_s", F.floor(F.col(time) - at).cast("long")).dropDuplicates([key, "offset_s"])
    return thinned(second, [key], ["offset_s"], points).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("offset_s", "lat", "lon"))).alias("trail"))
