"""Operators on any table: newest rows, ordinals, samples, pages, bands, neighbours, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from squelch.functions.hashing import sample_key
from squelch.session import stored


def newest(frame: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 1) -> DataFrame:
    """The ``n`` last rows of each key by ``order``; the limit works before the shuffle too."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order]))
    return frame.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def superseded(frame: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds ``superseded``: a newer row of the same key exists."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order]))
    return frame.withColumn("superseded", rank > 1)


def ordinals(frame: DataFrame, order: Sequence[Column], within: Sequence[str]) -> DataFrame:
    """Adds ``ordinal`` from 0 in a total order, within groups."""
    return frame.withColumn("ordinal", F.row_number().over(W.partitionBy(*within).orderBy(*order)) - 1)


def global_ordinals(frame: DataFrame, order: Sequence[Column], buckets: Column) -> DataFrame:
    """Adds ``ordinal`` from 0 over the whole table without one task for all rows.

    ``buckets`` must ascend with the order; rows are ranked within a bucket,
    and the counts of the buckets before are added.
    """
    rows = frame.withColumn("_bucket", buckets)
    counts = rows.groupBy("_bucket").count()
    before = counts.select(F.col("_bucket").alias("_b"), F.coalesce(F.sum("count").over(W.orderBy(F.col("_bucket").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = rows.withColumn("_rank", F.row_number().over(W.partitionBy("_bucket").orderBy(*order)) - 1)
    return ranked.join(before, F.col("_bucket").eqNullSafe(F.col("_b"))).withColumn("ordinal", F.col("_rank") + F.col("_before")).drop("_bucket", "_b", "_rank", "_before")


def hash_sample(frame: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """``n`` rows in the order of a seeded hash: the same on every run and every cluster."""
    return frame.orderBy(sample_key(seed, F.col(key)), key).limit(n)


def range_ordinals(frame: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Adds ``ordinal`` from 0 over the whole table in ``order``, which should be total; equal rows get any of their places.

    Rows are dealt by ranges of the order and numbered in their range; a range
    begins where those before it end. The numbered rows are stored once, so
    that ranges and counts are of the same deal. No task holds more than a range.
    """
    ranged = frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    kept = stored(ranged, "ordinals").withColumn("_range", F.shiftright("_id", 33))
    sizes = sorted((r["_range"], r["count"]) for r in kept.groupBy("_range").count().collect())  # one number for each range
    begin, before = [], 0
    for k, n in sizes:
        begin.append((k, before))
        before += n
    starts = frame.sparkSession.createDataFrame(begin, "_range long, _before long")
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")
    return kept.join(F.broadcast(starts), "_range").withColumn("ordinal", place).drop("_id", "_range", "_before")


def page(frame: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    return frame.orderBy(*order).offset(offset).limit(limit)


def page_after(frame: DataFrame, key: str, after, limit: int) -> DataFrame:
    """Keyset paging: the next rows by a unique key."""
    return frame.filter(F.col(key) > after).orderBy(key).limit(limit)


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, seconds: int, right_name: str) -> DataFrame:
    """Pairs of equal keys at most ``seconds`` apart, as an equi-join on buckets of time.

    The right side goes to its own bucket alone, the left to three, so each
    pair meets once. Right columns come in a struct named ``right_name``.
    """
    bucket = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / (seconds * 1_000_000))
    a = left.withColumn("_bucket", F.explode(F.sequence(bucket - 1, bucket + 1)))
    b = right.select(bucket.alias("_b"), F.struct("*").alias(right_name))
    on = [F.col("_bucket") == F.col("_b"), *[F.col(k) == F.col(f"{right_name}.{k}") for k in keys]]
    gap = F.abs(F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col(f"{right_name}.{time}").cast("timestamp")))
    return a.join(b, reduce(lambda x, y: x & y, on)).filter(gap <= seconds * 1_000_000).drop("_bucket", "_b")


def neighbours(frame: DataFrame, keys: Sequence[str], time: str, key: str) -> DataFrame:
    """Adds ``previous`` and ``next``: the nearest rows strictly earlier and later on the same keys; of equally near ones the greater and the smaller ``key``.

    Rows of one time are one peer group, which a running frame passes as one;
    looking ahead is looking back in the other order, so both are linear.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    up, down = W.partitionBy(*keys).orderBy(micros), W.partitionBy(*keys).orderBy(micros.desc())
    before = F.max(F.struct(time, key)).over(up.rangeBetween(W.unboundedPreceding, -1))[key]
    after = F.min(F.struct(time, key)).over(down.rangeBetween(W.unboundedPreceding, -1))[key]
    return frame.withColumn("previous", before).withColumn("next", after)


def thinned(frame: DataFrame, keys: Sequence[str], order: Sequence[str], points: int) -> DataFrame:
    """At most ``points`` rows of each key, evenly spaced, the first and last kept."""
    w = W.partitionBy(*keys)
    rows = frame.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    step = (F.col("_n") - 1) / (points - 1)
    at = F.round(F.round(F.col("_i") / step) * step)
    return rows.filter((F.col("_n") <= points) | (at == F.col("_i"))).drop("_i", "_n")


def fingerprint(frame: DataFrame, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: the table's name, its rows, and the sum of 60 bits of each row's MD5 over its columns (all, if none are named).

    Each value is written after its length and a colon, a null as an
    exclamation mark, so no two rows are written alike; arrays count as their
    elements' text in brackets. A sum has no order, so tasks add up their own
    rows and one number each travels.
    """
    kinds = dict(frame.dtypes)

    def text(c: str) -> Column:
        if kinds[c].startswith("array"):
            return F.concat(F.lit("["), F.array_join(F.transform(F.col(c), lambda v: _plain(v)), ",", "!"), F.lit("]"))
        return _plain(F.col(c), kinds[c])

    def written(c: str) -> Column:
        value = text(c)
        return F.coalesce(F.concat(F.char_length(value).cast("string"), F.lit(":"), value), F.lit("!"))

    row = F.concat(*[written(c) for c in columns or frame.columns])
    part = F.conv(F.substring(F.md5(row.cast("binary")), 1, 15), 16, 10).cast("decimal(20,0)")
    return frame.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(part).cast("string"), F.lit("0")).alias("digest")).select(F.lit(name).alias("table_name"), "n_rows", "digest")


def _plain(value: Column, kind: str = "float") -> Column:
    """Text that other engines write alike: times in microseconds, fractions in billionths."""
    if kind.startswith("timestamp"):
        return F.unix_micros(value.cast("timestamp")).cast("string")
    if kind in ("float", "double"):
        return F.round(value.cast("double") * 1_000_000_000).cast("bigint").cast("string")
    return value.cast("string")


def gathered(key: str, parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of several tables that share a key, in one shuffle: the key, and an array of structs for each table.

    Each part has the key and one struct column. A key's rows meet in one task
    as arrays, so keys should be things of a few rows (a segment, an airport).
    Null keys meet nothing and are left out; a table without rows of a key
    gives it an empty array.
    """
    tall = None
    for name, part in parts.items():
        value = next(c for c in part.columns if c != key)
        rows = part.filter(F.col(key).isNotNull()).select(F.col(key), F.col(value).alias(name))
        tall = rows if tall is None else tall.unionByName(rows, allowMissingColumns=True)
    return tall.groupBy(key).agg(*[F.collect_list(name).alias(name) for name in parts])


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: ``missing`` on the right or ``extra`` there."""
    a = left.select(F.col(key).alias("a")).distinct()
    b = right.select(F.col(key).alias("b")).distinct()
    both = a.join(b, F.col("a") == F.col("b"), "full_outer").filter("a is null or b is null")
    return both.select(F.coalesce("a", "b").alias(key), F.when(F.col("b").isNull(), "missing").otherwise("extra").alias("side"))


def duplicates(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has."""
    return frame.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def cascade(reasons: dict[str, Column]) -> Column:
    """The first reason whose condition holds; null for none."""
    found = None
    for name, condition in reasons.items():
        found = F.when(condition, name) if found is None else found.when(condition, name)
    return found


def round_half_even(x: Column, digits: int = 4) -> Column:
    """The nearest multiple of 10^-digits to the exact value of a double; halves go to the even one.

    The product with 10^digits is taken as an exact sum of two doubles (by
    splitting x in two halves), so a half is a half and nothing near one is.
    For |x| 10^digits below 2^52.
    """
    ten = float(10**digits)
    wide = x.cast("double") * 134217729.0  # 2^27 + 1
    high = wide - (wide - x)
    product = x * ten
    error = (high * ten - product) + (x - high) * ten
    low = F.floor(product)
    beyond = (product - low - 0.5) + error
    return (low + F.when((beyond > 0) | ((beyond == 0) & (low % 2 != 0)), 1).otherwise(0)) / ten


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """A ratio of sums, rounded half to even; null where the whole is zero."""
    return round_half_even(part / F.nullif(whole, F.lit(0)), digits)
