"""Frozen training sets: selection, order, splits, manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from squelch.functions.hashing import canonical_hash, split_of
from squelch.operators.relational import range_ordinals


def freeze(items: DataFrame, order: Sequence[Column], group: Column, seed: str, shares: dict[str, float], within: str) -> DataFrame:
    """Items with ``ordinal`` (within the data set) and ``split`` (by their group's hash, so a group stays together)."""
    return items.withColumn("split", split_of(group, seed, shares)).withColumn("ordinal", F.row_number().over(W.partitionBy(within).orderBy(*order)) - 1)


def without_nested(items: DataFrame, parent: str, scope: str = "scope") -> DataFrame:
    """Spans go where their whole segment is in the set too."""
    whole = items.filter(F.col(scope) == "segment").select(parent).distinct()
    return items.filter(F.col(scope) == "segment").unionByName(items.filter(F.col(scope) != "segment").join(whole, parent, "left_anti").select(*items.columns))


#: Digests that are joined and hashed together at each level of a manifest.
FAN = 1024


def manifest_hash(items: DataFrame, fields: Sequence[str], ordinal: str = "ordinal") -> str | None:
    """One hash for items in their order: of a tree over the SHA-256 of each item's canonical JSON; None for no items.

    Ordinals go from 0 without gaps. Each level joins the digests of ``FAN``
    neighbours in order and hashes them, until one is left, so the hash depends
    on the items and their order, not on partitions, and no task sees more than
    ``FAN`` digests of a block.
    """
    record = F.struct(*sorted(fields))
    kind = items.select(record.alias("r")).schema["r"].dataType
    level = items.select(F.col(ordinal).cast("long").alias("k"), canonical_hash(record, kind).alias("digest"))
    last = level.agg(F.max("k").alias("k")).first().k
    if last is None:
        return None
    while True:
        blocks = level.groupBy(F.floor(F.col("k") / FAN).alias("k"))
        level = blocks.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "digest"))), lambda x: x["digest"]), "").cast("binary"), 256).alias("digest"))
        last //= FAN
        if last == 0:
            return level.first().digest


def split_group(grouping: str) -> Column:
    """The key that keeps neighbours in one split: the segment, its source's UTC day, or that day's channel; without a time, its directory."""
    day = F.date_format("capture_start", "yyyy-MM-dd")
    if grouping == "segment":
        return F.concat(F.lit("segment:"), F.col("segment_id").cast("string"))
    if grouping not in ("utc_day", "utc_day_channel"):
        raise ValueError(f"unknown grouping: {grouping}")
    dated = F.concat_ws(":", F.col("source_id").cast("string"), day, *([F.coalesce("channel", F.lit("-"))] if grouping == "utc_day_channel" else []))
    return F.when(day.isNull(), F.concat(F.lit("dir:"), F.col("source_id").cast("string"), F.lit(":"), F.coalesce("relative_dir", F.lit("")))).otherwise(dated)


def frozen(versions: DataFrame, labels: Sequence[str], scopes: Sequence[str], grouping: str, seed: str, shares: dict[str, float], with_spans: bool = False) -> DataFrame:
    """The items of a training set, in its order: current annotations of corpus segments with one of the labels and text.

    versions: version_id, segment_id, scope, start_ms, end_ms, text, label,
    text_origin, and of the segment source_id, role, channel, capture_start,
    relative_dir, duration_ms, sha256. Spans of segments that are in as a whole
    stay out, unless ``with_spans``. Ordered by time (none last), segment,
    whole before spans, start (none first), version.
    """
    fit = versions.filter((F.col("role") == "corpus") & F.col("label").isin(*labels) & F.col("scope").isin(*scopes) & (F.coalesce(F.trim("text"), F.lit("")) != ""))
    kept = fit if with_spans else without_nested(fit, "segment_id")
    length = F.when(F.col("scope") == "span", F.col("end_ms") - F.col("start_ms")).otherwise(F.col("duration_ms"))
    group = split_group(grouping)
    items = kept.select(
        "version_id", "segment_id", "scope", "start_ms", "end_ms", F.trim("text").alias("text"), "label", "text_origin", "sha256", "capture_start",
        split_of(group, seed, shares).alias("split"), group.alias("split_group"), length.alias("duration_ms"),
    )
    order = [F.col("capture_start").asc_nulls_last(), F.col("segment_id"), F.col("scope"), F.col("start_ms").asc_nulls_first(), F.col("version_id")]
    return range_ordinals(items, order).drop("capture_start")


def counts(items: DataFrame, *columns: str) -> DataFrame:
    """Items by each value of each column: column, value, n, in one pass."""
    long = items.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x"))
    return long.groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def export_lines(items: DataFrame) -> DataFrame:
    """One JSON line for each item, keys in order; write with ``write.text``."""
    return items.select(F.to_json(F.struct(*sorted(items.columns))).alias("value"))
