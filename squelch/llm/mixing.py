"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key, divided by its quality weight; within
a source the documents with the smallest keys fill the source's token budget.
A budget of more than the whole source takes complete epochs first, and only
the fraction that is left is sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from squelch.llm.shared import pieces, stored, text_buffer
from squelch.llm.words import SPACES

#: Keys fall into so many bins; only the bin that a budget ends in is sorted.
BINS = 1 << 14
MOST_EPOCHS = 3
#: Up to so many sources the plan (some 100 bytes a source) is broadcast.
BROADCAST_SOURCES = 50_000
_MARKS = np.zeros(256, bool)
_MARKS[list(b"#*$%&|<>!")] = True


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_size`` (words; null: 0) and ``_quality`` (0.1 to 1, less with marks among the words)."""
    schema = T.StructType([*docs.schema.fields, T.StructField("_size", T.LongType()), T.StructField("_quality", T.DoubleType())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                raw, offsets = text_buffer(part.column(text))
                inside = ~SPACES[raw]
                begins = inside.copy()
                begins[1:] &= ~inside[:-1]
                edges = offsets[:-1][offsets[:-1] < len(raw)]
                begins[edges] = inside[edges]
                size = np.diff(np.searchsorted(np.flatnonzero(begins), offsets))
                marks = np.diff(np.searchsorted(np.flatnonzero(_MARKS[raw]), offsets))
                quality = np.clip(1 - marks / np.maximum(size, 1), 0.1, 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(size, pa.int64()), pa.array(quality, pa.float64())], schema=pa.schema([*part.schema, pa.field("_size", pa.int64()), pa.field("_quality", pa.float64())]))

    return docs.mapInArrow(measure, schema)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = MOST_EPOCHS) -> DataFrame:
    """For each source (``_source``, ``source_size``) its ``target``: shares by weight of all words, at most ``most`` times its own.

    Weights repeat over the sources in code point order, null last. Where the
    sources are sorted by cap over weight, those that are full come first, and
    the others share what is left by weight; so one pass of running sums
    replaces the repeated resharing. One row per source: the windows over all
    sources hold no documents.
    """
    rank = W.orderBy(F.col("_source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int"))
    by_cap = W.orderBy("ratio", F.col("_source").asc_nulls_last())
    before, after = by_cap.rowsBetween(W.unboundedPreceding, -1), by_cap.rowsBetween(0, W.unboundedFollowing)
    every = W.orderBy("ratio", F.col("_source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("level", F.first(F.when(F.col("ratio") > F.col("level"), F.col("level")), ignorenulls=True).over(every))
        .withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
        .select("_source", "source_size", "target")
    )


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[float, ...] = (5, 2, 1), seed: int = 17, keep: list[str] | None = None) -> DataFrame:
    """Every document with ``_size``, ``source_size``, ``target`` (its source's) and ``copies`` (how often the mix takes it).

    The result holds the columns named in ``keep`` (all, if None) as struct
    ``doc``, so that their names can't clash with the added ones.

    A null text has size 0; a null source is a source of its own; documents of
    equal keys are ordered by id and size, and repeated rows are documents of
    their own. Whole documents are taken: those whose running sum fits the
    rest of the budget, then the one further document that brings the sum
    nearest to it, if that is nearer. Sources without words take nothing. An
    empty table gives an empty result. Keys hash the id and the seed, so reruns
    agree.
    """
    keep = docs.columns if keep is None else keep
    # Numbered names, so that no input column can be called as an added one.
    at = {name: f"c{k}" for k, name in enumerate(docs.columns)}
    docs = docs.toDF(*at.values())
    uniform = (F.shiftrightunsigned(F.xxhash64(F.col(at[doc_id]), F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    rows = stored(
        sized(docs, at[text]).select(
            F.struct(*[F.col(at[x]).alias(x) for x in keep]).alias("doc"), F.col(at[source]).alias("_source"), F.col(at[doc_id]).alias("_id"), "_size",
            (-F.log(uniform) / F.col("_quality")).alias("_key"), F.monotonically_increasing_id().alias("_row"),
        ).withColumn("_bin", F.floor((1 - F.exp(-F.col("_key"))) * BINS).cast("int")),
        "mix",
    )
    by_bin = rows.groupBy("_source", "_bin").agg(F.sum("_size").alias("bin_size"))
    plan = targets(by_bin.groupBy("_source").agg(F.sum("bin_size").alias("source_size")), weights)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("int"))
    plan = plan.withColumn("rest", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0)))
    upto = W.partitionBy("_source").orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)
    ends = (
        by_bin.withColumn("upto", F.sum("bin_size").over(upto)).withColumnRenamed("_source", "s2")
        .join(plan, F.col("s2").eqNullSafe(F.col("_source")))
        .groupBy("_source", "source_size", "target", "epochs", "rest")
        .agg(F.coalesce(F.min(F.when(F.col("upto") > F.col("rest"), F.col("_bin"))), F.lit(BINS + 1)).alias("last_bin"), F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))), F.lit(0)).alias("before"))
    )
    ends = stored(ends, "mix-plan")
    small = ends.count() <= BROADCAST_SOURCES
    hint = F.broadcast if small else (lambda x: x)
    planned = rows.join(hint(ends.withColumnRenamed("_source", "s2")), F.col("_source").eqNullSafe(F.col("s2"))).drop("s2")
    running = W.partitionBy("_source").orderBy("_key", "_id", "_size", "_row").rowsBetween(W.unboundedPreceding, 0)
    edge = planned.filter("_bin = last_bin").select("_source", "_row", "_size", "before", "rest", "_key", "_id")
    edge = stored(edge.withColumn("fits", F.col("before") + F.sum("_size").over(running) <= F.col("rest")).filter("fits").select("_source", "_row", "_size", "before", "rest"), "mix-edge")
    gaps = (
        ends.withColumnRenamed("_source", "s2")
        .join(edge.groupBy("_source").agg(F.sum("_size").alias("edge_size")), F.col("s2").eqNullSafe(F.col("_source")), "left")
        .select("s2", (F.col("rest") - F.col("before") - F.coalesce("edge_size", F.lit(0))).alias("gap"))
    )
    out = planned.filter("_bin >= last_bin").join(edge.select("_row", F.lit(True).alias("fits")), "_row", "left").filter("fits is null")
    distance = F.abs(F.col("_size") - F.col("gap"))
    closing = (
        out.join(hint(gaps), F.col("_source").eqNullSafe(F.col("s2")))
        .filter((F.col("gap") > 0) & (distance < F.col("gap")))
        .groupBy("s2").agg(F.min(F.struct(distance.alias("d"), "_key", "_id", "_row")).alias("best"))
        .select("best._row", F.lit(True).alias("closes"))
    )
    chosen = edge.select("_row").unionByName(closing.select("_row")).withColumn("chosen", F.lit(1))
    return planned.join(chosen, "_row", "left").select(
        "doc", "_size", "source_size", "target",
        (F.col("epochs") + F.when((F.col("_bin") < F.col("last_bin")) & (F.col("rest") > 0), 1).otherwise(F.coalesce("chosen", F.lit(0)))).cast("int").alias("copies"),
    )
