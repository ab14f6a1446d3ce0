"""Versions of annotations under optimistic concurrency, as a fold of each thread's log of saves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squelch.operators.folds import changed, fold, let
from squelch.operators.relational import cascade

#: Labels that a benchmark's segments can never bear, and milliseconds that a span may end after its segment.
TRAINING_LABELS, SPAN_SLACK_MS = ("gold", "silver", "candidate"), 50
_FIELDS = ("version", "event_id", "log")


def refusal(benchmark: Column, forbidden: Sequence[str] = TRAINING_LABELS) -> Column:
    """Why a save is refused whatever the thread's state: the first reason that holds; null for none.

    Columns: label, text, status, confirm_gold, scope, end_ms, duration_ms.
    """
    gold = F.col("label") == "gold"
    return cascade({
        "benchmark": benchmark & F.col("label").isin(*forbidden), "gold_not_confirmed": gold & ~F.coalesce("confirm_gold", F.lit(False)), "gold_without_text": gold & (F.coalesce(F.trim("text"), F.lit("")) == ""),
        "gold_not_reviewed": gold & (F.coalesce("status", F.lit("unreviewed")) == "unreviewed"), "span_after_end": (F.col("scope") == "span") & (F.col("duration_ms") > 0) & (F.col("end_ms") > F.col("duration_ms") + SPAN_SLACK_MS),
    })


def saves(log: DataFrame, thread: Sequence[str] = ("thread_id",)) -> DataFrame:
    """Each save's thread, event_id, outcome, and the thread's version after it.

    log: the thread's key, at_us, event_id (unique), expected_version and
    ``refusal``. A save that isn't refused is taken if the thread's version is
    the one its editor had, and makes the next version; else it is a conflict.
    A thread begins at version 0; a null expected version is 0.
    """
    log = log.select(*thread, "at_us", "event_id", F.coalesce("expected_version", F.lit(0)).cast("int").alias("expected_version"), "refusal")
    entry = "struct<event_id:bigint,outcome:string,version:int>"
    start = F.struct(F.lit(0).alias("version"), F.lit(None).cast("bigint").alias("event_id"), F.array().cast(f"array<{entry}>").alias("log"))

    def step(s: Column, e: Column) -> Column:
        outcome = F.when(e["refusal"].isNotNull(), e["refusal"]).when(e["expected_version"] == s["version"], "saved").otherwise("conflict")

        def taken(x: Column) -> Column:
            version = s["version"] + F.when(x == "saved", 1).otherwise(0)
            one = F.struct(e["event_id"].cast("bigint").alias("event_id"), x.alias("outcome"), version.alias("version"))
            return changed(s, _FIELDS, version=version, log=F.concat(s["log"], F.array(one)))

        return let(outcome, taken)

    return fold(log, list(thread), ["at_us", "event_id"], start, step).select(*thread, F.explode("state.log").alias("x")).select(*thread, "x.*")


def current(log: DataFrame, done: DataFrame, thread: Sequence[str] = ("thread_id",)) -> DataFrame:
    """Each thread's current version with what it says: the save that the thread's pointer names, joined by its id."""
    pointer = done.filter("outcome = 'saved'").groupBy(*thread).agg(F.max_by(F.struct("version", "event_id"), "version").alias("p"))
    return pointer.select(*thread, "p.version", "p.event_id").join(log.drop(*thread), "event_id")
