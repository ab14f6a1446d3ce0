"""Snapshots: what a scan found, upserts, imports and state machines as joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squelch.operators.relational import newest


def scan(known: DataFrame, seen: DataFrame, key: str, digest: str, final: bool = True) -> DataFrame:
    """The new snapshot: key, digest, presence, integrity and outcome of every known or seen file.

    ``known`` has key, digest and presence. Only a final batch makes unseen
    files missing.
    """
    old = known.select(F.col(key).alias("k"), F.col(digest).alias("old"), F.col("presence").alias("was"))
    new = seen.select(F.col(key).alias("n"), F.col(digest).alias("new"))
    both = old.join(new, F.col("k") == F.col("n"), "full_outer")
    changed = F.col("old").isNotNull() & F.col("new").isNotNull() & (F.col("old") != F.col("new"))
    outcome = (
        F.when(F.col("k").isNull(), "inserted").when(F.col("n").isNull() & (F.col("was") == "missing"), "still_missing")
        .when(F.col("n").isNull(), "missing" if final else "unseen").when(F.col("was") == "missing", "reappeared").when(changed, "changed").otherwise("updated")
    )
    presence = F.when(F.col("n").isNotNull(), "present").when(F.lit(final), "missing").otherwise(F.col("was"))
    return both.select(F.coalesce("k", "n").alias(key), F.coalesce("new", "old").alias(digest), presence.alias("presence"), F.when(changed, "changed").otherwise("ok").alias("integrity"), outcome.alias("outcome"))


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Current rows, replaced or joined by the changes of the same keys."""
    return current.join(changes.select(*keys).distinct(), list(keys), "left_anti").unionByName(changes)


def standing_result(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The result that stands for each key: an answer beats any error, then the later attempt."""
    return newest(results.withColumn("_answer", F.col("status") != "error"), keys, ["_answer", "attempt", "created_at", "seq"]).drop("_answer")


#: (state, action) -> state of a model run.
RUN_STEPS = {
    ("queued", "claim"): "loading", ("loading", "start"): "running", ("running", "finish"): "completed", ("running", "fail"): "failed", ("loading", "fail"): "failed",
    ("loading", "release"): "queued", ("running", "release"): "queued", ("failed", "retry"): "retrying", ("completed", "retry"): "retrying", ("retrying", "claim"): "loading",
}


def stepped(rows: DataFrame, state: str, action: str, steps: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """Adds ``new_state``: where the action leads; an action that doesn't apply leaves the state and is ``refused``."""
    table = rows.sparkSession.createDataFrame([(*k, v) for k, v in (steps or RUN_STEPS).items()], "_s string, _a string, _n string")
    joined = rows.join(F.broadcast(table), (F.col(state) == F.col("_s")) & (F.col(action) == F.col("_a")), "left")
    return joined.withColumn("new_state", F.coalesce("_n", F.col(state))).withColumn("refused", F.col("_n").isNull()).drop("_s", "_a", "_n")


def settled(runs: DataFrame, group: str, state: str = "state") -> DataFrame:
    """completed where all of a group's runs are, partial where all ended otherwise, else running."""
    ended = F.col(state).isin("completed", "failed", "cancelled")
    return runs.groupBy(group).agg(F.count("*").alias("runs"), F.when(F.every(F.col(state) == "completed"), "completed").when(F.every(ended), "partial").otherwise("running").alias("state"))


def import_diff(current: DataFrame, incoming: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """insert, unchanged or conflict for each incoming row (conflict: any field differs); duplicates within the import are conflicts."""
    old = current.select(F.col(key).alias("k"), F.struct(*fields).alias("old"))
    new = incoming.groupBy(F.col(key)).agg(F.first(F.struct(*fields)).alias("new"), F.count("*").alias("copies"))
    joined = new.join(old, F.col(key) == F.col("k"), "left")
    return joined.select(key, F.when(F.col("copies") > 1, "conflict").when(F.col("k").isNull(), "insert").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("conflict").alias("outcome"))


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows and the names of the rules they break (a rule that is null holds)."""
    broken = F.array_compact(F.array(*[F.when(~c, name) for name, c in rules.items()]))
    return rows.withColumn("broken", broken).filter(F.size("broken") > 0)
