"""Items of paid review: claims, answers, stale claims, and what late answers cost.

The log of an item has claims (``kind`` = claim) and answers (done or error) by
runners. A claim takes a queued item; an answer counts only for the runner that
holds the item. Whatever becomes of an answer, its cost is kept. A claim that
is older than ``stale_us`` goes stale: the item is queued again, or fails after
``most`` attempts. The same rules run as a fold over the whole log, here, and
as keyed state of a stream in ``squelch.streaming.answers``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squelch.operators.folds import changed, fold, let

#: Minutes until a claim goes stale, and attempts before an item fails.
STALE_MINUTES, MOST_ATTEMPTS = 20, 3
STATE = ("status", "runner", "claimed_us", "attempts", "cost_cents", "late", "finished_us")
STATE_SCHEMA = "status string, runner string, claimed_us bigint, attempts int, cost_cents bigint, late int, finished_us bigint"
OPEN = ("queued", "running")


def _start() -> Column:
    values = {"status": F.lit("queued"), "runner": F.lit(None), "claimed_us": F.lit(None), "attempts": F.lit(0), "cost_cents": F.lit(0), "late": F.lit(0), "finished_us": F.lit(None)}
    kinds = dict(x.split() for x in STATE_SCHEMA.split(", "))
    return F.struct(*[values[f].cast(kinds[f]).alias(f) for f in STATE])


def gone_stale(state: Column, now_us: Column, stale_us: int, most: int = MOST_ATTEMPTS) -> Column:
    """The state as of ``now_us``: a claim that is too old by then goes back to the queue, or fails."""
    stale = (state["status"] == "running") & (state["claimed_us"] + stale_us < now_us)
    over = state["attempts"] >= most
    return F.when(stale & over, changed(state, STATE, status=F.lit("failed"), finished_us=state["claimed_us"] + stale_us)).when(stale, changed(state, STATE, status=F.lit("queued"))).otherwise(state)


def _taken(state: Column, event: Column, most: int) -> Column:
    claim = event["kind"] == "claim"
    free = state["status"] == "queued"
    held = (state["status"] == "running") & state["runner"].eqNullSafe(event["runner"])
    paid = state["cost_cents"] + F.coalesce(event["cost_cents"], F.lit(0))
    again = F.coalesce(event["retryable"], F.lit(False)) & (state["attempts"] < most)
    return (
        F.when(claim & free, changed(state, STATE, status=F.lit("running"), runner=event["runner"], claimed_us=event["at_us"], attempts=state["attempts"] + 1))
        .when(claim, state)
        .when(~held, changed(state, STATE, cost_cents=paid, late=state["late"] + 1))
        .when(event["kind"] == "done", changed(state, STATE, status=F.lit("done"), cost_cents=paid, finished_us=event["at_us"]))
        .when(again, changed(state, STATE, status=F.lit("queued"), cost_cents=paid))
        .otherwise(changed(state, STATE, status=F.lit("failed"), cost_cents=paid, finished_us=event["at_us"]))
    )


def item_states(log: DataFrame, stale_us: int = STALE_MINUTES * 60_000_000, now_us: Column | None = None, most: int = MOST_ATTEMPTS) -> DataFrame:
    """item_id, the fields of its state and its events, after its whole log and as of ``now_us`` (if given).

    log: item_id, at_us (microseconds), event_id, kind (claim, done or error),
    runner, cost_cents, retryable. A null cost is none; a null runner holds
    what a null runner claimed.
    """
    log = log.select("item_id", "at_us", "event_id", "kind", "runner", "cost_cents", "retryable")
    step = lambda s, e: let(gone_stale(s, e["at_us"], stale_us, most), lambda x: _taken(x, e, most))
    found = fold(log, ["item_id"], ["at_us", "event_id"], _start(), step)
    if now_us is not None:
        found = found.withColumn("state", gone_stale(F.col("state"), now_us, stale_us, most))
    return found.select("item_id", *[F.col(f"state.{f}") for f in STATE], "events")


def as_of(items: DataFrame, now_us: Column, stale_us: int, most: int = MOST_ATTEMPTS) -> DataFrame:
    """Item states (as a stream left them) with claims that are too old by ``now_us`` gone stale."""
    state = gone_stale(F.struct(*STATE), now_us, stale_us, most)
    return items.withColumn("_s", state).select(*[F.col(f"_s.{c}").alias(c) if c in STATE else F.col(c) for c in items.columns])


def batches(items: DataFrame, batch: Column) -> DataFrame:
    """batch, items, open, spent_cents and status of each batch: done once nothing of it is queued or running."""
    waiting = F.count_if(F.col("status").isin(*OPEN))
    return items.groupBy(batch.alias("batch")).agg(
        F.count("*").alias("items"), waiting.alias("open"), F.sum("cost_cents").alias("spent_cents"), F.when(waiting == 0, "done").otherwise("running").alias("status")
    )
