"""Items of paid review as keyed state of a stream: the rules of ``squelch.operators.answers``, one event at a time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from squelch.operators.answers import MOST_ATTEMPTS, STALE_MINUTES, STATE, STATE_SCHEMA

#: Timers count in milliseconds, events in microseconds.
_MS = 1000
_OUT = f"item_id bigint, {STATE_SCHEMA}, events bigint"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Items(StatefulProcessor):
    """One value for each item; a timer for each claim, which does nothing if the claim has ended by then."""

    def __init__(self, stale_us: int, most: int):
        self.stale_us, self.most = stale_us, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", f"{STATE_SCHEMA}, events bigint")

    def _state(self) -> dict[str, Any]:
        if not self.item.exists():
            return {**dict.fromkeys(STATE), "status": "queued", "attempts": 0, "cost_cents": 0, "late": 0, "events": 0}
        return dict(zip((*STATE, "events"), self.item.get(), strict=True))

    def _expire(self, s: dict[str, Any], now_us: int) -> bool:
        if s["status"] != "running" or s["claimed_us"] + self.stale_us >= now_us:
            return False
        if s["attempts"] >= self.most:
            s.update(status="failed", finished_us=s["claimed_us"] + self.stale_us)
        else:
            s["status"] = "queued"
        return True

    def _take(self, s: dict[str, Any], e: Row) -> None:
        s["events"] += 1
        self._expire(s, e.at_us)
        if e.kind == "claim":
            if s["status"] == "queued":
                s.update(status="running", runner=e.runner, claimed_us=e.at_us, attempts=s["attempts"] + 1)
                self.handle.registerTimer((e.at_us + self.stale_us) // _MS + 1)
            return
        s["cost_cents"] += e.cost_cents or 0  # spent, whatever becomes of the answer
        if s["status"] != "running" or s["runner"] != e.runner:
            s["late"] += 1
        elif e.kind == "done":
            s.update(status="done", finished_us=e.at_us)
        elif e.retryable and s["attempts"] < self.most:
            s["status"] = "queued"
        else:
            s.update(status="failed", finished_us=e.at_us)

    def _out(self, key: Any, s: dict[str, Any]) -> Iterator[Row]:
        values = tuple(s[f] for f in (*STATE, "events"))
        self.item.update(values)  # at once: a key's rows may come in several calls before any output is read
        return iter([Row(item_id=key[0], **dict(zip((*STATE, "events"), values, strict=True)))])

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        s = self._state()
        for e in sorted(rows, key=lambda r: (r.at_us, r.event_id)):
            self._take(s, e)
        return self._out(key, s)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        s = self._state()
        if not self._expire(s, expiredTimerInfo.getExpiryTimeInMs() * _MS):
            return iter(())
        return self._out(key, s)

    def close(self) -> None:
        pass


def item_states(stream: DataFrame, late: str, stale_us: int = STALE_MINUTES * 60_000_000, most: int = MOST_ATTEMPTS) -> DataFrame:
    """The state of each item that a micro-batch or a timer changes.

    ``stream``: the columns of the log and ``at``, its time. An item's events
    have to come in order from one micro-batch to the next (as a partition of a
    queue has them); within one they may come in any. Events later than
    ``late`` are left out by the watermark.
    """
    log = stream.withWatermark("at", late)
    return log.groupBy("item_id").transformWithState(_Items(stale_us, most), outputStructType=_OUT, outputMode="Update", timeMode="EventTime")


def follow(stream: DataFrame, store: str, spark: SparkSession, late: str, stale_us: int = STALE_MINUTES * 60_000_000, most: int = MOST_ATTEMPTS) -> StreamingQuery:
    """Takes all that is available, keeps each batch's changed items under ``store``/items, and stops.

    A repeated batch overwrites itself; state and progress are in ``store``, so
    a rerun goes on where this run ended.
    """
    had = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)  # the only one that keeps this kind of state; a query takes it when it starts

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/items/batch={batch_id}")

    try:
        states = item_states(stream, late, stale_us, most)
        writer = states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{store}/checkpoint")
        return writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, had)


def current(spark: SparkSession, store: str) -> DataFrame:
    """Each item's latest state; a timer's change within a batch stands after the events'."""
    rows = spark.read.parquet(f"{store}/items")
    columns = ["item_id", *STATE, "events"]
    latest = F.struct("batch", "events", F.coalesce("finished_us", F.lit(0)), (F.col("status") != "running").cast("int"))
    return rows.groupBy("item_id").agg(F.max_by(F.struct(*columns), latest).alias("r")).select("r.*")
