"""Planning paid review: eligibility, cost and the cap, as one batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Tokens of a request and of its answer, by effort (typical, most).
PROMPT_TOKENS, TOKENS_PER_HYPOTHESIS, AUDIO_TOKENS_PER_SECOND = 1400, 45, 32
OUTPUT_TOKENS = {"low": (900, 2048), "medium": (2000, 4096), "high": (4500, 8192)}


def item_cost(duration_ms: Column, hypotheses: Column, effort: str, text_price: float, audio_price: float, output_price: float) -> tuple[Column, Column]:
    """Typical and worst cost in dollars; prices are for a million tokens."""
    typical, most = OUTPUT_TOKENS[effort]
    audio = AUDIO_TOKENS_PER_SECOND * F.greatest(duration_ms / 1000, F.lit(1.0))
    asked = (PROMPT_TOKENS + TOKENS_PER_HYPOTHESIS * hypotheses) * text_price / 1e6 + audio * audio_price / 1e6
    return asked + typical * output_price / 1e6, asked * 1.25 + most * output_price / 1e6


def admitted(items: DataFrame, cost: str, cap: float, batch: str, order: list[Column]) -> DataFrame:
    """Adds ``spent_before`` and ``admitted``: items of a batch are taken in order while the worst case stays within the cap."""
    w = W.partitionBy(batch).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(cost).over(w), F.lit(0))
    return items.withColumn("spent_before", before).withColumn("admitted", F.col("spent_before") + F.col(cost) <= cap)


def suggested_cap(total: Column, limit: float) -> Column:
    return F.least(F.greatest(F.round(total + 0.005, 2), F.lit(0.01)), F.lit(limit))


def claimable(items: DataFrame, now: Column, stale_minutes: int = 20, attempts: int = 3) -> DataFrame:
    """Items that a worker may take: queued ones, and running ones whose claim is old and attempts are left."""
    stale = (F.col("state") == "running") & (F.col("claimed_at") < now - F.expr(f"interval {stale_minutes} minutes"))
    return items.filter((F.col("state") == "queued") | (stale & (F.col("attempts") < attempts)))
