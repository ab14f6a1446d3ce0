"""What becomes of answers to accept and of segments to nominate: the first reason against each, or what is applied.

A segment's current annotation (``current``: segment_id, label, text,
text_origin, at most one row each) is joined once; nothing is looked up row by
row. A human's text or decision is never overridden.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squelch.functions.lexicon import NEAR_THRESHOLD
from squelch.operators.relational import cascade

#: Where a consensus text has to come from to be silver, and what can be asked of a batch.
SILVER_SOURCES, ACTIONS = ("exact", "near"), ("candidate", "silver", "clear")


def _says(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit("")) != ""


def _with_current(rows: DataFrame, segments: DataFrame, current: DataFrame) -> DataFrame:
    known = segments.select("segment_id", F.col("role").alias("_role"), F.lit(True).alias("_known"))
    now = current.select("segment_id", F.coalesce("label", F.lit("none")).alias("_label"), F.col("text").alias("_text"), F.col("text_origin").alias("_origin"))
    return rows.join(known, "segment_id", "left").join(now, "segment_id", "left").na.fill("none", ["_label"])


def accepted(items: DataFrame, segments: DataFrame, current: DataFrame, min_confidence: float, require_support: bool, threshold: float = NEAR_THRESHOLD) -> DataFrame:
    """item_id, segment_id and ``decision``: accepted, or the first of nine reasons against it.

    items: item_id, segment_id, status, accepted_version, transcript,
    speech_present, confidence (null: 0), similarity (to the best hypothesis;
    null: no support). An item of an unknown segment is judged without a role.
    """
    rows = _with_current(items, segments, current)
    decision = cascade({
        "not done": F.col("status") != "done", "already_accepted": F.col("accepted_version").isNotNull(), "no_speech": ~_says("transcript") | ~F.coalesce("speech_present", F.lit(False)),
        "below_min_confidence": F.coalesce("confidence", F.lit(0.0)) < min_confidence, "no_model_support": F.lit(require_support) & ~F.coalesce(F.col("similarity") >= threshold, F.lit(False)),
        "benchmark_source": F.col("_role") == "benchmark", "human_gold_unchanged": F.col("_label") == "gold", "rejected_by_human": F.col("_label") == "rejected",
        "human_text_unchanged": _says("_text") & (F.col("_origin") == "human"), "accepted": F.lit(True),
    })
    return rows.select("item_id", "segment_id", F.when(decision == "not done", F.concat(F.lit("not_done_"), "status")).otherwise(decision).alias("decision"))


def nominated(ids: DataFrame, segments: DataFrame, current: DataFrame, agreement: DataFrame, action: str) -> DataFrame:
    """segment_id, ``decision`` (applied, or the first reason against it), and the text and its origin that are applied.

    ids: segment_id; repeated ones count once, null ones not at all. agreement:
    segment_id, kind, representative. ``candidate`` and ``silver`` take a
    human's text where there is one, else the representative text; ``clear``
    takes a nomination back and keeps the text.
    """
    if action not in ACTIONS:
        raise ValueError(f"unknown action: {action}")
    asked = ids.select("segment_id").filter("segment_id is not null").distinct()
    rows = _with_current(asked, segments, current).join(agreement.select("segment_id", "kind", "representative"), "segment_id", "left")
    human, consensus = _says("_text") & (F.col("_origin") == "human"), _says("representative")
    origin = F.col("_origin") if action == "clear" else F.when(human, "human").when(consensus, "model_consensus")
    text = F.col("_text") if action == "clear" else F.when(human, F.col("_text")).when(consensus, F.col("representative"))
    reasons = {"unknown_segment": F.col("_known").isNull(), "benchmark_source": F.col("_role") == "benchmark", "human_gold_unchanged": F.col("_label") == "gold"}
    if action == "clear":
        reasons["not_nominated"] = ~F.col("_label").isin("candidate", "silver")
    else:
        reasons |= {"rejected_by_human": F.col("_label") == "rejected", "no_consensus_text": origin.isNull()}
        if action == "silver":
            reasons["insufficient_agreement"] = (origin == "model_consensus") & ~F.coalesce(F.col("kind").isin(*SILVER_SOURCES), F.lit(False))
        reasons[f"already_{action}"] = F.col("_label") == action
    rows = rows.withColumn("decision", cascade(reasons | {"applied": F.lit(True)}))
    applied = F.col("decision") == "applied"
    return rows.select("segment_id", "decision", F.when(applied, text).alias("text"), F.when(applied, origin).alias("text_origin"))
