"""Sweeps: which segments a run of models covers, how long it would take, and its frozen order."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squelch.functions.hashing import sample_key
from squelch.operators.relational import range_ordinals, round_half_even

#: Fixed value: minutes to load a model, once for each run.
LOAD_MINUTES = 1.0


@dataclass(frozen=True)
class Selection:
    """Segments of one source; absent and empty fields set no constraint."""

    source_id: int
    utc_from: datetime | str | None = None
    utc_to: datetime | str | None = None
    relative_dir: str | None = None
    channels: tuple[str, ...] = ()
    min_duration_ms: int | None = None
    max_duration_ms: int | None = None
    untranscribed_only: bool = False
    limit: int | None = None
    seed: int = 0


def selected(segments: DataFrame, results: DataFrame, s: Selection, models: list[int]) -> DataFrame:
    """The segments that a selection names: present ones, and of a sample the ``limit`` first by the hash of seed and id.

    ``untranscribed_only`` leaves out segments that all ``models`` have a
    result of (with no models, all that have any).
    """
    rows = segments.filter((F.col("source_id") == s.source_id) & (F.col("presence_status") == "present"))
    if s.utc_from is not None:
        rows = rows.filter(F.col("capture_start") >= F.lit(s.utc_from).cast("timestamp_ntz"))
    if s.utc_to is not None:
        rows = rows.filter(F.col("capture_start") < F.lit(s.utc_to).cast("timestamp_ntz"))
    if s.relative_dir is not None:
        rows = rows.filter(F.col("relative_dir") == s.relative_dir)
    if s.channels:
        rows = rows.filter(F.col("channel").isin(*s.channels))
    if s.min_duration_ms is not None:
        rows = rows.filter(F.col("duration_ms") >= s.min_duration_ms)
    if s.max_duration_ms is not None:
        rows = rows.filter(F.col("duration_ms") <= s.max_duration_ms)
    if s.untranscribed_only:
        pairs = results.filter(F.col("model_id").isin(*models)).select("segment_id", "model_id").distinct()
        done = pairs.groupBy("segment_id").count().filter(F.col("count") >= len(models))
        rows = rows.join(done, "segment_id", "left_anti")
    if s.limit is not None:
        rows = rows.orderBy(sample_key(str(s.seed), F.col("segment_id")), "segment_id").limit(s.limit)
    return rows


def preview(chosen: DataFrame, models: DataFrame, results: DataFrame) -> DataFrame:
    """A row for each model: the selection's segments and audio, the model's speed so far, and the minutes it would take.

    models: model_id, family, sweep_eligible; results: model_id, inference_ms,
    audio_ms. A model without any speed so far has no estimate; ``shared_family``
    says that another one here is of its family, so both agree as one.
    """
    total = chosen.agg(F.count("*").alias("segments"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("audio_ms"))
    speed = results.filter("audio_ms > 0").groupBy("model_id").agg((F.sum("inference_ms").cast("double") / F.sum("audio_ms")).alias("rtf"))
    family = models.groupBy("family").agg((F.count("*") > 1).alias("shared_family"))
    rows = models.join(speed, "model_id", "left").join(family, "family").join(F.broadcast(total))  # one row
    minutes = F.col("audio_ms") / 60000 * F.col("rtf") + LOAD_MINUTES
    return rows.select(
        "model_id", "family", "sweep_eligible", "shared_family", "segments", round_half_even(F.col("audio_ms") / 60000, 1).alias("audio_minutes"), round_half_even(F.col("rtf"), 4).alias("observed_rtf"), round_half_even(minutes, 1).alias("estimated_minutes")
    )


def frozen(chosen: DataFrame, *more_ids: DataFrame) -> DataFrame:
    """segment_id and ordinal of a selection and of explicit or sampled ids (segment_id), each once, by time (none last) and path."""
    rows = chosen.select("segment_id", "capture_start", "relative_path")
    for ids in more_ids:
        rows = rows.unionByName(ids.select("segment_id", "capture_start", "relative_path"))
    return range_ordinals(rows.dropDuplicates(["segment_id"]), [F.col("capture_start").asc_nulls_last(), F.col("relative_path"), F.col("segment_id")]).select("segment_id", "ordinal")
