"""The review workbench: a composable filter over segments, agreement and annotations."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squelch.functions.text import contains_text

MOST_ROWS = 1000


@dataclass(frozen=True)
class Filters:
    """Absent and empty fields set no constraint, with three exceptions.

    Unless sources are named or ``include_benchmark`` is set, only the corpus is
    searched; unless ``min_models`` is 0, a segment needs that many results;
    and an empty stored sample selects nothing.
    """

    sources: list | None = None
    channels: list[str] | None = None
    utc_from: datetime | str | None = None
    utc_to: datetime | str | None = None
    statuses: list[str] | None = None
    labels: list[str] | None = None
    at_least: dict[str, float] = field(default_factory=dict)
    at_most: dict[str, float] = field(default_factory=dict)
    partial_agreement: bool | None = None
    any_family: list[str] | None = None
    include_benchmark: bool = False
    has_error: bool | None = None
    has_abstention: bool | None = None
    has_error_or_abstention: bool | None = None
    stations: list[str] | None = None
    any_model: list[str] | None = None
    any_flag: list[str] | None = None
    span_labels: list[str] | None = None
    has_spans: bool | None = None
    partial_usable: bool | None = None
    sample_ids: list[int] | None = None
    min_models: int | None = 1
    airport: str | None = None
    q: str | None = None
    scope: str = "any"
    scope_model: str | None = None


@dataclass(frozen=True)
class Texts:
    """What a search looks through: hypotheses (segment_id, model, text), consensus and human texts (segment_id, text)."""

    hypotheses: DataFrame
    consensus: DataFrame
    human: DataFrame


def partial_agreement() -> Column:
    """Some passage is shared by two families, the whole is not. Null where a segment has no agreement row: neither answer selects it."""
    return (F.col("utterance_families") >= 2) & (F.col("exact_families") < 2)


def predicates(f: Filters) -> list[Column]:
    found: list[Column] = []
    if not f.sources and not f.include_benchmark:
        found.append(F.col("role") == "corpus")
    for name, values in (("source_id", f.sources), ("channel", f.channels), ("station", f.stations)):
        if values:
            found.append(F.col(name).isin(list(values)))
    if f.sample_ids is not None:
        found.append(F.col("segment_id").isin(list(f.sample_ids)))
    if f.min_models:
        found.append(F.col("results") >= f.min_models)
    if f.utc_from is not None:
        found.append(F.col("capture_start") >= F.lit(f.utc_from).cast("timestamp_ntz"))
    if f.utc_to is not None:
        found.append(F.col("capture_start") < F.lit(f.utc_to).cast("timestamp_ntz"))
    if f.statuses:
        found.append(F.coalesce(F.col("review_status"), F.lit("unreviewed")).isin(list(f.statuses)))
    if f.labels:
        found.append(F.coalesce(F.col("label"), F.lit("none")).isin(list(f.labels)))
    found += [F.col(c) >= v for c, v in f.at_least.items()]
    found += [F.col(c) <= v for c, v in f.at_most.items()]
    if f.partial_agreement is not None:
        found.append(partial_agreement() if f.partial_agreement else ~partial_agreement())
    for name, values in (("all_families", f.any_family), ("all_models", f.any_model), ("flags", f.any_flag), ("span_labels", f.span_labels)):
        if values:
            found.append(F.arrays_overlap(F.col(name), F.array(*[F.lit(x) for x in values])))
    spans = F.coalesce(F.size("span_labels"), F.lit(-1)) > 0
    if f.has_spans is not None:
        found.append(spans if f.has_spans else ~spans)
    if f.partial_usable is not None:
        usable = F.coalesce(F.arrays_overlap(F.coalesce("span_labels", F.array().cast("array<string>")), F.array(*map(F.lit, USABLE))), F.lit(False)) & ~F.coalesce(F.col("label"), F.lit("none")).isin(*USABLE)
        found.append(usable if f.partial_usable else ~usable)
    if f.has_error_or_abstention is not None:
        problem = (F.col("errors") > 0) | (F.col("abstained") > 0)
        found.append(problem if f.has_error_or_abstention else ~problem)
    for column, wanted in (("errors", f.has_error), ("abstained", f.has_abstention)):
        if wanted is not None:
            found.append(F.col(column) > 0 if wanted else F.col(column) == 0)
    return found


#: Labels that make a transcript usable for training.
USABLE = ("gold", "silver")
#: The saved views of the workbench, by key.
VIEWS = {
    "exact-2-families-3-words": Filters(at_least={"exact_families": 2, "words": 3}),
    "partial-agreement": Filters(partial_agreement=True),
    "utterance-3-families": Filters(at_least={"utterance_families": 3}),
    "exact-2-families": Filters(at_least={"exact_families": 2}),
    "exact-3-providers": Filters(at_least={"exact_providers": 3}),
    "near-3-families": Filters(at_least={"near_families": 3}),
    "high-agreement-unreviewed": Filters(at_least={"exact_families": 2}, statuses=["unreviewed"]),
    "human-corrected": Filters(statuses=["corrected"]),
    "silver-candidates": Filters(labels=["candidate", "silver"]),
    "gold": Filters(labels=["gold"]),
    "disagreement": Filters(at_least={"successes": 2}, at_most={"exact_families": 1, "near_families": 1}),
    "partial-usable": Filters(partial_usable=True, min_models=0),
    "errors-abstentions": Filters(has_error_or_abstention=True),
}


SCOPES = ("any", "human", "consensus", "hypotheses", "model")


def searched_ids(f: Filters, texts: Texts) -> DataFrame | None:
    """Ids of segments whose texts in the filter's scope hold its query; None where it asks for nothing.

    The scope ``model`` looks at one model's hypotheses and, without a query,
    takes all segments that have one.
    """
    words = (f.q or "").strip()
    if f.scope not in SCOPES:
        raise ValueError(f"unknown scope: {f.scope}")
    if not words and not (f.scope == "model" and f.scope_model):
        return None
    if f.scope == "model" and not f.scope_model:
        raise ValueError("scope 'model' needs scope_model")
    held = {"hypotheses": texts.hypotheses, "consensus": texts.consensus, "human": texts.human}
    if f.scope == "model":
        one = texts.hypotheses.filter(F.col("model") == f.scope_model)
        return matching_ids({"model": (one, "segment_id", "text")}, words) if words else one.select(F.col("segment_id").alias("id")).distinct()
    return matching_ids({k: (v, "segment_id", "text") for k, v in held.items() if f.scope in ("any", k)}, words)


def query(rows: DataFrame, filters: Filters, texts: Texts | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """Segments (already left-joined with agreement and annotations) that meet the filters.

    A search needs ``texts``, an airport ``aliases`` (icao, station).
    """
    for condition in predicates(filters):
        rows = rows.filter(condition)
    if filters.airport:
        if aliases is None:
            raise ValueError("an airport needs aliases of stations")
        rows = rows.join(aliases.filter(F.col("icao") == filters.airport).select("station"), "station", "left_semi")
    if filters.q or filters.scope == "model":
        if texts is None:
            raise ValueError("a search needs texts")
        ids = searched_ids(filters, texts)
        rows = rows if ids is None else rows.join(ids.withColumnRenamed("id", "segment_id"), "segment_id", "left_semi")
    return rows


def ordered(rows: DataFrame, key: str, descending: bool, offset: int = 0, limit: int = MOST_ROWS) -> DataFrame:
    """A page; nulls last either way, ids break ties in the same direction."""
    if limit > MOST_ROWS:
        raise ValueError(f"a page has at most {MOST_ROWS} rows")
    by = [F.col(key).desc_nulls_last(), F.col("segment_id").desc()] if descending else [F.col(key).asc_nulls_last(), F.col("segment_id").asc()]
    return rows.orderBy(*by).offset(offset).limit(limit)


def matching_ids(scopes: dict[str, tuple[DataFrame, str, str]], text: str) -> DataFrame:
    """Ids whose text in any scope (frame, id, column) holds the query, whatever its case."""
    found = None
    for frame, key, column in scopes.values():
        ids = frame.filter(contains_text(F.col(column), text)).select(F.col(key).alias("id"))
        found = ids if found is None else found.union(ids)
    return found.distinct()


def facet(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def key_facet(rows: DataFrame, column: str) -> DataFrame:
    """Keys of a JSON object column and how many rows have each."""
    return rows.select(F.explode(F.json_object_keys(column)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def detail(segments: DataFrame, hyp: DataFrame, agreement: DataFrame) -> DataFrame:
    """One nested document for each segment: its fields, hypotheses in model order, agreement."""
    said = hyp.groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("model", "family", "status", "text"))).alias("hypotheses"))
    agreed = agreement.select("segment_id", F.struct(*[c for c in agreement.columns if c != "segment_id"]).alias("agreement"))
    return segments.join(said, "segment_id", "left").join(agreed, "segment_id", "left")


def transcripts(hyp: DataFrame) -> DataFrame:
    """Each segment's hypotheses as a map from model to status and text."""
    return hyp.groupBy("segment_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", F.struct("status", "text"))))).alias("by_model"))
