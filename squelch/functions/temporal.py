"""Wall clocks, cycles and partitions of time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SECOND = 1_000_000


def utc_candidates(wall: Column, zone: Column) -> Column:
    """All instants (UTC, as timestamp_ntz) at which a zone's clocks show ``wall``: none in a gap, two in a fold."""
    base = F.convert_timezone(zone, F.lit("UTC"), wall)
    around = F.array(*[base + F.expr(f"interval {m} minutes") for m in (-60, -30, 0, 30, 60)])
    shown = F.filter(around, lambda c: F.convert_timezone(F.lit("UTC"), zone, c) == wall)
    return F.when(wall.isNotNull() & zone.isNotNull(), F.array_sort(F.array_distinct(shown)))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Seconds, exact to the microsecond."""
    micros = lambda t: F.expr("1") * F.unix_micros(t.cast("timestamp"))
    return (micros(later) - micros(earlier)) / _SECOND


def resolve_capture(wall: Column, zone: Column, modified: Column, duration_ms: Column, tolerance_s: float = 5.0) -> Column:
    """Struct of status and start: resolved, unverified, ambiguous or unresolved.

    A file's time of change should lie one duration after its start; where
    clocks show a time twice, exactly one candidate must agree with that.
    """
    c = utc_candidates(wall, zone)
    agree = F.filter(c, lambda x: F.abs(seconds_between(modified, x) - duration_ms / 1000) <= tolerance_s)
    known = modified.isNotNull() & duration_ms.isNotNull()
    n = F.size(F.coalesce(c, F.array().cast("array<timestamp_ntz>")))
    hits = F.when(known, F.size(agree)).otherwise(0)
    status = F.when(n == 0, "unresolved").when((n == 2) & (hits != 1), "ambiguous").when(hits >= 1, "resolved").otherwise("unverified")
    start = F.when(status == "resolved", F.get(agree, F.lit(0))).when(status == "unverified", F.get(c, F.lit(0)))
    return F.struct(status.alias("status"), start.alias("start"))


def cycle_start(day: Column, anchor: str = "2026-09-03", length: int = 28) -> Column:
    """First day of the publication cycle that holds ``day``, earlier days included."""
    first = F.lit(anchor).cast("date")
    return F.date_add(first, (F.floor(F.datediff(day, first) / length) * length).cast("int"))


def hours_covering(start: Column, end: Column) -> Column:
    """The full hours that a window touches."""
    return F.sequence(F.date_trunc("hour", start).cast("timestamp_ntz"), F.date_trunc("hour", end).cast("timestamp_ntz"), F.expr("interval 1 hour"))
