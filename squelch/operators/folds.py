"""Folds of an ordered log for each key, as native expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def changed(state: Column, fields: Sequence[str], **new: Column) -> Column:
    """The state's struct with some fields replaced."""
    return F.struct(*[new.get(f, state[f]).alias(f) for f in fields])


def fold(log: DataFrame, key: Sequence[str], order: Sequence[str], start: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """key, ``state`` and ``events`` (how many) of each key: ``step(state, event)`` over its rows in order.

    ``order`` should tell a key's rows apart; equal rows are folded one after
    another. One shuffle on the key; a key's own log is one array in its task,
    so keys should be things with a history of their own (an item, a thread).
    """
    rest = [c for c in log.columns if c not in key and c not in order]
    grouped = log.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("_log"))
    return grouped.select(*key, F.aggregate("_log", start, step).alias("state"), F.size("_log").cast("long").alias("events"))
