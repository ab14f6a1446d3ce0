"""All queries over the driver's tables, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from squelch.plans import archive, context, speech, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = tables.QUERIES | speech.QUERIES | archive.QUERIES | context.QUERIES
ORACLES: dict[str, str] = tables.ORACLES | speech.ORACLES | archive.ORACLES | context.ORACLES
