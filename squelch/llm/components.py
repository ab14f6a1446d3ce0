"""Connected components of a table of links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squelch.llm.shared import stored


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for each end of the links (columns a, b of long).

    Alternating large-star and small-star steps: each node hands its larger,
    then its smaller neighbours to the least one, until all links are stars.
    Each step is an aggregation and a join; a node with very many links is one
    row of the aggregate, and Spark splits its join partition. Each step is
    stored, so a lost executor costs one step at most.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "links")
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    before = edges.agg(F.count("*").alias("n"), mark.alias("h")).first()
    while before.n:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = stored(small.filter("u != v").distinct(), "links")
        after = edges.agg(F.count("*").alias("n"), mark.alias("h")).first()
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
