"""Agreement between independent model families on what was said.

Independence counts families, never models; an abstention is no disagreement.
Everything is keyed by segment, so a segment's few hypotheses meet in one
shuffle on ``segment_id`` and no segment meets another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from squelch.functions.lexicon import NEAR_THRESHOLD
from squelch.functions.sequence import compared_texts, token_similarity
from squelch.functions.text import evidence_tokens
from squelch.operators.relational import round_half_even


def spoken(hyp: DataFrame) -> DataFrame:
    """Successful hypotheses with ``tokens`` and ``norm`` (normalized text), the empty ones left out."""
    said = hyp.filter("status = 'success'").withColumn("tokens", evidence_tokens(F.col("text"))).filter(F.size("tokens") > 0)
    return said.withColumn("norm", F.array_join("tokens", " "))


def exact_groups(hyp: DataFrame) -> DataFrame:
    """Groups of equal normalized text of a segment: members, providers, families, and the text of the first model."""
    return spoken(hyp).groupBy("segment_id", "norm").agg(
        F.count("*").alias("providers"), F.count_distinct("family").alias("families"), F.min_by(F.trim("text"), "model").alias("text"),
        F.array_sort(F.collect_set("model")).alias("models"), F.array_sort(F.collect_set("family")).alias("family_names"),
    )


def by_segment(hyp: DataFrame) -> DataFrame:
    """One row for each segment: ``every`` (family, status) and ``said``, the spoken hypotheses (model, family, norm, text) in model order.

    A segment has a few hypotheses, so all that compares them works on this one
    array, after one shuffle.
    """
    norm = F.when(F.col("status") == "success", F.array_join(evidence_tokens(F.col("text")), " "))
    rows = hyp.select("segment_id", F.struct("model", "family", norm.alias("norm"), F.trim("text").alias("text"), "status").alias("h"))
    every = rows.groupBy("segment_id").agg(F.array_sort(F.collect_list("h")).alias("every"))
    return every.withColumn("said", F.filter("every", lambda h: F.coalesce(h["norm"], F.lit("")) != ""))


def _top(said: Column) -> Column:
    """The first of the groups of equal text: most families, most providers, least text."""

    def group(norm: Column) -> Column:
        same = F.filter(said, lambda h: h["norm"] == norm)
        return F.struct((-F.size(F.array_distinct(same["family"]))).alias("f"), (-F.size(same)).alias("p"), norm.alias("norm"), F.get(same, F.lit(0))["text"].alias("text"))

    return F.array_min(F.transform(F.array_distinct(said["norm"]), group))


def _counts() -> list[Column]:
    of = lambda status: F.size(F.filter("every", lambda h: h["status"] == status)).cast("long")
    return [F.size("every").cast("long").alias("results"), of("success").alias("successes"), of("abstained").alias("abstained"), of("error").alias("errors")]


def compared(hyp: DataFrame, threshold: float = NEAR_THRESHOLD) -> DataFrame:
    """``by_segment`` with ``near``: the best near group, and the similarity of each spoken hypothesis to each, row by row."""
    return by_segment(hyp).withColumn("near", compared_texts(F.col("said")["norm"], F.col("said")["family"], threshold))


def pair_similarities(hyp: DataFrame) -> DataFrame:
    """Similarity of every ordered pair of a segment's spoken hypotheses."""
    n = F.size("said")
    firsts = compared(hyp).select("segment_id", "said", "near.square", F.posexplode("said").alias("i", "a"))
    pairs = firsts.select("segment_id", "i", "a", F.posexplode("said").alias("j", "b"), F.slice("square", F.col("i") * n + 1, n).alias("row")).filter("i <> j")
    return pairs.select("segment_id", *[F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in ("a", "b") for c in ("model", "family", "text")], F.get("row", F.col("j")).alias("similarity"))


def near_groups(hyp: DataFrame, threshold: float = NEAR_THRESHOLD) -> DataFrame:
    """Each segment's near group: families (its anchor's own too), weakest link, anchor and members; and the greatest similarity across families."""
    rows = compared(hyp, threshold).filter("near.anchor is not null")
    anchor = F.get("said", F.col("near.anchor"))
    members = F.transform(F.array_sort(F.concat(F.array("near.anchor"), "near.joined")), lambda k: F.get("said", k)["model"])
    return rows.select("segment_id", (F.size("near.joined") + 1).alias("near_families"), "near.weakest", anchor["model"].alias("anchor"), anchor["text"].alias("anchor_text"), members.alias("members"), "near.max_pair")


def summary(hyp: DataFrame) -> DataFrame:
    """Counts by status and the top exact group of every segment: native expressions only."""
    rows = by_segment(hyp).withColumn("top", _top(F.col("said")))
    return rows.select("segment_id", *_counts(), F.coalesce(-F.col("top.f"), F.lit(0)).cast("long").alias("exact_families"), F.coalesce(-F.col("top.p"), F.lit(0)).cast("long").alias("exact_providers"), F.col("top.norm").alias("exact_norm"))


def agreement(hyp: DataFrame, threshold: float = NEAR_THRESHOLD) -> DataFrame:
    """The whole agreement row of each segment, with its representative text.

    The representative is the top exact group's text where two families agree,
    else the near group's anchor where that has two, else the medoid: the spoken
    hypothesis most like all others together, the first model on ties.
    """
    n, said = F.size("said"), F.col("said")
    total = lambda i: F.aggregate(F.slice("near.square", i * n + 1, n), F.lit(0.0), lambda a, x: a + x)
    medoid = F.array_min(F.transform("said", lambda h, i: F.struct((-total(i)).alias("t"), h["model"].alias("model"), h["text"].alias("text"))))
    rows = compared(hyp, threshold).withColumns({"top": _top(said), "m": medoid})
    families, near = F.coalesce(-F.col("top.f"), F.lit(0)), F.when(n > 0, F.size("near.joined") + 1).otherwise(0)
    kind = F.when(families >= 2, "exact").when(near >= 2, "near").when(n == 1, "single").when(n > 1, "medoid")
    text = F.when(families >= 2, F.col("top.text")).when(near >= 2, F.get("said", F.col("near.anchor"))["text"]).otherwise(F.col("m.text"))
    return rows.select(
        "segment_id", *_counts(), families.cast("long").alias("exact_families"), F.coalesce(-F.col("top.p"), F.lit(0)).cast("long").alias("exact_providers"), near.cast("long").alias("near_families"),
        round_half_even(F.col("near.weakest")).alias("weakest"), round_half_even(F.col("near.max_pair")).alias("max_pair"), kind.alias("kind"), text.alias("representative"),
    )


def evidence(hyp: DataFrame, threshold: float = NEAR_THRESHOLD) -> DataFrame:
    """For each model: how it compares with what two or more other families agree on, and whether it speaks over silence."""
    groups = exact_groups(hyp).select("segment_id", "norm", "family_names", "providers")
    said = spoken(hyp).select("segment_id", "model", "family", "norm")
    mine = said.join(groups.withColumnRenamed("norm", "g_norm"), "segment_id").withColumn("others", F.size(F.array_except("family_names", F.array("family"))))
    best = mine.filter("others >= 2").groupBy("segment_id", "model").agg(F.min_by("g_norm", F.struct((-F.col("others")).alias("o"), (-F.col("providers")).alias("p"), "g_norm")).alias("ref"), F.first("norm").alias("norm"))
    scored = best.withColumn("similarity", token_similarity(F.col("norm"), F.col("ref")))
    heard = scored.groupBy("model").agg(F.count("*").alias("compared"), F.avg("similarity").alias("mean_similarity"), F.count_if(F.col("similarity") >= threshold).alias("near"), F.count_if(F.col("similarity") >= 0.9999).alias("exact"))
    speaks = hyp.join(said.select("segment_id", "model", F.lit(1).alias("spoke")), ["segment_id", "model"], "left").na.fill(0, ["spoke"])
    w = W.partitionBy("segment_id")
    quiet = speaks.withColumn("others_spoke", F.sum("spoke").over(w) - F.col("spoke")).withColumn("others_quiet", F.count_if(F.col("status") == "abstained").over(w) - (F.col("status") == "abstained").cast("int"))
    alone = quiet.groupBy("model").agg(F.sum("spoke").alias("spoken"), F.count_if(F.col("status") == "abstained").alias("abstained"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if((F.col("spoke") == 1) & (F.col("others_spoke") == 0) & (F.col("others_quiet") >= 2)).alias("over_silence"))
    return alone.join(heard, "model", "left")
