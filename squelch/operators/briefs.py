"""What a reviewer is given of a segment besides its audio: hypotheses, agreement, neighbours in time, aircraft.

Hot channels are split by day and hot sources by hour: nearest rows come from
running frames and from frames of a few rows within such a part, and from the
ends of the parts before and after, never from pairs of a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from squelch.functions.sequence import token_similarity
from squelch.functions.text import evidence_text, telephony_hint
from squelch.operators.relational import gathered, round_half_even

#: Seconds around a segment, how many near ones it is shown with, how many of all a brief has.
SECONDS, MOST_NEARBY, MOST_SHOWN = 60, 6, 4
_SECOND = 1_000_000


def _previous_and_next(rows: DataFrame) -> DataFrame:
    """``previous`` and ``next`` on the same source and channel: strictly earlier and later; of equally near ones the greater and the smaller id."""
    key, me = ["source_id", "channel"], F.struct("t", "segment_id", "preview")
    timed = rows.withColumn("_day", F.floor(F.col("t") / (86_400 * _SECOND)))
    inside = W.partitionBy(*key, "_day")
    before = F.max(me).over(inside.orderBy("t").rangeBetween(W.unboundedPreceding, -1))
    after = F.min(me).over(inside.orderBy(F.col("t").desc()).rangeBetween(W.unboundedPreceding, -1))
    days = timed.groupBy(*key, "_day").agg(F.min(me).alias("first"), F.max(me).alias("last"))
    along = W.partitionBy(*key).orderBy("_day")
    ends = days.select(F.col("source_id").alias("_s"), F.col("channel").alias("_c"), F.col("_day").alias("_d"), F.lag("last").over(along).alias("_before"), F.lead("first").over(along).alias("_after"))
    same = F.col("source_id").eqNullSafe(F.col("_s")) & F.col("channel").eqNullSafe(F.col("_c")) & (F.col("_day") == F.col("_d"))
    found = timed.withColumns({"_earlier": before, "_later": after}).join(ends, same)
    return found.withColumns({"previous": F.coalesce("_earlier", "_before"), "next": F.coalesce("_later", "_after")}).select(*rows.columns, "previous", "next")


def _nearby(rows: DataFrame, seconds: int, most: int) -> DataFrame:
    """``near``: the ``most`` nearest others of the source within ``seconds``, besides the previous and the next.

    On either side the nearest come first in the order of (time, id), so a
    frame of ``most`` rows and the two left out holds them. A part's edge sees
    copies of the rows at most ``seconds`` beyond it.
    """
    hour, span = 3_600 * _SECOND, seconds * _SECOND
    part = F.floor(F.col("t") / hour)
    seen = F.array_distinct(F.transform(F.array(F.lit(0), F.lit(-span), F.lit(span)), lambda d: F.floor((F.col("t") + d) / hour)))
    spread = rows.withColumn("_own", part).withColumn("_part", F.explode(seen))
    order = W.partitionBy("source_id", "_part").orderBy("t", "segment_id")
    other = F.struct("t", "segment_id", "preview")
    before, after = (F.collect_list(other).over(order.rowsBetween(a, b)) for a, b in ((-most - 2, -1), (1, most + 2)))
    ranked = lambda side, rows_: F.transform(rows_, lambda x, i: F.struct(F.abs(x["t"] - F.col("t")).alias("gap"), i.alias("i"), F.lit(side).alias("side"), x.alias("x")))
    taken = lambda x: x["segment_id"].eqNullSafe(F.col("previous.segment_id")) | x["segment_id"].eqNullSafe(F.col("next.segment_id"))
    met = spread.withColumns({"_before": before, "_after": after}).filter("_part = _own")
    near = F.filter(F.concat(ranked(0, F.reverse("_before")), ranked(1, F.col("_after"))), lambda c: (c["gap"] <= span) & ~taken(c["x"]))
    return met.withColumn("near", F.transform(F.slice(F.array_sort(near), 1, most), lambda c: c["x"])).select(*rows.columns, "near")


def neighbourhood(segments: DataFrame, seconds: int = SECONDS, most: int = MOST_NEARBY) -> DataFrame:
    """segment_id and ``around``: structs of relation, segment_id, offset_s and preview, by offset.

    segments: segment_id (unique), source_id, channel (null is a channel of its
    own), capture_start, relative_path (unique in its source), preview. Those
    without a time have the ones before and after on their channel by path,
    without an offset. Of equally near ones, those come first that are nearer
    in the order of (time, id), earlier ones before later ones.
    """
    rows = segments.select("segment_id", "source_id", "channel", "relative_path", F.unix_micros(F.col("capture_start").cast("timestamp")).alias("t"), "preview")

    def view(x: Column, relation: str, place: Column | int) -> Column:
        offset = round_half_even((x["t"] - F.col("t")) / _SECOND, 1)
        return F.struct(offset.alias("offset_s"), (F.lit(place) if isinstance(place, int) else place).cast("int").alias("place"), F.lit(relation).alias("relation"), x["segment_id"].alias("segment_id"), x["preview"].alias("preview"))

    pair = F.filter(F.array(F.when(F.col("previous").isNotNull(), view(F.col("previous"), "previous", 0)), F.when(F.col("next").isNotNull(), view(F.col("next"), "next", 1))), lambda x: x.isNotNull())
    timed = _nearby(_previous_and_next(rows.filter("t is not null").drop("relative_path")), seconds, most)
    timed = timed.select("segment_id", F.array_sort(F.concat(pair, F.transform("near", lambda x, i: view(x, "nearby", i + 2)))).alias("around"))
    path, me = W.partitionBy("source_id", "channel").orderBy("relative_path"), F.struct(F.lit(None).cast("long").alias("t"), "segment_id", "preview")
    untimed = rows.withColumns({"previous": F.lag(me).over(path), "next": F.lead(me).over(path)}).filter("t is null").select("segment_id", pair.alias("around"))
    keep = lambda x: F.struct(*[x[c].alias(c) for c in ("relation", "segment_id", "offset_s", "preview")])
    return timed.unionByName(untimed).select("segment_id", F.transform("around", keep).alias("around"))


def briefs(segments: DataFrame, hypotheses: DataFrame, agreement: DataFrame, around: DataFrame, aircraft: DataFrame, most: int = MOST_SHOWN) -> DataFrame:
    """One nested row for each segment, from one shuffle of all five inputs on ``segment_id``, of what is shown only.

    hypotheses: the newest of each model (model, family, status, text,
    eligible); a success without words counts as an abstention. agreement: any
    columns. around: as ``neighbourhood`` gives it; those that say nothing are
    not shown. aircraft: rank, callsign and more. What a segment lacks is an
    empty array or null; rows of unknown segments are left out.
    """
    whole = lambda frame: frame.select("segment_id", F.struct(*[c for c in frame.columns if c != "segment_id"]).alias("v"))
    hint = aircraft.select("segment_id", F.struct("rank", *[c for c in aircraft.columns if c not in ("segment_id", "rank")], telephony_hint(F.col("callsign")).alias("telephony")).alias("v"))
    text = F.when(F.col("status") == "success", F.col("text")).alias("text")
    said = hypotheses.select("segment_id", F.struct("model", "family", "status", text, "eligible").alias("v"))
    telling = around.select("segment_id", F.slice(F.filter("around", lambda n: F.coalesce(n["preview"], F.lit("")) != ""), 1, most).alias("around"))
    rows = gathered("segment_id", {"s": whole(segments), "h": said, "a": whole(agreement), "n": telling, "c": hint}).filter(F.size("s") > 0)
    heard = lambda h: (h["status"] == "success") & (F.trim(F.coalesce(h["text"], F.lit(""))) != "")
    models = lambda which: F.transform(F.filter(F.array_sort("h"), which), lambda h: h["model"])
    shown = F.coalesce(F.get("n", F.lit(0)), F.array().cast(around.schema["around"].dataType))
    return rows.select(
        "segment_id", F.get("s", F.lit(0)).alias("segment"),
        F.transform(F.filter(F.array_sort("h"), heard), lambda h: F.struct(h["model"].alias("model"), h["family"].alias("family"), h["text"].alias("text"), (~F.coalesce(h["eligible"], F.lit(False))).alias("research_only"))).alias("hypotheses"),
        models(lambda h: h["status"].isin("abstained", "success") & ~heard(h)).alias("abstained"), models(lambda h: ~h["status"].isin("abstained", "success")).alias("errors"),
        F.get("a", F.lit(0)).alias("agreement"), shown.alias("neighbours"), F.array_sort("c").alias("aircraft"),
    )


def support(answers: DataFrame, hypotheses: DataFrame, representatives: DataFrame) -> DataFrame:
    """answers' item_id, with the hypothesis most like the transcript (the first model of equally like ones) and the likeness to the representative.

    answers: item_id, segment_id, transcript; representatives: segment_id,
    representative. Both likenesses are rounded to four places and null where
    there is nothing to compare with.
    """
    said = hypotheses.filter("status = 'success' and coalesce(text, '') <> ''").select("segment_id", F.struct("model", evidence_text(F.col("text")).alias("norm")).alias("h"))
    rows = answers.select("segment_id", "item_id", evidence_text(F.col("transcript")).alias("norm"))
    each = rows.join(said, "segment_id", "left").withColumn("s", F.when(F.col("h").isNotNull(), token_similarity(F.col("norm"), F.col("h.norm"))))
    best = each.groupBy("segment_id", "item_id", "norm").agg(F.min(F.when(F.col("h").isNotNull(), F.struct((-F.col("s")).alias("s"), F.col("h.model").alias("model")))).alias("b"))
    with_text = best.join(representatives.select("segment_id", evidence_text(F.col("representative")).alias("r"), (F.coalesce("representative", F.lit("")) != "").alias("has")), "segment_id", "left")
    like = F.when(F.coalesce("has", F.lit(False)), token_similarity(F.col("norm"), F.coalesce("r", F.lit(""))))
    return with_text.select("item_id", round_half_even(-F.col("b.s")).alias("best_similarity"), F.col("b.model").alias("best_model"), round_half_even(like).alias("representative_similarity"))
