"""Answers of review models: JSON as they send it, read tolerantly as VARIANT by native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from squelch.operators.folds import let
from squelch.operators.relational import cascade

#: Fields an answer must have, and how much of the lists and notes is kept.
REQUIRED = ("speech_present", "transcript", "confidence", "uncertain_words", "callsigns", "closest_hypothesis", "notes")
MOST_WORDS, MOST_CALLSIGNS, MOST_NOTES = 50, 20, 500
_EMPTY = ("null", "false", "0", "0.0", '""', "[]", "{}")


def unfenced(content: Column) -> Column:
    """The answer without blanks around it and without a code fence; what stands before the first brace goes with the fence."""
    text = F.regexp_replace(content, r"^\s+|\s+$", "")
    bare = F.regexp_replace(text, r"^`+|`+$", "")
    return F.when(text.startswith("```"), F.regexp_extract(bare, r"(?s)\{.*", 0)).otherwise(text)


def parsed(content: Column) -> Column:
    """Struct of ``refusal`` (null for a usable answer) and its fields, cleaned.

    Refused are, in this order: not_json (null and empty answers too),
    not_object, missing_fields, confidence_not_number, confidence_nan.
    Confidence is held to 0 to 1; the transcript's white space is collapsed, and
    without one no speech counts as present. Lists keep their first elements as
    text, callsigns trimmed and in capitals; elements that are null are left
    out, and what isn't a list counts as none.
    """

    def fields(v: Column) -> Column:
        at = lambda key: F.try_variant_get(v, f"$.{key}", "variant")
        text = lambda key: F.try_variant_get(v, f"$.{key}", "string")
        holds = lambda key: ~F.coalesce(F.to_json(at(key)), F.lit("null")).isin(*_EMPTY)
        listed = lambda key, most: F.slice(F.array_compact(F.coalesce(F.try_variant_get(v, f"$.{key}", "array<string>"), F.array().cast("array<string>"))), 1, most)
        confidence = F.try_variant_get(v, "$.confidence", "double")
        transcript = F.when(holds("transcript"), F.btrim(F.regexp_replace(text("transcript"), r"(?U)\s+", " "))).otherwise("")
        refusal = cascade({
            "not_json": v.isNull(), "not_object": ~F.schema_of_variant(v).startswith("OBJECT"), "missing_fields": ~_every([at(k).isNotNull() for k in REQUIRED]),
            "confidence_not_number": confidence.isNull(), "confidence_nan": F.isnan(confidence),
        })
        use = lambda value: F.when(refusal.isNull(), value)
        return F.struct(
            refusal.alias("refusal"), use(holds("speech_present") & (transcript != "")).alias("speech_present"), use(transcript).alias("transcript"), use(F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0))).alias("confidence"),
            use(listed("uncertain_words", MOST_WORDS)).alias("uncertain_words"), use(F.transform(listed("callsigns", MOST_CALLSIGNS), lambda c: F.upper(F.trim(c)))).alias("callsigns"),
            use(F.when(holds("closest_hypothesis"), text("closest_hypothesis")).otherwise("")).alias("closest_hypothesis"), use(F.when(holds("notes"), F.substring(text("notes"), 1, MOST_NOTES)).otherwise("")).alias("notes"),
        )

    return let(F.try_parse_json(unfenced(F.coalesce(content, F.lit("")))), fields)


def _every(conditions: list[Column]) -> Column:
    found = F.lit(True)
    for c in conditions:
        found = found & c
    return found
