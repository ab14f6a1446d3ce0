"""Text normalizers and parsers as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from squelch.functions.lexicon import DIGIT_WORDS, EDGE_MARKS, ICAO_NUMBERS, TELEPHONY

#: White space as Unicode has it, for Java's regular expressions.
WHITE = r"(?U)\s+"


def _empty_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip_markup(text: Column) -> Column:
    """Takes annotation tags out and keeps the words between class tags."""
    for tag in (r"\[/?#[^\]]*\]", r"\(\([^)]*\)\)", r"\[[^\]]*\]", r"<[^>]*>"):
        text = F.regexp_replace(text, tag, " ")
    return text


def scoring_tokens(text: Column, canonical_numbers: bool = False) -> Column:
    """Tokens for scoring: no markup, lower case, punctuation and symbols as blanks; null gives none."""
    plain = F.regexp_replace(F.lower(strip_markup(_empty_if_null(text))), r"[\p{P}\p{S}]", " ")
    tokens = F.array_remove(F.split(plain, WHITE), "")
    return canonical(tokens) if canonical_numbers else tokens


def scoring_text(text: Column, canonical_numbers: bool = False) -> Column:
    return F.array_join(scoring_tokens(text, canonical_numbers), " ")


def canonical(tokens: Column) -> Column:
    """Digits spelled out one by one, and radio number words folded to plain ones."""
    digits = F.create_map(*[F.lit(x) for pair in zip("0123456789", DIGIT_WORDS, strict=True) for x in pair])
    words = F.create_map(*[F.lit(x) for pair in ICAO_NUMBERS.items() for x in pair])
    spelled = lambda t: F.transform(F.split(t, "(?!^)(?!$)"), lambda c: F.coalesce(F.element_at(digits, c), c))
    return F.flatten(F.transform(tokens, lambda t: F.when(t.rlike("^[0-9]+$"), spelled(t)).otherwise(F.array(F.coalesce(F.element_at(words, t), t)))))


def evidence_tokens(text: Column) -> Column:
    """Tokens for comparing evidence: lower case, marks at the edges of words dropped, those inside kept."""
    bare = F.transform(F.split(F.lower(_empty_if_null(text)), WHITE), lambda t: F.btrim(t, F.lit(EDGE_MARKS)))
    return F.array_remove(bare, "")


def evidence_text(text: Column) -> Column:
    return F.array_join(evidence_tokens(text), " ")


def token_view(text: Column) -> Column:
    """Evidence tokens, each with the place of the word it comes from."""
    words = F.array_remove(F.split(_empty_if_null(text), WHITE), "")
    marked = F.transform(words, lambda w, i: F.struct(F.btrim(F.lower(w), F.lit(EDGE_MARKS)).alias("token"), i.alias("word")))
    return F.filter(marked, lambda x: x["token"] != "")


def like_pattern(query: str) -> str:
    """A pattern for a literal substring: wildcards and the escape itself are escaped."""
    return "%" + query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def contains_text(text: Column, query: str) -> Column:
    return text.ilike(like_pattern(query))


def within_dir(path: Column, prefix: str) -> Column:
    """A directory or anything below it; an empty prefix holds everything."""
    return F.lit(True) if not prefix else (path == prefix) | path.startswith(prefix + "/")


def valid_path(path: Column) -> Column:
    """A relative path without empty, dot or dot-dot parts, back slashes or control characters."""
    return path.rlike(r"^[^\x00-\x1f\\/]+(/[^\x00-\x1f\\/]+)*$") & ~path.rlike(r"(^|/)\.{1,2}(/|$)")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def parse_recording_name(path: Column) -> Column:
    """Struct of label, station, channel, wall clock and frequency from LABEL_YYYYMMDD_HHMMSS[_HZ].ext; nulls where it doesn't fit."""
    name, form = base_name(path), r"^(?:RTLSDR )?(.+?)_(\d{8})_(\d{6})(?:_(\d+))?\.[A-Za-z0-9]+$"
    fits = name.rlike(form)
    label = F.when(fits, F.regexp_extract(name, form, 1))
    wall = F.try_to_timestamp(F.concat(F.regexp_extract(name, form, 2), F.regexp_extract(name, form, 3)), F.lit("yyyyMMddHHmmss"))
    return F.struct(
        label.alias("label"),
        F.when(F.instr(label, "_") > 0, F.substring_index(label, "_", 1)).alias("station"),
        F.when(F.instr(label, "_") > 0, F.substring(label, F.instr(label, "_") + 1, 1000)).otherwise(label).alias("channel"),
        F.when(fits, wall.cast("timestamp_ntz")).alias("wall"),
        F.when(fits & (F.regexp_extract(name, form, 4) != ""), F.regexp_extract(name, form, 4).cast("long")).alias("frequency_hz"),
    )


def title_words(text: Column) -> Column:
    """Capital first letters at every run of letters, after collapsing white space."""
    parts = F.regexp_extract_all(F.trim(F.regexp_replace(text, WHITE, " ")), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 10000)))), "")


def spoken_digits(value: Column, icao: bool = True) -> Column:
    """Digits as they are said; 9 is niner in radio style."""
    words = [*DIGIT_WORDS[:9], "niner" if icao else "nine"]
    table = F.create_map(*[F.lit(x) for pair in [*zip("0123456789", words, strict=True), (".", "decimal" if icao else "point")] for x in pair])
    return F.array_join(F.filter(F.transform(F.split(value, "(?!^)(?!$)"), lambda c: F.element_at(table, c)), lambda x: x.isNotNull()), " ")


def entity_spans(text: Column) -> Column:
    """Array of (class, text) for [#class]words[/#class] of the classes that count."""
    form = r"\[#(callsign|command|value)\](.*?)\[/#\1\]"
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(form), 1).alias("kind"), F.regexp_extract_all(text, F.lit(form), 2).alias("said"))


def non_latin_share(text: Column) -> Column:
    letters = F.char_length(F.regexp_replace(text, r"\P{L}+", ""))
    latin = F.char_length(F.regexp_replace(text, r"[^\p{IsLatin}&&\p{L}]+|[^\p{IsLatin}]+", ""))
    return F.when(letters > 0, (letters - latin) / letters).otherwise(F.lit(0.0))


def telephony_hint(callsign: Column) -> Column:
    """How a callsign is said: November and the rest of a registration, or an airline's name and the flight; null where neither is known."""
    sign = F.upper(F.trim(callsign))
    airline = F.try_element_at(F.create_map(*[F.lit(x) for pair in TELEPHONY.items() for x in pair]), F.substring(sign, 1, 3))
    flight = F.substring(sign, 4, 1000)
    return F.when(sign.rlike(r"^N\d[0-9A-Z]{0,4}$"), F.concat(F.lit("November "), F.substring(sign, 2, 1000))).when(sign.rlike(r"^[A-Z]{3}\d[0-9A-Z]*$"), F.concat(airline, F.lit(" "), flight))
