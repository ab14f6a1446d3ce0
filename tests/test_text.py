"""Literal cases of the normalizers and kernels, and brute force beside them."""

import random

import pytest
from pyspark.sql import functions as F

from squelch.functions import sequence as S
from squelch.functions import text as X
from squelch.operators import quality


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_normalizers(spark):
    lit = F.lit
    assert value(spark, X.evidence_text(lit("  QFA-12, contact 118.5!  "))) == "qfa-12 contact 118.5"
    assert value(spark, X.evidence_text(lit("16L"))) != value(spark, X.evidence_text(lit("16R")))
    tagged = "[#callsign]Oscar Kilo[/#callsign] ((noise)) [BLANK] <unk> descend, level 100!"
    assert value(spark, X.scoring_text(lit(tagged))) == "oscar kilo descend level 100"
    assert value(spark, X.scoring_text(lit("heading 270, niner"), True)) == "heading two seven zero nine"
    assert value(spark, F.size(X.scoring_tokens(lit("नमस्ते आप कैसे हैं")))) == 4
    assert value(spark, X.scoring_tokens(F.lit(None).cast("string"))) == [] == value(spark, X.evidence_tokens(lit("  ")))


def test_names_and_paths(spark):
    p = value(spark, X.parse_recording_name(F.lit("d/YPPH_TWR_20260908_125830_118500000.mp3")))
    assert (p.station, p.channel, p.frequency_hz, str(p.wall)) == ("YPPH", "TWR", 118500000, "2026-09-08 12:58:30")
    assert value(spark, X.parse_recording_name(F.lit("notes.txt"))).label is None
    for path, good in (("a/b.mp3", True), ("../a", False), ("/a", False), ("a//b", False), ("a\\b", False), ("a/./b", False)):
        assert value(spark, X.valid_path(F.lit(path))) is good
    assert value(spark, X.spoken_digits(F.lit("19.5"))) == "one niner decimal five"
    assert X.like_pattern("5%_") == "%5\\%\\_%"


def brute_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
    return table[-1][-1]


def test_similarity_and_edits():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in "ab")
        assert S.lcs_length(a, b) == brute_lcs(a, b)
    assert S.similarity([], []) == 1.0 and S.similarity(list("abcd"), list("axyd")) == 0.5
    assert S.edits(list("abcd"), list("axcde")) == (1, 0, 1)
    assert S.edits([], list("ab")) == (0, 0, 2) and S.edits(list("ab"), []) == (0, 2, 0)


def every_alignment(a, b):
    """All ways to align two lists as (errors, S, D, I); equal heads always align."""
    if not a or not b:
        return {(len(a) + len(b), 0, len(a), len(b))}
    if a[-1] == b[-1]:
        return every_alignment(a[:-1], b[:-1])
    ways = [((1, 1, 0, 0), a[:-1], b[:-1]), ((1, 0, 1, 0), a[:-1], b), ((1, 0, 0, 1), a, b[:-1])]
    return {tuple(x + y for x, y in zip(cost, rest)) for cost, p, q in ways for rest in every_alignment(p, q)}


def test_edits_equal_the_least_alignment():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 6))] for _ in "ab")
        assert S.edits(a, b) == min(every_alignment(a, b))[1:]


@pytest.mark.parametrize(("words", "best"), [("a b c d e f g h i " * 20, (9, 20)), ("a b c", (0, 1)), ("x x x y", (1, 3)), ("", (0, 1)), ("a", (0, 1)), ("x y x y z z", (1, 2))])
def test_repetition(spark, words, best):
    found = value(spark, S.repetition_of(F.array(*map(F.lit, words.split())).cast("array<string>")))
    assert (found.n, found.repeats) == best


def test_runs_and_changes():
    a, b = "one two three four five".split(), "zero one two three nine four five".split()
    assert S.common_runs(a, b, 2) == [["one", "two", "three"], ["four", "five"]]
    assert S.common_runs(a, b, 3) == [["one", "two", "three"]]
    assert S.timings(["a", "b"], [(0, 10, "a"), (10, 20, "b")]) == [(0, 10), (10, 20)]
    assert S.word_changes(["a", "b"], ["a", "c"]) == [("same", "a"), ("removed", "b"), ("added", "c")]
    assert S.simplify_line([(0, 0), (1, 0.01), (2, 0), (2, 5)], 0.1) == [(0, 0), (2, 0), (2, 5)]


@pytest.mark.parametrize(
    ("text", "flag"),
    [
        ("", "empty"), ("uh um", "filler_only"), ("नमस्ते आप कैसे हैं", "non_latin_script"), ("dobrý den", "diacritics"), ("Thank you for watching!", "off_domain_phrase"),
        ("okay so what now", "conversational_phrase"), ("go go go go go go", "repetition_loop"), ("the weather is lovely today", "low_atc_content"),
    ],
)
def test_flags(spark, text, flag):
    assert flag in value(spark, quality.flags(F.lit(text)))


def test_clean_speech_has_no_flag(spark):
    assert value(spark, quality.flags(F.lit("qantas twelve contact tower one one eight decimal five"), F.lit(5000), F.lit("en"), F.lit("EN"))) == []
    assert value(spark, quality.flags(F.lit("a" * 200 + " runway"), F.lit(1000))) == ["implausible_rate"]


def test_counted_flags_are_computed_once(spark):
    from squelch.plans import catalogue

    counted = catalogue.QUERIES["flag_counts_unnest"](spark, "/root/testdata/sf0.001")
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("diacritics") == 1
    want = {}
    for r in catalogue.QUERIES["quality_flags"](spark, "/root/testdata/sf0.001").collect():
        for flag in r.flags:
            want[r.model, flag] = want.get((r.model, flag), 0) + 1
    assert {(r.model, r.flag): r.n for r in counted.collect()} == want and want
