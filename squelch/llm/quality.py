"""Quality rules as a short-circuit cascade, in SQL expressions only.

Each rule rejects a document by features of its text. Costs and rejection
rates are estimated on a bounded sample; the rules then run in the order of
rejection per cost, each given the rules before it, and a document that one
rule rejects is not measured for the later ones. The order can't change a
verdict, only how fast it comes.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squelch.llm.shared import stored

SAMPLE_ROWS = 300  # documents, about, for estimating costs and rejections
_SPACE = r"[\\x20\\x09-\\x0D]+"  # as written in a SQL string

#: name -> (features it needs, SQL). In order of need; `text` is never null here.
#:
#: Repeated words: each 3-word window gets 39 bits of a hash above 24 bits of
#: its place; sorting these longs brings equal windows together, and neighbours
#: with equal bits are compared word by word. Where two different hashes share
#: the 39 bits, or a text has 2^24 windows, places are sorted by the whole hash
#: and then the words, and all neighbours are compared word by word.
FEATURES: dict[str, tuple[tuple[str, ...], str]] = {
    "words": ((), f"array_remove(split(text, '{_SPACE}'), '')"),
    "n_words": (("words",), "cast(size(words) as long)"),
    "word_chars": ((), f"cast(char_length(regexp_replace(text, '{_SPACE}', '')) as long)"),
    "n_symbols": ((), "cast(char_length(text) - char_length(regexp_replace(text, '[#*$%&|<>]+', '')) as long)"),
    "n_upper": ((), "cast(char_length(text) - char_length(regexp_replace(text, '[A-Z]+', '')) as long)"),
    "lines": ((), "filter(split(text, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"),
    "n_lines": (("lines",), "cast(size(lines) as long)"),
    "n_dup_lines": (("lines",), "cast(size(lines) - size(array_distinct(lines)) as long)"),
    "hashes": (("words",), "case when size(words) < 3 then cast(array() as array<bigint>) else transform(sequence(0, size(words) - 3), i -> xxhash64(get(words, i), get(words, i + 1), get(words, i + 2))) end"),
    "repeats": (("hashes",), "size(array_distinct(hashes)) < size(hashes)"),
    "narrow": (
        ("hashes", "repeats"),
        "not repeats or (size(hashes) < 16777216 and size(array_distinct(transform(hashes, h -> shiftrightunsigned(h, 25)))) = size(array_distinct(hashes)))",
    ),
    "sorted": (
        ("hashes", "repeats", "narrow", "words"),
        "case when not repeats then cast(array() as array<bigint>)"
        " when narrow then sort_array(transform(hashes, (h, i) -> (shiftrightunsigned(h, 25) << 24) | i))"
        " else transform(sort_array(transform(hashes, (h, i) -> struct(h, slice(words, i + 1, 3) as w, i))), x -> cast(x.i as bigint)) end",
    ),
    "bits": (("narrow",), "case when narrow then 24 else 31 end"),
    "places": (
        ("sorted", "bits", "words"),
        "array_sort(flatten(transform(sequence(1, greatest(size(sorted) - 1, 1)), i -> case when"
        " shiftrightunsigned(get(sorted, i), bits) = shiftrightunsigned(get(sorted, i - 1), bits)"
        " and slice(words, cast(get(sorted, i) & ((1L << bits) - 1) as int) + 1, 3) = slice(words, cast(get(sorted, i - 1) & ((1L << bits) - 1) as int) + 1, 3)"
        " then array(get(sorted, i - 1) & ((1L << bits) - 1), get(sorted, i) & ((1L << bits) - 1)) else cast(array() as array<bigint>) end)))",
    ),
    "n_repeat_words": (("places",), "aggregate(transform(places, (p, i) -> least(3L, coalesce(get(places, i + 1) - p, 3L))), 0L, (a, x) -> a + x)"),
}
_INNER = ("words", "lines", "hashes", "repeats", "narrow", "sorted", "bits", "places")
#: What the contract shows of every document; other features are measured only for documents that are still in.
SHOWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    rejects: str


#: The two base rules come with the contract; the others catch symbol soup,
#: repeated lines, shouting, and words too short or long to be prose.
RULES = (
    Rule("few_words", ("n_words",), "n_words < 50"),
    Rule("repeated_words", ("n_words", "n_repeat_words"), "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", ("n_words", "n_symbols"), "10 * n_symbols > n_words"),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), "10 * n_dup_lines > 3 * n_lines"),
    Rule("shouting", ("word_chars", "n_upper"), "2 * n_upper > word_chars"),
    Rule("word_length", ("n_words", "word_chars"), "word_chars < 2 * n_words or word_chars > 15 * n_words"),
)
BASE = ("few_words", "repeated_words")


def _needed(names: tuple[str, ...]) -> list[str]:
    found: set[str] = set()

    def add(name: str) -> None:
        for other in FEATURES[name][0]:
            add(other)
        found.add(name)

    for name in names:
        add(name)
    return [x for x in FEATURES if x in found]


def measured(docs: DataFrame, names: tuple[str, ...], text: str = "text", only_if: str | None = None) -> DataFrame:
    """Adds a struct column ``_f`` of features, each in a projection after those it needs.

    ``only_if`` (a column) leaves the features null elsewhere, unmeasured.
    """
    todo = _needed(names)
    frame, level = docs, {}
    for name in todo:
        level[name] = 1 + max([0, *(level[x] for x in FEATURES[name][0])])
    for depth in range(1, max(level.values(), default=0) + 1):
        made = {}
        for name in (x for x in todo if level[x] == depth):
            sql = FEATURES[name][1]
            made[name] = F.expr(f"case when {only_if} then {sql} end" if only_if else sql)
        frame = frame.withColumns(made)
    return frame


def rule_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """Rules by rejection per cost, each among what the rules before it leave, on a sample by a hash of the row.

    Cost is the time of measuring and judging alone, less that of reading the
    sample. Only speed depends on it. The sample is stored, not collected; the
    driver sees one count for each combination of verdicts. Returns dicts of
    rule, cost, rejected (the share of what is left).
    """
    n = docs.count()
    share = min(1.0, sample_rows / max(n, 1))
    some = docs.filter(F.pmod(F.xxhash64(*docs.columns), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    some = some.limit(4 * sample_rows)  # equal rows share a hash, so all of them may be drawn
    kept = stored(some.select(F.coalesce(F.col(text), F.lit("")).alias("text")), "rule-sample").coalesce(1)

    def timed(rule: Rule | None) -> float:
        frame = kept if rule is None else measured(kept, rule.needs)
        query = frame.agg(F.sum(F.length("text")) if rule is None else F.count_if(F.expr(rule.rejects)))
        query.collect()  # compiles
        began = time.perf_counter()
        query.collect()
        return time.perf_counter() - began

    verdicts = measured(kept, tuple(x for r in rules for x in r.needs)).select(F.concat(*[F.when(F.expr(r.rejects), "1").otherwise("0") for r in rules]).alias("v"))
    left = {r.v: r["count"] for r in verdicts.groupBy("v").count().collect()}  # at most 2 ** rules, and at most the sample
    base = timed(None)
    cost = [max(timed(r) - base, 1e-4) for r in rules]
    found, todo = [], list(range(len(rules)))
    while todo:
        size = max(sum(left.values()), 1)
        rejected = {k: sum(c for v, c in left.items() if v[k] == "1") / size for k in todo}
        k = min(todo, key=lambda k: (-rejected[k] / cost[k], cost[k]))
        found.append({"rule": rules[k], "cost": cost[k], "rejected": rejected[k]})
        left = {v: c for v, c in left.items() if v[k] == "0"}
        todo.remove(k)
    return found


def _cascade(frame: DataFrame, order: list[Rule], have: set[str]) -> tuple[DataFrame, str]:
    """The rules one after another over a frame with ``text``; gives the frame and the column that says what is left.

    A feature that isn't there yet is measured only where all earlier rules passed.
    """
    frame, have = frame.withColumn("in0", F.lit(True)), set(have)
    for k, rule in enumerate(order, 1):
        new = [x for x in _needed(rule.needs) if x not in have]
        level: dict[str, int] = {}
        for name in new:
            level[name] = 1 + max([0, *(level.get(x, 0) for x in FEATURES[name][0])])
        for depth in range(1, max(level.values(), default=0) + 1):
            frame = frame.withColumns({x: F.expr(f"case when in{k - 1} then {FEATURES[x][1]} end") for x in new if level[x] == depth})
        have |= set(new)
        frame = frame.withColumn(f"in{k}", F.expr(f"in{k - 1} and not ({rule.rejects})"))
    return frame, f"in{len(order)}"


def judged(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The features of ``SHOWN`` of every document, ``base_failed``, and the cascade's verdict ``kept``.

    The base rules judge every document by these features; the other rules run
    as a cascade over what is left, and what they need beyond is measured only
    there. A null or empty text has no words and fails the first base rule.
    Repeated rows are judged alike. Columns of the input come as ``doc`` (a
    struct), so names can't clash.
    """
    order = [x["rule"] for x in rule_order(docs, rules, text)]
    base = " or ".join(f"({r.rejects})" for r in rules if r.name in BASE)
    frame = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    frame = measured(frame, SHOWN).withColumn("base_failed", F.expr(base))
    first = Rule("base", SHOWN, "base_failed")
    frame, left = _cascade(frame, [first, *(r for r in order if r.name not in BASE)], set(_needed(SHOWN)))
    # A generator keeps later filters from copying the chain of features into themselves.
    row = F.struct("doc", *SHOWN, "base_failed", F.col(left).alias("kept"))
    return frame.select(F.explode(F.array(row)).alias("row")).select("row.*")


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that no rule rejects, with their own columns.

    The cascade stops at the first rejection: a feature is measured only for
    documents that are still in.
    """
    frame = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    frame, left = _cascade(frame, [x["rule"] for x in rule_order(docs, rules, text)], set())
    # A generator stands between the features and the filter: Catalyst would
    # else copy the chain of features into the filter, once for each use.
    frame = frame.select(F.explode(F.array(F.struct("doc", F.col(left).alias("keep")))).alias("row"))
    return frame.filter("row.keep").select("row.doc.*")
