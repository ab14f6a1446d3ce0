import datetime as dt

import pytest
from pyspark.sql import functions as F

from squelch.functions import geo, temporal
from squelch.operators import adjudication, agreement, datasets, evaluation, lifecycle, relational, tracks, utterances
from squelch.streaming import incremental

HYP = "segment_id long, model string, family string, status string, text string"


@pytest.fixture(scope="module")
def hyp(spark):
    rows = [
        (1, "canary-a", "canary", "success", "Qantas twelve climb flight level one hundred"),
        (1, "canary-b", "canary", "success", "qantas twelve climb flight level one hundred."),
        (1, "parakeet-a", "parakeet", "success", "qantas twelve climb flight level one zero zero"),
        (1, "whisper-a", "whisper", "abstained", ""),
        (2, "canary-a", "canary", "success", "taxi via alpha hold short"),
        (2, "parakeet-a", "parakeet", "success", "Taxi via alpha, hold short"),
        (2, "whisper-a", "whisper", "error", None),
        (3, "canary-a", "canary", "success", "hello"),
        (4, "whisper-a", "whisper", "abstained", None),
    ]
    return spark.createDataFrame(rows, HYP).cache()


def test_agreement(hyp):
    rows = {r.segment_id: r for r in agreement.agreement(hyp).collect()}
    assert (rows[1].exact_families, rows[1].near_families, rows[1].kind) == (1, 2, "near") or rows[1].kind == "medoid"
    assert (rows[2].exact_families, rows[2].kind, rows[2].errors) == (2, "exact", 1)
    assert (rows[3].kind, rows[3].representative) == ("single", "hello")
    assert rows[4].kind is None and rows[4].abstained == 1
    pairs = {(r.a_model, r.b_model): r.similarity for r in agreement.pair_similarities(hyp).filter("segment_id = 1").collect()}
    assert pairs[("canary-a", "canary-b")] == 1.0 and pairs[("canary-a", "parakeet-a")] == pairs[("parakeet-a", "canary-a")] == 6 / 8


def test_utterances(spark, hyp):
    lengths = F.when(F.col("segment_id") == 1, 8000)
    found = [r for r in utterances.utterances(hyp.withColumn("duration_ms", lengths)).collect() if r.segment_id == 1]
    assert [(r.text, r.n_families, r.position, r.start_ms, r.end_ms, r.bounds_estimated) for r in found] == [("Qantas twelve climb flight level one", 2, "leading", 0, 6857, True)]


def heard(spark, *rows):
    return spark.createDataFrame([(1, model, family, "success", text) for model, family, text in rows], HYP)


def test_words_of_little_content_make_no_passage(spark):
    assert utterances.utterances(heard(spark, ("p", "parakeet", "okay thanks, bye"), ("w", "whisper", "Okay, thanks bye!"))).count() == 0
    same = heard(spark, ("canary-a", "canary", "speedbird six holding at bravo four"), ("canary-b", "canary", "speedbird six holding at bravo four"))
    assert utterances.utterances(same).count() == 0  # two models of one family


def test_shorter_passage_of_more_families_stays(spark):
    rows = heard(spark, ("p", "parakeet", "lufthansa eight descend to five thousand feet"), ("w", "whisper", "lufthansa eight descend to five thousand feet"), ("q", "qwen3-asr", "roger we descend to five then"))
    found = {r.text: r.n_families for r in utterances.utterances(rows).collect()}
    assert found == {"lufthansa eight descend to five thousand feet": 2, "descend to five": 3}


def test_coverage_is_of_the_longest_text_heard(spark):
    rows = heard(spark, ("a", "fa", "turn left heading north"), ("b", "fb", "turn left heading north"), ("c", "fc", "i did not get any of that"))
    (found,) = utterances.utterances(rows).collect()
    assert found.coverage == 0.571  # four of seven, which no family that holds it said


def timed(spark, *rows):
    """Rows of model, family, text, words."""
    return spark.createDataFrame([(1, m, f, "success", t, w, 9000) for m, f, t, w in rows], HYP + ", words array<struct<start_ms:int,end_ms:int,word:string>>, duration_ms int")


def test_times_come_from_trusted_families_and_their_median(spark):
    said = "Turn left, heading north"
    words = lambda at: [(at, at + 200, "Turn"), (at + 200, at + 400, "left,"), (at + 400, at + 700, "heading"), (at + 700, at + 900, "north")]
    rows = timed(spark, ("w", "whisper", said, words(1000)), ("p", "parakeet", said, words(1100)), ("q", "qwen3-asr", said, [(0, 0, x) for x in said.split()]), ("x", "other", said, None))
    (found,) = utterances.utterances(rows).collect()
    assert (found.start_ms, found.end_ms, found.timed_by, found.bounds_estimated) == (1050, 1950, ["p", "w"], False)
    assert found.text == said and [(s.model, s.from_word, s.to_word) for s in found.spans] == [("p", 0, 4), ("q", 0, 4), ("w", 0, 4), ("x", 0, 4)]


def test_words_timed_under_other_tokens_are_aligned(spark):
    said = "uh turn left heading north now"
    words = [(0, 90, "turn left"), (500, 800, "heading,"), (800, 950, "NORTH")]  # no times for uh and now, two tokens in one word
    rows = timed(spark, ("p", "parakeet", said, words), ("w", "whisper", "turn left heading north", None))
    (found,) = utterances.utterances(rows).collect()
    assert (found.start_ms, found.end_ms, found.timed_by, found.position) == (0, 950, ["p"], "middle")
    none = timed(spark, ("p", "parakeet", said, [(5, 9, "else")]), ("w", "whisper", "turn left heading north", []))
    (found,) = utterances.utterances(none).collect()
    assert (found.start_ms, found.end_ms, found.bounds_estimated) == (1500, 7500, True)


def test_highlights_resolve_overlaps_and_join_words(spark):
    passages = [(["b", "c", "d"], 2), (["c", "d"], 3), (["g"], 2), (["z"], 5)]
    rows = spark.createDataFrame([("A, b c , d. e f g", passages), (None, passages), ("b c", [])], "text string, p array<struct<tokens:array<string>,n_families:int>>")
    got = [[(x.mark and (x.mark.utterance, x.mark.n_families), x.words) for x in r.s] for r in rows.select(utterances.shown(F.col("text"), utterances.highlights(F.col("text"), F.col("p"))).alias("s")).collect()]
    assert got == [[(None, "A,"), ((0, 2), "b"), ((1, 3), "c , d."), (None, "e f"), ((2, 2), "g")], [], [(None, "b c")]]


def test_near_group_counts_its_anchor_and_breaks_ties_by_the_whole_name(spark):
    one = agreement.near_groups(heard(spark, ("a", "fa", "one two three four"), ("b", "fb", "one two three five")), 0.9).first()
    assert (one.near_families, one.anchor, one.weakest, one.max_pair, one.members) == (1, "a", None, 0.75, ["a"])
    said = "ryanair six kilo mike proceed {} to holding point lima then monitor tower"
    three = agreement.near_groups(heard(spark, ("a", "fa", said.format("straight")), ("b", "fb", said.format("strait")), ("c", "fc", "say again"))).first()
    assert three.near_families == 2 and 0.8 <= three.weakest < 1 and three.members == ["a", "b"]
    tied = agreement.near_groups(heard(spark, ("canary-b", "canary", "x y z"), ("canary-a", "canary", "x y z"), ("p", "parakeet", "x y z"))).first()
    assert (tied.anchor, tied.members) == ("canary-a", ["canary-a", "p"])
    alone = agreement.near_groups(heard(spark, ("a", "fa", "hello"))).first()
    assert (alone.near_families, alone.max_pair) == (1, None)


def test_models_trained_on_the_benchmark_leave_the_comparison(spark):
    scored = spark.createDataFrame([(1, "m1", 0, 4), (1, "m2", 2, 4), (1, "m3", 2, 4), (2, "m1", 0, 6), (2, "m2", 1, 6), (2, "m3", 1, 6)], "segment_id long, model string, errors int, ref_tokens int")
    models = spark.createDataFrame([("m1", 0, ["Bench"]), ("m2", 2, None), ("m3", 1, ["other"])], "model string, execution_order int, contaminated_benchmarks array<string>")
    fair = evaluation.fair_only(scored, models, "bench-1h")
    assert (evaluation.best_single(fair).first().model, evaluation.best_single(scored).first().model) == ("m3", "m1")
    assert {r.model: r.wins for r in evaluation.oracle(fair).collect()} == {"m2": 2, "m3": 2}
    assert [r.segment_id for r in evaluation.worst_segments(fair).collect()] == [1, 2]


def test_evaluation(spark, hyp):
    gold = spark.createDataFrame([(1, "Qantas twelve climb flight level one hundred"), (4, "roger")], "segment_id long, text string")
    scored = evaluation.scores(gold, hyp)
    rows = {(r.segment_id, r.model): r for r in scored.collect()}
    assert (rows[(1, "canary-b")].errors, rows[(1, "canary-b")].exact) == (0, True)
    assert rows[(1, "parakeet-a")].errors == 2 and rows[(4, "canary-a")].status == "missing" and rows[(4, "canary-a")].d == 1
    metrics = {r.model: r for r in evaluation.model_metrics(scored).collect()}
    assert metrics["whisper-a"].ter == 1.0 and metrics["canary-a"].ter == round(1 / 8, 4)
    assert evaluation.best_single(scored).first().model == "canary-a"
    tagged = spark.createDataFrame([(1, "[#callsign]Qantas twelve[/#callsign] [#value]nine[/#value] [#other]climb[/#other]")], "segment_id long, text string")
    recall = {(r.model, r.kind): r.recall for r in evaluation.entity_recall(tagged, hyp).collect()}
    assert recall[("canary-a", "callsign")] == 1.0 and recall[("canary-a", "value")] == 0.0 and ("canary-a", "other") not in recall


def test_clocks(spark):
    rows = [("2026-11-01 01:30:00", "America/New_York"), ("2026-03-08 02:30:00", "America/New_York"), ("2026-04-05 01:45:00", "Australia/Lord_Howe"), ("2026-09-08 12:00:00", "Australia/Perth")]
    frame = spark.createDataFrame(rows, "w string, z string").select(temporal.utc_candidates(F.col("w").cast("timestamp_ntz"), F.col("z")).alias("c"))
    assert [len(r.c) for r in frame.collect()] == [2, 0, 2, 1]
    resolved = spark.createDataFrame([("2026-11-01 01:30:00", "2026-11-01 06:30:03"), ("2026-11-01 01:30:00", None)], "w string, m string").select(
        temporal.resolve_capture(F.col("w").cast("timestamp_ntz"), F.lit("America/New_York"), F.col("m").cast("timestamp_ntz"), F.lit(3000)).alias("r")
    ).collect()
    assert (resolved[0].r.status, resolved[0].r.start) == ("resolved", dt.datetime(2026, 11, 1, 6, 30)) and resolved[1].r.status == "ambiguous"
    days = spark.createDataFrame([("2026-09-27",), ("2026-09-02",)], "d string").select(temporal.cycle_start(F.col("d").cast("date")).alias("c")).collect()
    assert [str(r.c) for r in days] == ["2026-09-03", "2026-08-06"]


def test_geography_and_tracks(spark):
    nm = spark.range(1).select(geo.distance_nm(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("d")).first().d
    assert nm == pytest.approx(60.04, abs=0.01)
    line = spark.range(1).select(geo.simplified(F.expr("array(struct(0d as x, 0d as y), struct(1d as x, 0.01d as y), struct(2d as x, 0d as y))"), 0.1).alias("p")).first().p
    assert len(line) == 2
    track = spark.createDataFrame([("a", 0.0, 0.0, 0.0), ("a", 10.0, 1.0, 2.0), ("b", 0.0, 5.0, 5.0), ("b", 9000.0, 6.0, 6.0)], "k string, t double, lat double, lon double")
    at = tracks.positions_at(track, "k", "t", F.lit(5.0)).collect()
    assert [(r.k, r.lat, r.lon) for r in at] == [("a", 0.5, 1.0)]


def test_lifecycle(spark):
    known = spark.createDataFrame([("a", "1", "present"), ("b", "1", "present"), ("c", "1", "missing"), ("d", "1", "present"), ("e", "1", "missing")], "p string, h string, presence string")
    seen = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1"), ("n", "9")], "p string, h string")
    out = {r.p: (r.outcome, r.presence) for r in lifecycle.scan(known, seen, "p", "h").collect()}
    assert out == {"a": ("updated", "present"), "b": ("changed", "present"), "c": ("reappeared", "present"), "d": ("missing", "missing"), "e": ("still_missing", "missing"), "n": ("inserted", "present")}
    assert {r.p: r.outcome for r in lifecycle.scan(known, seen, "p", "h", False).collect()}["d"] == "unseen"
    steps = lifecycle.stepped(spark.createDataFrame([("queued", "claim"), ("queued", "finish")], "s string, a string"), "s", "a").collect()
    assert [(r.new_state, r.refused) for r in steps] == [("loading", False), ("queued", True)]


def test_datasets_and_costs(spark):
    items = spark.createDataFrame([(1, "segment", 1), (2, "span", 1), (3, "span", 2)], "id long, scope string, parent long")
    assert sorted(r.id for r in datasets.without_nested(items, "parent").collect()) == [1, 3]
    frozen = datasets.freeze(items.withColumn("set", F.lit("s")), [F.col("id")], F.col("parent").cast("string"), "x", {"train": 1.0, "test": 0.0}, "set").collect()
    assert {r.split for r in frozen} == {"train"} and sorted(r.ordinal for r in frozen) == [0, 1, 2]
    typical, worst = adjudication.item_cost(F.lit(4000), F.lit(5), "low", 2.0, 2.0, 12.0)
    cost = spark.range(1).select(typical.alias("t"), worst.alias("w")).first()
    assert 0.01 < cost.t <= cost.w < 0.05


def test_band_join_equals_brute_force(spark):
    rows = [(k, k % 3, dt.datetime(2026, 1, 1) + dt.timedelta(seconds=(k * 37) % 600)) for k in range(80)]
    frame = spark.createDataFrame(rows, "id long, g long, t timestamp_ntz")
    got = {(r.id, r.other.id) for r in relational.band_join(frame, frame, ["g"], "t", 60, "other").collect()}
    assert got == {(a, b) for a, g, t in rows for b, h, u in rows if g == h and abs((t - u).total_seconds()) <= 60}


def test_rates_round_as_exact_binary_values(spark):
    values = [1 / 32, 1 / 8, 0.00285, 0.5, 2.5, 0.12345, 0.33335, 1.00005, 7 / 20000, 0.0, -0.03125, *[s / n for n in range(1, 80) for s in range(n)], *[k / 20000 for k in range(1, 4001, 2)]]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", *[relational.round_half_even(F.col("v"), d).alias(f"r{d}") for d in (2, 4)]).collect()
    assert all(r.r4 == round(r.v, 4) and r.r2 == round(r.v, 2) for r in rows)
    rate = spark.range(1).select(relational.rate(F.lit(1), F.lit(32)).alias("a"), relational.rate(F.lit(1), F.lit(0)).alias("b")).first()
    assert (rate.a, rate.b) == (0.0312, None)


def test_fingerprints_tell_moved_marks_and_nulls_apart(spark):
    prints = lambda *rows: relational.fingerprint(spark.createDataFrame(list(rows), "a string, b string, c double, d array<float>"), "t").first().digest
    seen = [prints(r) for r in [("a|b", "c", 1.0, [1.0]), ("a", "b|c", 1.0, [1.0]), ("a|b", None, 1.0, [1.0]), ("a|b", "~", 1.0, [1.0]), ("a|b", "c", 1.5, [1.0]), ("a|b", "c", 1.0, [1.0, None]), ("a|b", "c", 1.0, None), ("a|b", "c", None, [1.0])]]
    assert len(set(seen)) == len(seen)
    two = [("x", "y", 1.0, [2.0]), ("p", "q", 3.0, [])]
    assert prints(*two) == prints(*two[::-1])


def test_neighbours_equal_brute_force(spark):
    rows = [(k, k % 2, dt.datetime(2026, 1, 1) + dt.timedelta(seconds=(k * 7) % 13)) for k in range(40)]
    got = {r.id: (r.previous, r.next) for r in relational.neighbours(spark.createDataFrame(rows, "id long, g long, t timestamp_ntz"), ["g"], "t", "id").collect()}
    for k, g, t in rows:
        before, after = [(u, i) for i, h, u in rows if h == g and u < t], [(u, i) for i, h, u in rows if h == g and u > t]
        assert got[k] == (max(before)[1] if before else None, min(after)[1] if after else None)


def test_stream_equals_batch(spark, hyp, tmp_path):
    store = str(tmp_path)
    hyp.repartition(4, "model").write.parquet(f"{store}/incoming")
    stream = spark.readStream.schema(hyp.schema).option("maxFilesPerTrigger", 1).parquet(f"{store}/incoming")
    incremental.follow(stream, store, spark).awaitTermination()
    assert sorted(map(tuple, incremental.current_rows(spark, store).collect())) == sorted(map(tuple, agreement.summary(hyp).collect()))
