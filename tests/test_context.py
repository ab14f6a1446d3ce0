"""Airports, decisions, neighbours and briefs: literal cases and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from squelch.functions.text import telephony_hint
from squelch.operators import airports, briefs, decisions, relational

BASE = "line long, ARPT_ID string, ICAO_ID string, ARPT_NAME string, CITY string, LAT_DECIMAL string, LONG_DECIMAL string, ELEV string, MAG_VARN string, MAG_HEMIS string, MAG_VARN_YEAR string, EFF_DATE string"
ENDS = "line long, ARPT_ID string, RWY_ID string, RWY_END_ID string, TRUE_ALIGNMENT string, LAT_DECIMAL string, LONG_DECIMAL string, RWY_END_ELEV string, LAT_DISPLACED_THR_DECIMAL string, LONG_DISPLACED_THR_DECIMAL string"
USED = "line long, SERVICED_FACILITY string, FREQ string, FREQ_USE string, SECTORIZATION string, PRIMARY_APPROACH_RADIO_CALL string, TOWER_OR_COMM_CALL string, FACILITY string"


def files(spark):
    base = [
        (1, "QQX", None, "lower  FALLS/o'dell field", "LOWER FALLS", "41.5", "x", "", "11", "W", "2025", "2026/09/03"), (2, "Q7", "KQSV", None, "", None, None, None, None, None, None, None),
        (3, "QQX", "KXXX", "a second row", "", None, None, None, None, None, None, None), (4, None, None, "nowhere", "", None, None, None, None, None, None, None),
    ]
    runways = [(1, "QQX", "09/27", "5000.9", "75"), (2, "QQX", "09/27", "6001", ""), (3, "XYZ", "09/27", "1", "1")]
    ends = [(1, "QQX", "09/27", "27", "270.5", "41.5", "-70", "12.5", None, ""), (2, "QQX", "09/27", "09", "", "41.5", "-71", "", None, None), (3, "QQX", "4C", "4C", None, "41.5", "-71", "", None, None), (4, "QQX", "H1", "H1", None, None, None, None, None, None)]
    used = [
        (1, "QQX", "119.950", " LCL/P ", "", "HIGH hills", "", "F1"), (2, "QQX", "119.95", "LCL/P", None, "", "big top", ""), (3, "QQX", "136.999", "APCH/P", "north", "HIGH hills", "big top", None),
        (4, "QQX", "137", "APCH/P", "", "", "", ""), (5, "QQX", "107.9", "GND", "", "", "", ""), (6, "QQX", "108", "emerg", "", "", "T", ""), (7, "QQX", "120", "APT REMARK x", "", "", "", ""), (8, "QQX", "", "GND", "", "", "", ""),
        (9, "QQX", "121.5", "SEAS STAR", "", "", "", ""), (10, "QQX", "122.8", "CTAF", "", "", "", ""), (11, "QQX", "127.25", "D-ATIS", "", "", "", ""), (12, "Q7", "118.7", "GND/P", "", "", None, None), (13, None, "118.7", "GND/P", "", "", None, None),
    ]
    make = spark.createDataFrame
    return {
        "base": make(base, BASE), "runways": make(runways, "line long, ARPT_ID string, RWY_ID string, RWY_LEN string, RWY_WIDTH string"), "ends": make(ends, ENDS),
        "frequencies": make(used, USED).repartition(3), "places": make([("QQX", "America/New_York", ["QQX", "TOWERCAM"])], "faa_id string, timezone string, stations array<string>"),
    }


def test_airport_profiles(spark):
    found = {r.faa_id: r for r in airports.profiles(**files(spark)).collect()}
    assert set(found) == {"QQX", "Q7"}
    a, b = found["QQX"], found["Q7"]
    assert (a.icao, a.iata, a.name, a.city, a.latitude, a.longitude, a.elevation_ft) == ("KQQX", "QQX", "Lower Falls/O'Dell Field", "Lower Falls", 41.5, None, None)
    assert (a.magnetic_variation, a.timezone, a.effective) == ("11W (2025)", "America/New_York", "2026/09/03")
    assert (b.icao, b.iata, b.name, b.city, b.timezone, b.runways) == ("KQSV", None, "Q7", None, None, [])
    assert [(e.pair, e.end_ident, e.length_ft, e.width_ft, e.true_alignment) for e in a.runways] == [("09/27", "09", 6001, None, None), ("09/27", "27", 6001, None, 270.5), ("4C", "4C", None, None, None), ("H1", "H1", None, None, None)]
    assert [list(e.spoken) for e in a.runways[:3]] == [["runway zero niner", "runway zero nine"], ["runway two seven"], ["runway four center"]]
    assert [(f.service, f.frequency_hz, f.call) for f in a.frequencies] == [
        ("APP", 136_999_000, "High Hills Approach"), ("ATIS", 127_250_000, "Lower Falls ATIS"), ("EMERG", 108_000_000, None), ("OTHER", 122_800_000, None), ("PROC", 121_500_000, "Approach"), ("TWR", 119_950_000, "Big Top Tower"),
    ]
    tower = a.frequencies[-1]
    assert (tower.facility, tower.sectorization, tower.line) == (None, "LCL/P", 1) and a.frequencies[0].sectorization == "APCH/P north"
    assert list(tower.spoken) == ["one one niner point niner five", "one one nine point nine five", "one one niner decimal niner five"] and list(a.frequencies[2].spoken) == ["one zero eight point zero", "one zero eight decimal zero"]
    assert [(x.alias, x.kind) for x in a.aliases] == [
        ("KQQX", "icao"), ("QQX", "faa"), ("QQX", "station"), ("TOWERCAM", "station"), ("Lower Falls/O'Dell Field", "name"), ("Lower Falls", "spoken"), ("High Hills Approach", "spoken"), ("Big Top Tower", "spoken"),
    ]
    assert [(x.alias, x.kind) for x in b.aliases] == [("KQSV", "icao"), ("Q7", "faa"), ("Q7", "station"), ("Q7", "name"), ("Q7", "spoken"), ("Q7 Ground", "spoken")]


def test_airport_listing_and_drawing(spark):
    row = airports.profiles(**files(spark)).filter("faa_id = 'QQX'").select(airports.shown_frequencies(F.col("frequencies"))["service"].alias("s"), airports.drawn_runways(F.col("runways")).alias("d")).first()
    assert row.s == ["TWR", "ATIS", "APP", "PROC", "EMERG", "OTHER"]
    assert [(d.pair, [e.end_ident for e in d.ends]) for d in row.d] == [("09/27", ["09", "27"])]
    none = {k: v.limit(0) for k, v in files(spark).items()}
    assert airports.profiles(**none).count() == 0


def test_gathered_meets_in_one_shuffle(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "k long, v string"), spark.createDataFrame([(2, 5)], "k long, v int")
    found = relational.gathered("k", {"a": a.select("k", F.struct("v").alias("v")), "b": b.select("k", F.struct("v").alias("v"))})
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted((r.k, sorted(x.v for x in r.a), [x.v for x in r.b]) for r in found.collect()) == [(1, ["x", "y"], []), (2, [], [5])]


ITEM = "item_id long, segment_id long, status string, accepted_version long, transcript string, speech_present boolean, confidence double, similarity double"
CURRENT = "segment_id long, label string, text string, text_origin string"


def test_accepted(spark):
    good = (1, "done", None, "words", True, 0.9, 0.8)
    rows = {
        "accepted": good, "not_done_failed": (1, "failed", 5, "", False, None, None), "already_accepted": (1, "done", 5, "", False, None, None), "no_speech": (1, "done", None, None, True, 0.9, 0.9),
        "no_speech ": (1, "done", None, "words", None, 0.9, 0.9), "below_min_confidence": (1, "done", None, "words", True, None, 0.9), "no_model_support": (1, "done", None, "words", True, 0.5, None), "no_model_support ": (1, "done", None, "words", True, 0.5, 0.79),
        "benchmark_source": (2, *good[1:]), "human_gold_unchanged": (3, *good[1:]), "rejected_by_human": (4, *good[1:]), "human_text_unchanged": (5, *good[1:]), "accepted ": (6, *good[1:]), "accepted  ": (99, *good[1:]), "accepted   ": (7, *good[1:]),
    }
    items = spark.createDataFrame([(k, *v) for k, v in enumerate(rows.values())], ITEM)
    segments = spark.createDataFrame([(k, "benchmark" if k == 2 else "corpus") for k in range(1, 8)], "segment_id long, role string")
    current = spark.createDataFrame([(2, "gold", "t", "human"), (3, "gold", "t", "human"), (4, "rejected", "t", "human"), (5, "none", "t", "human"), (6, "silver", "t", "model_consensus"), (7, None, "", "human")], CURRENT)
    got = {r.item_id: r.decision for r in decisions.accepted(items, segments, current, 0.5, True).collect()}
    assert [got[k] for k in range(len(rows))] == [name.strip() for name in rows]
    loose = {r.item_id: r.decision for r in decisions.accepted(items, segments, current, 0.0, False).collect()}
    assert [loose[k] for k in (5, 6, 7)] == ["accepted"] * 3


def test_nominated(spark):
    segments = spark.createDataFrame([(k, "benchmark" if k == 1 else "corpus") for k in range(1, 11)], "segment_id long, role string")
    current = spark.createDataFrame([(2, "gold", "t", "human"), (3, "rejected", "t", "human"), (4, "candidate", "own", "human"), (5, "silver", "m", "model_consensus"), (6, "none", "own", "human")], CURRENT)
    agreed = spark.createDataFrame([(1, "exact", "c"), (5, "near", "c"), (6, "medoid", "c"), (7, "medoid", "c"), (8, "exact", "c"), (9, "exact", "")], "segment_id long, kind string, representative string")
    ids = spark.createDataFrame([(k,) for k in [*range(1, 11), 8, 8, 404, None]], "segment_id long")

    def of(action):
        return {r.segment_id: (r.decision, r.text, r.text_origin) for r in decisions.nominated(ids, segments, current, agreed, action).collect()}

    same = {1: "benchmark_source", 2: "human_gold_unchanged", 404: "unknown_segment"}
    own, model = ("applied", "own", "human"), ("applied", "c", "model_consensus")
    no = lambda reason: (reason, None, None)
    both = {k: no(v) for k, v in (same | {3: "rejected_by_human", 9: "no_consensus_text", 10: "no_consensus_text"}).items()}
    assert of("candidate") == both | {4: no("already_candidate"), 5: model, 6: own, 7: model, 8: model}
    assert of("silver") == both | {4: own, 5: no("already_silver"), 6: own, 7: no("insufficient_agreement"), 8: model}
    assert of("clear") == {k: no(v) for k, v in (same | {k: "not_nominated" for k in (3, 6, 7, 8, 9, 10)}).items()} | {4: own, 5: ("applied", "m", "model_consensus")}
    with pytest.raises(ValueError):
        decisions.nominated(ids, segments, current, agreed, "delete")


def brute_around(rows, seconds, most):
    out = {}
    timed = sorted((r for r in rows if r[4] is not None), key=lambda r: (r[1], r[4], r[0]))
    place = {r[0]: k for k, r in enumerate(timed)}
    for me in rows:
        same = [r for r in rows if r[1] == me[1] and r[2] == me[2] and r[0] != me[0]]
        found = []
        if me[4] is None:
            for relation, side in (("previous", sorted((r for r in same if r[3] < me[3]), key=lambda r: r[3])[-1:]), ("next", sorted((r for r in same if r[3] > me[3]), key=lambda r: r[3])[:1])):
                found += [(relation, r[0], None) for r in side]
            out[me[0]] = found
            continue
        with_time = [r for r in same if r[4] is not None]
        ends = [("previous", sorted((r for r in with_time if r[4] < me[4]), key=lambda r: (r[4], r[0]))[-1:]), ("next", sorted((r for r in with_time if r[4] > me[4]), key=lambda r: (r[4], r[0]))[:1])]
        found = [(relation, r[0], round((r[4] - me[4]) / 1, 1)) for relation, side in ends for r in side]
        gone = {f[1] for f in found} | {me[0]}
        near = [r for r in timed if r[1] == me[1] and r[0] not in gone and abs(r[4] - me[4]) <= seconds]
        near.sort(key=lambda r: (abs(r[4] - me[4]), abs(place[r[0]] - place[me[0]]), place[r[0]]))
        found += [("nearby", r[0], round(float(r[4] - me[4]), 1)) for r in near[:most]]
        out[me[0]] = sorted(found, key=lambda f: f[2])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_neighbourhood(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(250):
        day = rng.choice((0, 0, 0, 86_400, 5 * 86_400))
        at = rng.choice((3_590, 3_600, 3_610, 86_399, 0, rng.randint(3_400, 3_800), rng.randint(0, 7_300)))
        rows.append((k, rng.randint(0, 1), rng.choice(("A", "A", "B", None)), f"p{rng.random()}", None if rng.random() < 0.1 else day + at, f"text {k}"))
    frame = spark.createDataFrame(rows, "segment_id long, source_id long, channel string, relative_path string, t long, preview string").withColumn("capture_start", F.timestamp_seconds("t"))
    got = {r.segment_id: [(x.relation, x.segment_id, x.offset_s) for x in r.around] for r in briefs.neighbourhood(frame.repartition(5)).collect()}
    assert got == brute_around(rows, 60, 6)


def test_briefs(spark):
    make = spark.createDataFrame
    segments = make([(1, "TWR", 900), (2, None, None)], "segment_id long, channel string, duration_ms long")
    said = [(1, "m2", "f", "success", "two words", True), (1, "m1", "f", "success", "x", None), (1, "m3", "g", "success", " ", True), (1, "m0", "g", "abstained", None, True), (1, "m4", "g", "error", None, True), (7, "m", "f", "success", "y", True)]
    hyp = make(said, "segment_id long, model string, family string, status string, text string, eligible boolean")
    agreed = make([(1, "exact", "two words")], "segment_id long, kind string, representative string")
    around = make([(1, [("previous", 9, -3.0, "said before"), ("nearby", 8, -1.0, ""), *[("nearby", k, float(k), f"t{k}") for k in range(4)]])], "segment_id long, around array<struct<relation:string,segment_id:long,offset_s:double,preview:string>>")
    planes = make([(1, 2, "n12q"), (1, 1, " dal88 "), (1, 3, "ZZZ9"), (1, 4, None), (1, 5, "N123456")], "segment_id long, rank int, callsign string")
    rows = {r.segment_id: r for r in briefs.briefs(segments, hyp, agreed, around, planes).collect()}
    assert set(rows) == {1, 2}
    a, b = rows[1], rows[2]
    assert [(h.model, h.text, h.research_only) for h in a.hypotheses] == [("m1", "x", True), ("m2", "two words", False)]
    assert (a.abstained, a.errors, a.agreement.kind, a.segment.channel) == (["m0", "m3"], ["m4"], "exact", "TWR")
    assert [n.preview for n in a.neighbours] == ["said before", "t0", "t1", "t2"]
    assert [c.telephony for c in a.aircraft] == ["Delta 88", "November 12Q", None, None, None]
    assert (b.hypotheses, b.agreement, b.neighbours, b.aircraft, b.segment.channel) == ([], None, [], [], None)
    assert spark.createDataFrame([("SWA1A",), ("SW1",), ("N",), ("",)], "c string").select(telephony_hint(F.col("c")).alias("t")).collect()[0].t == "Southwest 1A"


def test_models_and_unshown_neighbours_take_no_shuffle_of_results(spark):
    from squelch.plans import context

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = context._newest(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(model_id" not in plan and "hashpartitioning(l_suppkey" not in plan
    around = spark.createDataFrame([(1, [(float(k), None if k % 2 else f"p{k}") for k in range(20)])], "segment_id long, around array<struct<offset_s:double,preview:string>>")
    empty = {"h": "segment_id long, model string, family string, status string, text string, eligible boolean", "a": "segment_id long, kind string", "c": "segment_id long, rank int, callsign string"}
    frames = {k: spark.createDataFrame([], v) for k, v in empty.items()}
    found = briefs.briefs(spark.createDataFrame([(1, 5)], "segment_id long, duration_ms long"), frames["h"], frames["a"], around, frames["c"])
    assert [n.preview for n in found.first().neighbours] == ["p0", "p2", "p4", "p6"]


def test_support(spark):
    make = spark.createDataFrame
    answers = make([(10, 1, "Cross runway two, hold short"), (11, 2, "hello"), (12, 3, None)], "item_id long, segment_id long, transcript string")
    hyp = make([(1, "b", "success", "cross runway two"), (1, "a", "success", "CROSS runway TWO."), (1, "c", "error", "cross runway two hold short"), (2, "a", "success", ""), (3, "a", "success", "x")], "segment_id long, model string, status string, text string")
    reps = make([(1, "hold short"), (2, None)], "segment_id long, representative string")
    got = {r.item_id: (r.best_similarity, r.best_model, r.representative_similarity) for r in briefs.support(answers, hyp, reps).collect()}
    assert got == {10: (0.6, "a", 0.4), 11: (None, None, None), 12: (0.0, "a", None)}
