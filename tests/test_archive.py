"""Logs of paid review, aircraft of a transmission, positions in areas, review filters: literal cases and brute force."""

import hashlib
import json
import random
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from squelch.functions import hashing, replies
from squelch.operators import annotations, answers, areas, datasets, relational, review, sightings, sweeps, utterances
from squelch.plans import catalogue
from squelch.sources import views
from squelch.streaming import answers as live
from squelch.streaming import incremental

LOG = "item_id long, at_us long, event_id long, kind string, runner string, cost_cents long, retryable boolean"
MINUTE = 60_000_000


def log_of(spark, *events):
    return spark.createDataFrame([(1, at * MINUTE, k, kind, runner, cost, again) for k, (at, kind, runner, cost, again) in enumerate(events)], LOG)


@pytest.mark.parametrize(
    ("events", "state"),
    [
        ([(0, "claim", "a", None, None), (5, "done", "a", 7, None)], ("done", 1, 7, 0)),
        ([(0, "claim", "a", None, None), (5, "done", "b", 7, None)], ("running", 1, 7, 1)),  # another's answer: paid for, not taken
        ([(0, "claim", "a", None, None), (30, "done", "a", 7, None)], ("queued", 1, 7, 1)),  # stale by then
        ([(0, "claim", "a", None, None), (20, "done", "a", 7, None)], ("done", 1, 7, 0)),  # exactly as old as a claim may be
        ([(0, "claim", "a", None, None), (1, "error", "a", 2, True), (2, "claim", "b", None, None), (3, "done", "b", 3, None), (4, "done", "b", 3, None)], ("done", 2, 8, 1)),  # the second answer is late
        ([(k, kind, "a", 1, True) for k in range(3) for kind in ("claim", "error")], ("failed", 3, 3, 0)),
        ([(0, "claim", "a", None, None), (1, "error", "a", None, False)], ("failed", 1, 0, 0)),
        ([(0, "claim", "a", None, None), (1, "claim", "b", None, None), (2, "done", "b", 4, None)], ("running", 1, 4, 1)),
        ([(0, "done", "a", 4, None)], ("queued", 0, 4, 1)),
        ([(0, "claim", None, None, None), (1, "done", None, None, None)], ("done", 1, 0, 0)),
    ],
)
def test_items(spark, events, state):
    row = answers.item_states(log_of(spark, *events)).first()
    assert (row.status, row.attempts, row.cost_cents, row.late) == state and row.events == len(events)


def test_claims_go_stale_after_the_log_too(spark):
    log = log_of(spark, *[(25 * k, "claim", "a", None, None) for k in range(3)])
    assert answers.item_states(log).first().status == "running"
    late = answers.item_states(log, now_us=F.lit(200 * MINUTE)).first()
    assert (late.status, late.attempts, late.finished_us) == ("failed", 3, 70 * MINUTE)
    assert answers.batches(answers.item_states(log), F.lit(0)).first().status == "running"


def test_stream_of_answers_equals_the_fold(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.randrange(12), (t + 1) * 7 * MINUTE, t, rng.choice(["claim", "claim", "done", "error"]), rng.choice("ab"), rng.randrange(50), rng.random() < 0.5) for t in range(400)]
    log = spark.createDataFrame(rows, LOG).withColumn("at", F.timestamp_micros("at_us"))
    for k in range(4):
        log.filter(F.col("event_id").between(100 * k, 100 * k + 99)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/incoming")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/incoming")
    live.follow(stream, str(tmp_path), spark, "1 hour").awaitTermination()
    now = F.lit(10_000 * MINUTE)
    got = answers.as_of(live.current(spark, str(tmp_path)), now, 20 * MINUTE)
    want = answers.item_states(log, now_us=now)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


# Aircraft


def test_successors_cross_blocks_of_time(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["x", "y"]), rng.randrange(1000), k) for k in range(120)] + [("z", 5, 0), (None, 6, 1), ("x", None, 2)]
    got = sightings.successors(spark.createDataFrame(rows, "k string, t long, v long"), "k", "t", ["v"], 60).collect()
    order = {key: sorted((t, v) for k, t, v in rows if k == key and t is not None) for key in "xyz"}
    assert len(got) == len(rows)
    for r in got:
        own = order.get(r.k, [])
        after = own[own.index((r.t, r.v)) + 1 :] if r.t is not None and own else []
        assert (r.next_t, r.next_v) == (after[0] if after else (None, None))


FIXES = "icao string, t long, lat double, lon double, alt double, heading double, ground boolean"


def test_positions_between_fixes(spark):
    fixes = spark.createDataFrame(
        [
            ("a", 0, 0.0, 0.0, 1000.0, 90.0, False), ("a", 100, 0.0, 1.0, 2000.0, 91.0, False), ("a", 150, None, 5.0, 1.0, 1.0, False), ("a", 200, 0.0, 2.0, None, 92.0, True),
            ("b", 0, 0.0, 0.0, 1.0, 1.0, False), ("b", 1801, 0.0, 0.5, 1.0, 1.0, False), ("c", 90, 3.0, 0.0, 1.0, 1.0, False), ("c", 110, 0.0, 0.0, 1.0, 1.0, False),
        ], FIXES,
    )
    near = spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate([("a", 50), ("a", 100), ("a", 101), ("a", 150), ("b", 900), ("c", 95), ("c", 109), ("a", 201)])], "segment_id long, icao string, t long")
    got = {r.segment_id: (round(r.lat, 9), round(r.lon, 9), r.alt, r.heading) for r in sightings.positions(near, fixes, {k: F.lit(v) for k, v in (("south", -1.0), ("north", 1.0), ("west", -1.0), ("east", 1.0))}).collect()}
    # 1: both legs hold it, the first counts. 2, 3: east of the box. 4: too long a gap. 5: north of the box. 7: after the track.
    assert got == {0: (0.0, 0.5, 1500.0, 90.0), 1: (0.0, 1.0, 2000.0, 90.0), 6: (0.15, 0.0, 1.0, 1.0)}


def test_flights_near_equal_brute_force(spark):
    rng = random.Random(7)
    flights = [(k % 2, f"i{rng.randrange(9)}", None, *sorted(rng.randrange(100_000) for _ in "ab"), k) for k in range(60)]
    flights += [(0, None, None, 1, 99_000, 60), (0, "n", None, None, 3000, 61), (0, "o", None, 5, None, 62)]
    calls = [(k, k % 2, rng.randrange(100_000)) for k in range(40)]
    got = sightings.active_flights(spark.createDataFrame(calls, "segment_id long, station long, t long"), spark.createDataFrame(flights, "station long, icao string, callsign string, first_seen long, last_seen long, listed long"), 3)
    want = set()
    for i, station, t in calls:
        found = {}
        for s, icao, _, first, last, _ in flights:
            if s == station and icao and last is not None and (first or 0) - 600 <= t <= last + 600:
                found[icao] = min(abs((first if first is not None else t) - t), abs(last - t))
        want |= {(i, icao, rank + 1) for rank, (icao, _) in enumerate(sorted(found.items(), key=lambda x: (x[1], x[0]))[:3])}
    assert {(r.segment_id, r.icao, r.rank) for r in got.collect()} == want


@pytest.mark.parametrize("unknown", [False, True])
def test_flights_that_cannot_be_near_go_before_transmissions_meet_them(spark, unknown):
    rng = random.Random(11)
    flights = []
    for k in range(1500):  # most of them under way at any time, aircraft with several flights, some from midnight on
        first = rng.randrange(150_000)
        flights.append((k % 2, k // 3, f"c{k}", None if unknown and k % 7 == 0 else first, first + rng.randrange(80_000), k))
    calls = [(k, k % 2, rng.randrange(180_000)) for k in range(300)] + [(900 + k, k % 2, 3600 * k) for k in range(20)]
    schema = "station long, icao long, callsign string, first_seen long, last_seen long, listed long"
    frame = spark.createDataFrame(flights, schema)
    got = {(r.segment_id, r.icao, r.callsign, r.rank) for r in sightings.active_flights(spark.createDataFrame(calls, "segment_id long, station long, t long"), frame, 4).collect()}
    want, pairs = set(), 0
    for i, station, t in calls:
        found = {}
        for s, icao, name, first, last, _ in flights:  # as they are listed
            if s == station and (first if first is not None else last - last % 86_400) - 600 <= t <= last + 600:
                found[icao] = (min(abs((first if first is not None else t) - t), abs(last - t)), icao, name)
        pairs += len(found)
        want |= {(i, icao, name, rank + 1) for rank, (_, icao, name) in enumerate(sorted(found.values())[:4])}
    assert got == want
    hours = frame.select("station", "icao", F.struct("listed", "last_seen", "first_seen", "callsign", (F.coalesce("first_seen", F.expr("last_seen - last_seen % 86400")) - 600).alias("begin"), (F.col("last_seen") + 600).alias("end")).alias("f"))
    spread = hours.withColumns({"_day": F.lit(0), "_from": F.floor(F.col("f.begin") / 60), "_to": F.floor(F.col("f.end") / 60)})
    kept = sightings._kept(spread, 60, 4).groupBy("station", "_bucket").count().agg(F.avg("count")).first()[0]
    assert kept < 40 < pairs / len(calls)


# Passages


def test_passages_of_gathered_hypotheses_need_no_shuffle_and_equal_those_of_rows(spark, tmp_path):
    texts = ["alpha bravo charlie delta, echo 118.5 tango - sierra " * 3, "Turn left heading two seven zero\u2003please \u2003now", "", "one"]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    gathered = views.timed_hypotheses(spark, str(tmp_path))
    gathered = gathered.withColumn("every", F.transform("every", lambda h: F.when(h["model"] == "canary-b", F.struct(*[h[c].alias(c) for c in ("model", "family", "status", "text")], F.slice(h["words"], 2, 9).alias("words"))).otherwise(h)))  # words that don't give the text
    rows = gathered.select("segment_id", "duration_ms", F.explode("every").alias("h")).select("segment_id", "duration_ms", "h.*")
    want = utterances.utterances(rows.repartition(5)).orderBy("segment_id", "ordinal").collect()
    found = utterances.utterances(gathered)
    assert found.orderBy("segment_id", "ordinal").collect() == want and want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
    assert "hashpartitioning" not in catalogue.QUERIES["text_highlights"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


# Areas


def ring_of(*points):
    return [*points, points[0]]


def test_points_in_areas_equal_a_ray_test(spark):
    rng = random.Random(1)
    rings = [(k, ring_of(*[(rng.uniform(-20, 20), rng.uniform(-20, 20)) for _ in range(rng.randint(3, 9))])) for k in range(12)]
    rings += [(20, ring_of((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))), (21, [(1.0, 1.0), (2.0, 2.0)]), (22, [])]
    points = [(k, rng.uniform(-22, 22), rng.uniform(-22, 22)) for k in range(400)] + [(500 + k, float(k % 5), float(k // 5)) for k in range(25)] + [(600, None, 1.0), (601, 1.0, None)]

    def holds(x, y, ring):
        return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:])) % 2 == 1

    frame = spark.createDataFrame(points, "id long, x double, y double")
    shapes = spark.createDataFrame(rings, "area_id long, ring array<struct<x:double,y:double>>")
    want = {(i, k) for i, x, y in points if x is not None and y is not None for k, ring in rings if len(ring) > 3 and holds(x, y, ring)}
    for size in (0.7, 3.0, 50.0):
        assert {(r.id, r.area_id) for r in areas.located(frame, shapes, size).collect()} == want
    inner = areas.cells(shapes.filter("area_id = 20"), 1.0).collect()
    assert {(c.cx, c.cy) for c in inner if c.deciding is None} == {(1, 1), (1, 2), (2, 1), (2, 2)}  # only the cells on the edge test rays


def test_distances_and_labels(spark):
    square = [ring_of((100.0, 100.0), (300.0, 100.0), (300.0, 300.0), (100.0, 300.0))]
    hole = [ring_of((100.0, 100.0), (200.0, 100.0), (200.0, 300.0), (100.0, 300.0))]
    rows = spark.createDataFrame([(1, square[0], None), (2, square[0], hole), (3, ring_of((0.0, 0.0), (5.0, 0.0), (5.0, 5.0)), []), (4, ring_of((50.0, 50.0), (60.0, 50.0), (60.0, 60.0), (50.0, 60.0)), [])], "area_id long, ring array<struct<x:double,y:double>>, exclude array<array<struct<x:double,y:double>>>")
    got = {r.area_id: (r.x, r.y, r.room) for r in areas.label_points(rows, 400, 400).collect()}
    assert got == {1: (200.0, 200.0, 100.0), 2: (250.0, 150.0, 50.0)}  # 3 is out of the frame's margin, 4 too small
    far = rows.filter("area_id = 1").select(areas.edge_distance(F.lit(90.0), F.lit(90.0), areas.edges(F.col("ring"))).alias("d")).first().d
    assert far == pytest.approx(200**0.5)


# Review


def test_review_filters(spark):
    rows = spark.createDataFrame([(1, "bench", "benchmark", "TWR", 3), (2, "a", "corpus", "TWR", 0), (3, "a", "corpus", None, 2), (4, "b", "corpus", "GND", None)], "segment_id long, source_id string, role string, channel string, results int")
    ids = lambda f, **more: sorted(r.segment_id for r in review.query(rows, f, **more).collect())
    assert ids(review.Filters()) == [3] and ids(review.Filters(min_models=0)) == [2, 3, 4]
    assert ids(review.Filters(sources=["bench"])) == [1]  # a named source is searched whatever its role
    assert ids(review.Filters(sources=[], channels=[], min_models=None)) == [2, 3, 4] and ids(review.Filters(sample_ids=[], min_models=0)) == []
    texts = review.Texts(spark.createDataFrame([(3, "m1", "Cleared 50%"), (4, "m2", "cleared 500")], "segment_id long, model string, text string"), spark.createDataFrame([(2, "fifty")], "segment_id long, text string"), spark.createDataFrame([(3, "FIFTY")], "segment_id long, text string"))
    ask = lambda **f: ids(review.Filters(min_models=0, **f), texts=texts)
    assert ask(q="50%") == [3] and ask(q="fifty") == [2, 3] and ask(q="fifty", scope="human") == [3] and ask(q="fifty", scope="consensus") == [2]
    assert ask(q="cleared", scope="hypotheses") == [3, 4] and ask(q="cleared", scope="model", scope_model="m2") == [4] and ask(scope="model", scope_model="m1") == [3] and ask(q="  ") == [2, 3, 4]
    with pytest.raises(ValueError, match="scope_model"):
        ask(q="x", scope="model")


@pytest.mark.parametrize("name", ["review_time_channel", "review_coalesce_status"])
def test_segments_of_many_errors_are_reviewed(spark, tmp_path, name):
    """1 has three errors, 2 one success, 3 no result, 4 three errors in the benchmark."""
    tables = {
        "orders": ([(k, 7 if k == 4 else 1, "F", 100.0, datetime(1995, 6, k), "1-URGENT") for k in (1, 2, 3, 4)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        "lineitem": (
            [(k, 1, 1, n, 1.0, 1.0, 0.0, "R", datetime(1995, 7, n)) for k in (1, 4) for n in (1, 2, 3)] + [(2, 1, 1, 1, 1.0, 1.0, 0.0, "N", datetime(1995, 7, 1))],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_shipdate timestamp_ntz",
        ),
        "supplier": ([(1, "m", 0, 1.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "nation": ([(0, "f", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "labels": ([(2, 0, 0)], "doc_id long, quality int, toxic int"),
    }
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    assert sorted(r.segment_id for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()) == [1, 2]
    assert sorted(con.execute(catalogue.ORACLES[name]).fetchall()) == [(1,), (2,)]


# Annotations, data sets, sweeps, votes, answers


def test_saves_conflict_by_the_version_their_editor_had(spark):
    rows = [(1, 1, 10, 0, None), (1, 2, 11, 0, None), (1, 3, 12, 1, "benchmark"), (1, 4, 13, 1, None), (1, 5, 14, None, None), (2, 1, 15, None, None), (2, 2, 16, 5, None)]
    log = spark.createDataFrame(rows, "thread_id long, at_us long, event_id long, expected_version int, refusal string").withColumn("label", F.concat(F.lit("l"), "event_id"))
    done = annotations.saves(log)
    assert {r.event_id: (r.outcome, r.version) for r in done.collect()} == {10: ("saved", 1), 11: ("conflict", 1), 12: ("benchmark", 1), 13: ("saved", 2), 14: ("conflict", 2), 15: ("saved", 1), 16: ("conflict", 1)}
    assert sorted((r.thread_id, r.version, r.label) for r in annotations.current(log, done).collect()) == [(1, 2, "l13"), (2, 1, "l15")]


def test_refusals(spark):
    rows = [("gold", "x", "reviewed", True, "segment", None, False), ("gold", "x", "reviewed", None, "segment", None, False), ("gold", " ", "reviewed", True, "segment", None, False), ("gold", "x", None, True, "segment", None, False), ("silver", None, None, None, "segment", None, True), ("none", None, None, None, "span", 1051, False), ("none", None, None, None, "span", 1050, True)]
    frame = spark.createDataFrame(rows, "label string, text string, status string, confirm_gold boolean, scope string, end_ms long, benchmark boolean").withColumn("duration_ms", F.lit(1000))
    assert [r.r for r in frame.select(annotations.refusal(F.col("benchmark")).alias("r")).collect()] == [None, "gold_not_confirmed", "gold_without_text", "gold_not_reviewed", "benchmark", "span_after_end", None]


def test_annotations_of_one_version_id_are_one_whatever_their_segments(spark, tmp_path):
    lines = [(7, 90909, 1, 300.5, "A"), (8, 0, 1, 50.0, "A"), (7, 90909, 5, 200.5, "A"), (9, 3, 2, 10.0, "A"), (9, 3, 2, 9.0, "A")]  # 7 * 1000003 + 90909 * 11 + 5 = 8 * 1000003 + 1
    spark.createDataFrame([(o, p, 1, n, 1.0, x, 0.0, f, datetime(1998, 1, 1)) for o, p, n, x, f in lines], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o, 1, "F", 100.0, datetime(1998, 1, o), "1-URGENT") for o in (7, 8, 9)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = {(r.version_id, r.segment_id, r.scope, r.end_ms) for r in views.annotated_segments(spark, str(tmp_path)).collect()}
    assert got == {(7 * 1000003 + 90909 * 11 + 1, 7, "segment", None), (8 * 1000003 + 1, 8, "segment", None), (9 * 1000003 + 35, 9, "span", 209)}
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert set(con.execute(views.with_views("SELECT version_id, segment_id, scope, end_ms FROM annotated", "segment", "result", "annotated")).fetchall()) == got


def test_ordinals_and_manifests_do_not_depend_on_partitions(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, rng.randrange(40)]), f"é{k}") for k in range(2100)]
    want = {k: i for i, (k, _, _) in enumerate(sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0])))}
    prints = []
    for parts in (1, 3, 17):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        frame = spark.createDataFrame(rows, "id long, t long, s string").repartition(5)
        got = relational.range_ordinals(frame, [F.col("t").asc_nulls_last(), F.col("id")])
        assert {r.id: r.ordinal for r in got.collect()} == want
        prints.append(datasets.manifest_hash(got, ["ordinal", "id", "s", "t"]))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    leaf = lambda o, r: hashlib.sha256(json.dumps({"id": r[0], "ordinal": o, "s": r[2], "t": r[1]}, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    level = [leaf(want[r[0]], r) for r in sorted(rows, key=lambda r: want[r[0]])]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[k : k + 1024]).encode()).hexdigest() for k in range(0, len(level), 1024)]
    assert set(prints) == {level[0]}
    none = spark.createDataFrame([], "id long, ordinal long")
    assert datasets.manifest_hash(none, ["id"]) is None and relational.range_ordinals(none.drop("ordinal"), [F.col("id")]).collect() == []


def test_canonical_json_sorts_at_every_depth(spark):
    frame = spark.sql("select named_struct('b', 1, 'a', named_struct('z', map('y', 2, 'x', cast(null as int)), 'c', array(named_struct('q', 1, 'p', 'é')))) as v, cast(null as struct<a:int>) as n")
    kinds = {f.name: f.dataType for f in frame.schema}
    row = frame.select(hashing.canonical_json(F.col("v"), kinds["v"]).alias("v"), hashing.canonical_hash(F.col("v"), kinds["v"]).alias("h"), hashing.canonical_json(F.col("n"), kinds["n"]).alias("n")).first()
    assert row.v == '{"a":{"c":[{"p":"é","q":1}],"z":{"x":null,"y":2}},"b":1}' and row.n is None
    assert row.h == hashlib.sha256(row.v.encode()).hexdigest()


def test_sweep_selection_and_preview(spark):
    rows = [(k, 1 if k < 8 else 2, "missing" if k == 7 else "present", None, "d", "TWR", 60_000, f"p{k}") for k in range(10)]
    segments = spark.createDataFrame(rows, "segment_id long, source_id long, presence_status string, capture_start timestamp_ntz, relative_dir string, channel string, duration_ms long, relative_path string")
    results = spark.createDataFrame([(0, 1, 30, 60), (0, 2, 30, 60), (1, 1, 30, 60), (1, 1, 30, 60), (2, 9, 5, 0)], "segment_id long, model_id long, inference_ms long, audio_ms long")
    ids = lambda s, m=(1, 2): sorted(r.segment_id for r in sweeps.selected(segments, results, s, list(m)).collect())
    assert ids(sweeps.Selection(1)) == [0, 1, 2, 3, 4, 5, 6] and ids(sweeps.Selection(1, untranscribed_only=True)) == [1, 2, 3, 4, 5, 6]
    assert ids(sweeps.Selection(1, untranscribed_only=True), (1,)) == [2, 3, 4, 5, 6] and len(ids(sweeps.Selection(1, limit=3, seed=5))) == 3
    assert ids(sweeps.Selection(1, limit=3, seed=5)) == ids(sweeps.Selection(1, limit=3, seed=5)) and ids(sweeps.Selection(1, max_duration_ms=10)) == []
    models = spark.createDataFrame([(1, "f", True), (2, "f", True), (9, "g", False)], "model_id long, family string, sweep_eligible boolean")
    out = {r.model_id: r for r in sweeps.preview(sweeps.selected(segments, results, sweeps.Selection(1), [1]), models, results).collect()}
    assert (out[1].segments, out[1].audio_minutes, out[1].observed_rtf, out[1].estimated_minutes, out[1].shared_family) == (7, 7.0, 0.5, 4.5, True)
    assert (out[9].observed_rtf, out[9].estimated_minutes, out[9].shared_family) == (None, None, False)
    both = sweeps.frozen(segments.filter("segment_id < 3"), segments.filter("segment_id in (2, 9)")).collect()
    assert sorted((r.ordinal, r.segment_id) for r in both) == [(0, 0), (1, 1), (2, 2), (3, 9)]


def test_a_rerun_is_no_second_provider_and_votes_touch_their_segments_only(spark, tmp_path):
    kind = "segment_id long, model string, family string, status string, text string"
    step = incremental.refresh(spark, str(tmp_path))
    step(spark.createDataFrame([(1, "a", "fa", "success", "one two"), (2, "b", "fb", "success", "x y"), (3, "a", "fa", "success", "only")], kind), 0)
    step(spark.createDataFrame([(1, "a", "fa", "success", "one two"), (1, "b", "fb", "success", "one two")], kind), 1)
    rows = lambda: {r.segment_id: (r.results, r.exact_providers, r.exact_families) for r in incremental.current_rows(spark, str(tmp_path)).collect()}
    assert rows() == {1: (2, 2, 2), 2: (1, 1, 1), 3: (1, 1, 1)}
    incremental.decide(spark, str(tmp_path), "a", False)
    assert rows() == {1: (1, 1, 1), 2: (1, 1, 1)}  # segment 3 has no voter left
    step(spark.createDataFrame([(3, "a", "fa", "success", "again")], kind), 2)
    assert rows() == {1: (1, 1, 1), 2: (1, 1, 1)}
    incremental.decide(spark, str(tmp_path), "a", True)
    assert rows() == {1: (2, 2, 2), 2: (1, 1, 1), 3: (1, 1, 1)}
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(1).cast("long")), F.lit(incremental.BUCKETS)).cast("int")).first()[0]
    opened = incremental.results_of(spark, str(tmp_path), [bucket])
    scan = opened._jdf.queryExecution().executedPlan().toString()
    assert opened.filter("segment_id = 1").count() == 3 and f"(bucket#" in scan and "PartitionFilters: []" not in scan


@pytest.mark.parametrize(
    ("content", "want"),
    [
        (None, "not_json"), ("", "not_json"), ("{", "not_json"), ("[1]", "not_object"), ("null", "not_object"), ('{"transcript": "x"}', "missing_fields"),
        ('```json\n{"speech_present": true, "transcript": " a \\n b ", "confidence": 2, "uncertain_words": null, "callsigns": [" x1 ", 5], "closest_hypothesis": "", "notes": null}\n```', (True, "a b", 1.0, [], ["X1", "5"], "", "")),
        ('{"speech_present": 1, "transcript": "", "confidence": "0.5", "uncertain_words": ["a", null], "callsigns": "no list", "closest_hypothesis": 7, "notes": "' + "n" * 600 + '"}', (False, "", 0.5, ["a"], [], "7", "n" * 500)),
        ('{"speech_present": [], "transcript": "x", "confidence": -1, "uncertain_words": [' + ",".join(f'"{k}"' for k in range(60)) + '], "callsigns": [], "closest_hypothesis": null, "notes": ""}', (False, "x", 0.0, [str(k) for k in range(50)], [], "", "")),
        ('{"speech_present": true, "transcript": "x", "confidence": "high", "uncertain_words": [], "callsigns": [], "closest_hypothesis": "", "notes": ""}', "confidence_not_number"),
        ('{"speech_present": true, "transcript": "x", "confidence": "NaN", "uncertain_words": [], "callsigns": [], "closest_hypothesis": "", "notes": ""}', "confidence_nan"),
    ],
)
def test_answers_are_read_tolerantly(spark, content, want):
    p = spark.createDataFrame([(content,)], "c string").select(replies.parsed(F.col("c")).alias("p")).first().p
    got = p.refusal or (p.speech_present, p.transcript, p.confidence, p.uncertain_words, p.callsigns, p.closest_hypothesis, p.notes)
    assert got == want
