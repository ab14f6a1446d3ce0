"""Queries over logs, positions, areas, passages and documents of the archive, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squelch.functions.geo import box
from squelch.operators import annotations, answers, areas, datasets, sightings, sweeps, utterances
from squelch.session import shared_folder
from squelch.sources import views
from squelch.sources.views import answer_log, with_views

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None, *views: str):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_views(sql, *views) if views else sql
        return f

    return register


# Paid review: claims and answers

STALE_US = 8 * 3600 * 1_000_000
_NOW_US = 1_706_745_600_000_000  # the first of February 2024
_FOLD = f"""ordered AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY at_us, event_id) AS n FROM answer_log),
folded AS (
 SELECT item_id, CAST(0 AS BIGINT) AS n, 'queued' AS status, CAST(NULL AS VARCHAR) AS runner, CAST(NULL AS BIGINT) AS claimed_us, 0 AS attempts, CAST(0 AS BIGINT) AS cost_cents, 0 AS late, CAST(NULL AS BIGINT) AS finished_us
 FROM (SELECT DISTINCT item_id FROM answer_log)
 UNION ALL
 SELECT item_id, n, CASE WHEN kind = 'claim' THEN CASE WHEN was = 'queued' THEN 'running' ELSE was END WHEN NOT held THEN was WHEN kind = 'done' THEN 'done' WHEN retryable AND attempts < 3 THEN 'queued' ELSE 'failed' END,
  CASE WHEN kind = 'claim' AND was = 'queued' THEN new_runner ELSE runner END, CASE WHEN kind = 'claim' AND was = 'queued' THEN at_us ELSE claimed_us END,
  attempts + CASE WHEN kind = 'claim' AND was = 'queued' THEN 1 ELSE 0 END, cost_cents + paid, late + CASE WHEN kind <> 'claim' AND NOT held THEN 1 ELSE 0 END,
  CASE WHEN kind <> 'claim' AND held AND (kind = 'done' OR NOT (retryable AND attempts < 3)) THEN at_us ELSE ended END
 FROM (SELECT *, was = 'running' AND runner = new_runner AS held FROM (
  SELECT f.item_id, o.n, o.kind, o.runner AS new_runner, o.cost_cents AS paid, o.retryable, o.at_us, f.runner, f.claimed_us, f.attempts, f.cost_cents, f.late,
   CASE WHEN f.status = 'running' AND f.claimed_us + {STALE_US} < o.at_us THEN CASE WHEN f.attempts >= 3 THEN 'failed' ELSE 'queued' END ELSE f.status END AS was,
   CASE WHEN f.status = 'running' AND f.claimed_us + {STALE_US} < o.at_us AND f.attempts >= 3 THEN f.claimed_us + {STALE_US} ELSE f.finished_us END AS ended
  FROM folded f JOIN ordered o ON o.item_id = f.item_id AND o.n = f.n + 1))),
final AS (SELECT item_id, CASE WHEN stale AND attempts >= 3 THEN 'failed' WHEN stale THEN 'queued' ELSE status END AS status, runner, claimed_us, attempts, cost_cents, late,
 CASE WHEN stale AND attempts >= 3 THEN claimed_us + {STALE_US} ELSE finished_us END AS finished_us, n AS events
 FROM (SELECT *, status = 'running' AND claimed_us + {STALE_US} < {_NOW_US} AS stale FROM folded QUALIFY n = max(n) OVER (PARTITION BY item_id)))"""


def _folded(select: str) -> str:
    return with_views("", "answer_log").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + _FOLD + "\n" + select


@query("answer_items", _folded("SELECT * FROM final"))
def answer_items(spark: SparkSession, d: str) -> DataFrame:
    """The state of every item after its log, by one fold."""
    return answers.item_states(answer_log(spark, d), STALE_US, F.lit(_NOW_US))


@query("answer_stream", _folded("SELECT * FROM final"))
def answer_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same from the log replayed as a stream of files, with keyed state and timers."""
    from squelch.streaming import answers as live

    store, log = shared_folder(spark, "answers"), answer_log(spark, d)
    for k, (low, high) in enumerate(((1, 7), (8, 14), (15, 21), (22, 31))):  # weeks, one after another; an item's events of a week in one file
        log.filter(F.dayofmonth("at").between(low, high)).repartition(4, "item_id").write.mode("append").parquet(f"{store}/incoming/week={k}")
    stream = spark.readStream.schema(log.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 4).parquet(f"{store}/incoming")
    live.follow(stream, store, spark, "15 days", STALE_US).awaitTermination()
    return answers.as_of(live.current(spark, store), F.lit(_NOW_US), STALE_US)


@query("answer_batches", _folded("SELECT item_id % 7 AS batch, count(*) AS items, count(*) FILTER (status IN ('queued', 'running')) AS open, CAST(sum(cost_cents) AS BIGINT) AS spent_cents, CASE WHEN count(*) FILTER (status IN ('queued', 'running')) = 0 THEN 'done' ELSE 'running' END AS status FROM final GROUP BY 1"))
def answer_batches(spark: SparkSession, d: str) -> DataFrame:
    return answers.batches(answer_items(spark, d), F.col("item_id") % 7)


# Aircraft of a transmission

MOST_TRACKS = 12
_NM = "2 * 3440.065 * asin(sqrt(least(1.0, pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2))))"
_BOX = "{0} BETWEEN 40 - 45 / 60.0::DOUBLE AND 40 + 45 / 60.0::DOUBLE AND {1} BETWEEN -100 - 45 / 60.0::DOUBLE / cos(radians(40.0)) AND -100 + 45 / 60.0::DOUBLE / cos(radians(40.0))"
_NEAR = f"""met AS (SELECT c.*, f.icao, f.callsign, f.first_seen, f.last_seen FROM call c JOIN flight f ON c.station = f.station AND coalesce(f.first_seen, f.last_seen - f.last_seen % 86400) - 600 <= c.t AND c.t <= f.last_seen + 600
  QUALIFY row_number() OVER (PARTITION BY c.segment_id, f.icao ORDER BY f.listed DESC) = 1),
near AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY least(abs(coalesce(first_seen, t) - t), abs(last_seen - t)), icao) AS rank FROM met QUALIFY rank <= {MOST_TRACKS}),
moves AS (SELECT *, {_NM.format('lat', 'lon', 'next_lat', 'next_lon')} * 1852 / nullif(next_t - t, 0) AS speed, (next_alt - alt) / nullif(next_t - t, 0) AS climb
 FROM (SELECT *, lead(t) OVER w AS next_t, lead(lat) OVER w AS next_lat, lead(lon) OVER w AS next_lon, lead(alt) OVER w AS next_alt FROM fix WHERE lat IS NOT NULL AND lon IS NOT NULL WINDOW w AS (PARTITION BY icao ORDER BY t, lat, lon, alt NULLS FIRST)))"""


def _tracked(select: str) -> str:
    return with_views("", "fix", "flight", "call").rstrip() + ",\n" + _NEAR + "\n" + select


def _near(spark: SparkSession, d: str) -> DataFrame:
    return sightings.active_flights(views.calls(spark, d), views.flights(spark, d), MOST_TRACKS)


def _station_box() -> dict:
    return box(F.lit(40.0), F.lit(-100.0), 45)


@query("active_flights_nearest", _tracked("SELECT segment_id, icao, callsign, rank FROM near"))
def active_flights_nearest(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).select("segment_id", "icao", "callsign", "rank")


@query(
    "track_interpolation",
    _tracked(f"""SELECT segment_id, icao, round(lat, 6) AS lat, round(lon, 6) AS lon, round(alt, 3) AS alt, round(speed, 4) AS speed, heading, round(climb, 6) AS climb, ground FROM (
 SELECT n.segment_id, n.icao, m.lat + (n.t - m.t) / (m.next_t - m.t) * (m.next_lat - m.lat) AS lat, m.lon + (n.t - m.t) / (m.next_t - m.t) * (m.next_lon - m.lon) AS lon,
  coalesce(m.alt + (n.t - m.t) / (m.next_t - m.t) * (m.next_alt - m.alt), m.alt) AS alt, m.speed, m.heading, m.climb, m.ground
 FROM near n JOIN moves m ON n.icao = m.icao AND m.t <= n.t AND n.t <= m.next_t AND m.next_t > m.t AND m.next_t - m.t <= 1800
 QUALIFY row_number() OVER (PARTITION BY n.segment_id, n.icao ORDER BY m.t, m.lat, m.lon) = 1) WHERE {_BOX.format('lat', 'lon')}"""),
)
def track_interpolation(spark: SparkSession, d: str) -> DataFrame:
    """Positions of the nearest flights at each transmission, between the two fixes around it."""
    found = sightings.positions(_near(spark, d).select("segment_id", "icao", "t"), views.fixes(spark, d), _station_box())
    return found.select("segment_id", "icao", *[F.round(c, n).alias(c) for c, n in (("lat", 6), ("lon", 6), ("alt", 3), ("speed", 4))], "heading", F.round("climb", 6).alias("climb"), "ground")


_WAY = f"""ways AS (SELECT n.segment_id, n.icao, m.t - n.t AS offset_s, m.lat, m.lon, m.alt, m.speed, m.climb FROM near n JOIN moves m ON n.icao = m.icao AND abs(m.t - n.t) <= 240 WHERE {_BOX.format('m.lat', 'm.lon')})"""


@query("track_waypoints", _tracked("").rstrip() + ",\n" + _WAY + "\nSELECT segment_id, icao, offset_s, lat, lon, alt, round(speed, 4) AS speed, round(climb, 6) AS climb FROM ways")
def track_waypoints(spark: SparkSession, d: str) -> DataFrame:
    found = sightings.waypoints(_near(spark, d).select("segment_id", "icao", "t"), views.fixes(spark, d), _station_box())
    return found.select("segment_id", "icao", "offset_s", "lat", "lon", "alt", F.round("speed", 4).alias("speed"), F.round("climb", 6).alias("climb"))


@query(
    "aircraft_order",
    _tracked("").rstrip() + ",\n" + _WAY + f""",
one AS (SELECT *, {_NM.format('lat', 'lon', '40.0', '-100.0')} AS far FROM ways QUALIFY row_number() OVER (PARTITION BY segment_id, icao ORDER BY abs(offset_s), offset_s, lat, lon) = 1)
SELECT segment_id, icao, offset_s, round(far, 4) AS distance_nm, row_number() OVER (PARTITION BY segment_id ORDER BY abs(offset_s), far, icao) AS place FROM one""",
)
def aircraft_order(spark: SparkSession, d: str) -> DataFrame:
    seen = sightings.waypoints(_near(spark, d).select("segment_id", "icao", "t"), views.fixes(spark, d), _station_box())
    return sightings.aircraft_order(seen, F.lit(40.0), F.lit(-100.0)).select("segment_id", "icao", "offset_s", F.round("distance_nm", 4).alias("distance_nm"), "place")


# Positions in areas

_INSIDE = "(e.y1 > {1}) <> (e.y2 > {1}) AND {0} < (e.x2 - e.x1) * ({1} - e.y1) / nullif(e.y2 - e.y1, 0) + e.x1"
_ALONG = "greatest(0.0, least(1.0, coalesce((({0} - e.x1) * (e.x2 - e.x1) + ({1} - e.y1) * (e.y2 - e.y1)) / nullif((e.x2 - e.x1) * (e.x2 - e.x1) + (e.y2 - e.y1) * (e.y2 - e.y1), 0), 0)))"
_FAR = f"sqrt(pow({{0}} - (e.x1 + {_ALONG} * (e.x2 - e.x1)), 2) + pow({{1}} - (e.y1 + {_ALONG} * (e.y2 - e.y1)), 2))"


@query(
    "points_in_areas",
    f"SELECT event_id, area_id, round(min({_FAR.format('p.x', 'p.y')}), 6) AS edge_distance FROM position p, edge e GROUP BY event_id, area_id HAVING count(*) FILTER ({_INSIDE.format('p.x', 'p.y')}) % 2 = 1",
    "area", "position",
)
def points_in_areas(spark: SparkSession, d: str) -> DataFrame:
    """Every position with each area that holds it, and how far it is from the area's edge."""
    own = views.areas(spark, d)
    found = areas.located(views.positions(spark, d), own, 2.0)
    rings = own.select("area_id", areas.edges(F.col("ring")).alias("es"))
    return found.join(rings, "area_id").select("event_id", "area_id", F.round(areas.edge_distance(F.col("x"), F.col("y"), F.col("es")), 6).alias("edge_distance"))


@query(
    "area_labels",
    f"""lab AS (SELECT area_id, 450 + (x1 - lon0) * 60 * cos(radians(lat0)) * 0.5 AS x1, 450 - (y1 - lat0) * 60 * 0.5 AS y1, 450 + (x2 - lon0) * 60 * cos(radians(lat0)) * 0.5 AS x2, 450 - (y2 - lat0) * 60 * 0.5 AS y2
 FROM (SELECT *, area_id * 14 - 170 + 4 AS lon0, area_id * 5 - 60 + 3 AS lat0 FROM edge)),
span AS (SELECT area_id, greatest(min(x1), 18) AS a0, least(max(x1), 882) AS a1, greatest(min(y1), 18) AS b0, least(max(y1), 882) AS b1 FROM lab GROUP BY area_id),
grid AS (SELECT area_id, i, j, a0 + (a1 - a0) * i / 20 AS x, b0 + (b1 - b0) * j / 20 AS y FROM span, range(21) g(i), range(21) h(j) WHERE a0 < a1 AND b0 < b1),
held AS (SELECT g.area_id, g.i, g.j, g.x, g.y, min({_FAR.format('g.x', 'g.y')}) AS room FROM grid g JOIN lab e ON g.area_id = e.area_id GROUP BY ALL HAVING count(*) FILTER ({_INSIDE.format('g.x', 'g.y')}) % 2 = 1)
SELECT area_id, round(x, 4) AS x, round(y, 4) AS y, round(room, 4) AS room FROM held WHERE room > 11 QUALIFY row_number() OVER (PARTITION BY area_id ORDER BY round(room, 9) DESC, i, j) = 1""",
    "area",
)
def area_labels(spark: SparkSession, d: str) -> DataFrame:
    """Where each area's label goes, in a frame of its own a little off its middle."""
    rows = views.areas(spark, d).withColumns({"lat0": F.col("area_id") * 5 - 60 + 3, "lon0": F.col("area_id") * 14 - 170 + 4})

    def shown(p):
        x, y = areas.projected(p["y"], p["x"], F.col("lat0"), F.col("lon0"), 900, 900, 900)
        return F.struct(x.alias("x"), y.alias("y"))

    framed = rows.select("area_id", F.transform("ring", shown).alias("ring")).withColumn("exclude", F.array().cast("array<array<struct<x:double,y:double>>>"))
    found = areas.label_points(framed, 900, 900)
    return found.select("area_id", *[F.round(c, 4).alias(c) for c in ("x", "y", "room")])


# Passages that families agree on, and how texts show them

_LOW = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in utterances.LOW_CONTENT) + "]"
_MARKS = "'\"''`“”‘’.,;:!?()[]{}<>'"
_VIEW = "list_filter(range(len({0})), lambda i: trim(lower({0}[i + 1]), " + _MARKS.replace("{", "{{").replace("}", "}}") + ") <> '')"
_PASSAGES = rf"""h AS MATERIALIZED (SELECT segment_id, model, family, text, norm, string_split(norm, ' ') AS tk, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM heard),
placed AS (SELECT segment_id, model, family, unnest(tk) AS t, unnest(range(1, len(tk) + 1)) AS i FROM h),
same AS (SELECT a.segment_id, a.model AS am, b.model AS bm, a.i - b.i AS diagonal, a.i, a.t FROM placed a JOIN placed b ON a.segment_id = b.segment_id AND a.family <> b.family AND a.model < b.model AND a.t = b.t),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY segment_id, am, bm, diagonal ORDER BY i) AS island FROM same),
runs AS (SELECT DISTINCT segment_id, string_agg(t, ' ' ORDER BY i) AS run, count(*) AS n FROM islands GROUP BY segment_id, am, bm, diagonal, island HAVING count(*) >= 3),
held AS MATERIALIZED (SELECT segment_id, run, n, model, family, length(before) - length(replace(before, ' ', '')) AS place, len(tk) AS of_tokens, ws, wi FROM (
  SELECT r.*, h.model, h.family, h.tk, h.ws, {_VIEW.format('h.ws')} AS wi, left(' ' || h.norm || ' ', instr(' ' || h.norm || ' ', ' ' || r.run || ' ') - 1) AS before FROM runs r JOIN h ON r.segment_id = h.segment_id AND contains(' ' || h.norm || ' ', ' ' || r.run || ' '))),
sup AS MATERIALIZED (SELECT segment_id, run, any_value(n) AS n, list_sort(list_distinct(list(family))) AS families, list_sort(list(model)) AS models, arg_min(struct_pack(place := place, of_tokens := of_tokens, ws := ws, wi := wi), model) AS anchor,
  string_agg(model || ':' || wi[place + 1] || '-' || (wi[place + n] + 1), ' ' ORDER BY model) AS spans,
  list(CASE model WHEN 'parakeet-a' THEN wi[place + 1] * 300 WHEN 'canary-b' THEN wi[place + 1] * 300 + 20 END) AS starts, list(CASE model WHEN 'parakeet-a' THEN wi[place + n] * 300 + 250 WHEN 'canary-b' THEN wi[place + n] * 300 + 270 END) AS stops,
  string_agg(CASE WHEN model IN ('parakeet-a', 'canary-b') THEN model END, ' ' ORDER BY model DESC) AS timed_by
 FROM held WHERE len(list_filter(string_split(run, ' '), lambda t: NOT list_contains({_LOW}, replace(t, '''', '')))) >= 2 GROUP BY segment_id, run HAVING count(DISTINCT family) >= 2),
kept AS (SELECT s.* FROM sup s WHERE NOT EXISTS (SELECT 1 FROM sup o WHERE o.segment_id = s.segment_id AND o.n > s.n AND contains(' ' || o.run || ' ', ' ' || s.run || ' ') AND list_has_all(o.families, s.families))),
most AS (SELECT segment_id, max(len(tk)) AS longest FROM h GROUP BY segment_id),
told AS (SELECT k.*, row_number() OVER (PARTITION BY k.segment_id ORDER BY len(families) DESC, n DESC, string_split(run, ' ')) - 1 AS ordinal, m.longest, tl.duration_ms FROM kept k JOIN most m ON k.segment_id = m.segment_id JOIN (SELECT segment_id, len(w) * 300 AS duration_ms FROM tl) tl ON tl.segment_id = k.segment_id)"""


def _passages(select: str) -> str:
    return with_views("", "hyp").rstrip() + ",\n" + _PASSAGES + "\n" + select


@query(
    "utterance_agreement",
    _passages("""SELECT segment_id, CAST(ordinal AS INTEGER) AS ordinal, run, array_to_string(anchor.ws[anchor.wi[anchor.place + 1] + 1 : anchor.wi[anchor.place + n] + 1], ' ') AS text, len(families) AS n_families, array_to_string(models, ' ') AS models, spans,
 CASE WHEN timed_by IS NULL THEN CAST(floor(duration_ms * anchor.place / anchor.of_tokens) AS INTEGER) ELSE CAST(floor(list_median(list_filter(starts, lambda x: x IS NOT NULL))) AS INTEGER) END AS start_ms,
 CASE WHEN timed_by IS NULL THEN CAST(floor(duration_ms * (anchor.place + n) / anchor.of_tokens) AS INTEGER) ELSE CAST(floor(list_median(list_filter(stops, lambda x: x IS NOT NULL))) AS INTEGER) END AS end_ms,
 timed_by IS NULL AS bounds_estimated, coalesce(timed_by, '') AS timed_by, CASE WHEN anchor.place = 0 THEN 'leading' WHEN anchor.place + n = anchor.of_tokens THEN 'trailing' ELSE 'middle' END AS position, round(n / longest::DOUBLE, 3) AS coverage FROM told"""),
)
def utterance_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Every passage of every transmission, with its bounds by the word times of the families that can be trusted most."""
    found = utterances.utterances(views.timed_hypotheses(spark, d))
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["model"], F.lit(":"), s["from_word"], F.lit("-"), s["to_word"])), " ")
    return found.select(
        "segment_id", "ordinal", F.array_join("tokens", " ").alias("run"), "text", "n_families", F.array_join("models", " ").alias("models"), spans.alias("spans"), "start_ms", "end_ms", "bounds_estimated",
        F.array_join("timed_by", " ").alias("timed_by"), "position", "coverage",
    )


@query(
    "text_highlights",
    _passages("""SELECT segment_id, model, string_agg(stretch, ' ' ORDER BY first_word) AS shown FROM (
 SELECT segment_id, model, min(k) AS first_word, CASE WHEN any_value(u) IS NULL THEN string_agg(word, ' ' ORDER BY k) ELSE '[' || any_value(u) || '/' || any_value(f) || ' ' || string_agg(word, ' ' ORDER BY k) || ']' END AS stretch FROM (
  SELECT *, k - row_number() OVER (PARTITION BY segment_id, model, u ORDER BY k) AS island FROM (
   SELECT w.segment_id, w.model, w.k, any_value(w.word) AS word, (max(struct_pack(f := s.f, u := s.u)) FILTER (s.u IS NOT NULL)).u AS u, (max(struct_pack(f := s.f, u := s.u)) FILTER (s.u IS NOT NULL)).f AS f
   FROM (SELECT segment_id, model, unnest(ws) AS word, unnest(range(len(ws))) AS k FROM h) w
   LEFT JOIN (SELECT t.segment_id, h2.model, t.ordinal AS u, len(t.families) AS f, h2.wi[h2.place + 1] AS a, h2.wi[h2.place + t.n] AS b FROM told t JOIN held h2 ON h2.segment_id = t.segment_id AND h2.run = t.run) s
    ON s.segment_id = w.segment_id AND s.model = w.model AND w.k BETWEEN s.a AND s.b GROUP BY w.segment_id, w.model, w.k)) GROUP BY segment_id, model, u, island) GROUP BY segment_id, model"""),
)
def text_highlights(spark: SparkSession, d: str) -> DataFrame:
    """Each heard text with its stretches marked as [passage/families words]."""
    # The outer form, as for utterances.
    heard = utterances.passages(views.gathered_hypotheses(spark, d)).select("segment_id", F.explode_outer("said").alias("h"), "passages").filter("h is not null")
    marked = heard.select("segment_id", "h.model", utterances.shown(F.col("h.text"), utterances.highlights(F.col("h.text"), F.col("passages"))).alias("s"))
    part = lambda x: F.when(x["mark"].isNull(), x["words"]).otherwise(F.concat(F.lit("["), x["mark"]["utterance"], F.lit("/"), x["mark"]["n_families"], F.lit(" "), x["words"], F.lit("]")))
    return marked.select("segment_id", "model", F.array_join(F.transform("s", part), " ").alias("shown"))


# Versions of annotations

_SAVES = """judged AS (SELECT *, CASE WHEN benchmark AND label IN ('gold', 'silver', 'candidate') THEN 'benchmark' WHEN label = 'gold' AND NOT confirm_gold THEN 'gold_not_confirmed' WHEN label = 'gold' AND trim(text) = '' THEN 'gold_without_text'
  WHEN label = 'gold' AND status = 'unreviewed' THEN 'gold_not_reviewed' WHEN scope = 'span' AND end_ms > duration_ms + 50 THEN 'span_after_end' END AS refusal, row_number() OVER (PARTITION BY thread_id ORDER BY at_us, event_id) AS n FROM save_log),
versions AS (SELECT thread_id, CAST(0 AS BIGINT) AS n, 0 AS version, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS outcome FROM (SELECT DISTINCT thread_id FROM save_log)
 UNION ALL SELECT v.thread_id, j.n, v.version + CASE WHEN j.refusal IS NULL AND j.expected_version = v.version THEN 1 ELSE 0 END, j.event_id, coalesce(j.refusal, CASE WHEN j.expected_version = v.version THEN 'saved' ELSE 'conflict' END)
 FROM versions v JOIN judged j ON j.thread_id = v.thread_id AND j.n = v.n + 1)"""


def _saved(select: str) -> str:
    return with_views("", "save_log").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + _SAVES + "\n" + select


def _saves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    log = views.save_log(spark, d)
    return log, annotations.saves(log.withColumn("refusal", annotations.refusal(F.col("benchmark"))))


@query("annotation_saves", _saved("SELECT thread_id, event_id, outcome, version FROM versions WHERE n > 0"))
def annotation_saves(spark: SparkSession, d: str) -> DataFrame:
    """What became of every save: refused, in conflict with another, or the next version."""
    return _saves(spark, d)[1]


@query("annotation_current", _saved("SELECT v.thread_id, v.version, v.event_id, l.label, l.text FROM versions v JOIN save_log l ON l.event_id = v.event_id WHERE outcome = 'saved' QUALIFY v.version = max(v.version) OVER (PARTITION BY v.thread_id)"))
def annotation_current(spark: SparkSession, d: str) -> DataFrame:
    log, done = _saves(spark, d)
    return annotations.current(log, done).select("thread_id", "version", "event_id", "label", "text")


# Sweeps and data sets

_SELECTION = sweeps.Selection(3, utc_from="1994-01-01 00:00:00", channels=("TWR", "APP", "GND"), min_duration_ms=2000, untranscribed_only=True)
_SWEPT = """asked AS (SELECT model_id FROM model WHERE model_id % 10 = 1),
chosen AS (SELECT * FROM segment WHERE source_id = 3 AND presence_status = 'present' AND capture_start >= TIMESTAMP '1994-01-01' AND channel IN ('TWR', 'APP', 'GND') AND duration_ms >= 2000
 AND segment_id NOT IN (SELECT segment_id FROM result WHERE model_id IN (SELECT model_id FROM asked) GROUP BY segment_id HAVING count(DISTINCT model_id) >= (SELECT count(*) FROM asked)))"""


def _swept(select: str) -> str:
    return with_views("", "segment", "result", "model").rstrip() + ",\n" + _SWEPT + "\n" + select


def _asked_models(spark: SparkSession, d: str) -> DataFrame:
    return views.models(spark, d).filter("model_id % 10 = 1").selectExpr("model_id", "family", "ensemble_eligible as sweep_eligible")


def _chosen(spark: SparkSession, d: str, selection: sweeps.Selection) -> DataFrame:
    names = [r.model_id for r in _asked_models(spark, d).select("model_id").collect()]  # models that a user names
    return sweeps.selected(views.segments(spark, d), views.results(spark, d), selection, names)


@query(
    "sweep_preview",
    _swept("""SELECT m.model_id, m.family, m.ensemble_eligible AS sweep_eligible, count(*) OVER (PARTITION BY m.family) > 1 AS shared_family, (SELECT count(*) FROM chosen) AS segments, round_even((SELECT coalesce(sum(duration_ms), 0) FROM chosen) / 60000, 1) AS audio_minutes,
 round_even(r.rtf, 4) AS observed_rtf, round_even((SELECT coalesce(sum(duration_ms), 0) FROM chosen) / 60000 * r.rtf + 1, 1) AS estimated_minutes
 FROM model m LEFT JOIN (SELECT model_id, CAST(sum(inference_ms) AS DOUBLE) / sum(audio_ms) AS rtf FROM result WHERE audio_ms > 0 GROUP BY model_id) r ON r.model_id = m.model_id WHERE m.model_id IN (SELECT model_id FROM asked)"""),
)
def sweep_preview(spark: SparkSession, d: str) -> DataFrame:
    return sweeps.preview(_chosen(spark, d, _SELECTION), _asked_models(spark, d), views.results(spark, d))


@query(
    "sweep_freeze",
    _swept("""SELECT segment_id, row_number() OVER (ORDER BY capture_start NULLS LAST, relative_path, segment_id) - 1 AS ordinal FROM segment
 WHERE segment_id IN (SELECT segment_id FROM chosen) OR segment_id % 11 = 0 OR segment_id IN (SELECT segment_id FROM segment WHERE source_id = 5 AND presence_status = 'present' ORDER BY md5(concat('7:', segment_id)), segment_id LIMIT 300)"""),
)
def sweep_freeze(spark: SparkSession, d: str) -> DataFrame:
    """A selection, a sample of another source and explicit ids, each segment once, in the sweep's order."""
    sample = _chosen(spark, d, sweeps.Selection(5, limit=300, seed=7))
    return sweeps.frozen(_chosen(spark, d, _SELECTION), sample, views.segments(spark, d).filter("segment_id % 11 = 0"))


_FROZEN = """fit AS (SELECT * FROM annotated WHERE role = 'corpus' AND label IN ('gold', 'silver') AND trim(text) <> ''),
kept AS (SELECT * FROM fit WHERE scope = 'segment' OR segment_id NOT IN (SELECT segment_id FROM fit WHERE scope = 'segment')),
grouped AS (SELECT *, CASE WHEN capture_start IS NULL THEN concat('dir:', source_id, ':', relative_dir) ELSE concat(source_id, ':', strftime(capture_start, '%Y-%m-%d'), ':', coalesce(channel, '-')) END AS split_group FROM kept),
items AS (SELECT *, row_number() OVER (ORDER BY capture_start NULLS LAST, segment_id, scope, start_ms NULLS FIRST, version_id) - 1 AS ordinal,
 CASE WHEN CAST(concat('0x', substr(sha256(concat('s1:', split_group)), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE < 0.8 THEN 'train' WHEN CAST(concat('0x', substr(sha256(concat('s1:', split_group)), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE < 0.9 THEN 'validation' ELSE 'test' END AS split FROM grouped),
leaf AS (SELECT ordinal AS k, sha256('{"end_ms":' || coalesce(CAST(end_ms AS VARCHAR), 'null') || ',"label":"' || label || '","ordinal":' || ordinal || ',"scope":"' || scope || '","segment_id":' || segment_id || ',"sha256":"' || sha256 || '","split":"' || split
 || '","start_ms":' || coalesce(CAST(start_ms AS VARCHAR), 'null') || ',"text":"' || trim(text) || '","text_origin":' || coalesce('"' || text_origin || '"', 'null') || ',"version_id":' || version_id || '}') AS digest FROM items),
level1 AS (SELECT k // 1024 AS k, sha256(string_agg(digest, '' ORDER BY k)) AS digest FROM leaf GROUP BY 1), level2 AS (SELECT k // 1024 AS k, sha256(string_agg(digest, '' ORDER BY k)) AS digest FROM level1 GROUP BY 1)"""
_MANIFEST = ("ordinal", "version_id", "segment_id", "scope", "start_ms", "end_ms", "text", "label", "text_origin", "sha256", "split")


def _set(spark: SparkSession, d: str) -> DataFrame:
    return datasets.frozen(views.annotated_segments(spark, d), ["gold", "silver"], ["segment", "span"], "utc_day_channel", "s1", {"train": 0.8, "validation": 0.1, "test": 0.1})


@query("dataset_freeze", with_views("", "segment", "result", "annotated").rstrip() + ",\n" + _FROZEN + "\nSELECT ordinal, version_id, split, split_group, CASE WHEN scope = 'span' THEN end_ms - start_ms ELSE duration_ms END AS duration_ms FROM items")
def dataset_freeze(spark: SparkSession, d: str) -> DataFrame:
    return _set(spark, d).select("ordinal", "version_id", "split", "split_group", "duration_ms")


@query("dataset_manifest", with_views("", "segment", "result", "annotated").rstrip() + ",\n" + _FROZEN + "\nSELECT (SELECT count(*) FROM items) AS n_items, CASE WHEN (SELECT count(*) FROM level1) = 1 THEN (SELECT any_value(digest) FROM level1) ELSE (SELECT any_value(digest) FROM level2) END AS manifest")
def dataset_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The set's items and the hash of all of them in order: a tree of hashes, so that no task sees them all."""
    items = _set(spark, d)
    return spark.createDataFrame([(items.count(), datasets.manifest_hash(items, _MANIFEST))], "n_items long, manifest string")


# Answers of review models

_TEXT = "regexp_replace(substr({t}, 1, 60), '[^A-Za-z ]', ' '{g})"
_BODY = (
    "concat('{{\"speech_present\": ', CASE WHEN doc_id % 3 = 0 THEN 'false' ELSE 'true' END, ', \"transcript\": \"', {text}, '\", \"confidence\": ', CASE doc_id % 6 WHEN 0 THEN '1.7' WHEN 1 THEN '\"0.4\"' WHEN 2 THEN 'null' WHEN 3 THEN '-3' ELSE '0.25' END,"
    " ', \"uncertain_words\": [\"a\", \"b\", null], \"callsigns\": [\" ab1 \", \"cd2\"], \"closest_hypothesis\": ', CASE WHEN doc_id % 4 = 0 THEN 'null' ELSE '\"H1\"' END, ', \"notes\": \"', lang, '\"}}')"
)
_ANSWER = "CASE WHEN doc_id % 17 = 0 THEN replace({b}, '\"notes\"', '\"note\"') WHEN doc_id % 13 = 0 THEN '[1, 2]' WHEN doc_id % 11 = 0 THEN substr({b}, 1, length({b}) - 1) WHEN doc_id % 7 = 0 THEN concat('```json ', {b}, ' ```') ELSE concat('  ', {b}) END"


def _answer_text(t: str, g: str) -> str:
    return _ANSWER.replace("{b}", _BODY.format(text=_TEXT.format(t=t, g=g)))


@query(
    "parse_answers",
    f"""WITH a AS (SELECT doc_id, CASE WHEN c LIKE '```%' THEN regexp_extract(trim(c, '`'), '\\{{.*', 0, 's') ELSE trim(c) END AS j FROM (SELECT doc_id, {_answer_text("coalesce(text, '')", ", 'g'")} AS c FROM documents WHERE lang IS NOT NULL)),
r AS (SELECT doc_id, CASE WHEN NOT json_valid(j) THEN 'not_json' WHEN json_type(j) <> 'OBJECT' THEN 'not_object' WHEN NOT json_exists(j, '$.notes') THEN 'missing_fields' WHEN json_extract_string(j, '$.confidence') IS NULL THEN 'confidence_not_number' END AS refusal,
 CASE WHEN json_valid(j) THEN j END AS j FROM a),
t AS (SELECT *, trim(regexp_replace(json_extract_string(j, '$.transcript'), '\\s+', ' ', 'g')) AS transcript FROM r)
SELECT doc_id, refusal, CASE WHEN refusal IS NULL THEN json_extract_string(j, '$.speech_present') = 'true' AND transcript <> '' END AS speech_present, CASE WHEN refusal IS NULL THEN transcript END AS transcript,
 CASE WHEN refusal IS NULL THEN least(greatest(CAST(json_extract_string(j, '$.confidence') AS DOUBLE), 0), 1) END AS confidence, CASE WHEN refusal IS NULL THEN 'a,b' END AS words, CASE WHEN refusal IS NULL THEN 'AB1,CD2' END AS callsigns,
 CASE WHEN refusal IS NULL THEN coalesce(json_extract_string(j, '$.closest_hypothesis'), '') END AS closest_hypothesis, CASE WHEN refusal IS NULL THEN json_extract_string(j, '$.notes') END AS notes FROM t""",
)
def parse_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers made from documents: fenced, cut off, lists, without a field, with odd confidences."""
    from squelch.functions.replies import parsed

    answers_ = views.table(spark, d, "documents").filter("lang is not null").selectExpr("doc_id", _answer_text("coalesce(text, '')", "") + " as content")
    found = answers_.select("doc_id", parsed(F.col("content")).alias("p")).select("doc_id", "p.*")
    return found.select(
        "doc_id", "refusal", "speech_present", "transcript", "confidence", F.array_join("uncertain_words", ",").alias("words"), F.array_join("callsigns", ",").alias("callsigns"), "closest_hypothesis", "notes"
    )


# Upkeep


@query(
    "stale_segments",
    """SELECT r.segment_id FROM (SELECT segment_id, max(created_at) AS last FROM result GROUP BY segment_id) r LEFT JOIN segment s ON s.segment_id = r.segment_id AND s.segment_id % 9 <> 0
 WHERE s.segment_id IS NULL OR s.segment_id % 5 = 0 OR s.segment_id % 7 = 0 OR s.capture_start IS NULL OR s.capture_start + INTERVAL 60 DAY < r.last""",
    "result", "segment",
)
def stale_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments whose agreement is missing, of another version or threshold, or older than their newest result."""
    from squelch.streaming.incremental import stale_segments as stale

    known = views.segments(spark, d).filter("segment_id % 9 <> 0").selectExpr("segment_id", "if(segment_id % 5 = 0, 1, 2) as version", "if(segment_id % 7 = 0, 0.7d, 0.8d) as threshold", "capture_start + interval 60 days as computed_at")
    return stale(views.results(spark, d), known, 2, 0.8)


@query("windowed_counts", "SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    from squelch.streaming.incremental import windowed_counts as counted

    events = views.table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return counted(events, "at", "event_type").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
