"""Queries over what surrounds a segment: airports, decisions on it, neighbours and briefs, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squelch.operators import airports, briefs, decisions, relational, sightings
from squelch.plans.speech import _LCS
from squelch.sources import views
from squelch.sources.views import with_views

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None, *views_: str):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_views(sql, *views_) if views_ else sql
        return f

    return register


# Airports

_TITLE = "array_to_string(list_transform(regexp_extract_all(lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'))), '[a-z]+|[^a-z]+'), lambda w: concat(upper(w[1]), w[2:])), '')"
_WORDS = "array_to_string(list_transform(list_filter(string_split({0}, ''), lambda c: c BETWEEN '0' AND '9'), lambda c: ['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', '{1}'][CAST(c AS INTEGER) + 1]), ' ')"
_SIDE = "CASE right({0}, 1) WHEN 'L' THEN ' left' WHEN 'R' THEN ' right' WHEN 'C' THEN ' center' ELSE '' END"
_RUNWAY_SAID = f"concat_ws('|', 'runway ' || {_WORDS.format('{0}', 'niner')} || {_SIDE}, CASE WHEN contains({{0}}, '9') THEN 'runway ' || {_WORDS.format('{0}', 'nine')} || {_SIDE} END)"
_SERVICE = "CASE " + " ".join(f"WHEN upper(u) LIKE '{p}%' THEN {{{k}}}" for k, (p, _, _) in enumerate(airports.SERVICES)) + " WHEN upper(u) LIKE '% STAR' OR upper(u) LIKE '% DP' THEN {9} ELSE {10} END"
_NAMES = _SERVICE.format(*[f"'{s}'" for _, s, _ in airports.SERVICES], "'PROC'", "'OTHER'")
_SUFFIXES = _SERVICE.format(*[f"'{x}'" for _, _, x in airports.SERVICES], "'Approach'", "''")
_FRACTION = "CASE WHEN rtrim(split_part(f, '.', 2), '0') = '' THEN '0' ELSE rtrim(split_part(f, '.', 2), '0') END"
_AIRPORT = f"""named AS (SELECT *, coalesce(nullif(icao_id, ''), 'K' || faa) AS icao, {_TITLE.format("coalesce(arpt_name, faa)")} AS name, {_TITLE.format("coalesce(nullif(city, ''), faa)")} AS tower FROM base),
voice AS (SELECT q.*, n.tower, CAST(round_even(CAST(f AS DOUBLE) * 1000000, 0) AS BIGINT) AS hz, CAST(round_even(CAST(f AS DOUBLE) * 1000, 0) AS BIGINT) AS khz, {_NAMES} AS service, {_SUFFIXES} AS suffix, concat_ws(' ', u, sector) AS sect
 FROM freq q JOIN named n ON n.faa = q.faa WHERE CAST(f AS DOUBLE) >= 108 AND CAST(f AS DOUBLE) < 137 AND u NOT LIKE 'APT REMARK%'),
settled AS (SELECT *, min(line) OVER k AS first_line, CASE WHEN suffix <> '' AND service <> 'EMERG' THEN trim(CASE WHEN service IN ('APP', 'DEP', 'CLASS_B', 'PROC') THEN approach_call ELSE coalesce(tower_call, tower) END || ' ' || suffix) END AS call
 FROM voice WINDOW k AS (PARTITION BY faa, service, khz, sect) QUALIFY row_number() OVER (PARTITION BY faa, service, khz, sect ORDER BY line DESC) = 1),
spoken AS (SELECT *, concat_ws('|', {_WORDS.format("split_part(f, '.', 1)", 'niner')} || ' point ' || {_WORDS.format(_FRACTION, 'niner')}, CASE WHEN contains(split_part(f, '.', 1), '9') OR contains(split_part(f, '.', 2), '9') THEN {_WORDS.format("split_part(f, '.', 1)", 'nine')} || ' point ' || {_WORDS.format(_FRACTION, 'nine')} END,
 {_WORDS.format("split_part(f, '.', 1)", 'niner')} || ' decimal ' || {_WORDS.format(_FRACTION, 'niner')}) AS said FROM settled),
fs AS (SELECT faa, string_agg(concat_ws(':', service, hz, coalesce(facility, '-'), coalesce(call, '-'), sect, said), ';' ORDER BY service, hz, first_line) AS frequencies,
 list(call ORDER BY service, hz, first_line) FILTER (call IS NOT NULL AND service IN ('TWR', 'GND', 'CD', 'APP', 'DEP')) AS calls FROM spoken GROUP BY faa),
strip AS (SELECT faa, pair, arg_max(CAST(floor(o_totalprice) AS BIGINT), o_orderkey) AS len, arg_max(CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE '150' END, o_orderkey) AS width FROM way WHERE o_orderkey % 17 <> 0 GROUP BY ALL),
rs AS (SELECT t.faa, string_agg(concat_ws(':', t.pair, e, coalesce(CAST(len AS VARCHAR), '-'), coalesce(width, '-'), one * 10, {_RUNWAY_SAID.format('e')}, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(one AS VARCHAR) ELSE '-' END), ';' ORDER BY t.pair, e, o_orderkey) AS runways
 FROM tip t LEFT JOIN strip s ON s.faa = t.faa AND s.pair = t.pair GROUP BY t.faa)"""


@query(
    "airport_profiles",
    _AIRPORT + f""" SELECT icao, n.faa AS faa_id, CASE WHEN regexp_full_match(n.faa, '[A-Z]{{3}}') THEN n.faa END AS iata, name, CASE WHEN city <> '' THEN {_TITLE.format('city')} END AS city, lat AS latitude, lon AS longitude, variation AS magnetic_variation,
 CASE WHEN line % 6 <> 0 THEN 'America/New_York' END AS timezone, coalesce(runways, '') AS runways, coalesce(frequencies, '') AS frequencies
 FROM named n LEFT JOIN fs ON fs.faa = n.faa LEFT JOIN rs ON rs.faa = n.faa""",
    "airport_files",
)
def airport_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Every airport's profile, its runway ends and frequencies written out in order."""
    dash = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    end = lambda e: F.concat_ws(":", e["pair"], e["end_ident"], dash(e["length_ft"]), dash(e["width_ft"]), e["true_alignment"].cast("long"), F.array_join(e["spoken"], "|"), dash(e["latitude"].cast("long")))
    said = lambda f: F.concat_ws(":", f["service"], f["frequency_hz"], dash(f["facility"]), dash(f["call"]), f["sectorization"], F.array_join(f["spoken"], "|"))
    kept = ["icao", "faa_id", "iata", "name", "city", "latitude", "longitude", "magnetic_variation", "timezone"]
    return _profiles(spark, d).select(*kept, F.array_join(F.transform("runways", end), ";").alias("runways"), F.array_join(F.transform("frequencies", said), ";").alias("frequencies"))


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    return airports.profiles(**views.airport_files(spark, d))


@query(
    "airport_aliases",
    _AIRPORT + """, al AS (SELECT n.faa, unnest(a) AS a, generate_subscripts(a, 1) AS i FROM (SELECT n.faa, list_concat([icao || '/icao', n.faa || '/faa'],
  CASE WHEN line % 2 = 0 AND line % 6 <> 0 THEN ['S1/station', n.faa || '/station'] ELSE [n.faa || '/station'] END, [name || '/name', tower || '/spoken'], list_transform(coalesce(calls, []), lambda c: c || '/spoken')) AS a FROM named n LEFT JOIN fs ON fs.faa = n.faa) n)
SELECT faa AS faa_id, a AS alias, row_number() OVER (PARTITION BY faa ORDER BY min(i)) - 1 AS place FROM al GROUP BY faa, a""",
    "airport_files",
)
def airport_aliases(spark: SparkSession, d: str) -> DataFrame:
    """What every airport is called, each name of a kind once, in order."""
    return _profiles(spark, d).select("faa_id", F.posexplode("aliases").alias("place", "a")).select("faa_id", F.concat("a.alias", F.lit("/"), "a.kind").alias("alias"), F.col("place").cast("long").alias("place"))


_SHOWN = "list_position([" + ", ".join(f"'{s}'" for s in airports.SHOWN_ORDER) + "], service)"


@query("airport_shown_frequencies", _AIRPORT + f" SELECT faa AS faa_id, string_agg(concat(service, ' ', hz), ', ' ORDER BY {_SHOWN}, hz, first_line) AS shown FROM settled GROUP BY faa", "airport_files")
def airport_shown_frequencies(spark: SparkSession, d: str) -> DataFrame:
    rows = _profiles(spark, d).filter(F.size("frequencies") > 0)
    return rows.select("faa_id", F.array_join(F.transform(airports.shown_frequencies(F.col("frequencies")), lambda f: F.concat(f["service"], F.lit(" "), f["frequency_hz"])), ", ").alias("shown"))


@query("airport_drawn_runways", "SELECT t.faa AS faa_id, t.pair, string_agg(e, ' ' ORDER BY e, o_orderkey) AS ends FROM tip t JOIN base b ON b.faa = t.faa WHERE o_orderkey % 9 <> 0 GROUP BY ALL HAVING count(*) = 2", "airport_files")
def airport_drawn_runways(spark: SparkSession, d: str) -> DataFrame:
    rows = _profiles(spark, d).select("faa_id", F.explode(airports.drawn_runways(F.col("runways"))).alias("x"))
    return rows.select("faa_id", "x.pair", F.array_join(F.transform("x.ends", lambda e: e["end_ident"]), " ").alias("ends"))


# Decisions

@query(
    "accept_decisions",
    """SELECT item_id, i.segment_id, CASE WHEN status <> 'done' THEN 'not_done_' || status WHEN taken THEN 'already_accepted' WHEN NOT says OR NOT speech THEN 'no_speech' WHEN tenths < 3 THEN 'below_min_confidence' WHEN alike < 8 THEN 'no_model_support'
 WHEN s.role = 'benchmark' THEN 'benchmark_source' WHEN l.label = 'gold' THEN 'human_gold_unchanged' WHEN l.label = 'rejected' THEN 'rejected_by_human' WHEN l.text <> '' AND l.text_origin = 'human' THEN 'human_text_unchanged' ELSE 'accepted' END AS decision
 FROM paid_item i LEFT JOIN segment s ON s.segment_id = i.segment_id LEFT JOIN labelled l ON l.segment_id = i.segment_id""",
    "paid_item", "segment", "labelled",
)
def accept_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Every answered item: accepted as silver, or the first of nine reasons against it."""
    return decisions.accepted(views.paid_items(spark, d), views.segments(spark, d), views.labelled(spark, d), 0.3, True)


def _nominated_sql(reasons: str, text: str, origin: str) -> str:
    decided = f"""asked AS (SELECT o_orderkey AS segment_id FROM orders WHERE o_orderkey % 3 <> 1 UNION SELECT o_orderkey + 1000000000000 FROM orders WHERE o_orderkey % 40 = 0),
decided AS (SELECT a.segment_id, CASE WHEN s.segment_id IS NULL THEN 'unknown_segment' WHEN s.role = 'benchmark' THEN 'benchmark_source' WHEN l.label = 'gold' THEN 'human_gold_unchanged' {reasons} ELSE 'applied' END AS decision, {text} AS text, {origin} AS text_origin
 FROM asked a LEFT JOIN segment s ON s.segment_id = a.segment_id LEFT JOIN labelled l ON l.segment_id = a.segment_id LEFT JOIN agreed_on g ON g.segment_id = a.segment_id)"""
    return decided + " SELECT segment_id, decision, CASE WHEN decision = 'applied' THEN text END AS text, CASE WHEN decision = 'applied' THEN text_origin END AS text_origin FROM decided"


_HUMAN = "coalesce(l.text <> '' AND l.text_origin = 'human', false)"
_TEXT = f"CASE WHEN {_HUMAN} THEN l.text ELSE g.representative END"
_ORIGIN = f"CASE WHEN {_HUMAN} THEN 'human' WHEN g.representative IS NOT NULL THEN 'model_consensus' END"
_NONE = f"WHEN l.label = 'rejected' THEN 'rejected_by_human' WHEN NOT {_HUMAN} AND g.representative IS NULL THEN 'no_consensus_text'"
for _action, _reasons, _text, _origin in (
    ("candidate", f"{_NONE} WHEN l.label = 'candidate' THEN 'already_candidate'", _TEXT, _ORIGIN),
    ("silver", f"{_NONE} WHEN NOT {_HUMAN} AND g.kind NOT IN ('exact', 'near') THEN 'insufficient_agreement' WHEN l.label = 'silver' THEN 'already_silver'", _TEXT, _ORIGIN),
    ("clear", "WHEN coalesce(l.label, 'none') NOT IN ('candidate', 'silver') THEN 'not_nominated'", "l.text", "l.text_origin"),
):

    @query(f"nominate_{_action}", _nominated_sql(_reasons, _text, _origin), "segment", "labelled", "agreed_on")
    def nominate(spark: SparkSession, d: str, action: str = _action) -> DataFrame:
        """Segments asked for by id, some of them twice or unknown."""
        known = views.segments(spark, d).select("segment_id")
        ids = known.filter("segment_id % 3 <> 1").union(known.filter("segment_id % 6 = 0")).union(known.filter("segment_id % 40 = 0").selectExpr("segment_id + 1000000000000"))
        return decisions.nominated(ids, views.segments(spark, d), views.labelled(spark, d), views.consensus(spark, d), action)


# Neighbours and briefs

_AROUND = """told AS (SELECT s.segment_id, s.source_id, s.channel, s.relative_path, epoch_us(s.capture_start) AS t, g.representative AS preview FROM segment s LEFT JOIN agreed_on g ON g.segment_id = s.segment_id),
timed AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY t, segment_id) AS pos FROM told WHERE t IS NOT NULL),
prv AS (SELECT a.segment_id, arg_max(b.segment_id, (b.t, b.segment_id)) AS other FROM timed a JOIN timed b ON a.source_id = b.source_id AND a.channel IS NOT DISTINCT FROM b.channel AND b.t < a.t GROUP BY a.segment_id),
nxt AS (SELECT a.segment_id, arg_min(b.segment_id, (b.t, b.segment_id)) AS other FROM timed a JOIN timed b ON a.source_id = b.source_id AND a.channel IS NOT DISTINCT FROM b.channel AND b.t > a.t GROUP BY a.segment_id),
near AS (SELECT a.segment_id, b.segment_id AS other, row_number() OVER (PARTITION BY a.segment_id ORDER BY abs(b.t - a.t), abs(b.pos - a.pos), b.pos) AS place FROM timed a JOIN timed b ON a.source_id = b.source_id AND b.t BETWEEN a.t - 60000000 AND a.t + 60000000 AND a.segment_id <> b.segment_id
 WHERE NOT EXISTS (SELECT 1 FROM prv p WHERE p.segment_id = a.segment_id AND p.other = b.segment_id) AND NOT EXISTS (SELECT 1 FROM nxt p WHERE p.segment_id = a.segment_id AND p.other = b.segment_id) QUALIFY place <= 6),
path AS (SELECT segment_id, t, lag(segment_id) OVER w AS p, lead(segment_id) OVER w AS n FROM told WINDOW w AS (PARTITION BY source_id, channel ORDER BY relative_path)),
around AS (SELECT segment_id, other, 'previous' AS relation, 0 AS place FROM prv UNION ALL SELECT segment_id, other, 'next', 1 FROM nxt UNION ALL SELECT segment_id, other, 'nearby', place + 1 FROM near
 UNION ALL SELECT segment_id, p, 'previous', 0 FROM path WHERE t IS NULL AND p IS NOT NULL UNION ALL SELECT segment_id, n, 'next', 1 FROM path WHERE t IS NULL AND n IS NOT NULL),
seen AS (SELECT r.*, o.preview, round_even((o.t - a.t) / 1000000, 1) AS offset_s FROM around r JOIN told a ON a.segment_id = r.segment_id JOIN told o ON o.segment_id = r.other)"""


def _around(spark: SparkSession, d: str) -> DataFrame:
    previews = views.consensus(spark, d).selectExpr("segment_id", "representative as preview")
    return briefs.neighbourhood(views.segments(spark, d).join(previews, "segment_id", "left"))


@query("neighbourhood", _AROUND + " SELECT segment_id, string_agg(concat(relation, ' ', other), ', ' ORDER BY CASE WHEN offset_s IS NULL THEN 0 ELSE 1 END, offset_s, place) AS around FROM seen GROUP BY segment_id", "segment", "agreed_on")
def neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    """Each segment's previous and next on its channel and the nearest others of its source, in order."""
    return _around(spark, d).filter(F.size("around") > 0).select("segment_id", F.array_join(F.transform("around", lambda x: F.concat(x["relation"], F.lit(" "), x["segment_id"])), ", ").alias("around"))


def _newest(spark: SparkSession, d: str) -> DataFrame:
    """The newest result of each model, with what it heard: the name, type and brand of a part."""
    part = views.table(spark, d, "part").selectExpr("p_partkey as seq", "case when p_partkey % 23 = 0 then ' ' else concat(p_name, ' ', p_type, ' ', p_brand) end as text")
    rows = relational.newest(views.results(spark, d), ["segment_id", "model_id"], ["created_at", "attempt", "seq"])
    return rows.join(part, "seq").join(F.broadcast(views.models(spark, d)), "model_id").selectExpr("segment_id", "logical_name as model", "family", "status", "text", "ensemble_eligible as eligible")


_HEARD = """newest AS (SELECT r.segment_id, logical_name AS model, family, status, ensemble_eligible AS eligible, CASE WHEN p_partkey % 23 = 0 THEN ' ' ELSE concat(p_name, ' ', p_type, ' ', p_brand) END AS text
 FROM (SELECT * FROM result QUALIFY row_number() OVER (PARTITION BY segment_id, model_id ORDER BY created_at DESC, attempt DESC, seq DESC) = 1) r JOIN part ON p_partkey = seq JOIN model USING (model_id))"""
_CALL = "CASE icao % 4 WHEN 0 THEN concat('swa', icao) WHEN 1 THEN concat(' N', icao, 'AB') WHEN 2 THEN concat('JBU', icao) ELSE callsign END"


def _aircraft(spark: SparkSession, d: str) -> DataFrame:
    near = sightings.active_flights(views.calls(spark, d), views.flights(spark, d), 12)
    return near.selectExpr("segment_id", "rank", "case cast(icao % 4 as int) when 0 then concat('swa', icao) when 1 then concat(' N', icao, 'AB') when 2 then concat('JBU', icao) else callsign end as callsign")


def _brief_sql() -> str:
    from squelch.plans.archive import _NEAR

    sky = _NEAR[: _NEAR.index(",\nmoves AS")].replace("near AS", "plane AS")
    return with_views("", "segment", "result", "model", "agreed_on", "fix", "flight", "call").rstrip() + ",\n" + _HEARD + ",\n" + _AROUND + ",\n" + sky + f"""
SELECT s.segment_id, s.duration_ms, h.heard, h.research, h.abstained, h.errors, g.kind, g.representative, n.around, coalesce(p.aircraft, '') AS aircraft FROM segment s LEFT JOIN agreed_on g ON g.segment_id = s.segment_id
 LEFT JOIN (SELECT segment_id, coalesce(string_agg(concat(model, '=', text), '; ' ORDER BY model) FILTER (status = 'success' AND trim(text) <> ''), '') AS heard, count(*) FILTER (status = 'success' AND trim(text) <> '' AND NOT eligible) AS research,
  coalesce(string_agg(model, '; ' ORDER BY model) FILTER (status = 'abstained' OR status = 'success' AND trim(text) = ''), '') AS abstained, coalesce(string_agg(model, '; ' ORDER BY model) FILTER (status = 'error'), '') AS errors FROM newest GROUP BY segment_id
  UNION ALL SELECT segment_id, '', 0, '', '' FROM segment WHERE segment_id NOT IN (SELECT segment_id FROM newest)) h ON h.segment_id = s.segment_id
 LEFT JOIN (SELECT a.segment_id, coalesce(string_agg(concat(coalesce(CAST(CAST(offset_s AS BIGINT) AS VARCHAR), '-'), ' ', preview), '; ' ORDER BY place4) FILTER (preview IS NOT NULL), '') AS around FROM segment a LEFT JOIN
  (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY CASE WHEN offset_s IS NULL THEN 0 ELSE 1 END, offset_s, place) AS place4 FROM seen WHERE preview IS NOT NULL QUALIFY place4 <= 4) f ON f.segment_id = a.segment_id GROUP BY a.segment_id) n ON n.segment_id = s.segment_id
 LEFT JOIN (SELECT segment_id, string_agg(concat(c, ' ', coalesce(CASE WHEN c LIKE 'swa%' THEN 'Southwest ' || icao WHEN c LIKE ' N%' AND length(CAST(icao AS VARCHAR)) <= 3 THEN 'November ' || icao || 'AB' WHEN c LIKE 'JBU%' THEN 'JetBlue ' || icao END, '-')), '; ' ORDER BY rank) AS aircraft
  FROM (SELECT segment_id, rank, icao, {_CALL} AS c FROM plane) GROUP BY segment_id) p ON p.segment_id = s.segment_id"""


@query("segment_briefs", _brief_sql())
def segment_briefs(spark: SparkSession, d: str) -> DataFrame:
    """One nested row for each segment, written out: what was heard, by whom not, agreement, neighbours, aircraft."""
    around = _around(spark, d).select("segment_id", F.transform("around", lambda n: F.struct(n["offset_s"].alias("offset_s"), n["preview"].alias("preview"))).alias("around"))
    rows = briefs.briefs(views.segments(spark, d).select("segment_id", "duration_ms"), _newest(spark, d), views.consensus(spark, d), around, _aircraft(spark, d))
    listed = lambda column, f: F.array_join(F.transform(column, f), "; ")
    return rows.select(
        "segment_id", "segment.duration_ms", listed("hypotheses", lambda h: F.concat(h["model"], F.lit("="), h["text"])).alias("heard"), F.size(F.filter("hypotheses", lambda h: h["research_only"])).cast("long").alias("research"),
        F.array_join("abstained", "; ").alias("abstained"), F.array_join("errors", "; ").alias("errors"), "agreement.kind", "agreement.representative",
        listed("neighbours", lambda n: F.concat(F.coalesce(n["offset_s"].cast("long").cast("string"), F.lit("-")), F.lit(" "), n["preview"])).alias("around"),
        listed("aircraft", lambda c: F.concat(c["callsign"], F.lit(" "), F.coalesce(c["telephony"], F.lit("-")))).alias("aircraft"),
    )


_SUPPORT = """item AS (SELECT o_orderkey AS segment_id, concat(p_name, ' ', p_type, ' ', p_brand) AS transcript FROM orders JOIN part ON p_partkey = o_custkey),
rep AS (SELECT segment_id, min(text) AS representative FROM newest WHERE status = 'success' AND trim(text) <> '' GROUP BY segment_id),
heard AS (SELECT segment_id, model, model AS family, lower(trim(text)) AS norm FROM newest WHERE status = 'success'
 UNION ALL SELECT segment_id, '~item', '~item', lower(transcript) FROM item UNION ALL SELECT segment_id, '~rep', '~rep', lower(representative) FROM rep)"""


@query(
    "answer_support",
    with_views("", "result", "model").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + _HEARD + ",\n" + _SUPPORT + ",\n" + _LCS + """
SELECT i.segment_id AS item_id, round_even(best_similarity, 4) AS best_similarity, best_model, round_even(representative_similarity, 4) AS representative_similarity FROM item i LEFT JOIN (
 SELECT segment_id, max(s) FILTER (b_model <> '~rep') AS best_similarity, arg_min(b_model, (-s, b_model)) FILTER (b_model <> '~rep') AS best_model, max(s) FILTER (b_model = '~rep') AS representative_similarity FROM sim WHERE a_model = '~item' AND b_model <> '~item' GROUP BY segment_id) q ON q.segment_id = i.segment_id""",
)
def answer_support(spark: SparkSession, d: str) -> DataFrame:
    """How much of each answer the models heard too: the hypothesis most like it, and its likeness to the representative text."""
    said = _newest(spark, d)
    texts = views.table(spark, d, "part").selectExpr("p_partkey", "concat(p_name, ' ', p_type, ' ', p_brand) as transcript")
    items = views.table(spark, d, "orders").join(texts, F.expr("p_partkey = o_custkey")).selectExpr("o_orderkey as item_id", "o_orderkey as segment_id", "transcript")
    reps = said.filter("status = 'success' and trim(text) <> ''").groupBy("segment_id").agg(F.min("text").alias("representative"))
    return briefs.support(items, said, reps)


# Gold references

_ID = "concat(CASE WHEN o_orderkey % 13 = 0 THEN 'kabc' ELSE concat('K', to_base(o_custkey + 12960, 36)) END, '_', coalesce(channel, 'North_Ground'), '_', 118 + o_orderkey % 19, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '_' || (o_orderkey % 40 * 25) END, 'MHz_', strftime(o_orderdate, '%Y%m%d'), '_', CASE WHEN o_orderkey % 17 = 0 THEN '2561' ELSE '2359' END, lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0'))"
_CLIPS = f"clip AS (SELECT o_orderkey AS segment_id, {_ID} AS recording, o_orderkey % 140 AS i, duration_ms AS a, duration_ms + o_orderkey % 5000 AS b FROM orders JOIN segment ON segment_id = o_orderkey)"


@query(
    "clip_paths",
    _CLIPS + r""" SELECT segment_id, concat(recording, '/', CASE WHEN i < 10 THEN '0' ELSE '' END, i, '_', a, '_', b, '.wav') AS path, CASE WHEN ok THEN i END AS index, CASE WHEN ok THEN a END AS start_ms, CASE WHEN ok THEN b END AS end_ms,
 CASE WHEN ok THEN substr(recording, 1, 4) END AS station, CASE WHEN ok THEN regexp_extract(recording, '^[A-Z0-9]{4}_(.+?)_\d+(_\d+)?MHz', 1) END AS channel,
 CASE WHEN ok THEN CAST(round_even(CAST(replace(regexp_extract(recording, '_(\d+(_\d+)?)MHz', 1), '_', '.') AS DOUBLE) * 1000000, 0) AS BIGINT) END AS frequency_hz
 FROM (SELECT *, NOT starts_with(recording, 'kabc') AND segment_id % 17 <> 0 AS ok FROM clip)""",
    "segment",
)
def clip_paths(spark: SparkSession, d: str) -> DataFrame:
    """Clip paths written and read back; those whose recording has a bad name or time give nulls."""
    from squelch.sources import recordings

    name = "concat(if(o_orderkey % 13 = 0, 'kabc', concat('K', conv(o_custkey + 12960, 10, 36))), '_', coalesce(channel, 'North_Ground'), '_', 118 + o_orderkey % 19, if(o_orderkey % 3 = 0, '', concat('_', o_orderkey % 40 * 25)), 'MHz_', date_format(o_orderdate, 'yyyyMMdd'), '_', if(o_orderkey % 17 = 0, '2561', '2359'), lpad(cast(o_orderkey % 60 as string), 2, '0'))"
    rows = views.table(spark, d, "orders").join(views.segments(spark, d), F.expr("segment_id = o_orderkey")).selectExpr("segment_id", f"{name} as recording", "o_orderkey % 140 as i", "duration_ms as a", "duration_ms + o_orderkey % 5000 as b")
    paths = rows.select("segment_id", recordings.clip_path(F.col("recording"), F.col("i"), F.col("a"), F.col("b")).alias("path"))
    read = paths.withColumn("c", recordings.parsed_clip(F.col("path"))).withColumn("r", recordings.recording_of(F.col("c.recording")))
    return read.select("segment_id", "path", F.col("c.number").alias("index"), "c.start_ms", "c.end_ms", "r.station", "r.channel", "r.frequency_hz")


@query("segments_with_gold", "SELECT s.segment_id, g.text FROM segment s LEFT JOIN (SELECT source_id, relative_path, concat('gold ', segment_id) AS text FROM segment WHERE role = 'benchmark' OR segment_id % 10 = 0) g ON g.source_id = s.source_id AND g.relative_path = s.relative_path", "segment")
def segments_with_gold(spark: SparkSession, d: str) -> DataFrame:
    """Segments with the gold references of their source and path."""
    from squelch.sources import recordings

    gold = views.segments(spark, d).filter("role = 'benchmark' or segment_id % 10 = 0").selectExpr("source_id", "relative_path", "concat('gold ', segment_id) as text")
    return recordings.with_gold(views.segments(spark, d), gold).select("segment_id", "gold.text")
