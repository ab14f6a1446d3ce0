"""Relational queries over segments, results and models, each with the SQL that checks it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squelch.functions import hashing, temporal, text
from squelch.operators import adjudication, datasets, lifecycle, relational, review, tracks
from squelch.sources.views import hypotheses, models, results, segments, sightings, table, with_views

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None, *views: str):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_views(sql, *views) if views else sql
        return f

    return register


# Aggregations


@query("source_summary_total", "SELECT source_id, count(*) AS segments, CAST(coalesce(sum(duration_ms), 0) AS BIGINT) AS audio_ms FROM segment GROUP BY source_id", "segment")
def source_summary_total(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).groupBy("source_id").agg(F.count("*").alias("segments"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("audio_ms"))


for _column, _name in (("presence_status", "presence"), ("channel", "channel")):

    @query(f"counts_by_{_name}", f"SELECT {_column} AS value, count(*) AS n FROM segment GROUP BY {_column}", "segment")
    def counts_by(spark: SparkSession, d: str, column: str = _column) -> DataFrame:
        return segments(spark, d).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


@query("summary_by_utc_day", "SELECT CAST(capture_start AS DATE) AS day, count(*) AS segments, CAST(sum(duration_ms) AS BIGINT) AS audio_ms FROM segment WHERE capture_start IS NOT NULL GROUP BY 1", "segment")
def summary_by_utc_day(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).filter("capture_start is not null").groupBy(F.to_date("capture_start").alias("day")).agg(F.count("*").alias("segments"), F.sum("duration_ms").alias("audio_ms"))


@query(
    "sweep_report",
    """SELECT model_id, count(*) AS results, count(*) FILTER (status = 'success') AS successes, count(*) FILTER (status = 'abstained') AS abstained,
 count(*) FILTER (status = 'error') AS errors, CAST(sum(audio_ms) AS DOUBLE) / count(*) AS mean_audio_ms,
 CAST(sum(CASE WHEN status = 'success' THEN inference_ms END) AS DOUBLE) / nullif(count(*) FILTER (status = 'success'), 0) AS mean_inference_ms FROM result GROUP BY model_id""",
    "result",
)
def sweep_report(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("status") == "success"
    return results(spark, d).groupBy("model_id").agg(
        F.count("*").alias("results"), F.count_if(ok).alias("successes"), F.count_if(F.col("status") == "abstained").alias("abstained"), F.count_if(F.col("status") == "error").alias("errors"),
        (F.sum("audio_ms").cast("double") / F.count("*")).alias("mean_audio_ms"), (F.sum(F.when(ok, F.col("inference_ms"))).cast("double") / F.nullif(F.count_if(ok), F.lit(0))).alias("mean_inference_ms"),
    )


@query("language_drift", "SELECT source, count(*) AS n, count(*) FILTER (lower(lang) <> 'en') AS drifted FROM documents GROUP BY source")
def language_drift(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.lower("lang") != "en").alias("drifted"))


@query("fully_transcribed_having", "SELECT segment_id, count(DISTINCT model_id) AS models FROM result WHERE status = 'success' GROUP BY segment_id HAVING count(DISTINCT model_id) >= 3", "result")
def fully_transcribed_having(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).filter("status = 'success'").groupBy("segment_id").agg(F.count_distinct("model_id").alias("models")).filter("models >= 3")


@query("observed_rtf", "SELECT model_id, CAST(sum(inference_ms) AS DOUBLE) / nullif(sum(audio_ms), 0) AS rtf FROM result WHERE status <> 'error' GROUP BY model_id", "result")
def observed_rtf(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).filter("status <> 'error'").groupBy("model_id").agg((F.sum("inference_ms").cast("double") / F.nullif(F.sum("audio_ms"), F.lit(0))).alias("rtf"))


@query("wall_per_audio", "SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / count(*) AS seconds_each FROM events GROUP BY user_id")
def wall_per_audio(spark: SparkSession, d: str) -> DataFrame:
    span = temporal.seconds_between(F.max("ts"), F.min("ts"))
    return table(spark, d, "events").groupBy("user_id").agg((span / F.count("*")).alias("seconds_each"))


_NOW = "TIMESTAMP '2024-01-15 00:00:00'"


@query("run_health_recent", f"SELECT event_type, max(ts) AS last_at, count(*) FILTER (ts > {_NOW} - INTERVAL 10 DAY AND ts <= {_NOW}) AS recent, coalesce(max(ts) < {_NOW} - INTERVAL 10 MINUTE, true) AS stalled FROM events GROUP BY event_type")
def run_health_recent(spark: SparkSession, d: str) -> DataFrame:
    now = F.expr("timestamp_ntz '2024-01-15 00:00:00'")
    return table(spark, d, "events").groupBy("event_type").agg(
        F.max("ts").alias("last_at"), F.count_if((F.col("ts") > now - F.expr("interval 10 days")) & (F.col("ts") <= now)).alias("recent"), F.coalesce(F.max("ts") < now - F.expr("interval 10 minutes"), F.lit(True)).alias("stalled")
    )


@query("status_matrix", "SELECT model_id, status, count(*) AS n FROM result GROUP BY model_id, status", "result")
def status_matrix(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).groupBy("model_id", "status").agg(F.count("*").alias("n"))


@query("max_greatest", "SELECT o_orderpriority AS priority, count(CASE WHEN o_orderstatus <> 'O' THEN 1 END) AS closed, max(greatest(o_totalprice, l_extendedprice)) AS most FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority")
def max_greatest(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return both.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.when(F.col("o_orderstatus") != "O", 1)).alias("closed"), F.max(F.greatest("o_totalprice", "l_extendedprice")).alias("most"))


_LABELLED = "FROM labels JOIN documents USING (doc_id)"
for _name, _key, _sql in (("label", "quality", "quality"), ("channel", "source", "source"), ("day", "lang", "lang")):

    @query(f"training_summary_by_{_name}", f"SELECT CAST({_sql} AS VARCHAR) AS value, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars {_LABELLED} GROUP BY 1")
    def training_summary(spark: SparkSession, d: str, key: str = _key) -> DataFrame:
        rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
        return rows.groupBy(F.col(key).cast("string").alias("value")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("dataset_counts", "SELECT 'quality' AS field, CAST(quality AS VARCHAR) AS value, count(*) AS n FROM labels GROUP BY quality UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR), count(*) FROM labels GROUP BY toxic")
def dataset_counts(spark: SparkSession, d: str) -> DataFrame:
    return datasets.counts(table(spark, d, "labels"), "quality", "toxic").select("field", "value", "n")


@query("facets_channels", "SELECT channel, count(*) AS n FROM segment WHERE channel IS NOT NULL GROUP BY channel", "segment")
def facets_channels(spark: SparkSession, d: str) -> DataFrame:
    return review.facet(segments(spark, d), "channel")


@query("facets_flags", "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def facets_flags(spark: SparkSession, d: str) -> DataFrame:
    return review.key_facet(table(spark, d, "events"), "props")


#: Every column of every table, by how it is written: as it is, as microseconds, in billionths, as a list of those.
FINGERPRINTED = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_mktsegment c_acctbal:f", "supplier": "s_suppkey s_name s_nationkey s_acctbal:f",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice:f", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice:f o_orderdate:t o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity:f l_extendedprice:f l_discount:f l_tax:f l_returnflag l_linestatus l_shipdate:t", "events": "event_id ts:t user_id event_type value:f props",
    "documents": "doc_id text lang source n_chars", "embeddings": "vec_id embedding:l label", "pages": "page_id url html", "benchmark": "item_id text", "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}


def _fingerprint_sql(name: str, columns: str) -> str:
    forms = {"": "CAST({} AS VARCHAR)", "t": "CAST(epoch_us({}) AS VARCHAR)", "f": "CAST(CAST(round(CAST({} AS DOUBLE) * 1000000000) AS BIGINT) AS VARCHAR)"}
    forms["l"] = "'[' || array_to_string(list_transform({}, lambda x: coalesce(CAST(CAST(round(CAST(x AS DOUBLE) * 1000000000) AS BIGINT) AS VARCHAR), '!')), ',') || ']'"
    values = [forms[kind].format(c) for c, _, kind in (x.partition(":") for x in columns.split())]
    row = " || ".join(f"coalesce(length({v}) || ':' || {v}, '!')" for v in values)
    return f"SELECT '{name}' AS table_name, count(*) AS n_rows, CAST(coalesce(sum(CAST('0x' || substr(md5({row}), 1, 15) AS BIGINT)), 0) AS VARCHAR) AS digest FROM {name}"


@query("table_fingerprint", " UNION ALL ".join(_fingerprint_sql(n, c) for n, c in FINGERPRINTED.items()))
def table_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [relational.fingerprint(table(spark, d, n), n, [x.partition(":")[0] for x in c.split()]) for n, c in FINGERPRINTED.items()])


# Filters, joins and sets


@query("version_is_distinct", "SELECT segment_id, model_id, seq FROM result WHERE nullif(attempt, 2) IS DISTINCT FROM 1", "result")
def version_is_distinct(spark: SparkSession, d: str) -> DataFrame:
    version = F.nullif(F.col("attempt"), F.lit(2))
    return results(spark, d).filter(~version.eqNullSafe(F.lit(1))).select("segment_id", "model_id", "seq")


@query("json_path_filter", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events WHERE CAST(props->>'k' AS BIGINT) IN (1, 2, 3, 5, 8)")
def json_path_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).filter(F.col("k").isin(1, 2, 3, 5, 8))


@query(
    "validate_segment_rules",
    """SELECT segment_id, array_to_string(list_filter([CASE WHEN NOT (relative_path LIKE relative_dir || '/%') THEN 'path_outside_dir' END,
  CASE WHEN capture_start IS NULL THEN 'no_start' END, CASE WHEN NOT (duration_ms >= 1000) THEN 'too_short' END, CASE WHEN channel IS NULL THEN 'no_channel' END], lambda x: x IS NOT NULL), ',') AS broken
 FROM segment WHERE NOT (relative_path LIKE relative_dir || '/%') OR capture_start IS NULL OR duration_ms < 1000 OR channel IS NULL""",
    "segment",
)
def validate_segment_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = {
        "path_outside_dir": text.parent_dir(F.col("relative_path")) == F.col("relative_dir"), "no_start": F.col("capture_start").isNotNull(),
        "too_short": F.col("duration_ms") >= 1000, "no_channel": F.col("channel").isNotNull(),
    }
    return lifecycle.violations(segments(spark, d), rules).select("segment_id", F.array_join("broken", ",").alias("broken"))


@query("validate_unique", "SELECT segment_id, model_id, count(*) AS n_rows FROM result GROUP BY segment_id, model_id HAVING count(*) > 1", "result")
def validate_unique(spark: SparkSession, d: str) -> DataFrame:
    return relational.duplicates(results(spark, d), ["segment_id", "model_id"])


@query(
    "skip_reason_cascade",
    """SELECT CASE WHEN presence_status = 'missing' THEN 'audio_missing' WHEN duration_ms > 25000 THEN 'too_long' WHEN r.segment_id IS NOT NULL THEN 'already_queued' WHEN channel IS NULL THEN 'no_channel' END AS skip_reason,
 count(*) AS n FROM segment s LEFT JOIN (SELECT DISTINCT segment_id FROM result WHERE status = 'error') r ON s.segment_id = r.segment_id GROUP BY 1""",
    "segment", "result",
)
def skip_reason_cascade(spark: SparkSession, d: str) -> DataFrame:
    queued = results(spark, d).filter("status = 'error'").select("segment_id", F.lit(True).alias("queued")).distinct()
    rows = segments(spark, d).join(queued, "segment_id", "left")
    reason = relational.cascade({"audio_missing": F.col("presence_status") == "missing", "too_long": F.col("duration_ms") > 25000, "already_queued": F.col("queued"), "no_channel": F.col("channel").isNull()})
    return rows.groupBy(reason.alias("skip_reason")).agg(F.count("*").alias("n"))


@query(
    "accept_cascade",
    """SELECT CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN toxic = 1 THEN 'rejected' WHEN quality = 0 THEN 'low_quality' WHEN text IS NULL OR trim(text) = '' THEN 'no_text' WHEN lang IS NULL THEN 'no_language' ELSE 'accepted' END AS decision, count(*) AS n
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""",
)
def accept_cascade(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels").withColumnRenamed("doc_id", "labelled"), F.col("doc_id") == F.col("labelled"), "left")
    decision = relational.cascade({
        "unlabelled": F.col("labelled").isNull(), "rejected": F.col("toxic") == 1, "low_quality": F.col("quality") == 0,
        "no_text": F.col("text").isNull() | (F.trim("text") == ""), "no_language": F.col("lang").isNull(), "accepted": F.lit(True),
    })
    return rows.groupBy(decision.alias("decision")).agg(F.count("*").alias("n"))


@query(
    "nominate_cascade",
    """SELECT b.item_id, CASE WHEN e.n IS NULL THEN 'unknown' WHEN e.n > 1 THEN 'insufficient_agreement' ELSE 'nominated' END AS decision
 FROM benchmark b LEFT JOIN (SELECT text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text) e ON b.text = e.text""",
)
def nominate_cascade(spark: SparkSession, d: str) -> DataFrame:
    same = table(spark, d, "documents").filter("text is not null").groupBy("text").agg(F.count("*").alias("n"))
    rows = table(spark, d, "benchmark").join(same, "text", "left")
    return rows.select("item_id", relational.cascade({"unknown": F.col("n").isNull(), "insufficient_agreement": F.col("n") > 1, "nominated": F.lit(True)}).alias("decision"))


@query("join_chain_inner", "SELECT family, count(*) AS results, CAST(sum(duration_ms) AS BIGINT) AS audio_ms FROM result JOIN model USING (model_id) JOIN segment USING (segment_id) WHERE role = 'corpus' GROUP BY family", "result", "model", "segment")
def join_chain_inner(spark: SparkSession, d: str) -> DataFrame:
    rows = results(spark, d).join(models(spark, d), "model_id").join(segments(spark, d).filter("role = 'corpus'"), "segment_id")
    return rows.groupBy("family").agg(F.count("*").alias("results"), F.sum("duration_ms").alias("audio_ms"))


@query("join_left_compound", "SELECT s.segment_id, count(r.seq) AS errors FROM segment s LEFT JOIN result r ON s.segment_id = r.segment_id AND r.status = 'error' GROUP BY s.segment_id", "segment", "result")
def join_left_compound(spark: SparkSession, d: str) -> DataFrame:
    failed = results(spark, d).filter("status = 'error'").select(F.col("segment_id").alias("s2"), "seq")  # the constant of the ON clause
    return segments(spark, d).join(failed, F.col("segment_id") == F.col("s2"), "left").groupBy("segment_id").agg(F.count("seq").alias("errors"))


@query(
    "pending_segments",
    """SELECT s.segment_id FROM segment s LEFT JOIN (SELECT segment_id, max(CASE WHEN status <> 'error' THEN 1 ELSE 0 END) AS ok FROM result GROUP BY segment_id) r
 ON s.segment_id = r.segment_id WHERE r.segment_id IS NULL OR r.ok = 0""",
    "segment", "result",
)
def pending_segments(spark: SparkSession, d: str) -> DataFrame:
    done = results(spark, d).groupBy("segment_id").agg(F.max((F.col("status") != "error").cast("int")).alias("ok"))
    return segments(spark, d).join(done, "segment_id", "left").filter("ok is null or ok = 0").select("segment_id")


@query("pending_all_anti", "SELECT segment_id FROM segment WHERE segment_id NOT IN (SELECT segment_id FROM result)", "segment", "result")
def pending_all_anti(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).join(results(spark, d), "segment_id", "left_anti").select("segment_id")


@query("untranscribed_not_in", "SELECT segment_id FROM segment WHERE segment_id NOT IN (SELECT segment_id FROM result WHERE status = 'success' GROUP BY segment_id HAVING count(DISTINCT model_id) >= 2)", "segment", "result")
def untranscribed_not_in(spark: SparkSession, d: str) -> DataFrame:
    done = results(spark, d).filter("status = 'success'").groupBy("segment_id").agg(F.count_distinct("model_id").alias("n")).filter("n >= 2")
    return segments(spark, d).join(done, "segment_id", "left_anti").select("segment_id")


@query("blocked_models_anti", "SELECT model_id, logical_name FROM model WHERE model_id NOT IN (SELECT model_id FROM result GROUP BY model_id HAVING count(*) FILTER (status = 'error') * 100 > count(*) * 33)", "model", "result")
def blocked_models_anti(spark: SparkSession, d: str) -> DataFrame:
    """Models of which at most 33 % of the results are errors."""
    blocked = results(spark, d).groupBy("model_id").agg((F.count_if(F.col("status") == "error") * 100 > F.count("*") * 33).alias("blocked")).filter("blocked")
    return models(spark, d).join(blocked, "model_id", "left_anti").select("model_id", "logical_name")


@query(
    "nearby_band_join",
    "SELECT a.event_id, b.event_id AS other_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 60000000",
)
def nearby_band_join(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "user_id", "ts")
    return relational.band_join(events, events, ["user_id"], "ts", 60, "other").filter("event_id <> other.event_id").select("event_id", F.col("other.event_id").alias("other_id"))


@query(
    "neighbors_prev_next",
    """SELECT a.event_id, (SELECT arg_max(b.event_id, (b.ts, b.event_id)) FROM events b WHERE b.user_id = a.user_id AND b.ts < a.ts) AS previous_id,
 (SELECT arg_min(b.event_id, (b.ts, b.event_id)) FROM events b WHERE b.user_id = a.user_id AND b.ts > a.ts) AS next_id FROM events a""",
)
def neighbors_prev_next(spark: SparkSession, d: str) -> DataFrame:
    return relational.neighbours(table(spark, d, "events"), ["user_id"], "ts", "event_id").select("event_id", F.col("previous").alias("previous_id"), F.col("next").alias("next_id"))


@query(
    "missing_result_matrix",
    """SELECT m.model_id, count(*) AS missing FROM model m CROSS JOIN (SELECT DISTINCT relative_dir FROM segment) s
 LEFT JOIN (SELECT DISTINCT model_id, relative_dir FROM result JOIN segment USING (segment_id) WHERE status = 'success') r ON r.model_id = m.model_id AND r.relative_dir = s.relative_dir
 WHERE r.model_id IS NULL GROUP BY m.model_id""",
    "model", "segment", "result",
)
def missing_result_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Directories in which a model has no success: all pairs of the two small dimensions that have none."""
    dirs = segments(spark, d).select("segment_id", "relative_dir")
    n_dirs = dirs.agg(F.count_distinct("relative_dir").alias("dirs"))
    have = results(spark, d).filter("status = 'success'").join(dirs, "segment_id").groupBy("model_id").agg(F.count_distinct("relative_dir").alias("have"))
    rows = models(spark, d).select("model_id").join(have, "model_id", "left").na.fill(0).join(F.broadcast(n_dirs))
    return rows.select("model_id", (F.col("dirs") - F.col("have")).alias("missing")).filter("missing > 0")


@query("station_lookup", "SELECT s_suppkey AS key, coalesce(n_name, CASE WHEN regexp_matches(s_name, '^[A-Z0-9]{4}$') THEN s_name END, 'unknown') AS station FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey <> 2")
def station_lookup(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "nation").filter("n_regionkey <> 2")
    rows = table(spark, d, "supplier").join(F.broadcast(known), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rows.select(F.col("s_suppkey").alias("key"), F.coalesce("n_name", F.when(F.col("s_name").rlike("^[A-Z0-9]{4}$"), F.col("s_name")), F.lit("unknown")).alias("station"))


@query("channel_service_pref", "SELECT relative_dir, arg_min(channel, (list_position(['TWR','GND','APP','CLNC'], channel), segment_id)) AS channel FROM segment WHERE channel IS NOT NULL GROUP BY relative_dir", "segment")
def channel_service_pref(spark: SparkSession, d: str) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(x) for x in ("TWR", "GND", "APP", "CLNC")]), F.col("channel"))
    return segments(spark, d).filter("channel is not null").groupBy("relative_dir").agg(F.min_by("channel", F.struct(place.alias("p"), "segment_id")).alias("channel"))


@query(
    "export_coverage_full_outer",
    """SELECT coalesce(a.k, b.k) AS segment_id, CASE WHEN b.k IS NULL THEN 'missing' ELSE 'extra' END AS side FROM (SELECT DISTINCT segment_id AS k FROM segment WHERE presence_status = 'present') a
 FULL OUTER JOIN (SELECT DISTINCT segment_id AS k FROM result WHERE status = 'success') b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""",
    "segment", "result",
)
def export_coverage_full_outer(spark: SparkSession, d: str) -> DataFrame:
    return relational.coverage(segments(spark, d).filter("presence_status = 'present'"), results(spark, d).filter("status = 'success'"), "segment_id")


# Windows, order, samples


@query("sweep_ordinals", "SELECT segment_id, row_number() OVER (ORDER BY capture_start NULLS LAST, relative_path) - 1 AS ordinal FROM segment", "segment")
def sweep_ordinals(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("capture_start").asc_nulls_last(), F.col("relative_path")]
    return relational.global_ordinals(segments(spark, d), order, F.to_date("capture_start")).select("segment_id", "ordinal")


@query(
    "latest_result_per_model",
    "SELECT segment_id, model_id, seq, status FROM result JOIN model USING (model_id) WHERE ensemble_eligible QUALIFY row_number() OVER (PARTITION BY segment_id, model_id ORDER BY created_at DESC, attempt DESC, seq DESC) = 1",
    "result", "model",
)
def latest_result_per_model(spark: SparkSession, d: str) -> DataFrame:
    voting = results(spark, d).join(models(spark, d).filter("ensemble_eligible").select("model_id"), "model_id")
    return relational.newest(voting, ["segment_id", "model_id"], ["created_at", "attempt", "seq"]).select("segment_id", "model_id", "seq", "status")


@query("latest_n_per_model", "SELECT model_id, segment_id, seq FROM result QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY segment_id DESC, created_at DESC, attempt DESC, seq DESC) <= 100", "result")
def latest_n_per_model(spark: SparkSession, d: str) -> DataFrame:
    return relational.newest(results(spark, d), ["model_id"], ["segment_id", "created_at", "attempt", "seq"], 100).select("model_id", "segment_id", "seq")


@query("superseded_flag", "SELECT segment_id, model_id, attempt, seq, row_number() OVER (PARTITION BY segment_id, model_id ORDER BY created_at DESC, attempt DESC, seq DESC) > 1 AS superseded FROM result", "result")
def superseded_flag(spark: SparkSession, d: str) -> DataFrame:
    return relational.superseded(results(spark, d), ["segment_id", "model_id"], ["created_at", "attempt", "seq"]).select("segment_id", "model_id", "attempt", "seq", "superseded")


@query("nearest_in_time", f"SELECT user_id, arg_min(event_id, (abs(epoch_us(ts) - epoch_us({_NOW})), event_id)) AS event_id FROM events GROUP BY user_id")
def nearest_in_time(spark: SparkSession, d: str) -> DataFrame:
    return tracks.nearest_in_time(table(spark, d, "events"), "user_id", "ts", F.expr("timestamp_ntz '2024-01-15 00:00:00'"), "event_id").select("user_id", "event_id")


@query(
    "successor_rate",
    "SELECT event_id, (lead(value) OVER w - value) / nullif((epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6, 0) AS per_second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
)
def successor_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = tracks.with_successor(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["ts", "value"])
    return rows.select("event_id", ((F.col("next_value") - F.col("value")) / F.nullif(temporal.seconds_between(F.col("next_ts"), F.col("ts")), F.lit(0.0))).alias("per_second"))


@query(
    "even_thinning",
    """SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
 WHERE n <= 50 OR round(round(i / ((n - 1) / 49.0::DOUBLE)) * ((n - 1) / 49.0::DOUBLE)) = i""",
)
def even_thinning(spark: SparkSession, d: str) -> DataFrame:
    return relational.thinned(table(spark, d, "events"), ["event_type"], ["ts", "event_id"], 50).select("event_id")


@query("dataset_ordinals", "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY quality DESC NULLS LAST, n_chars, doc_id) - 1 AS ordinal FROM labels JOIN documents USING (doc_id)")
def dataset_ordinals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return relational.ordinals(rows, [F.col("quality").desc_nulls_last(), F.col("n_chars"), F.col("doc_id")], ["lang"]).select("doc_id", "ordinal")


@query("hash_sample", "SELECT segment_id FROM segment ORDER BY md5(concat('seed-7:', segment_id)), segment_id LIMIT 200", "segment")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return relational.hash_sample(segments(spark, d), "segment_id", "seed-7", 200).select("segment_id")


_PLACE = "CAST(concat('0x', substr(sha256(concat('s1:', {})), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE"


@query("assign_split", f"SELECT segment_id, CASE WHEN p < 0.8 THEN 'train' WHEN p < 0.9 THEN 'validation' ELSE 'test' END AS split FROM (SELECT segment_id, {_PLACE.format('relative_dir')} AS p FROM segment)", "segment")
def assign_split(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).select("segment_id", hashing.split_of(F.col("relative_dir"), "s1", {"train": 0.8, "validation": 0.1, "test": 0.1}).alias("split"))


@query("derived_split", "SELECT segment_id, CASE WHEN CAST(concat('0x', substr(sha256(lower(relative_path)), 1, 2)) AS BIGINT) % 2 = 0 THEN 'calibration' ELSE 'test' END AS split FROM segment", "segment")
def derived_split(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).select("segment_id", hashing.parity_split(F.col("relative_path")).alias("split"))


@query("keyset_page", "SELECT segment_id FROM segment WHERE segment_id > 1000 ORDER BY segment_id LIMIT 500", "segment")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return relational.page_after(segments(spark, d), "segment_id", 1000, 500).select("segment_id")


# Geography, time, money


@query(
    "haversine_matrix",
    """SELECT a.key, b.station, round(2 * 3440.065 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))), 4) AS nm
 FROM sight a JOIN (SELECT n_name AS station, CAST(n_nationkey * 5 - 60 AS DOUBLE) AS lat, CAST(n_nationkey * 14 - 170 AS DOUBLE) AS lon FROM nation) b ON true""",
    "sight",
)
def haversine_matrix(spark: SparkSession, d: str) -> DataFrame:
    from squelch.functions.geo import distance_nm

    places = table(spark, d, "nation").selectExpr("n_name as place", "cast(n_nationkey * 5 - 60 as double) as lat2", "cast(n_nationkey * 14 - 170 as double) as lon2")
    rows = sightings(spark, d).join(F.broadcast(places))  # 25 places, whatever the input
    return rows.select("key", F.col("place").alias("station"), F.round(distance_nm(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 4).alias("nm"))


@query("bbox_filter", "SELECT key, lat, lon FROM sight WHERE lat BETWEEN 10 - 1200 / 60.0 AND 10 + 1200 / 60.0 AND lon BETWEEN 20 - 20.0 / cos(radians(10.0)) AND 20 + 20.0 / cos(radians(10.0))", "sight")
def bbox_filter(spark: SparkSession, d: str) -> DataFrame:
    from squelch.functions.geo import box, in_box

    return sightings(spark, d).filter(in_box(F.col("lat"), F.col("lon"), box(F.lit(10.0), F.lit(20.0), 1200))).select("key", "lat", "lon")


_COST = "((1400 + 45 * 5) * 2.0::DOUBLE / 1e6 + 32 * greatest(duration_ms / 1000.0::DOUBLE, 1.0) * 2.0::DOUBLE / 1e6)"


@query("cost_estimate", f"SELECT segment_id, round({_COST} + 2000 * 12.0::DOUBLE / 1e6, 6) AS typical, round({_COST} * 1.25 + 4096 * 12.0::DOUBLE / 1e6, 6) AS worst FROM segment", "segment")
def cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    typical, worst = adjudication.item_cost(F.col("duration_ms"), F.lit(5), "medium", 2.0, 2.0, 12.0)
    return segments(spark, d).select("segment_id", F.round(typical, 6).alias("typical"), F.round(worst, 6).alias("worst"))


@query(
    "cap_running_sum",
    "SELECT segment_id, coalesce(CAST(sum(duration_ms) OVER w AS BIGINT), 0) AS spent_before, coalesce(CAST(sum(duration_ms) OVER w AS BIGINT), 0) + duration_ms <= 500000 AS admitted FROM segment WINDOW w AS (PARTITION BY relative_dir ORDER BY segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "segment",
)
def cap_running_sum(spark: SparkSession, d: str) -> DataFrame:
    return adjudication.admitted(segments(spark, d), "duration_ms", 500_000, "relative_dir", [F.col("segment_id")]).select("segment_id", "spent_before", "admitted")


@query("nasr_cycle", "SELECT o_orderkey AS segment_id, CAST(DATE '2026-09-03' + CAST(floor(date_diff('day', DATE '2026-09-03', CAST(o_orderdate AS DATE)) / 28.0) * 28 AS INTEGER) AS DATE) AS cycle FROM orders")
def nasr_cycle(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("segment_id"), temporal.cycle_start(F.to_date("o_orderdate")).alias("cycle"))


@query("hour_partitions", "SELECT hour, count(*) AS n FROM (SELECT unnest(generate_series(date_trunc('hour', ts - INTERVAL 20 MINUTE), date_trunc('hour', ts + INTERVAL 20 MINUTE), INTERVAL 1 HOUR)) AS hour FROM events) GROUP BY hour")
def hour_partitions(spark: SparkSession, d: str) -> DataFrame:
    hours = temporal.hours_covering(F.col("ts") - F.expr("interval 20 minutes"), F.col("ts") + F.expr("interval 20 minutes"))
    return table(spark, d, "events").select(F.explode(hours).alias("hour")).groupBy("hour").agg(F.count("*").alias("n"))


# Snapshots and state


@query(
    "scan_lifecycle",
    """SELECT coalesce(o.p, n.p) AS relative_path, coalesce(n.h, o.h) AS digest, CASE WHEN n.p IS NOT NULL THEN 'present' ELSE 'missing' END AS presence, CASE WHEN o.h <> n.h THEN 'changed' ELSE 'ok' END AS integrity,
 CASE WHEN o.p IS NULL THEN 'inserted' WHEN n.p IS NULL AND o.was = 'missing' THEN 'still_missing' WHEN n.p IS NULL THEN 'missing' WHEN o.was = 'missing' THEN 'reappeared' WHEN o.h <> n.h THEN 'changed' ELSE 'updated' END AS outcome
 FROM (SELECT relative_path AS p, md5(CAST(duration_ms AS VARCHAR)) AS h, presence_status AS was FROM segment WHERE channel IS DISTINCT FROM 'GND') o
 FULL OUTER JOIN (SELECT relative_path AS p, md5(CAST(CASE WHEN channel = 'TWR' THEN duration_ms + 1 ELSE duration_ms END AS VARCHAR)) AS h FROM segment WHERE channel IS DISTINCT FROM 'APP') n ON o.p = n.p""",
    "segment",
)
def scan_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    rows, digest = segments(spark, d), lambda c: F.md5(c.cast("string").cast("binary"))
    known = rows.filter(~F.col("channel").eqNullSafe("GND")).select("relative_path", digest(F.col("duration_ms")).alias("digest"), F.col("presence_status").alias("presence"))
    changed = F.when(F.col("channel") == "TWR", F.col("duration_ms") + 1).otherwise(F.col("duration_ms"))
    seen = rows.filter(~F.col("channel").eqNullSafe("APP")).select("relative_path", digest(changed).alias("digest"))
    return lifecycle.scan(known, seen, "relative_path", "digest")


@query(
    "merge_latest",
    """SELECT relative_dir, sum(n)::BIGINT AS n, max(v) AS v FROM (SELECT relative_dir, count(*) AS n, 1 AS v FROM segment WHERE relative_dir NOT IN (SELECT relative_dir FROM segment WHERE channel = 'TWR') GROUP BY relative_dir
 UNION ALL SELECT relative_dir, count(*), 2 FROM segment WHERE channel = 'TWR' GROUP BY relative_dir) GROUP BY relative_dir""",
    "segment",
)
def merge_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = segments(spark, d)
    current = rows.groupBy("relative_dir").agg(F.count("*").alias("n")).withColumn("v", F.lit(1))
    changes = rows.filter("channel = 'TWR'").groupBy("relative_dir").agg(F.count("*").alias("n")).withColumn("v", F.lit(2))
    return lifecycle.upsert(current, changes, ["relative_dir"])


@query("result_replacement", "SELECT segment_id, model_id, status, attempt, seq FROM result QUALIFY row_number() OVER (PARTITION BY segment_id, model_id ORDER BY status <> 'error' DESC, attempt DESC, created_at DESC, seq DESC) = 1", "result")
def result_replacement(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.standing_result(results(spark, d), ["segment_id", "model_id"]).select("segment_id", "model_id", "status", "attempt", "seq")


_STEPS = ", ".join(f"('{s}', '{a}', '{n}')" for (s, a), n in lifecycle.RUN_STEPS.items())
_STATE = "CASE status WHEN 'error' THEN 'failed' WHEN 'abstained' THEN 'running' ELSE 'completed' END"
_ACTION = "CASE attempt WHEN 1 THEN 'retry' WHEN 2 THEN 'finish' WHEN 3 THEN 'release' ELSE 'claim' END"


@query(
    "state_transitions",
    f"""SELECT r.state, r.action, coalesce(t.n, r.state) AS new_state, t.n IS NULL AS refused, count(*) AS n_rows FROM (SELECT {_STATE} AS state, {_ACTION} AS action FROM result) r
 LEFT JOIN (VALUES {_STEPS}) t(s, a, n) ON r.state = t.s AND r.action = t.a GROUP BY ALL""",
    "result",
)
def state_transitions(spark: SparkSession, d: str) -> DataFrame:
    rows = results(spark, d).select(F.expr(_STATE).alias("state"), F.expr(_ACTION).alias("action"))
    return lifecycle.stepped(rows, "state", "action").groupBy("state", "action", "new_state", "refused").agg(F.count("*").alias("n_rows"))


@query(
    "gold_import_diff",
    """SELECT n.doc_id, CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN o.lang IS NOT DISTINCT FROM n.lang AND o.source IS NOT DISTINCT FROM n.source THEN 'unchanged' ELSE 'conflict' END AS outcome
 FROM (SELECT doc_id, lower(lang) AS lang, source FROM documents) n LEFT JOIN (SELECT doc_id, lang, source FROM documents JOIN labels USING (doc_id)) o ON n.doc_id = o.doc_id""",
)
def gold_import_diff(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    current = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return lifecycle.import_diff(current, docs.withColumn("lang", F.lower("lang")), "doc_id", ["lang", "source"])


@query("settle_sweeps", "SELECT model_id, count(*) AS runs, CASE WHEN bool_and(status = 'success') THEN 'completed' WHEN bool_and(status <> 'abstained') THEN 'partial' ELSE 'running' END AS state FROM result GROUP BY model_id", "result")
def settle_sweeps(spark: SparkSession, d: str) -> DataFrame:
    state = F.expr("case status when 'success' then 'completed' when 'error' then 'failed' else 'running' end")
    return lifecycle.settled(results(spark, d).select("model_id", state.alias("state")), "model_id").select("model_id", "runs", "state")


@query("label_pivot", "SELECT source, count(*) FILTER (quality = 0) AS low, count(*) FILTER (quality = 1) AS high FROM labels JOIN documents USING (doc_id) GROUP BY source")
def label_pivot(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return rows.groupBy("source").pivot("quality", [0, 1]).agg(F.count("doc_id").alias("n")).na.fill(0).select("source", F.col("0").alias("low"), F.col("1").alias("high"))


@query("next_version", "SELECT relative_dir, max(CAST(segment_id AS BIGINT)) + 1 AS next_version, count(*) AS versions FROM segment GROUP BY relative_dir", "segment")
def next_version(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).groupBy("relative_dir").agg((F.max("segment_id") + 1).alias("next_version"), F.count("*").alias("versions"))


@query("last_wins", "SELECT model_id, attempt, arg_max(seq, (created_at, segment_id, seq)) AS seq FROM result GROUP BY model_id, attempt", "result")
def last_wins(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).groupBy("model_id", "attempt").agg(F.max_by("seq", F.struct("created_at", "segment_id", "seq")).alias("seq"))


@query("stalled_runs", f"SELECT user_id, max(ts) < {_NOW} - INTERVAL 10 MINUTE AS stalled FROM events GROUP BY user_id")
def stalled_runs(spark: SparkSession, d: str) -> DataFrame:
    from squelch.streaming.incremental import stalled

    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_result_at"))
    return stalled(last, F.expr("timestamp_ntz '2024-01-15 00:00:00'")).select("user_id", "stalled")


_TRAILS = """SELECT user_id, count(*) AS points, min(s) AS first_s, max(s) AS last_s, CAST(sum(s) AS BIGINT) AS sum_s FROM (
 SELECT user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n
 FROM (SELECT DISTINCT user_id, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS s FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL))
 WHERE n <= {most} OR round(round(i / ((n - 1) / {last}::DOUBLE)) * ((n - 1) / {last}::DOUBLE)) = i GROUP BY user_id"""


def _trails(spark: SparkSession, d: str, most: int) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("value").alias("lat"), F.col("value").alias("lon"))
    found = tracks.trails(rows.filter("user_id is not null and t is not null"), "user_id", "t", F.lit(0.0), most)
    offsets = F.col("trail.offset_s")
    return found.select("user_id", F.size("trail").cast("long").alias("points"), F.array_min(offsets).alias("first_s"), F.array_max(offsets).alias("last_s"), F.aggregate(offsets, F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_s"))


@query("trails", _TRAILS.format(most=64, last=63))
def trails(spark: SparkSession, d: str) -> DataFrame:
    """All users' points as ordered trails of at most 64 points: some users have fewer, some are thinned."""
    return _trails(spark, d, 64)


@query("trails_all", _TRAILS.format(most=40, last=39))
def trails_all(spark: SparkSession, d: str) -> DataFrame:
    """The same with 40 points, which every user exceeds."""
    return _trails(spark, d, 40)
