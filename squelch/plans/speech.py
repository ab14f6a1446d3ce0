"""Queries over texts and hypotheses: normalizers, agreement, evaluation, review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squelch.functions import sequence, text
from squelch.functions.lexicon import CONVERSATIONAL_PHRASES, FILLER_TOKENS, NEAR_THRESHOLD, OFF_DOMAIN_PHRASES
from squelch.operators import agreement, evaluation, quality, review
from squelch.sources.views import hypotheses, segments, table, transmissions, with_views

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None, *views: str):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_views(sql, *views) if views else sql
        return f

    return register


# Text

_MARKUP = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\[/?#[^\]]*\]', ' ', 'g'), '\(\([^)]*\)\)', ' ', 'g'), '\[[^\]]*\]', ' ', 'g'), '<[^>]*>', ' ', 'g')"
_SCORING = r"list_filter(regexp_split_to_array(regexp_replace(lower(" + _MARKUP + r"), '[\p{{P}}\p{{S}}]', ' ', 'g'), '[\p{{Z}}\x09-\x0D\x85]+'), lambda t: t <> '')"
_EVIDENCE = r"list_filter(list_transform(regexp_split_to_array(lower({}), '[\p{{Z}}\x09-\x0D\x85]+'), lambda t: trim(t, '\"''`“”‘’.,;:!?()[]{{}}<>')), lambda t: t <> '')".replace("\\\"", '"')


@query("strip_markup_pages", "SELECT page_id, md5(" + _MARKUP.format("html") + ") AS digest FROM pages WHERE html IS NOT NULL")
def strip_markup_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").filter("html is not null").select("page_id", F.md5(text.strip_markup(F.col("html")).cast("binary")).alias("digest"))


@query("scoring_normalize", "SELECT doc_id, md5(array_to_string(" + _SCORING.format("coalesce(text, '')") + ", ' ')) AS digest FROM documents")
def scoring_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.scoring_text(F.col("text")).cast("binary")).alias("digest"))


_SPELL = "['zero','one','two','three','four','five','six','seven','eight','nine']"


@query(
    "canonical_numbers",
    "SELECT doc_id, md5(array_to_string(flatten(list_transform(" + _SCORING.format("coalesce(text, '')") + f""", lambda t: CASE WHEN regexp_full_match(t, '[0-9]+')
 THEN list_transform(string_split(t, ''), lambda c: {_SPELL}[CAST(c AS INTEGER) + 1])
 ELSE [CASE t WHEN 'niner' THEN 'nine' WHEN 'tree' THEN 'three' WHEN 'fife' THEN 'five' WHEN 'fower' THEN 'four' WHEN 'decimal' THEN 'point' WHEN 'dot' THEN 'point' ELSE t END] END)), ' ')) AS digest FROM documents""",
)
def canonical_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.scoring_text(F.col("text"), True).cast("binary")).alias("digest"))


@query("evidence_normalize", "SELECT doc_id, md5(array_to_string(" + _EVIDENCE.format("coalesce(text, '')") + ", ' ')) AS digest FROM documents")
def evidence_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.evidence_text(F.col("text")).cast("binary")).alias("digest"))


@query(
    "parse_filename",
    r"""SELECT event_id, regexp_extract(n, '^(.+?)_(\d{8})_(\d{6})_(\d+)\.[a-z0-9]+$', 1) AS label, event_type AS channel, strptime(strftime(ts, '%Y%m%d%H%M%S'), '%Y%m%d%H%M%S') AS wall, user_id AS frequency_hz
 FROM (SELECT *, concat('ST', user_id % 9, '_', event_type, '_', strftime(ts, '%Y%m%d_%H%M%S'), '_', user_id, '.mp3') AS n FROM events)""",
)
def parse_filename(spark: SparkSession, d: str) -> DataFrame:
    name = F.expr("concat('rec/ST', user_id % 9, '_', event_type, '_', date_format(ts, 'yyyyMMdd_HHmmss'), '_', user_id, '.mp3')")
    rows = table(spark, d, "events").select("event_id", text.parse_recording_name(name).alias("p"))
    return rows.select("event_id", "p.label", "p.channel", "p.wall", "p.frequency_hz")


@query("search_ilike_escaped", r"SELECT doc_id FROM documents WHERE text ILIKE '%50\%%' ESCAPE '\' OR text ILIKE '%the \_%' ESCAPE '\' OR text ILIKE '%_ THE%'")
def search_ilike_escaped(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").filter(text.contains_text(t, "50%") | text.contains_text(t, "the _") | t.ilike("%_ THE%")).select("doc_id")


@query("search_any_scope", "SELECT DISTINCT id FROM (SELECT doc_id AS id FROM documents WHERE text ILIKE '%the %' UNION ALL SELECT conv_id FROM conversations WHERE text ILIKE '%the %' UNION ALL SELECT item_id FROM benchmark WHERE text ILIKE '%the %')")
def search_any_scope(spark: SparkSession, d: str) -> DataFrame:
    scopes = {"documents": "doc_id", "conversations": "conv_id", "benchmark": "item_id"}
    return review.matching_ids({name: (table(spark, d, name), key, "text") for name, key in scopes.items()}, "the ")


@query(
    "quality_flags_native",
    "WITH n AS (SELECT doc_id, " + _EVIDENCE.format("coalesce(text, '')") + " AS ts FROM documents), f AS (SELECT doc_id, ts, array_to_string(ts, ' ') AS s FROM n)\n"
    + "SELECT doc_id, array_to_string(list_filter([CASE WHEN len(ts) = 0 THEN 'empty' WHEN len(list_filter(ts, lambda t: NOT list_contains(" + str(list(FILLER_TOKENS)) + ", t))) = 0 THEN 'filler_only' END,"
    + " CASE WHEN " + " OR ".join("contains(s, '" + p.replace("'", "''") + "')" for p in OFF_DOMAIN_PHRASES) + " THEN 'off_domain_phrase' END,"
    + " CASE WHEN " + " OR ".join("contains(s, '" + p.replace("'", "''") + "')" for p in CONVERSATIONAL_PHRASES) + " THEN 'conversational_phrase' END], lambda x: x IS NOT NULL), ',') AS flags FROM f",
)
def quality_flags_native(spark: SparkSession, d: str) -> DataFrame:
    empty, _, off, talk, _, _ = quality.native_flags(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_compact(F.array(empty, off, talk)), ",").alias("flags"))


@query("quality_flags")
def quality_flags(spark: SparkSession, d: str) -> DataFrame:
    """All ten flags of every transmission that a model transcribed."""
    rows = hypotheses(spark, d).filter("status = 'success'")
    return quality.with_flags(rows.select("segment_id", "model", "text"), "text", F.lit(4000), F.lit("en"), F.lit("en")).drop("text")


@query("flag_counts_unnest")
def flag_counts_unnest(spark: SparkSession, d: str) -> DataFrame:
    # The outer form: for the other, Catalyst infers a filter on the flags, for which it computes all of them, and the tokens anew for each use.
    return quality_flags(spark, d).select("model", F.explode_outer("flags").alias("flag")).filter("flag is not null").groupBy("model", "flag").agg(F.count("*").alias("n"))


# Agreement


@query(
    "exact_groups",
    "SELECT segment_id, norm, count(*) AS providers, count(DISTINCT family) AS families, arg_min(trim(text), model) AS text FROM heard GROUP BY segment_id, norm",
    "hyp",
)
def exact_groups(spark: SparkSession, d: str) -> DataFrame:
    return agreement.exact_groups(hypotheses(spark, d)).select("segment_id", "norm", "providers", "families", "text")


_SUMMARY = """g AS (SELECT segment_id, norm, count(*) AS p, count(DISTINCT family) AS f FROM heard GROUP BY segment_id, norm),
t AS (SELECT segment_id, arg_min(struct_pack(norm := norm, p := p, f := f), (-f, -p, norm)) AS t FROM g GROUP BY segment_id),
c AS (SELECT segment_id, count(*) AS results, count(*) FILTER (status = 'success') AS successes, count(*) FILTER (status = 'abstained') AS abstained, count(*) FILTER (status = 'error') AS errors FROM hyp GROUP BY segment_id),
summary AS (SELECT c.*, coalesce(t.t.f, 0) AS exact_families, coalesce(t.t.p, 0) AS exact_providers, t.t.norm AS exact_norm FROM c LEFT JOIN t USING (segment_id))"""


def _after_hyp(sql: str) -> str:
    return with_views("", "hyp").rstrip() + ",\n" + _SUMMARY + "\n" + sql


@query("agreement_summary", _after_hyp("SELECT * FROM summary"))
def agreement_summary(spark: SparkSession, d: str) -> DataFrame:
    return agreement.summary(hypotheses(spark, d))


_LCS = """lpair AS MATERIALIZED (SELECT row_number() OVER () AS pk, x, y, string_split(x, ' ') AS xs, string_split(y, ' ') AS ys FROM (
 SELECT DISTINCT a.norm AS x, b.norm AS y FROM heard a JOIN heard b ON a.segment_id = b.segment_id AND a.norm < b.norm)),
lcs_rows AS (
 SELECT pk, CAST(0 AS BIGINT) AS j, list_transform(xs, lambda t: CAST(0 AS BIGINT)) AS best FROM lpair
 UNION ALL
 SELECT pk, j + 1, list_transform(range(1, len(reach) + 1), lambda i: list_max(reach[1:i])) FROM (
  SELECT d.pk, d.j, list_transform(range(1, len(p.xs) + 1), lambda i: greatest(d.best[i], CASE WHEN p.xs[i] = p.ys[d.j + 1] THEN 1 + CASE WHEN i = 1 THEN 0 ELSE d.best[i - 1] END ELSE 0 END)) AS reach
  FROM lcs_rows d JOIN lpair p ON p.pk = d.pk WHERE d.j < len(p.ys))),
alike AS MATERIALIZED (SELECT p.x, p.y, r.best[len(p.xs)] / greatest(len(p.xs), len(p.ys))::DOUBLE AS s FROM lcs_rows r JOIN lpair p ON p.pk = r.pk WHERE r.j = len(p.ys)),
sim AS MATERIALIZED (SELECT a.segment_id, a.model AS a_model, a.family AS a_family, b.model AS b_model, b.family AS b_family, CASE WHEN a.norm = b.norm THEN 1.0 ELSE l.s END AS s
 FROM heard a JOIN heard b ON a.segment_id = b.segment_id LEFT JOIN alike l ON l.x = least(a.norm, b.norm) AND l.y = greatest(a.norm, b.norm))"""
_NEAR = f"""link AS (SELECT segment_id, a_model, b_family, max(s) AS s FROM sim WHERE a_family <> b_family GROUP BY ALL),
around AS (SELECT h.segment_id, h.model, count(*) FILTER (l.s >= {NEAR_THRESHOLD}) AS size, coalesce(min(l.s) FILTER (l.s >= {NEAR_THRESHOLD}), -1) AS link, max(l.s) AS most FROM heard h LEFT JOIN link l ON l.segment_id = h.segment_id AND l.a_model = h.model GROUP BY ALL),
near AS (SELECT segment_id, size, CASE WHEN size > 0 THEN link END AS weakest, model AS anchor, max(most) OVER (PARTITION BY segment_id) AS max_pair FROM around QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY size DESC, link DESC, model) = 1)"""


def _with_lcs(sql: str, *more: str) -> str:
    return with_views("", "hyp").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + ",\n".join([_LCS, *more]) + "\n" + sql


@query("contains_run", "SELECT segment_id, model FROM heard WHERE contains(concat(' ', norm, ' '), ' of the ')", "hyp")
def contains_run(spark: SparkSession, d: str) -> DataFrame:
    said = agreement.spoken(hypotheses(spark, d))
    return said.filter(sequence.contains_run(F.col("tokens"), F.array(F.lit("of"), F.lit("the")))).select("segment_id", "model")


@query("lcs_similarity_pairs", _with_lcs("SELECT segment_id, a_model, b_model, s AS similarity FROM sim WHERE a_model < b_model"))
def lcs_similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    return agreement.pair_similarities(hypotheses(spark, d)).filter("a_model < b_model").select("segment_id", "a_model", "b_model", "similarity")


@query("near_groups", _with_lcs("SELECT segment_id, CAST(size + 1 AS INTEGER) AS near_families, weakest, anchor, max_pair FROM near", _NEAR))
def near_groups(spark: SparkSession, d: str) -> DataFrame:
    return agreement.near_groups(hypotheses(spark, d)).select("segment_id", "near_families", "weakest", "anchor", "max_pair")


@query(
    "medoid_representative",
    _with_lcs(
        """SELECT c.*, exact_families, exact_providers, coalesce(near.size + 1, 0) AS near_families, round_even(near.weakest, 4) AS weakest, round_even(near.max_pair, 4) AS max_pair,
 CASE WHEN exact_families >= 2 THEN 'exact' WHEN near.size >= 1 THEN 'near' WHEN m.n = 1 THEN 'single' WHEN m.n > 1 THEN 'medoid' END AS kind,
 CASE WHEN exact_families >= 2 THEN x.text WHEN near.size >= 1 THEN y.text ELSE m.text END AS representative
 FROM (SELECT segment_id, results, successes, abstained, errors FROM summary) c JOIN (SELECT segment_id, exact_families, exact_providers, exact_norm FROM summary) e USING (segment_id)
 LEFT JOIN near USING (segment_id) LEFT JOIN m USING (segment_id)
 LEFT JOIN (SELECT segment_id, norm, arg_min(trim(text), model) AS text FROM heard GROUP BY ALL) x ON x.segment_id = c.segment_id AND x.norm = e.exact_norm
 LEFT JOIN (SELECT segment_id, model, trim(text) AS text FROM heard) y ON y.segment_id = c.segment_id AND y.model = near.anchor""",
        _NEAR, _SUMMARY,
        """t2 AS (SELECT segment_id, a_model, sum(s ORDER BY b_model) AS total FROM sim GROUP BY ALL),
m AS (SELECT h.segment_id, count(*) AS n, arg_min(trim(h.text), (-round(total, 9), h.model)) AS text FROM heard h JOIN t2 ON t2.segment_id = h.segment_id AND t2.a_model = h.model GROUP BY h.segment_id)""",
    ),
)
def medoid_representative(spark: SparkSession, d: str) -> DataFrame:
    return agreement.agreement(hypotheses(spark, d))


@query(
    "model_evidence",
    _with_lcs(
        """SELECT model, spoken, abstained, errors, over_silence, compared, mean_similarity, near, exact FROM (
 SELECT model, sum(spoke)::BIGINT AS spoken, count(*) FILTER (status = 'abstained') AS abstained, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (spoke = 1 AND others_spoke = 0 AND others_quiet >= 2) AS over_silence FROM (
  SELECT *, sum(spoke) OVER (PARTITION BY segment_id) - spoke AS others_spoke, count(*) FILTER (status = 'abstained') OVER (PARTITION BY segment_id) - (status = 'abstained')::INT AS others_quiet
  FROM (SELECT p.*, (h.model IS NOT NULL)::INT AS spoke FROM hyp p LEFT JOIN heard h ON h.segment_id = p.segment_id AND h.model = p.model)) GROUP BY model) a
 LEFT JOIN (SELECT model, count(*) AS compared, avg(s) AS mean_similarity, count(*) FILTER (s >= """
        + str(NEAR_THRESHOLD)
        + """) AS near, count(*) FILTER (s >= 0.9999) AS exact FROM (SELECT r.model, CASE WHEN r.norm = r.ref THEN 1.0 ELSE l.s END AS s FROM refs r LEFT JOIN alike l ON l.x = least(r.norm, r.ref) AND l.y = greatest(r.norm, r.ref)) GROUP BY model) b USING (model)""",
        """grp AS (SELECT segment_id, norm AS g_norm, list_distinct(list(family)) AS fams, count(*) AS p FROM heard GROUP BY segment_id, norm),
refs AS (SELECT h.segment_id, h.model, h.norm, g.g_norm AS ref FROM heard h JOIN grp g ON g.segment_id = h.segment_id WHERE len(list_filter(g.fams, lambda f: f <> h.family)) >= 2
 QUALIFY row_number() OVER (PARTITION BY h.segment_id, h.model ORDER BY len(list_filter(g.fams, lambda f: f <> h.family)) DESC, g.p DESC, g.g_norm) = 1)""",
    ),
)
def model_evidence(spark: SparkSession, d: str) -> DataFrame:
    return agreement.evidence(hypotheses(spark, d))


@query("has_any_family", "SELECT segment_id FROM hyp WHERE status = 'error' GROUP BY segment_id HAVING list_has_any(array_agg(DISTINCT family), ['qwen3-asr', 'whisper'])", "hyp")
def has_any_family(spark: SparkSession, d: str) -> DataFrame:
    families = hypotheses(spark, d).filter("status = 'error'").groupBy("segment_id").agg(F.collect_set("family").alias("all_families"))
    return families.filter(F.arrays_overlap("all_families", F.array(F.lit("qwen3-asr"), F.lit("whisper")))).select("segment_id")


@query("sweep_transcripts", "SELECT segment_id, count(*) AS models, max(CASE WHEN model = 'qwen-a' THEN text END) AS qwen FROM hyp GROUP BY segment_id", "hyp")
def sweep_transcripts(spark: SparkSession, d: str) -> DataFrame:
    return review.transcripts(hypotheses(spark, d)).select("segment_id", F.size("by_model").cast("long").alias("models"), F.col("by_model")["qwen-a"]["text"].alias("qwen"))


# Evaluation, with canary-a as gold


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return hypotheses(spark, d).filter("model = 'canary-a' and status = 'success'").select("segment_id", "text")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.scores(_gold(spark, d), hypotheses(spark, d).filter("model <> 'canary-a'"))


# One number holds errors, substitutions, deletions and insertions, so the least of it is the least of the four in order.
_SUB, _DEL, _INS = (1 << 45) + (1 << 30), (1 << 45) + (1 << 15), (1 << 45) + 1
_EVAL = f"""gold AS (SELECT segment_id, text FROM hyp WHERE model = 'canary-a' AND status = 'success'),
toks AS MATERIALIZED (SELECT g.segment_id, p.model, p.status, {_SCORING.format("g.text")} AS r, CASE WHEN p.status = 'success' THEN {_SCORING.format("p.text")} ELSE [] END AS h FROM gold g JOIN hyp p ON p.segment_id = g.segment_id WHERE p.model <> 'canary-a'),
tpair AS MATERIALIZED (SELECT row_number() OVER () AS pk, r, h FROM (SELECT DISTINCT r, h FROM toks)),
edit_rows AS (
 SELECT pk, CAST(0 AS BIGINT) AS i, list_transform(range(0, len(h) + 1), lambda j: j * {_INS}) AS cost FROM tpair
 UNION ALL
 SELECT pk, i + 1, list_transform(range(1, len(base) + 1), lambda j: list_min(list_transform(range(list_max(starts[1:j]), j + 1), lambda k: base[k] + (j - k) * {_INS}))) FROM (
  SELECT *, list_transform(range(1, len(base) + 1), lambda j: CASE WHEN j = 1 OR h[j - 1] = r[i + 1] THEN j ELSE 1 END) AS starts FROM (
   SELECT d.pk, d.i, p.h, p.r, list_transform(range(1, len(d.cost) + 1), lambda j: CASE WHEN j = 1 THEN (d.i + 1) * {_DEL} WHEN p.h[j - 1] = p.r[d.i + 1] THEN d.cost[j - 1] ELSE least(d.cost[j - 1] + {_SUB}, d.cost[j] + {_DEL}) END) AS base
   FROM edit_rows d JOIN tpair p ON p.pk = d.pk WHERE d.i < len(p.r)))),
counted AS (SELECT p.r, p.h, e.cost[len(p.h) + 1] AS c FROM edit_rows e JOIN tpair p ON p.pk = e.pk WHERE e.i = len(p.r)),
scored AS MATERIALIZED (SELECT t.segment_id, t.model, t.status, c.c >> 45 AS errors, (c.c >> 30) & 32767 AS s, (c.c >> 15) & 32767 AS d, c.c & 32767 AS i, len(t.r) AS ref_tokens, array_to_string(t.r, ' ') AS ref_text, array_to_string(t.h, ' ') AS hyp_text
 FROM toks t JOIN counted c ON c.r = t.r AND c.h = t.h)"""


def _evaluated(sql: str) -> str:
    return with_views("", "hyp").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + _EVAL + "\n" + sql


@query("levenshtein_cer")
def levenshtein_cer(spark: SparkSession, d: str) -> DataFrame:
    """Distances in characters; the oracle's function counts bytes, so a test checks this one."""
    said = hypotheses(spark, d).filter("model <> 'canary-a' and status = 'success'")
    return evaluation.character_errors(_gold(spark, d), said).select("segment_id", "model", F.col("char_errors").cast("long").alias("char_errors"), F.col("ref_chars").cast("long").alias("ref_chars"))


@query("edit_counts", _evaluated("SELECT segment_id, model, status, s, d, i, errors, ref_tokens, length(ref_text) AS ref_chars, ref_text = hyp_text AS exact FROM scored"))
def edit_counts(spark: SparkSession, d: str) -> DataFrame:
    """Without the distances in characters, which the checking engine can't count (see ``levenshtein_cer``)."""
    return _scored(spark, d).drop("char_errors")


@query(
    "eval_model_metrics",
    _evaluated("""SELECT model, count(*) AS segments, sum(s)::BIGINT AS s, sum(d)::BIGINT AS d, sum(i)::BIGINT AS i, sum(errors)::BIGINT AS errors, sum(ref_tokens)::BIGINT AS ref_tokens, sum(length(ref_text))::BIGINT AS ref_chars, count(*) FILTER (ref_text = hyp_text) AS exact,
 count(*) FILTER (status = 'abstained') AS abstained, count(*) FILTER (status IN ('error', 'missing')) AS failed, round_even(sum(errors)::DOUBLE / nullif(sum(ref_tokens), 0), 4) AS ter FROM scored GROUP BY model"""),
)
def eval_model_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Rates of tokens; those of characters are in ``levenshtein_cer``."""
    return evaluation.model_metrics(_scored(spark, d)).drop("char_errors", "cer")


@query("eval_best_single", _evaluated("SELECT arg_min(model, (errors, model)) AS model, min(errors) AS errors FROM (SELECT model, sum(errors)::BIGINT AS errors FROM scored GROUP BY model)"))
def eval_best_single(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.best_single(_scored(spark, d))


@query("eval_oracle", _evaluated("SELECT model, count(*) FILTER (errors = low) AS wins, sum(low)::BIGINT AS oracle_errors, sum(ref_tokens)::BIGINT AS ref_tokens FROM (SELECT *, min(errors) OVER (PARTITION BY segment_id) AS low FROM scored) GROUP BY model"))
def eval_oracle(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.oracle(_scored(spark, d))


@query("eval_by_split", _evaluated("SELECT CASE WHEN CAST(concat('0x', substr(sha256(CAST(segment_id AS VARCHAR)), 1, 2)) AS BIGINT) % 2 = 0 THEN 'calibration' ELSE 'test' END AS split, model, count(*) AS segments, round_even(sum(errors)::DOUBLE / nullif(sum(ref_tokens), 0), 4) AS ter FROM scored GROUP BY ALL"))
def eval_by_split(spark: SparkSession, d: str) -> DataFrame:
    from squelch.functions.hashing import parity_split

    return evaluation.by_split(_scored(spark, d), _gold(spark, d).select("segment_id", parity_split(F.col("segment_id").cast("string")).alias("split")))


@query(
    "eval_agreement_bins",
    with_views("", "hyp").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + _LCS + ",\n" + _EVAL
    + """,
low AS (SELECT segment_id, min(errors) AS low, any_value(ref_tokens) AS ref_tokens FROM scored GROUP BY segment_id), mean AS (SELECT segment_id, avg(s) AS m FROM sim WHERE a_model < b_model GROUP BY segment_id),
sums AS (SELECT (m >= 0.25)::INT + (m >= 0.5)::INT + (m >= 0.75)::INT AS bin, count(*) AS segments, sum(low)::BIGINT AS errors, sum(ref_tokens)::BIGINT AS ref_tokens FROM low JOIN mean USING (segment_id) GROUP BY 1)
SELECT CAST(k AS INTEGER) AS bin, coalesce(segments, 0) AS segments, coalesce(errors, 0) AS errors, coalesce(ref_tokens, 0) AS ref_tokens, round_even(errors::DOUBLE / nullif(ref_tokens, 0), 4) AS oracle_ter FROM range(4) r(k) LEFT JOIN sums ON k = bin""",
)
def eval_agreement_bins(spark: SparkSession, d: str) -> DataFrame:
    pairs = agreement.pair_similarities(hypotheses(spark, d)).filter("a_model < b_model")
    return evaluation.agreement_bins(_scored(spark, d), pairs.groupBy("segment_id").agg(F.avg("similarity").alias("mean_similarity")))


_SCORED_TEXT = "' ' || array_to_string(" + _SCORING.format("{}") + ", ' ') || ' '"


@query(
    "entity_recall",
    "spans AS (SELECT segment_id, 'callsign' AS kind, array_to_string(w[1:2], ' ') AS said FROM tl WHERE len(w) >= 6 UNION ALL SELECT segment_id, 'command', array_to_string(w[3:5], ' ') FROM tl WHERE len(w) >= 6),\n"
    "asked AS (SELECT segment_id, kind, " + _SCORED_TEXT.replace("{}", "said") + " AS span FROM spans),\n"
    "told AS (SELECT segment_id, model, " + _SCORED_TEXT.replace("{}", "CASE WHEN status = 'success' THEN text ELSE '' END") + " AS t FROM hyp)\n"
    "SELECT model, kind, count(*) AS spans, count(*) FILTER (contains(t, span)) AS recovered, round_even(count(*) FILTER (contains(t, span))::DOUBLE / count(*), 4) AS recall FROM asked JOIN told USING (segment_id) WHERE trim(span) <> '' GROUP BY model, kind",
    "hyp",
)
def entity_recall(spark: SparkSession, d: str) -> DataFrame:
    tagged = transmissions(spark, d).filter(F.size("words") >= 6).select(
        "segment_id", F.concat(F.lit("[#callsign]"), F.concat_ws(" ", F.slice("words", 1, 2)), F.lit("[/#callsign] [#command]"), F.concat_ws(" ", F.slice("words", 3, 3)), F.lit("[/#command]")).alias("text")
    )
    return evaluation.entity_recall(tagged, hypotheses(spark, d))


@query("word_diff")
def word_diff(spark: SparkSession, d: str) -> DataFrame:
    said = hypotheses(spark, d).filter("status = 'success'").select("segment_id", "model", F.array_remove(F.split("text", " "), "").alias("ws"))
    a, b = said.filter("model = 'canary-a'").select("segment_id", F.col("ws").alias("before")), said.filter("model = 'whisper-a'").select("segment_id", F.col("ws").alias("after"))
    return a.join(b, "segment_id").select("segment_id", sequence.changes(F.col("before"), F.col("after")).alias("changes"))


# Review: every segment of orders is reviewed by its counts


def _review_rows(spark: SparkSession, d: str, every: bool = False) -> DataFrame:
    """Segments with agreement counters from their results, and an annotation for some.

    Three errors leave a segment without counters, unless ``every`` segment with a result keeps them.
    """
    from squelch.sources.views import models, results

    rows = results(spark, d).join(models(spark, d).select("model_id", "family"), "model_id")
    ok = F.col("status") == "success"
    # By family first: distinct families are then plain sums, and no row is copied for each distinct count.
    families = rows.groupBy("segment_id", "family").agg(
        F.count("*").alias("n"), F.max(ok.cast("int")).alias("spoke"), F.max((ok & (F.col("attempt") == 1)).cast("int")).alias("exact"),
        F.count_if(F.col("status") == "error").alias("e"), F.count_if(F.col("status") == "abstained").alias("a"),
    )
    agreed = families.groupBy("segment_id").agg(
        F.sum("n").alias("results"), F.sum("spoke").alias("utterance_families"), F.sum("exact").alias("exact_families"), F.sum("e").alias("errors"), F.sum("a").alias("abstained"), F.collect_list("family").alias("all_families"),
    )
    agreed = agreed if every else agreed.filter("errors < 3")
    notes = table(spark, d, "labels").selectExpr("doc_id as segment_id", "case when quality = 1 then 'reviewed' else 'rejected' end as review_status", "case when toxic = 1 then 'unusable' else 'usable' end as label")
    return segments(spark, d).join(agreed, "segment_id", "left").join(notes, "segment_id", "left")


_REVIEW = """agreed AS (SELECT segment_id, count(*) AS results, count(DISTINCT CASE WHEN status = 'success' THEN family END) AS utterance_families, count(DISTINCT CASE WHEN status = 'success' AND attempt = 1 THEN family END) AS exact_families,
 count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'abstained') AS abstained, list(DISTINCT family) AS all_families FROM result JOIN model USING (model_id) GROUP BY segment_id HAVING count(*) FILTER (status = 'error') < 3),
rev AS (SELECT s.*, a.* EXCLUDE (segment_id), CASE WHEN quality = 1 THEN 'reviewed' WHEN quality = 0 THEN 'rejected' END AS review_status, CASE WHEN toxic = 1 THEN 'unusable' WHEN toxic = 0 THEN 'usable' END AS label
 FROM segment s LEFT JOIN agreed a ON s.segment_id = a.segment_id LEFT JOIN labels l ON s.segment_id = l.doc_id)"""


_FEW_ERRORS = " HAVING count(*) FILTER (status = 'error') < 3"


def _review_sql(where: str, tail: str = "", every: bool = False) -> str:
    """By default a segment needs one result; untranscribed ones have none."""
    return with_views("", "segment", "result", "model").rstrip() + ",\n" + (_REVIEW.replace(_FEW_ERRORS, "") if every else _REVIEW) + f"\nSELECT segment_id FROM rev WHERE results >= 1 AND {where} {tail}"


_FILTERS = {
    "review_default": (review.Filters(), "role = 'corpus'"),
    "review_time_channel": (review.Filters(channels=["TWR", "APP"], utc_from="1995-01-01 00:00:00", utc_to="1997-01-01 00:00:00"), "role = 'corpus' AND channel IN ('TWR', 'APP') AND capture_start >= TIMESTAMP '1995-01-01' AND capture_start < TIMESTAMP '1997-01-01'"),
    "review_disagreement": (review.Filters(at_most={"exact_families": 1}, at_least={"utterance_families": 2}), "role = 'corpus' AND exact_families <= 1 AND utterance_families >= 2"),
    "review_partial_agreement": (review.VIEWS["partial-agreement"], "role = 'corpus' AND utterance_families >= 2 AND exact_families < 2"),
    "review_not_partial": (review.Filters(partial_agreement=False), "role = 'corpus' AND NOT (utterance_families >= 2 AND exact_families < 2)"),
    "review_coalesce_status": (review.Filters(statuses=["unreviewed", "rejected"], labels=["none", "usable"]), "role = 'corpus' AND coalesce(review_status, 'unreviewed') IN ('unreviewed', 'rejected') AND coalesce(label, 'none') IN ('none', 'usable')"),
    "review_with_errors": (review.Filters(has_error=True), "role = 'corpus' AND errors > 0"),
    "review_no_abstention": (review.Filters(has_abstention=False, include_benchmark=True), "abstained = 0"),
    "review_named_benchmark": (review.Filters(sources=[0, 3]), "source_id IN (0, 3)"),
    "review_empty_lists": (review.Filters(sources=[], channels=[], statuses=[], labels=[], any_family=[], stations=[]), "role = 'corpus'"),
    "review_untranscribed": (review.Filters(min_models=0), None),
    "review_two_results": (review.Filters(min_models=2, any_family=["NATION_3", "NATION_11"]), "role = 'corpus' AND results >= 2 AND list_has_any(all_families, ['NATION_3', 'NATION_11'])"),
}
#: Filters of time, channel, status and label need no counters: no segment with a result is left out for its errors.
_EVERY = ("review_time_channel", "review_coalesce_status")
for _name, (_filters, _where) in _FILTERS.items():

    @query(_name, _review_sql(_where, every=_name in _EVERY) if _where else _review_sql("role = 'corpus'").replace("results >= 1 AND ", ""))
    def reviewed(spark: SparkSession, d: str, filters: review.Filters = _filters, every: bool = _name in _EVERY) -> DataFrame:
        return review.query(_review_rows(spark, d, every), filters).select("segment_id")


def _full_rows(spark: SparkSession, d: str) -> DataFrame:
    """Segments with all that the saved views ask for, made from their results and labels."""
    from squelch.sources.views import models, results

    rows = results(spark, d).join(models(spark, d).select("model_id", "family"), "model_id")
    ok = F.col("status") == "success"
    said = lambda least: F.max((ok & (F.col("attempt") < least)).cast("int"))
    span = F.when(F.col("status") == "abstained", F.when(F.col("seq") % 2 == 0, "silver").otherwise("none"))
    # By model, by family, by segment: no distinct counts, so no copies of rows.
    by_model = rows.groupBy("segment_id", "family", "model_id").agg(
        F.count("*").alias("n"), F.count_if(ok).alias("s"), F.count_if(F.col("status") == "error").alias("e"), F.count_if(F.col("status") == "abstained").alias("a"), said(99).alias("u"), said(4).alias("m"), said(3).alias("x"), said(5).alias("p"),
        F.max(F.when(ok, F.col("seq") % 9)).alias("w"), F.collect_set(span).alias("spans"),
    )
    by_family = by_model.groupBy("segment_id", "family").agg(*[F.sum(c).alias(c) for c in ("n", "s", "e", "a", "p")], *[F.max(c).alias(c) for c in ("u", "m", "x", "w")], F.flatten(F.collect_list("spans")).alias("spans"))
    agreed = by_family.groupBy("segment_id").agg(
        F.sum("n").alias("results"), F.sum("s").alias("successes"), F.sum("e").alias("errors"), F.sum("a").alias("abstained"), F.sum("u").alias("utterance_families"), F.sum("m").alias("near_families"), F.sum("x").alias("exact_families"),
        F.sum("p").alias("exact_providers"), F.max("w").alias("words"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("span_labels"),
    )
    notes = table(spark, d, "labels").selectExpr(
        "doc_id as segment_id", "case when quality = 1 then 'corrected' else 'unreviewed' end as review_status",
        "case when toxic = 1 then 'none' when quality = 0 then 'candidate' when doc_id % 3 = 0 then 'silver' else 'gold' end as label",
    )
    return segments(spark, d).join(agreed, "segment_id", "left").join(notes, "segment_id", "left")


_FULL = """full_agreed AS (SELECT segment_id, count(*) AS results, count(*) FILTER (status = 'success') AS successes, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'abstained') AS abstained,
 count(DISTINCT CASE WHEN status = 'success' THEN family END) AS utterance_families, count(DISTINCT CASE WHEN status = 'success' AND attempt < 4 THEN family END) AS near_families,
 count(DISTINCT CASE WHEN status = 'success' AND attempt < 3 THEN family END) AS exact_families, count(DISTINCT CASE WHEN status = 'success' AND attempt < 5 THEN model_id END) AS exact_providers,
 max(CASE WHEN status = 'success' THEN seq % 9 END) AS words, bool_or(status = 'abstained' AND seq % 2 = 0) AS usable_span FROM result JOIN model USING (model_id) GROUP BY segment_id),
rev AS (SELECT s.*, a.* EXCLUDE (segment_id), CASE WHEN quality = 1 THEN 'corrected' WHEN quality = 0 THEN 'unreviewed' END AS review_status,
 CASE WHEN toxic = 1 THEN 'none' WHEN quality = 0 THEN 'candidate' WHEN doc_id % 3 = 0 THEN 'silver' WHEN doc_id IS NOT NULL THEN 'gold' END AS label
 FROM segment s LEFT JOIN full_agreed a ON s.segment_id = a.segment_id LEFT JOIN labels l ON s.segment_id = l.doc_id)"""
_VIEW_WHERE = {
    "exact-2-families-3-words": "exact_families >= 2 AND words >= 3",
    "partial-agreement": "utterance_families >= 2 AND exact_families < 2",
    "utterance-3-families": "utterance_families >= 3",
    "exact-2-families": "exact_families >= 2",
    "exact-3-providers": "exact_providers >= 3",
    "near-3-families": "near_families >= 3",
    "high-agreement-unreviewed": "exact_families >= 2 AND coalesce(review_status, 'unreviewed') = 'unreviewed'",
    "human-corrected": "review_status = 'corrected'",
    "silver-candidates": "label IN ('candidate', 'silver')",
    "gold": "label = 'gold'",
    "disagreement": "successes >= 2 AND exact_families <= 1 AND near_families <= 1",
    "partial-usable": "coalesce(usable_span, false) AND coalesce(label, 'none') NOT IN ('gold', 'silver')",
    "errors-abstentions": "errors > 0 OR abstained > 0",
}
for _key, _where in _VIEW_WHERE.items():

    @query("view_" + _key.replace("-", "_"), with_views("", "segment", "result", "model").rstrip() + ",\n" + _FULL + f"\nSELECT segment_id FROM rev WHERE role = 'corpus' AND ({_where}) AND {'true' if _key == 'partial-usable' else 'results >= 1'}")
    def viewed(spark: SparkSession, d: str, key: str = _key) -> DataFrame:
        return review.query(_full_rows(spark, d), review.VIEWS[key]).select("segment_id")


@query("review_page", _review_sql("role = 'corpus'", "ORDER BY duration_ms DESC NULLS LAST, segment_id DESC LIMIT 100 OFFSET 50"))
def review_page(spark: SparkSession, d: str) -> DataFrame:
    return review.ordered(review.query(_review_rows(spark, d), review.Filters()), "duration_ms", True, 50, 100).select("segment_id")


# Text search in the review: parts' types are what models heard, market segments what people wrote

_TEXTS = """heard_text AS (SELECT segment_id, logical_name AS model, concat(p_type, ' ', p_brand) AS text FROM result JOIN model USING (model_id) JOIN part ON p_partkey = seq WHERE status = 'success'),
consensus AS (SELECT segment_id, min(text) AS text FROM heard_text GROUP BY segment_id), human AS (SELECT o_orderkey AS segment_id, c_mktsegment AS text FROM orders JOIN customer ON o_custkey = c_custkey JOIN labels ON doc_id = o_orderkey)"""


def _texts(spark: SparkSession, d: str) -> review.Texts:
    from squelch.sources.views import models, results

    part = table(spark, d, "part").selectExpr("p_partkey as seq", "concat(p_type, ' ', p_brand) as text")
    heard = results(spark, d).filter("status = 'success'").join(models(spark, d), "model_id").join(part, "seq").selectExpr("segment_id", "logical_name as model", "text")
    human = table(spark, d, "orders").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey")).join(table(spark, d, "labels"), F.expr("doc_id = o_orderkey")).selectExpr("o_orderkey as segment_id", "c_mktsegment as text")
    return review.Texts(heard, heard.groupBy("segment_id").agg(F.min("text").alias("text")), human)


_SEARCHES = {
    "review_search_any": (review.Filters(q="an"), "segment_id IN (SELECT segment_id FROM human WHERE text ILIKE '%an%' UNION SELECT segment_id FROM consensus WHERE text ILIKE '%an%' UNION SELECT segment_id FROM heard_text WHERE text ILIKE '%an%')"),
    "review_search_human": (review.Filters(q="BUILD", scope="human"), "segment_id IN (SELECT segment_id FROM human WHERE text ILIKE '%build%')"),
    "review_search_consensus": (review.Filters(q="econ", scope="consensus"), "segment_id IN (SELECT segment_id FROM consensus WHERE text ILIKE '%econ%')"),
    "review_search_hypotheses": (review.Filters(q="#1", scope="hypotheses"), "segment_id IN (SELECT segment_id FROM heard_text WHERE text ILIKE '%#1%')"),
    "review_search_model": (review.Filters(q="o", scope="model", scope_model="Supplier#000000007"), "segment_id IN (SELECT segment_id FROM heard_text WHERE text ILIKE '%o%' AND model = 'Supplier#000000007')"),
    "review_search_model_alone": (review.Filters(scope="model", scope_model="Supplier#000000007"), "segment_id IN (SELECT segment_id FROM heard_text WHERE model = 'Supplier#000000007')"),
}
for _name, (_filters, _where) in _SEARCHES.items():

    @query(_name, with_views("", "segment", "result", "model").rstrip() + ",\n" + _REVIEW + ",\n" + _TEXTS + f"\nSELECT segment_id FROM rev WHERE results >= 1 AND role = 'corpus' AND {_where}")
    def searched(spark: SparkSession, d: str, filters: review.Filters = _filters) -> DataFrame:
        return review.query(_review_rows(spark, d), filters, _texts(spark, d)).select("segment_id")


@query("review_airport", with_views("", "segment", "result", "model").rstrip() + ",\n" + _REVIEW + "\nSELECT segment_id FROM rev WHERE results >= 1 AND role = 'corpus' AND source_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def review_airport(spark: SparkSession, d: str) -> DataFrame:
    """Sources stand for stations, regions for airports with several of them."""
    aliases = table(spark, d, "nation").selectExpr("concat('K', n_regionkey) as icao", "cast(n_nationkey as bigint) as station")
    rows = _review_rows(spark, d).withColumn("station", F.col("source_id"))
    return review.query(rows, review.Filters(airport="K1"), aliases=aliases).select("segment_id")


def _spans(spark: SparkSession, d: str) -> DataFrame:
    from squelch.sources.views import results

    return results(spark, d).filter("status = 'abstained'").select("segment_id")


@query("review_exists_span", "SELECT segment_id FROM segment WHERE EXISTS (SELECT 1 FROM result r WHERE r.segment_id = segment.segment_id AND r.status = 'abstained')", "segment", "result")
def review_exists_span(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).join(_spans(spark, d), "segment_id", "left_semi").select("segment_id")


@query("review_not_exists_span", "SELECT segment_id FROM segment WHERE NOT EXISTS (SELECT 1 FROM result r WHERE r.segment_id = segment.segment_id AND r.status = 'abstained')", "segment", "result")
def review_not_exists_span(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).join(_spans(spark, d), "segment_id", "left_anti").select("segment_id")


@query(
    "review_partial_usable",
    "SELECT segment_id, EXISTS (SELECT 1 FROM result r WHERE r.segment_id = segment.segment_id AND r.status = 'abstained') AND coalesce(toxic, 1) <> 0 AS partial_usable FROM segment LEFT JOIN labels ON doc_id = segment_id",
    "segment", "result",
)
def review_partial_usable(spark: SparkSession, d: str) -> DataFrame:
    has = _spans(spark, d).distinct().withColumn("has", F.lit(True))
    rows = segments(spark, d).join(has, "segment_id", "left").join(table(spark, d, "labels").withColumnRenamed("doc_id", "segment_id"), "segment_id", "left")
    return rows.select("segment_id", (F.coalesce("has", F.lit(False)) & (F.coalesce("toxic", F.lit(1)) != 0)).alias("partial_usable"))


@query("stream_equals_batch", _after_hyp("SELECT * FROM summary"))
def stream_equals_batch(spark: SparkSession, d: str) -> DataFrame:
    """Hypotheses as a stream of files, agreement kept by micro-batches, then read as one table."""
    from squelch.session import shared_folder
    from squelch.streaming import incremental

    store = shared_folder(spark, "stream")
    hyp = hypotheses(spark, d)
    hyp.repartition(4, "segment_id").write.parquet(f"{store}/incoming")
    stream = spark.readStream.schema(hyp.schema).option("maxFilesPerTrigger", 2).parquet(f"{store}/incoming")
    incremental.follow(stream, store, spark).awaitTermination()
    return incremental.current_rows(spark, store)


_MUTED = (_after_hyp("SELECT * FROM summary")).replace("FROM hyp WHERE status = 'success'", "FROM hyp WHERE status = 'success' AND model <> 'canary-b'").replace("FROM hyp GROUP BY segment_id), ", "FROM hyp WHERE model <> 'canary-b' GROUP BY segment_id), ").replace("FROM hyp GROUP BY segment_id),\n", "FROM hyp WHERE model <> 'canary-b' GROUP BY segment_id),\n")


@query("voting_change", _MUTED)
def voting_change(spark: SparkSession, d: str) -> DataFrame:
    """Agreement kept by micro-batches, in which every model runs twice, after one model has lost its vote."""
    from squelch.session import shared_folder
    from squelch.streaming import incremental

    store = shared_folder(spark, "votes")
    hyp = hypotheses(spark, d)
    hyp.withColumn("text", F.lit("an earlier run")).withColumn("status", F.lit("success")).repartition(2, "segment_id").write.parquet(f"{store}/incoming/run=1")
    schema = spark.read.parquet(f"{store}/incoming/run=1").schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 2).parquet(f"{store}/incoming")
    incremental.follow(stream, store, spark).awaitTermination()
    hyp.repartition(2, "segment_id").write.parquet(f"{store}/incoming/run=2")
    incremental.follow(stream, store, spark).awaitTermination()
    incremental.decide(spark, store, "canary-b", False)
    return incremental.current_rows(spark, store)


# What else the library answers


@query("max_pair_similarity", _with_lcs("SELECT segment_id, max_pair FROM near", _NEAR))
def max_pair_similarity(spark: SparkSession, d: str) -> DataFrame:
    """The greatest similarity of two families' texts in each segment."""
    return agreement.compared(hypotheses(spark, d)).filter("near.anchor is not null").select("segment_id", "near.max_pair")


@query("worst_segments", _evaluated("SELECT segment_id, min(errors) AS errors, any_value(ref_tokens) AS ref_tokens, round_even(min(errors)::DOUBLE / nullif(any_value(ref_tokens), 0), 4) AS ter FROM scored GROUP BY segment_id"))
def worst_segments(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.worst_segments(_scored(spark, d))


@query("eval_fair_best", _evaluated("SELECT arg_min(model, (errors, place)) AS model, min(errors) AS errors FROM (SELECT model, sum(errors)::BIGINT AS errors, CASE model WHEN 'parakeet-a' THEN 0 WHEN 'whisper-a' THEN 1 WHEN 'canary-b' THEN 2 ELSE 3 END AS place FROM scored WHERE model <> 'canary-b' GROUP BY model)"))
def eval_fair_best(spark: SparkSession, d: str) -> DataFrame:
    """The best of the models that weren't trained on the benchmark."""
    registry = [("parakeet-a", 0, ["other"]), ("whisper-a", 1, None), ("canary-b", 2, ["Bench"]), ("qwen-a", 3, [])]
    models = spark.createDataFrame(registry, "model string, execution_order int, contaminated_benchmarks array<string>")
    return evaluation.best_single(evaluation.fair_only(_scored(spark, d), models, "bench-1h"))


@query(
    "segment_detail",
    _after_hyp("SELECT t.segment_id, n_len, n_hypotheses, s.exact_families, s.exact_providers, h.texts FROM tl t JOIN summary s USING (segment_id) JOIN (SELECT segment_id, count(*) AS n_hypotheses, string_agg(coalesce(text, '-'), '|' ORDER BY model) AS texts FROM hyp GROUP BY segment_id) h USING (segment_id)"),
)
def segment_detail(spark: SparkSession, d: str) -> DataFrame:
    """One document for each transmission: its fields, its hypotheses in model order, its agreement."""
    hyp = hypotheses(spark, d)
    whole = review.detail(transmissions(spark, d).select("segment_id", "n_len"), hyp, agreement.summary(hyp))
    texts = F.array_join(F.transform("hypotheses", lambda h: F.coalesce(h["text"], F.lit("-"))), "|")
    return whole.select("segment_id", "n_len", F.size("hypotheses").cast("long").alias("n_hypotheses"), "agreement.exact_families", "agreement.exact_providers", texts.alias("texts"))
