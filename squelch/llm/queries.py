"""The thirteen operators as queries over the driver's tables, and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squelch.llm import alignment, clustering, codes, fingerprint, langid, mixing, neardup, neighbours, packing, pseudolm, quality, sharding, substring

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    """Where the public tokenizers lie on this machine (and on each executor's)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir).select("doc_id", "source", "text"), keep=["doc_id"])
    return mixed.select("doc.doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("copies")).alias("taken"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: rows whose id is divisible by 100; candidates: all rows."""
    return neighbours.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, 10)


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size")


def op4_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = codes.write_tokens(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"), 0)
    return codes.read_digests(segments)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


CAPACITY = 4096


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.token_pieces(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"), 1, CAPACITY)
    return packing.pack(cut, CAPACITY)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned where crc32(doc_id) mod 4 is not 2; a null id counts as not held out, and nothing is learned from it."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = langid.fit(docs.filter(~held_out), "text", "lang", "doc_id")
    return langid.predict(docs, model, "text", ["doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out")])


def op9_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pseudolm.score(docs, pseudolm.fit(docs), ["doc_id"])


SHARDS = [f"shard-{k:03d}" for k in range(64)]


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placement of every document by its id."""
    return sharding.shard(documents(spark, sf_dir).select("doc_id"), ["doc_id"], SHARDS).select("doc_id", "slot", "shard", "shard_name")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 components times 1024, 8 centroids, 10 rounds."""
    found = clustering.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.against_next(documents(spark, sf_dir).select("doc_id", "text"))


QUERIES: dict[str, Query] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_minhash_neardup": op3_minhash_neardup,
    "op4_token_codes": op4_token_codes,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_language_id": op8_language_id,
    "op9_pseudo_likelihood": op9_pseudo_likelihood,
    "op10_sharding": op10_sharding,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_document_fingerprints": op13_document_fingerprints,
}

def _clusters_sql(k: int = 8, rounds: int = 10) -> str:
    """The rounds of op11 written out one after another, in whole numbers."""
    far = "list_sum(list_transform(range(1, 65), lambda i: CAST(v[i] - c[i] AS HUGEINT) * (v[i] - c[i])))"
    steps = [
        "e AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "p AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM e)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS j, v AS c FROM p WHERE vec_id IS NOT NULL QUALIFY j < {k})",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT id, vec_id, v, min({{'d': {far}, 'j': j}}) AS m FROM p, c{r} GROUP BY ALL)")
        if r < rounds:
            steps.append(f"""t{r} AS (SELECT m.j AS j, i, CAST(sum(v[i]) AS HUGEINT) AS s, count(*) AS n FROM a{r}, range(1, 65) g(i) GROUP BY ALL),
n{r} AS (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM t{r} GROUP BY j),
c{r + 1} AS MATERIALIZED (SELECT c{r}.j, coalesce(n{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN n{r} ON c{r}.j = n{r}.j)""")
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(m.j AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.j) AS BIGINT) AS cluster_inertia,
  CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON m.j = j"""
    )


def _digest_sql(source: str) -> str:
    """Of each row (k, t): the length's code and the codes of the 256 buckets."""
    return f"""(SELECT k, list(code ORDER BY b) AS codes, any_value(length_code) AS length_code FROM (
  SELECT k, b, length_code, (n > l[64])::INT + (n > l[128])::INT + (n > l[192])::INT AS code FROM (
   SELECT z.k, z.b, z.length_code, coalesce(c.n, 0) AS n, list_sort(list(coalesce(c.n, 0)) OVER (PARTITION BY z.k)) AS l FROM (
     SELECT k, b, CAST(CASE WHEN size = 0 THEN 0 ELSE least(255, 1 + floor(8 * log2(size))) END AS INT) AS length_code FROM (SELECT k, strlen(t) AS size FROM {source}), range(256) r(b)) z
   LEFT JOIN (SELECT k, b, count(*) AS n FROM (
     SELECT k, ((b1 * 40503 + b2 * 30011 + b3 * 10007) % 65521) % 256 AS b FROM (
      SELECT k, unnest(x[1:len(x) - 2]) AS b1, unnest(x[2:len(x) - 1]) AS b2, unnest(x[3:len(x)]) AS b3 FROM (
       SELECT k, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: CAST('0x' || h AS INT)) AS x FROM {source}) WHERE len(x) >= 3)) GROUP BY ALL) c
   ON z.k = c.k AND z.b = c.b)) GROUP BY k)"""


_HEX = "lower(printf('%02x', {0}.length_code) || array_to_string(list_transform(range(64), lambda i: printf('%02x', {0}.codes[4 * i + 1] * 64 + {0}.codes[4 * i + 2] * 16 + {0}.codes[4 * i + 3] * 4 + {0}.codes[4 * i + 4])), ''))"
_NEAR = "1 - least(416, list_sum(list_transform(range(1, 257), lambda i: [0, 1, 2, 6][abs({0}.codes[i] - {1}.codes[i]) + 1])) + least(40, abs({0}.length_code - {1}.length_code))) / 416.0::DOUBLE"

ORACLES: dict[str, str] = {
    "op11_centroid_clustering": _clusters_sql(),
    "op13_document_fingerprints": f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id, coalesce(text, '') AS t FROM documents),
e AS MATERIALIZED (SELECT k, doc_id, t, length(t) AS n, CASE WHEN k = max(k) OVER () THEN 1 ELSE k + 1 END AS k2 FROM d),
x AS MATERIALIZED (SELECT e.k, e.k2, e.doc_id, e.n, left(e.t, e.n - e.n // 4) || left(u.t, e.n // 4) AS t FROM e JOIN d u ON u.k = e.k2),
f AS MATERIALIZED {_digest_sql('d')},
g AS MATERIALIZED {_digest_sql('x')}
SELECT x.doc_id, CAST(x.n AS BIGINT) AS n_chars, sha256(x.t) AS edited_sha256, {_HEX.format('f')} AS fingerprint, {_HEX.format('g')} AS edited_fingerprint,
 {_NEAR.format('f', 'g')} AS near_edited, {_NEAR.format('f', 'h')} AS near_next
FROM x JOIN f ON x.k = f.k JOIN g ON x.k = g.k JOIN f h ON x.k2 = h.k
""",
    "op5_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, ws FROM d WHERE len(ws) >= 20),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS nth FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM k WHERE nth > 1),
w AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM d),
r AS (SELECT w.doc_id, count(*) AS n_words, count(c.p) AS n_removed,
  string_agg(CASE WHEN c.p IS NULL THEN word END, ' ' ORDER BY w.p) AS kept
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id AND w.p = c.p GROUP BY w.doc_id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
""",
    "op7_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS k FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT k, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
h AS (SELECT k, i, count(*) OVER (PARTITION BY k, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g),
r AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM h WHERE c > 1) GROUP BY k),
f AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g')) AS BIGINT) AS n_upper,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r USING (k)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR 2 * n_upper > word_chars
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept FROM b
""",
}
