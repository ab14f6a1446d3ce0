"""Centroid clustering, tokenizer alignment and fingerprints against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from squelch.llm import alignment, clustering, fingerprint, queries

PATHS = (queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model"))


# Clustering


def plain_clusters(rows, k=8, rounds=10, dims=64):
    """Python integers only: (id, cluster, distance) and the centroids."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted(kept, key=lambda r: ("~" if r[0] is None else hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in named[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    assign = lambda: [min(range(len(centroids)), key=lambda j: (far(v, centroids[j]), j)) for _, v in kept]
    for _ in range(rounds):
        label = assign()
        for j in set(label):
            mine = [v for (_, v), x in zip(kept, label) if x == j]
            centroids[j] = [sum(column) // len(mine) for column in zip(*mine)]
    return [(i, j, far(v, centroids[j])) for (i, v), j in zip(kept, assign())], centroids


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, n string, cluster int").repartition(3)


def test_clusters_equal_brute_force(spark):
    rng = random.Random(5)
    draw = lambda s: [float(np.float32(rng.gauss(0, s))) for _ in range(64)]
    rows = [(k, draw(0.2)) for k in range(150)]
    rows += [(500 + k, rows[3][1]) for k in range(60)]  # copies
    rows += [rows[7], (None, draw(1)), (900, None), (901, []), (902, draw(1)[:63]), (903, [None, *draw(1)[1:]]), (904, [float("nan"), *draw(1)[1:]]), (905, [float("inf"), *draw(1)[1:]])]
    expected, centroids = plain_clusters(rows)
    got = clustering.cluster(vectors(spark, rows)).collect()
    assert sorted(((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance) for r in got)) == sorted((i is None, i or 0, j, d) for i, j, d in expected)
    assert all(r.centroid == centroids[r.cluster] for r in got)
    total = Counter()
    for _, j, d in expected:
        total[j] += d
    assert all(r.cluster_inertia == total[r.cluster] and r.inertia == sum(total.values()) for r in got)


def test_clusters_of_few_or_no_vectors(spark):
    few = clustering.cluster(vectors(spark, [(1, [0.5] * 64), (2, [0.5] * 64), (3, None)])).collect()
    assert [(r.cluster, r.distance) for r in few] == [(0, 0), (0, 0)]  # equal centroids: the smaller number
    assert clustering.cluster(vectors(spark, [])).collect() == []


def test_large_components_are_refused(spark):
    with pytest.raises(Exception, match="wouldn't fit"):
        clustering.cluster(vectors(spark, [(1, [1e30] * 64)])).collect()


@given(st.integers(0, 2**32 - 1), st.sampled_from([1, 40, 5_000, 10_000_000]), st.integers(1, 12))
@settings(max_examples=60, deadline=None)
def test_screen_never_rules_out_the_nearest(seed, size, k):
    rng = np.random.default_rng(seed)
    x = rng.integers(-size, size + 1, (200, 64)).astype(np.int32)
    centroids = rng.integers(-size, size + 1, (k, 64))
    centroids = np.concatenate([centroids, centroids[:2], x[:3].astype(np.int64) + rng.integers(-1, 2, (3, 64))])
    apart = x.astype(np.int64)[:, None] - centroids
    assert (clustering.nearest(x, centroids) == (apart * apart).sum(2).argmin(1)).all()


# Alignment


def plain_alignment(texts):
    """Whole texts, all pairs of tokens: (per text a, b, groups, links) and how many texts link each pair."""
    both = alignment.Pair(*PATHS)
    found, counts = [], Counter()
    for text in texts:
        a = both.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = both.b.encode(text) if text else []
        if not text or b"".join(both.a_bytes[i] for i in a) != (" " + text).encode() or b"".join(both.b_bytes[i] for i in b) != (" " + text).encode():
            found.append(([], [], [], []))
            continue
        spans = []
        for ids, size in ((a, both.a_bytes), (b, both.b_bytes)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(size[i]), i))
                at += len(size[i])
            spans.append(own)
        links, low = [], 0
        for s, e, i in spans[0]:
            while spans[1][low][1] <= s:
                low += 1
            k = low
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, begin = [], 0
        for end in ends:
            groups.append(tuple([i for s, e, i in own if begin < e <= end] for own in spans) if len(ends) < 400 else None)
            begin = end
        found.append((a, b, groups, links))
        counts.update(set(links))
    return found, counts


def expected_rows(rows):
    found, counts = plain_alignment([t for _, t in rows])
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for (i, _), (a, b, groups, links) in zip(rows, found):
        digest = ""
        if a and None not in groups:
            digest = hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest()
        elif a:
            digest = None
        out.append((i, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), digest))
    return out


def as_key(row):
    return tuple((x is None, x if x is not None else 0) for x in row[:-1])


def test_alignment_equals_brute_force(spark, odd_rows):
    strange = ["a  b\n\nc \n", " ", "\n", "x\r\ny \r z\t\tw", "foo;\r\nbar", "a▁b", "<s> <|endoftext|> </s> <0x0A>", "    q　 r", "नमस्ते दुनिया 你好世界 안녕", "a\x00b c", "don't  it's\n 's", "🙂 \U0001f9d1‍\U0001f680 ok ", "tail   ", "\x1c \x1d a \x85 b", "K\u0000", "ﬁ ｆｕｌｌ é"]
    rows = [(r[0], r[1]) for r in odd_rows] + [(1000 + k, t) for k, t in enumerate(strange)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, chunk int, place int").repartition(4)
    got = [tuple(r) for r in alignment.align_documents(docs, *PATHS).collect()]
    want = expected_rows(rows)
    assert sorted(map(as_key, got)) == sorted(map(as_key, want))
    digests = Counter((g[0], g[-1]) for g in got)
    assert all(digests[(w[0], w[-1])] for w in want if w[-1] is not None)


def test_alignment_of_real_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").filter("doc_id < 60")
    rows = [tuple(r) for r in docs.collect()]
    got = [tuple(r) for r in alignment.align_documents(docs, *PATHS).collect()]
    assert sorted(map(as_key, got)) == sorted(map(as_key, expected_rows(rows)))


def test_alignment_of_nothing(spark, empty):
    assert alignment.align_documents(empty, *PATHS).collect() == []


@given(st.lists(st.text(st.sampled_from("ab.é ,'\n\r\t  ▁0<>s;{}\x1c我​"), max_size=25), max_size=8))
@settings(max_examples=300, deadline=None)
def test_segments_encode_as_whole_texts(texts):
    both = alignment.pair_of(*PATHS)
    whole = [" " + t for t in texts if t]
    raw, offsets = alignment.text_buffer(pa.array(whole, pa.large_string()))
    start, of_text = alignment.cuts(raw, offsets, both.safe_blanks())
    segments = [raw[a:b].tobytes().decode() for a, b in zip(start, [*start[1:], len(raw)])]
    a, b = both.encoded(segments)
    for k, t in enumerate(whole):
        mine = [j for j in range(len(segments)) if of_text[j] == k]
        assert sum((a[j] for j in mine), []) == both.a.encode(t, add_special_tokens=False).ids
        assert sum((b[j] for j in mine), []) == both.b.encode(t[1:])


def test_carriage_returns_are_no_cuts():
    safe = alignment.pair_of(*PATHS).safe_blanks()
    assert b" " in safe and b"\n" in safe and b"\r" not in safe  # the second vocabulary has pieces that end in one


# Fingerprints


def plain_digest(text: str) -> list[int]:
    """The length's code and the code of each bucket, counted one triplet at a time."""
    data = text.encode()
    counts = Counter((a * 40503 + b * 30011 + c * 10007) % 65521 % 256 for a, b, c in zip(data, data[1:], data[2:]))
    every = [counts[k] for k in range(256)]
    ranked = sorted(every)
    length = 0 if not data else min(255, 1 + math.floor(8 * math.log2(len(data))))
    return [length, *[(c > ranked[63]) + (c > ranked[127]) + (c > ranked[191]) for c in every]]


def plain_likeness(a, b):
    apart = sum({0: 0, 1: 1, 2: 2, 3: 6}[abs(x - y)] for x, y in zip(a[1:], b[1:])) + min(40, abs(a[0] - b[0]))
    return 1 - min(apart, 416) / 416


def in_hex(digest):
    packed = [digest[0], *[(a << 6) + (b << 4) + (c << 2) + d for a, b, c, d in zip(*[digest[1 + k :: 4] for k in range(4)])]]
    return bytes(packed).hex()


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_fingerprints_equal_brute_force(spark, odd, odd_rows, parts):
    ordered = sorted(((r[0], r[1] or "") for r in odd_rows), key=lambda r: (r[0] is not None, r[0] or 0))  # repeated ids have equal texts here
    want = Counter()
    for (i, t), (_, u) in zip(ordered, ordered[1:] + ordered[:1]):
        q = len(t) // 4
        edited = t[: len(t) - q] + u[:q]
        a, e, n = plain_digest(t), plain_digest(edited), plain_digest(u)
        want[(i, len(t), hashlib.sha256(edited.encode()).hexdigest(), in_hex(a), in_hex(e), plain_likeness(a, e), plain_likeness(a, n))] += 1
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = Counter(tuple(r) for r in fingerprint.against_next(odd).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == want


def test_fingerprints_of_one_or_no_document(spark, empty):
    assert fingerprint.against_next(empty).collect() == []
    (row,) = fingerprint.against_next(spark.createDataFrame([(3, "abcdefgh")], "doc_id long, text string")).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and row.near_next == 1.0


def test_fingerprint_column_and_comparison(spark):
    docs = spark.createDataFrame([(1, "the same text", "x"), (2, "the same text", "y"), (3, None, "z"), (4, "", "w"), (5, "quite another one, and longer", "v")], "doc_id long, text string, fingerprint string")
    rows = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    assert rows[1].fingerprint == rows[2].fingerprint and rows[3].fingerprint == rows[4].fingerprint and rows[1].text == "the same text"
    pairs = spark.createDataFrame([(rows[1].fingerprint, rows[2].fingerprint), (rows[1].fingerprint, rows[5].fingerprint), (rows[1].fingerprint, None)], "a string, b string")
    got = [r[0] for r in pairs.select(fingerprint.compared(pairs.a, pairs.b)).collect()]
    assert got[0] == 1.0 and 0 <= got[1] < 0.9 and got[2] is None


def test_small_edits_stay_near(spark, sf):
    rows = fingerprint.against_next(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert sum(r.near_edited > r.near_next for r in rows) > 0.95 * len(rows)
