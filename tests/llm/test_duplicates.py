import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import pytest

from squelch.llm import neardup, queries, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_substring(rows, window=20):
    """Windows in order of (id, start); later ones of equal words are covered."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out.append((doc_id, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def passages(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)]
    shared = [[rng.choice(vocabulary) for _ in range(n)] for n in (20, 21, 25, 60, 19)]
    rows = []
    for k in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(shared)
        if k % 11 == 0:
            w = ["same"] * rng.randint(15, 70)
        rows.append((k, rng.choice((" ", "\n", "\t ")).join(w)))
    return [*rows, (60, None), (61, ""), (62, rows[7][1])]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substring_is_exact(spark, seed):
    rows = passages(seed)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(frame).collect())
    assert got == brute_substring(rows)


def test_cleaned_keeps_columns_and_untouched_texts(spark, odd, odd_rows, empty):
    found = substring.cleaned(odd)
    assert found.columns == odd.columns
    rows = found.collect()
    assert len(rows) == len(odd_rows)
    texts = {r.doc_id: r for r in rows}
    assert texts[0].text == odd_rows[0][1] and texts[0].source == odd_rows[0][3] and texts[0].slot == "s"
    assert texts[33].text == "" and texts[39].text == odd_rows[39][1]
    assert substring.cleaned(empty).count() == 0 and substring.remove_repeats(empty).count() == 0


def prose(rng, n):
    return [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randint(0, 400)}" for _ in range(n)]


def planted(seed=5):
    rng = random.Random(seed)
    texts, group = [], []
    for g in range(40):
        base = prose(rng, 150)
        texts.append(" ".join(base))
        group.append(g)
        for _ in range(g % 4):
            copy = list(base)
            copy[rng.randint(0, 149)] = "changed"
            texts.append(" ".join(copy))
            group.append(g)
    for k in range(30):  # a large group of exact copies
        texts.append(texts[0])
        group.append(0)
    return [(k, t) for k, t in enumerate(texts)], group


def test_near_copies_share_a_class_and_others_do_not(spark):
    rows, group = planted()
    odd = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "one two"), (None, rows[0][1])]
    frame = spark.createDataFrame(rows + odd, "doc_id long, text string").repartition(4)
    found = {r.doc_id: (r.class_id, r.class_size) for r in neardup.classes(frame).collect()}
    assert len(found) == len(rows) + len(odd)
    first = {}
    for (doc_id, _), g in zip(rows, group):
        first.setdefault(g, doc_id)
        assert found[doc_id][0] == first[g]
    assert found[1000] == (1000, 1) and found[1001] == (1001, 1) and found[1002] == (1002, 1)
    assert found[1004] == (1003, 2) and found[None][0] == 0


def test_keep_one_keeps_one_of_each(spark, odd, empty):
    rows, group = planted(6)
    frame = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, node string")
    kept = neardup.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({g: k for (k, _), g in reversed(list(zip(rows, group)))}.values())
    assert neardup.keep_one(odd).count() == neardup.classes(odd).select("class_id").distinct().count()
    assert neardup.keep_one(empty).count() == 0 and neardup.classes(empty).count() == 0


def test_weighted_similarity_is_estimated(spark):
    """The share of equal samples estimates the weighted Jaccard similarity."""
    import numpy as np

    rng = np.random.default_rng(1)
    ids = rng.integers(0, 2**48, 400, dtype=np.uint64)
    a, b = np.sort(ids[:300]), np.sort(ids[100:])
    weigh = {int(x): float(v) for x, v in zip(ids, rng.uniform(0.5, 8, 400).astype(np.float32))}
    text = np.repeat([0, 1], [300, 300])
    both = np.concatenate([a, b])
    _, sample = neardup.samples(text, both, np.array([weigh[int(x)] for x in both], np.float32))
    wa, wb = ({int(x): weigh[int(x)] for x in s} for s in (a, b))
    common = sum(v for k, v in wa.items() if k in wb)
    exact = common / (sum(wa.values()) + sum(wb.values()) - common)
    assert (sample[0] == sample[1]).mean() == pytest.approx(exact, abs=0.17)


def test_oracle_of_substring(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.execute(queries.ORACLES["op5_substring_dedup"]).fetchall())
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in queries.QUERIES["op5_substring_dedup"](spark, sf).collect())
    assert got == want


def test_empty_digest(spark):
    row = substring.remove_repeats(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()
    assert (row.n_words, row.kept_text) == (0, "") and hashlib.sha256(b"").hexdigest().startswith("e3b0")


def five(text):
    w = text.split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute_links(texts):
    """All pairs of texts whose TF-IDF shingles have a weighted Jaccard similarity of 0.8 or more."""
    bags, n = [five(t or "") for t in texts], len(texts)
    held = Counter(s for bag in bags for s in bag)
    weigh = {s: 1 + neardup.RARITY * math.log((n + 1) / (k + 1)) / math.log(n + 1) for s, k in held.items()}
    mass = [sum(c * weigh[s] for s, c in bag.items()) for bag in bags]
    for i in range(n):
        for j in range(i):
            common = sum(min(c, bags[j][s]) * weigh[s] for s, c in bags[i].items() if s in bags[j])
            if common and common / (mass[i] + mass[j] - common) >= 0.8 - 1e-9:
                yield i, j


def family(seed=8):
    """Forms about 0.7 alike with some true pairs, and a star of copies that are close to their original only."""
    rng = random.Random(seed)
    fresh = lambda n: [f"u{rng.getrandbits(60):x}" for _ in range(n)]
    form, texts = prose(rng, 128), []
    for k in range(400):
        fill = fresh(22)
        texts.append(" ".join(form + fill))
        if k % 40 == 0:
            texts.append(" ".join(form + fill[:11] + fresh(11)))
    original = prose(rng, 150)
    texts.append(" ".join(original))
    for k in range(60):
        at = rng.randint(5, 140)
        texts.append(" ".join(original[:at] + fresh(8) + original[at + 8 :]))
    rng.shuffle(texts)
    return texts


def test_classes_of_mixed_buckets_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 3_000)  # several blocks in a bucket
    texts = family()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, j in brute_links(texts):
        a, b = sorted((find(i), find(j)))
        root[b] = a
    want = {k: find(k) for k in range(len(texts))}
    assert sum(k != v for k, v in want.items()) >= 65
    assert {r.doc_id: r.class_id for r in neardup.classes(frame).collect()} == want


def test_keep_one_keeps_one_of_classes_that_share_the_least_id(spark):
    rng = random.Random(9)
    a, b, c, d = (" ".join(prose(rng, 60)) for _ in range(4))
    near = c.rsplit(" ", 1)[0] + " other"
    nulls = [(None, a), (None, a), (None, b), (None, b), (None, c), (None, near)]
    rows = [*nulls, (5, d), (5, d + " more"), (6, d)]
    kept = sorted(r.text for r in neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert len(kept) == 4 and kept.count(a) == kept.count(b) == 1 and (c in kept) != (near in kept)
    x, y = (" ".join(prose(rng, 60)) for _ in range(2))
    shared = spark.createDataFrame([(5, x), (5, y), (7, x), (8, y)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in neardup.keep_one(shared).collect()) == sorted([(5, x), (5, y)])
