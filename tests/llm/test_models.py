import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from squelch.llm import langid, neighbours, pseudolm, quality, queries
from squelch.llm.words import fingerprints, words_of


def brute_nearest(rows, asked, k):
    out = {}
    for q, v in rows:
        if not asked(q):
            continue
        near = sorted((float(np.sqrt(((np.array(v) - np.array(x)) ** 2).sum())), i) for i, x in rows if i != q)
        out[q] = [i for _, i in near[:k]]
    return out


def test_neighbours_small_tables_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.normal(size=4)]) for k in range(90)]
    rows += [(100 + k, rows[0][1]) for k in range(30)]  # one vector many times
    bad = [(300, None), (310, [0.0] * 4), (320, [1.0, float("nan"), 0.0, 0.0]), (330, [1.0, None, 0.0, 0.0]), (340, [1.0, float("inf"), 0.0, 0.0]), (350, [1.0, 2.0]), (None, rows[1][1])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows + bad + [rows[3]]], "vec_id long, embedding array<double>, rank int")
    got = neighbours.search(frame, F.col("vec_id") % 10 == 0, 10).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found == brute_nearest(rows, lambda q: q % 10 == 0, 10)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert neighbours.search(few, F.col("vec_id") == 0, 10).count() == 2
    assert neighbours.search(few.limit(0), F.col("vec_id") == 0, 10).count() == 0


def test_neighbours_recall(spark, sf):
    got = queries.QUERIES["op2_nearest_neighbours"](spark, sf).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute_nearest(rows, lambda q: q % 100 == 0, 10)
    hits = sum(r.vec_id in want[r.query_id] for r in got)
    assert hits / sum(map(len, want.values())) >= 0.9


def test_balanced_parts_are_balanced():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 8))
    graph = neighbours._nearest(x, x, 6, np.arange(800))
    label = neighbours.balanced_parts(graph, x, 8)
    assert np.bincount(label, minlength=8).max() <= 800 / 8 * 1.06 + 1
    inside = (label[graph] == label[:, None]).mean()
    assert inside > 0.25  # 1/8 by chance


def measured(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def test_quality_features(spark, odd, odd_rows, empty):
    extra = [(900, "a b c a b c a b c d", None), (901, "# | x\n# | x\n\n# | x", None), (902, "x " * 200, None)]
    more = spark.createDataFrame(extra, "doc_id long, text string, lang string")
    rows = quality.judged(odd.select("doc_id", "text", "lang").unionByName(more)).select("doc.doc_id", "doc.text", "*").collect()
    assert len(rows) == len(odd_rows) + 3
    for r in rows:
        want = measured(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in rows if r.kept}
    assert {r.doc_id for r in quality.keep_good(odd.select("doc_id", "text", "lang").unionByName(more)).collect()} == kept
    assert quality.judged(empty).count() == 0 and quality.keep_good(empty).columns == empty.columns


def test_rules_are_ordered_by_what_is_left(spark):
    rows = [(k, " ".join(["word"] * 60)) for k in range(30)] + [(100 + k, "few words") for k in range(10)]
    rows += [(200 + k, " ".join(f"w{j}" for j in range(60))) for k in range(60)]
    order = quality.rule_order(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x["rule"].name for x in order} == {r.name for r in quality.RULES}
    left = 1.0
    for x in order:
        left *= 1 - x["rejected"]
    assert left == pytest.approx(0.6)  # the shares are of what the rules before leave
    assert max(x["rejected"] / x["cost"] for x in order) == order[0]["rejected"] / order[0]["cost"]


def test_windows_that_share_hash_bits_are_told_apart(spark, monkeypatch):
    """With a hash of few bits, equal windows are still found, and different ones are not."""
    narrow = {k: (needs, sql.replace("xxhash64(get(words, i), get(words, i + 1), get(words, i + 2))", "(length(get(words, i)) + length(get(words, i + 2)) * 2)")) for k, (needs, sql) in quality.FEATURES.items()}
    monkeypatch.setattr(quality, "FEATURES", {**narrow, "narrow": (("hashes", "repeats"), "not repeats")})
    text = "a b c d e f a b c g h i j a b c k"
    assert quality.measured(spark.createDataFrame([(text,)], "text string"), ("n_repeat_words",)).first().n_repeat_words == 9


def test_quality_main_path_is_native(spark, odd):
    plan = quality.judged(odd)._jdf.queryExecution().toString()
    assert not re.search(r"ArrowEval|BatchEvalPython|MapInArrow|MapInPandas|FlatMapGroups", plan)


def test_quality_oracle(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(map(tuple, queries.QUERIES["op7_quality_rules"](spark, sf).collect())) == sorted(con.execute(queries.ORACLES["op7_quality_rules"]).fetchall())


def test_language_id(spark, sf, odd, empty):
    rows = queries.QUERIES["op8_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in rows if r.held_out and r.lang and r.text and re.search(r"[^\W\d_]", r.text)]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.9
    assert all(0 <= r.score <= 1 for r in rows)
    model = langid.fit(odd, "text", "lang", "doc_id")
    got = {r.doc_id: r for r in langid.predict(odd, model, "text", ["doc_id"]).collect()}
    assert got[30].lang_pred == got[31].lang_pred == got[32].lang_pred == "und" and got[0].lang_pred in ("en", "fr")
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(empty, "text", "lang", "doc_id"), "text", ["doc_id"]).collect()} == {"und"}
    assert langid.predict(empty, model, "text", ["doc_id"]).count() == 0


def test_language_of_few_documents_is_learned(spark):
    """The bound of the sample holds for each language; priors come from all labelled documents."""
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choices(["the", "house", "water", "walks"], k=20)), "en") for k in range(400)]
    rows += [(1_000 + k, " ".join(rng.choices(["xuz", "qof", "zyx"], k=20)), "rare") for k in range(4)]
    frame = spark.createDataFrame([*rows, (None, None, "en"), (None, "the house", None)], "doc_id long, text string, lang string")
    model = langid.fit(frame, "text", "lang", "doc_id", train_docs=20)
    assert model.langs == ["en", "rare"] and np.exp(model.prior) == pytest.approx([400 / 404, 4 / 404])
    asked = spark.createDataFrame([(1, "xuz zyx qof qof"), (2, "the water walks")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(asked, model, "text", ["doc_id"]).collect()} == {1: "rare", 2: "en"}


@pytest.fixture(scope="module")
def chains(spark):
    """Sentences in which each word depends on its neighbours."""
    rng = random.Random(3)
    follow = {k: [(3 * k + j) % 50 for j in (1, 2)] for k in range(50)}
    rows = []
    for doc in range(400):
        w, k = [], rng.randrange(50)
        for _ in range(120):
            w.append(f"t{k}")
            k = rng.choice(follow[k])
        rows.append((doc, " ".join(w)))
    return rows


def test_pseudo_likelihood_prefers_order(spark, chains):
    frame = spark.createDataFrame(chains, "doc_id long, text string").repartition(2)
    model = pseudolm.fit(frame, rounds=3)
    rng = random.Random(1)
    mixed = [(k, " ".join(rng.sample(t.split(), 120))) for k, t in chains[:60]] + [(900, None), (901, " "), (902, "t1")]
    other = {r.doc_id: r for r in pseudolm.score(spark.createDataFrame(mixed, "doc_id long, text string"), model, ["doc_id"]).collect()}
    own = {r.doc_id: r for r in pseudolm.score(frame, model, ["doc_id"]).collect()}
    assert all(own[k].mean_pll > other[k].mean_pll for k in range(60))
    assert np.mean([own[k].mean_pll for k in range(60)]) > np.log(1 / 50)  # better than guessing words
    assert (other[900].n_words, other[900].pll, other[900].mean_pll) == (0, 0.0, None) and other[901].n_words == 0 and other[902].n_words == 1


def test_pseudo_likelihood_is_a_distribution(spark, chains):
    model = pseudolm.fit(spark.createDataFrame(chains[:50], "doc_id long, text string"))
    w = model.words
    assert np.exp(w.within[: pseudolm.PAD].astype(float)).sum() == pytest.approx(len(set(w.word_class[: pseudolm.PAD])), rel=1e-3)
    share, total = model.net.shares(np.zeros((1, pseudolm.HIDDEN), np.float32))
    assert (share / total[:, None]).sum() == pytest.approx(1)


def test_pseudo_likelihood_against_brute_force(spark):
    """More words than the network knows; each word's log-probability from plain loops over plain counts."""
    rng = random.Random(8)
    common, uncommon = [f"c{k}" for k in range(8_000)], [f"u{k}" for k in range(3_000)]
    rows = [(k, " ".join(rng.sample(common, 2_000) + uncommon[k * 75 : k * 75 + 75])) for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = pseudolm.fit(frame)
    asked = [(0, rows[0][1]), (1, " ".join(uncommon[:60])), (2, " ".join(f"none{k}" for k in range(60))), (2, None), (None, "u1 c1 none1 u1")]
    got = {(r.doc_id, r.n_words): r for r in pseudolm.score(spark.createDataFrame(asked, "doc_id long, text string"), model, ["doc_id"]).collect()}
    assert len(got) == len(asked)

    def prints(text):
        return fingerprints(words_of(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])))

    counts = Counter(w for _, t in rows for w in prints(t).tolist())
    known = {w for w in counts if model.words.ids(np.array([w], np.uint64))[0] < pseudolm.KNOWN}
    total, distinct = Counter(), Counter()
    for w, n in counts.items():
        if w not in known:
            total[w % pseudolm.RARE] += n
            distinct[w % pseudolm.RARE] += 1
    net, words = model.net, model.words
    for doc, text in asked:
        if text is None:
            continue
        w = prints(text)
        ids = [pseudolm.PAD] * 2 + words.ids(w).tolist() + [pseudolm.PAD] * 2
        want = 0.0
        for k, one in enumerate(w.tolist()):
            h = np.tanh(sum(net.near[ids[k + p]][i * 8 : i * 8 + 8].astype(float) for i, p in enumerate((0, 1, 3, 4))))
            s = h @ net.out.astype(float) + net.bias
            want += s[words.word_class[ids[k + 2]]] - np.log(np.exp(s).sum()) + float(words.within[ids[k + 2]])
            if one not in known:
                b = one % pseudolm.RARE
                want += np.log((counts[one] + pseudolm.SMOOTHING) / (total[b] + pseudolm.SMOOTHING * (distinct[b] + 1)))
        assert got[doc, len(w)].pll == pytest.approx(want, rel=1e-4)
    assert got[1, 60].mean_pll > got[2, 60].mean_pll + 1  # words that occur nowhere are no prose


def test_pseudo_likelihood_edges(spark, odd, odd_rows, empty):
    model = pseudolm.fit(odd)
    rows = pseudolm.score(odd, model, ["doc_id"]).collect()
    assert len(rows) == len(odd_rows)
    assert {r.doc_id: r.n_words for r in rows}[36] == 30_000
    assert pseudolm.score(empty, pseudolm.fit(empty), ["doc_id"]).count() == 0
