"""Masked pseudo-likelihood of documents by a bidirectional window network.

The network predicts every word from the two before and the two after it: each
neighbour adds a vector that depends on the word and its place, a tanh follows,
and a softmax over word classes; within a class, words go by their corpus
frequencies. A document's score is the sum of its words' conditional
log-probabilities.

The network sees the most frequent words and buckets of all others, but a word
of a bucket has its own share of it: the table of all words and their counts
stays whole and grows with the corpus, and scoring joins it by word. A word
that the corpus lacks has only the smoothing's share.

Training is data-parallel: every task trains a copy of the network on all words
of its own documents, and the copies are averaged, weighted by their words. What
reaches the driver is one network and the buckets' sums, however large the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from squelch.llm.shared import pieces, stored, text_buffer
from squelch.llm.words import fingerprints, words_of

#: Known words (the most frequent ones), and buckets for all others; one more id stands between documents.
KNOWN, RARE = 7_680, 511
TOKENS = KNOWN + RARE + 1
#: What is added to each word's count in a bucket, and what words outside the corpus have there together.
SMOOTHING = 0.1
PAD = TOKENS - 1
REACH, HIDDEN = 2, 8
SINGLE, CLASSES = 32, 64
BATCH, RATE = 2_048, 0.12
_SLOTS = 18
_SLICES, _WAYS = 16, 16
_FIXED = float(1 << 20)  # copies are summed as integers, so their order can't change the average
_WEIGHT_WORDS = 1_024  # a copy weighs one for so many words: sums stay below 2^63 up to 10^15 words
_LOG_FIXED = float(1 << 30)  # likewise for the sums of logarithms of a document


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word (fingerprint) and n, over all words of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 4_000_000):
                words, counts = np.unique(fingerprints(words_of(*text_buffer(part.column("text")))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Ids of words by a table of slots, their classes, their log-shares of a class, and the log of each bucket's smoothed count."""

    slot_word: np.ndarray
    slot_id: np.ndarray
    word_class: np.ndarray
    within: np.ndarray
    class_share: np.ndarray
    bucket_total: np.ndarray

    def ids(self, prints: np.ndarray) -> np.ndarray:
        slot = (prints >> np.uint64(64 - _SLOTS)).astype(np.int64)
        known = self.slot_word[slot] == prints
        rare = (prints % np.uint64(RARE)).astype(np.int16) + np.int16(KNOWN)
        return np.where(known, self.slot_id[slot], rare)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The most frequent words (ties: by fingerprint) and the buckets' sums; at most ``TOKENS`` rows reach the driver."""
    top = [(np.uint64(r.word & (2**64 - 1)), r.n) for r in counts.orderBy(F.desc("n"), "word").limit(KNOWN).collect()]
    sums, distinct = np.zeros(TOKENS), np.zeros(RARE)
    # Of two known words in one slot the more frequent stays; the other is a rare word.
    slot_word, slot_id = np.zeros(1 << _SLOTS, np.uint64), np.zeros(1 << _SLOTS, np.int16)
    kept = []
    for word, n in top:
        slot = int(word >> np.uint64(64 - _SLOTS))
        if slot_word[slot] == 0:
            slot_word[slot], slot_id[slot] = word, len(kept)
            sums[len(kept)] = n
            kept.append((word, n))
    unsigned = F.expr(f"cast(cast(case when word >= 0 then cast(word as decimal(20,0)) else cast(word as decimal(20,0)) + 18446744073709551616 end as decimal(20,0)) % {RARE} as int)")
    for r in counts.groupBy(unsigned.alias("bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():  # RARE rows
        sums[KNOWN + r.bucket] = r.n
        distinct[r.bucket] = r.words
    for word, n in kept:
        sums[KNOWN + int(word % np.uint64(RARE))] -= n
        distinct[int(word % np.uint64(RARE))] -= 1
    bucket_total = np.log(sums[KNOWN:PAD] + SMOOTHING * (distinct + 1))
    order = np.argsort(-sums[:PAD], kind="stable")
    word_class = np.zeros(TOKENS, np.int64)
    word_class[order[:SINGLE]] = np.arange(SINGLE)
    rest = order[SINGLE:]
    share = np.sqrt(np.maximum(sums[rest], 0.25)).cumsum()
    word_class[rest] = SINGLE + np.minimum((share / share[-1] * (CLASSES - SINGLE)).astype(int), CLASSES - SINGLE - 1)
    smooth = sums + 0.1
    smooth[PAD] = 0
    of_class = np.bincount(word_class, smooth, CLASSES)
    of_class = np.maximum(of_class, 1e-9)
    within = np.log(np.maximum(smooth, 1e-300) / of_class[word_class])
    return Vocabulary(slot_word, slot_id, word_class.astype(np.int16), within.astype(np.float32), np.log(of_class / of_class.sum()).astype(np.float32), bucket_total)


@dataclass
class Stream:
    """The words of a batch: their ids, with ``REACH`` pads before each text and at the end; each text's first place; fingerprints, texts and places of the words."""

    ids: np.ndarray
    first: np.ndarray
    prints: np.ndarray
    text: np.ndarray
    place: np.ndarray


def stream(column: pa.Array, words: Vocabulary) -> Stream:
    w = words_of(*text_buffer(column))
    texts, text, prints = len(w.first) - 1, w.text_of(), fingerprints(w)
    ids, place = np.full(w.n + REACH * (texts + 1), PAD, np.int16), np.arange(w.n) + REACH * (text + 1)
    ids[place] = words.ids(prints)
    return Stream(ids, w.first[:-1] + REACH * np.arange(1, texts + 1), prints, text, place)


@dataclass
class Network:
    """Its size is fixed: TOKENS x 4 x HIDDEN and HIDDEN x CLASSES floats."""

    near: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, words: Vocabulary) -> Network:
        rng = np.random.default_rng(3)
        near = rng.normal(0, 0.1, (TOKENS, 2 * REACH * HIDDEN)).astype(np.float32)
        return cls(near, rng.normal(0, 0.1, (HIDDEN, CLASSES)).astype(np.float32), words.class_share.copy())

    def flat(self) -> np.ndarray:
        return np.concatenate([self.near.ravel(), self.out.ravel(), self.bias])

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        a, b = TOKENS * 2 * REACH * HIDDEN, HIDDEN * CLASSES
        flat = flat.astype(np.float32)
        return cls(flat[:a].reshape(TOKENS, -1).copy(), flat[a : a + b].reshape(HIDDEN, CLASSES).copy(), flat[a + b :].copy())

    def hidden(self, ids: np.ndarray) -> np.ndarray:
        """For each id but ``REACH`` at both ends, the tanh of what its neighbours say."""
        said, n = self.near[ids], len(ids) - 2 * REACH
        total = np.zeros((n, HIDDEN), np.float32)
        for k, place in enumerate((0, 1, 3, 4)):
            total += said[place : place + n, k * HIDDEN : (k + 1) * HIDDEN]
        return np.tanh(total, out=total)

    def shares(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp of the class scores (less their greatest, where that could overflow), and the sums."""
        score = h @ self.out
        score += self.bias
        if np.abs(self.out).sum(0).max() + np.abs(self.bias).max() > 60:  # tanh is at most 1
            score -= score.max(1, keepdims=True)
        np.exp(score, out=score)
        return score, score.sum(1)

    def log_probabilities(self, ids: np.ndarray, words: Vocabulary) -> np.ndarray:
        """For each id but ``REACH`` at both ends; 0 for pads. A bucket's id stands for any of its words."""
        found = np.zeros(len(ids) - 2 * REACH)
        for at in range(0, len(found), BATCH):
            some = ids[at : at + BATCH + 2 * REACH]
            target = some[REACH:-REACH]
            share, total = self.shares(self.hidden(some))
            picked = share[np.arange(len(target)), words.word_class[target]]
            found[at : at + BATCH] = np.where(target == PAD, 0, np.log(np.maximum(picked, 1e-30) / total) + words.within[target])
        return found


class Trainer:
    """Adagrad over small batches, by rows for the neighbours' vectors."""

    def __init__(self, net: Network, words: Vocabulary):
        self.net, self.words = net, words
        self.near_sum, self.out_sum, self.bias_sum = np.full(TOKENS, 1e-6, np.float32), np.full_like(net.out, 1e-6), np.full_like(net.bias, 1e-6)

    def learn(self, ids: np.ndarray) -> None:
        for at in range(0, len(ids) - 2 * REACH, BATCH):
            self.step(ids[at : at + BATCH + 2 * REACH])

    def step(self, ids: np.ndarray) -> None:
        net, target = self.net, ids[REACH:-REACH]
        h = net.hidden(ids)
        wrong, total = net.shares(h)
        real = target != PAD
        wrong *= (real / total).astype(np.float32)[:, None]
        wrong[np.arange(len(target)), self.words.word_class[target]] -= real
        back = wrong @ net.out.T
        back *= 1 - h * h
        grad, grad_bias = h.T @ wrong, wrong.sum(0)
        self.out_sum += grad * grad
        net.out -= RATE * grad / np.sqrt(self.out_sum)
        self.bias_sum += grad_bias * grad_bias
        net.bias -= RATE * grad_bias / np.sqrt(self.bias_sum)
        n = len(target)
        each = np.zeros((len(ids), 2 * REACH * HIDDEN), np.float32)
        for k, place in enumerate((0, 1, 3, 4)):
            each[place : place + n, k * HIDDEN : (k + 1) * HIDDEN] = back
        order = np.argsort(ids, kind="stable")
        ranked = ids[order]
        head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        rows, sums = ranked[head], np.add.reduceat(each[order], head, axis=0)
        self.near_sum[rows] += (sums * sums).mean(1)
        net.near[rows] -= (RATE / np.sqrt(self.near_sum[rows]))[:, None] * sums


_COPY = "slice int, way int, weight long, sums binary"


def _added(rows: DataFrame, *by: str) -> DataFrame:
    """Adds up the copies' slices as they stream by: one slice of integers for each key in memory."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for batch in batches:
            for s, way, n, blob in zip(*(batch.column(x) for x in ("slice", "way", "weight", "sums")), strict=True):
                values = np.frombuffer(blob.as_buffer(), np.int64)
                have = found.setdefault((s.as_py(), way.as_py() if "way" in by else 0), [0, np.zeros(len(values), np.int64)])
                have[0] += n.as_py()
                have[1] += values
        if found:
            columns = [[k[0] for k in found], [k[1] for k in found], [v[0] for v in found.values()], [v[1].tobytes() for v in found.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["slice", "way", "weight", "sums"])

    return rows.repartition(_SLICES, *by).mapInArrow(add, _COPY)


@dataclass
class Model:
    """``counts`` is the stored table of all words of the corpus (word, n)."""

    words: Vocabulary
    net: Network
    counts: DataFrame


def fit(docs: DataFrame, text: str = "text", rounds: int = 1) -> Model:
    """Trains on every word of every document; null texts and an empty table teach nothing."""
    spark = docs.sparkSession
    counts = stored(word_counts(docs, text), "word-counts")
    words = vocabulary(counts)
    net = Network.fresh(words)
    texts = docs.select(F.col(text).alias("text"))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((words, net))

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, net = shared.value
            trainer, seen = Trainer(Network.of(net.flat()), words), 0
            for batch in batches:
                for part in pieces(batch, "text", 4_000_000):
                    ids = stream(part.column("text"), words).ids
                    trainer.learn(ids)
                    seen += int((ids != PAD).sum())
            if seen:
                weight = -(-seen // _WEIGHT_WORDS)
                values = np.rint(trainer.net.flat() * _FIXED).astype(np.int64) * weight
                cut = np.array_split(values, _SLICES)
                way = TaskContext.get().partitionId() % _WAYS
                yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array([way] * _SLICES, pa.int32()), pa.array([weight] * _SLICES, pa.int64()), pa.array([x.tobytes() for x in cut], pa.binary())], names=["slice", "way", "weight", "sums"])

        copies = _added(_added(texts.mapInArrow(train, _COPY), "slice", "way"), "slice")
        rows = sorted(copies.collect(), key=lambda r: r["slice"])  # one network
        if not rows:
            break
        net = Network.of(np.concatenate([np.frombuffer(bytes(r["sums"]), np.int64) / (r["weight"] * _FIXED) for r in rows]))
    return Model(words, net, counts)


def _rare(found: Stream, texts: int) -> tuple[pa.ListArray, pa.ListArray]:
    """For each text, its distinct words that only buckets stand for, and how often each occurs."""
    at = np.flatnonzero(found.ids[found.place] >= KNOWN)
    text, prints = found.text[at], found.prints[at]
    order = np.lexsort((prints, text))
    text, prints = text[order], prints[order]
    head = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (prints[1:] != prints[:-1])])) if len(text) else np.zeros(0, np.int64)
    ends = pa.array(np.searchsorted(text[head], np.arange(texts + 1)).astype(np.int32))
    times = np.diff(np.append(head, len(text))).astype(np.int64)
    return pa.ListArray.from_arrays(ends, pa.array(prints[head].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(times))


def score(docs: DataFrame, model: Model, keep: list[str | Column], text: str = "text") -> DataFrame:
    """``keep`` columns, ``n_words``, ``pll`` (sum of the words' conditional log-probabilities) and ``mean_pll``.

    Whole texts count, however long. A text that is null or has no word has
    ``n_words`` 0, ``pll`` 0 and no mean. Repeated rows score alike; an empty
    table stays empty; kept columns go through a struct.

    The network's part comes from one pass, whose rows are stored under numbers
    of their own, as ids may repeat or be null. The words of buckets then meet
    the table of counts by word, one entry for each word of a document; a word
    that many documents hold has an id, so no key of this join is hot.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.net))
    inner = docs.select(F.struct(*keep).alias("doc"), F.col(text).alias("text"))
    schema = T.StructType().add("row", "long").add(inner.schema["doc"]).add("n_words", "long").add("pll", "double")
    schema = schema.add("words", T.ArrayType(T.LongType())).add("times", T.ArrayType(T.LongType()))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, net = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in pieces(batch, "text", 4_000_000):
                found = stream(part.column("text"), words)
                ids, first, n = found.ids, found.first, part.num_rows
                logs = net.log_probabilities(ids, words)
                bucket = ids[REACH:-REACH].astype(np.int64) - KNOWN
                rare = (bucket >= 0) & (bucket < RARE)
                logs[rare] -= words.bucket_total[bucket[rare]]
                sums = np.concatenate([np.zeros(REACH + 1), logs.cumsum()])
                size = np.diff(np.append(first, len(ids))) - REACH
                pll = sums[first + size] - sums[first]
                columns = [pa.array(np.arange(row, row + n)), part.column("doc"), pa.array(size.astype(np.int64)), pa.array(np.where(size > 0, pll, 0.0)), *_rare(found, n)]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc", "n_words", "pll", "words", "times"])
                row += n

    rows = stored(inner.mapInArrow(judge, schema), "scored")
    held = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("e")).select("row", F.col("e.words").alias("word"), F.col("e.times").alias("times"))
    of_word = F.round(F.log(F.coalesce("n", F.lit(0)) + SMOOTHING) * _LOG_FIXED).cast("long")
    own = held.join(model.counts, "word", "left").groupBy("row").agg((F.sum(F.col("times") * of_word) / _LOG_FIXED).alias("own"))
    pll = F.col("pll") + F.coalesce("own", F.lit(0.0))
    found = rows.select("row", "doc", "n_words", "pll").join(own, "row", "left")
    return found.select("doc.*", "n_words", pll.alias("pll"), F.when(F.col("n_words") > 0, pll / F.col("n_words")).alias("mean_pll"))
