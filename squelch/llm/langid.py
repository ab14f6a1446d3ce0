"""Language identification: multinomial naive Bayes over hashed byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from squelch.llm.shared import pieces, stored, text_buffer

ORDERS = (2, 3, 4)
BUCKETS = 1 << 16
#: The bound of the sample that the classifier is fitted on: about so many
#: labelled documents of each language, chosen by a hash of id and text, whole
#: texts each. A language with fewer is learned from all of them.
TRAIN_DOCS = 2_500
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32


def grams(raw: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram at each byte (ASCII letters in lower case)."""
    folded = _FOLD[raw]
    n = len(raw) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint16)
    code = np.full(n, 0x9E3779B1 * order & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        code = (code ^ folded[k : k + n]) * np.uint32(0x85EBCA6B)
        code ^= code >> np.uint32(13)
    return (code >> np.uint32(16)).astype(np.uint16)


@dataclass
class Model:
    """Log-probabilities: languages x buckets, and each language's prior. Bounded by languages x 2^16 floats."""

    langs: list[str]
    table: np.ndarray
    prior: np.ndarray

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts x languages: the log of prior times likelihood."""
        out = np.tile(self.prior, (len(offsets) - 1, 1))
        for order in ORDERS:
            code = grams(raw, order)
            end = np.maximum(offsets[1:] - order + 1, offsets[:-1])
            sums = np.zeros(len(code) + 1)
            for k in range(len(self.langs)):
                np.cumsum(self.table[k][code], dtype=np.float64, out=sums[1:])
                some = end > offsets[:-1]
                out[some, k] += sums[end[some]] - sums[offsets[:-1][some]]
        return out


def fit(labelled: DataFrame, text: str, lang: str, doc_id: str, train_docs: int = TRAIN_DOCS, smoothing: float = 0.5) -> Model:
    """Counts n-grams by language in parallel; what reaches the driver is one counter per language and bucket.

    About ``train_docs`` documents of each language teach n-grams; the priors
    come from all labelled documents. Null languages and texts teach nothing.
    """
    labelled = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    labelled = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(doc_id).alias("doc_id"))
    counted = stored(labelled.groupBy("lang").agg(F.count("*").alias("of_lang")), "languages")
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.lit(float(train_docs << 30)) / F.col("of_lang")
    docs = labelled.join(counted, "lang").filter(drawn).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in pieces(batch, "text", 1_000_000):
                raw, offsets = text_buffer(part.column("text"))
                names = part.column("lang").to_pylist()
                of_text = np.repeat(np.arange(len(names)), np.diff(offsets))
                for order in ORDERS:
                    code = grams(raw, order)
                    same = of_text[: len(code)] == of_text[order - 1 :]
                    for name in set(names):
                        mine = np.array([x == name for x in names])
                        at = code[same & mine[of_text[: len(code)]]]
                        found.setdefault(name, np.zeros(BUCKETS, np.int64))[:] += np.bincount(at, minlength=BUCKETS)
        if found:
            yield pa.RecordBatch.from_pydict({"lang": list(found), "counts": [x.tobytes() for x in found.values()]}, schema=pa.schema([("lang", pa.string()), ("counts", pa.binary())]))

    def total(key: tuple, table: pa.Table) -> pa.Table:
        sums = np.zeros(BUCKETS, np.int64)
        for blob in table.column("counts"):
            sums += np.frombuffer(blob.as_buffer(), np.int64)
        return pa.table({"lang": [key[0].as_py()], "counts": pa.array([sums.tobytes()], pa.binary())})

    schema = "lang string, counts binary"
    rows = sorted(docs.mapInArrow(count, schema).groupBy("lang").applyInArrow(total, schema).collect(), key=lambda r: r.lang)
    of_lang = {r.lang: r.of_lang for r in counted.collect()}  # one number for each language
    if not rows:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros(0))
    counts = np.array([np.frombuffer(bytes(r.counts), np.int64) for r in rows]) + smoothing
    table = np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)
    sizes = np.array([of_lang[r.lang] for r in rows], float)
    return Model([r.lang for r in rows], table, np.log(sizes / sizes.sum()))


def predict(docs: DataFrame, model: Model, text: str, keep: list[str | Column]) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` (the posterior of that language).

    A text that is null or has no letter is ``und`` with score 0, as is every
    text where no language was learned. Ties go to the first language by name.
    Whole texts count, however long. Repeated rows are predicted alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inner = docs.select(F.struct(*keep).alias("doc"), F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).alias("text"))
    schema = T.StructType([inner.schema["doc"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in pieces(batch, "text", 1_000_000):
                pred, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                known = np.flatnonzero(part.column("text").is_valid().to_numpy(zero_copy_only=False))
                if model.langs and len(known):
                    logs = model.scores(*text_buffer(part.column("text").take(pa.array(known))))
                    best = logs.argmax(1)
                    score[known] = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
                    for k, b in zip(known, best, strict=True):
                        pred[k] = model.langs[b]
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(pred, pa.string()), pa.array(score)], names=["doc", "lang_pred", "score"])

    return inner.mapInArrow(label, schema).select("doc.*", "lang_pred", "score")
