"""Document fingerprints: a quartile digest of hashed byte triplets.

Every three bytes in a row name one of 256 buckets. A bucket's code says in
which quarter of the document's own bucket counts it lies (0 to 3), so the
digest is of one size for any text and small edits change few codes. Digests
compare by a difference that grows with the distance of the codes, and with
that of the lengths, up to a bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from squelch.llm.shared import pieces, stored, text_buffer

BUCKETS = 256
#: Multipliers of a triplet's bytes, and the shift that leaves eight bits of the sum.
FIRST, SECOND, THIRD, MODULUS = 40503, 30011, 10007, 65521
#: What two codes count for, by their distance: opposite quarters count double.
STEP = np.array([0, 1, 2, 6])
#: The difference at which two texts count as unlike: what codes drawn evenly at random would give.
BOUND = BUCKETS * 13 // 8
#: Lengths differ by at most so much; each doubling of the length is eight steps.
LENGTH_STEPS, LENGTH_BOUND = 8, 40


def bucket_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x buckets: how many triplets of bytes fall into each."""
    n = len(offsets) - 1
    if len(raw) < 3:
        return np.zeros((n, BUCKETS), np.int64)
    b = raw.astype(np.uint32)
    bucket = (b[:-2] * np.uint32(FIRST) + b[1:-1] * np.uint32(SECOND) + b[2:] * np.uint32(THIRD)) % np.uint32(MODULUS) % np.uint32(BUCKETS)
    sizes = np.maximum(np.diff(offsets) - 2, 0)
    inside = np.zeros(len(raw), bool)
    begin = offsets[:-1][sizes > 0]
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[begin] += 1
    np.subtract.at(edge, begin + sizes[sizes > 0], 1)
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)[: len(bucket)]
    place = np.repeat(np.arange(n), sizes) * BUCKETS + bucket[inside]
    return np.bincount(place, minlength=n * BUCKETS).reshape(n, BUCKETS)


def codes_of(counts: np.ndarray) -> np.ndarray:
    """Texts x buckets: the quarter of each bucket; equal counts share the lower quarter."""
    ranked = np.sort(counts, 1)
    limits = ranked[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    return (counts[:, :, None] > limits[:, None, :]).sum(2).astype(np.uint8)


def length_code(n_bytes: np.ndarray) -> np.ndarray:
    """0 for an empty text, then a step for each eighth of a doubling; 255 at most."""
    n = np.asarray(n_bytes, np.float64)
    return np.minimum(np.where(n > 0, 1 + np.floor(LENGTH_STEPS * np.log2(np.maximum(n, 1))), 0), 255).astype(np.uint8)


def digests(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x bytes: the length's code, then four bucket codes a byte."""
    found = []
    lengths = length_code(np.diff(offsets))
    for at in range(0, len(lengths), 2048):
        some = offsets[at : at + 2049]
        codes = codes_of(bucket_counts(raw[some[0] : some[-1]], some - some[0])).reshape(len(some) - 1, BUCKETS // 4, 4)
        found.append((codes << np.array([6, 4, 2, 0], np.uint8)).sum(2).astype(np.uint8))
    body = np.concatenate(found) if found else np.zeros((0, BUCKETS // 4), np.uint8)
    return np.concatenate([lengths[:, None], body], 1)


_APART = STEP[np.abs(np.arange(4)[:, None] - np.arange(4))]
#: What two bytes of four codes differ by.
_BYTES = sum(_APART[(np.arange(256)[:, None] >> s) & 3, (np.arange(256) >> s) & 3] for s in (6, 4, 2, 0))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - difference / bound, from 0 (unlike) to 1 (equal digests)."""
    apart = _BYTES[a[:, 1:], b[:, 1:]].sum(1) + np.minimum(np.abs(a[:, 0].astype(np.int64) - b[:, 0]), LENGTH_BOUND)
    return 1 - np.minimum(apart, BOUND) / BOUND


def hexed(found: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes().hex() for x in found], pa.string())


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """The table with a column ``out``: each whole text's digest in hexadecimal. A null text counts as empty.

    A column of that name is replaced.
    """
    schema = T.StructType([f for f in docs.schema if f.name != out]).add(out, "string")
    spare = "_text_of_" + "_".join(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces(batch, spare):
                found = hexed(digests(*text_buffer(some.column(spare))))
                kept = [some.column(f.name) for f in schema.fields[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, found], names=schema.names)

    kept = [F.col(f"`{f.name}`") for f in schema.fields[:-1]]
    return docs.select(*kept, F.col(f"`{text}`").alias(spare)).mapInArrow(run, schema)


def compared(a: Column, b: Column) -> Column:
    """Likeness of two digests in hexadecimal, 0 to 1; null if either is."""

    @F.pandas_udf("double")
    def score(x, y):
        import pandas as pd

        there = (x.notna() & y.notna()).to_numpy()
        found = np.full(len(x), np.nan)
        if there.any():
            cut = [np.frombuffer(bytes.fromhex("".join(v[there])), np.uint8).reshape(there.sum(), -1) for v in (x, y)]
            found[there] = likeness(*cut)
        return pd.Series(found).astype("Float64")

    return F.when(a.isNotNull() & b.isNotNull(), score(a, b))


# Against the next document



def _judged(ids: pa.Array, texts: list[str], nexts: list[str], prints: np.ndarray, next_prints: np.ndarray) -> pa.RecordBatch:
    """The result's rows of documents whose next ones are known."""
    sizes = np.array([len(t) for t in texts], np.int64)
    edited = [t[: len(t) - len(t) // 4] + u[: len(t) // 4] for t, u in zip(texts, nexts, strict=True)]
    of_edited = digests(*text_buffer(pa.array(edited, pa.large_string())))
    columns = [
        ids, pa.array(sizes), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]), hexed(prints), hexed(of_edited),
        pa.array(likeness(prints, of_edited)), pa.array(likeness(prints, next_prints)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


_RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def against_next(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edit by the next document, and how like they are.

    Documents stand in ascending ``doc_id``, null ids first, rows of one id by
    a hash of their text and then by their place in the table; the first
    follows the last. The edit replaces the last quarter of the code points by
    as many of the next document's first ones, or by all that it has. A null
    text is empty. A single document is its own next one; an empty table stays
    empty; other columns are ignored.

    One shuffle deals the whole texts out by ranges of their order. A task
    finishes all rows but its last, and leaves that one and its first one for a
    join of neighbouring ranges: two texts for each range.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("place"))
    order = [F.col("id").asc_nulls_first(), F.col("h"), F.col("place")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, held = TaskContext.get().partitionId(), None, None
        for batch in batches:
            for some in pieces(batch, "text"):
                prints = digests(*text_buffer(some.column("text")))
                texts, ids = some.column("text").to_pylist(), some.column("id")
                if first is None:
                    first = (texts[0], prints[:1])
                else:
                    texts, ids, prints = [held[1], *texts], pa.concat_arrays([held[0], ids]), np.concatenate([held[2], prints])
                if len(texts) > 1:
                    done = _judged(ids[:-1], texts[:-1], texts[1:], prints[:-1], prints[1:])
                    blank = [pa.nulls(len(done), pa.int32()), pa.nulls(len(done), pa.string()), pa.nulls(len(done), pa.string())]
                    yield pa.RecordBatch.from_arrays([*done.columns, *blank], names=[*done.schema.names, "part", "first_text", "last_text"])
                held = (ids[-1:], texts[-1], prints[-1:])
        if held:
            none = pa.nulls(1, pa.string())
            ends = [held[0], pa.nulls(1, pa.int64()), none, none, none, pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64()), pa.array([part], pa.int32()), pa.array([first[0]]), pa.array([held[1]])]
            yield pa.RecordBatch.from_arrays(ends, names=[*_judged_names, "part", "first_text", "last_text"])

    found = stored(ranged.mapInArrow(run, _RESULT + ", part int, first_text string, last_text string"), "fingerprints")
    ends = found.filter("part is not null")
    parts = sorted(r.part for r in ends.select("part").collect())  # one number for each range
    follows = docs.sparkSession.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "part int, next_part int")
    firsts = ends.select(F.col("part").alias("next_part"), F.col("first_text").alias("next_text"))
    open_ends = ends.select("part", "doc_id", "last_text").join(follows, "part").join(firsts, "next_part")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in pieces(batch, "last_text"):
                texts, nexts = some.column("last_text"), some.column("next_text")
                yield _judged(some.column("doc_id"), texts.to_pylist(), nexts.to_pylist(), digests(*text_buffer(texts)), digests(*text_buffer(nexts)))

    done = found.filter("part is null").select(*_judged_names)
    return done.unionByName(open_ends.select("doc_id", "last_text", "next_text").mapInArrow(close, _RESULT))


_judged_names = [x.split()[0] for x in _RESULT.split(", ")]
