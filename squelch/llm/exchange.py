"""Whole documents in chunks, and questions that all chunks ask each other about their keys.

A chunk is a row of some MB: whole documents, their text compressed. Every
chunk sends its distinct keys to the buckets that their first bits name; a
bucket answers each chunk with one number for each key. A key that a third of
all documents hold is one entry for each chunk, and an entry is a few bytes of
an array, not a row.

The number of buckets follows the number of chunks, so a bucket holds the keys
of about ``CHUNKS_PER_BUCKET`` chunks at any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from squelch.llm.shared import owned, pieces, text_buffer

CHUNK_BYTES = 1_000_000
CHUNKS_PER_BUCKET = 16
#: A row number is that of its chunk and these bits for its place there; a chunk has fewer rows.
PLACE_BITS = 15


def chunks(docs: DataFrame, text: str, doc_id: str, keep: list[str] | None = None, limit: int = CHUNK_BYTES) -> DataFrame:
    """Rows of chunk, doc_ids, lengths (bytes; -1 for a null text), blob (the texts) and docs (structs of the ``keep`` columns).

    Stored chunks stay as they are, so that a row number (``rows_of``) names a
    document for good, whatever ids repeat or are null.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owned("near duplicates")
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in pieces(batch, "text", limit):
                raw, offsets = text_buffer(some.column("text"))
                lengths = np.diff(offsets)
                lengths[some.column("text").is_null().to_numpy(zero_copy_only=False)] = -1
                row = {
                    "chunk": pa.array([part << 25 | seq], pa.int64()),
                    "doc_ids": pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column("doc_id")),
                    "lengths": pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), pa.array(lengths, pa.int64())),
                    "blob": pa.array([pa.compress(raw.tobytes(), codec="zstd", asbytes=True) if len(raw) else b""], pa.binary()),
                }
                if keep:
                    row["docs"] = pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column("doc"))
                yield pa.RecordBatch.from_arrays(list(row.values()), names=list(row))
                seq += 1

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *([F.struct(*keep).alias("doc")] if keep else []))
    schema = T.StructType().add("chunk", "long").add("doc_ids", T.ArrayType(T.LongType())).add("lengths", T.ArrayType(T.LongType())).add("blob", "binary")
    return rows.mapInArrow(build, schema.add("docs", T.ArrayType(rows.schema["doc"].dataType)) if keep else schema)


@dataclass
class Chunk:
    """A chunk in memory: its number, the bytes of all its texts and where each begins (n + 1)."""

    number: int
    raw: np.ndarray
    offsets: np.ndarray
    doc_ids: pa.Array
    null: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def rows(self) -> np.ndarray:
        return (self.number << PLACE_BITS) + np.arange(len(self))

    def texts(self) -> pa.Array:
        """The texts as strings, nulls included."""
        valid = np.packbits(~self.null, bitorder="little").tobytes()
        return pa.Array.from_buffers(pa.large_string(), len(self), [pa.py_buffer(valid), pa.py_buffer(self.offsets.tobytes()), pa.py_buffer(self.raw)])


def opened(batch: pa.RecordBatch) -> Iterator[tuple[int, Chunk]]:
    """Each row of a batch of chunks: (its index, the chunk)."""
    for k in range(batch.num_rows):
        lengths = batch.column("lengths")[k].values.to_numpy()
        offsets = np.concatenate([[0], np.maximum(lengths, 0).cumsum()]).astype(np.int64)
        raw = np.frombuffer(pa.decompress(batch.column("blob")[k].as_buffer(), int(offsets[-1]), codec="zstd"), np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
        yield k, Chunk(batch.column("chunk")[k].as_py(), raw, offsets, batch.column("doc_ids")[k].values, lengths < 0)


def bucket_count(table: DataFrame) -> int:
    """A power of two that follows the number of chunks."""
    n, found = table.count(), 1
    while found * CHUNKS_PER_BUCKET < n:
        found *= 2
    return found


def limits(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin in ascending 64-bit keys (buckets + 1 places)."""
    if buckets == 1:
        return np.array([0, len(keys)])
    return np.searchsorted(keys >> np.uint64(64 - (buckets - 1).bit_length()), np.arange(buckets + 1, dtype=np.uint64))


Entries = dict[str, np.ndarray]


def _pack(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True)


def _unpack(blob: pa.Scalar, n: int, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob.as_buffer(), n * dtype.itemsize, codec="zstd"), dtype)


def ask(table: DataFrame, sent: Callable[[pa.RecordBatch, int, Chunk], Entries], fields: dict[str, str], answer: Callable[[Entries], np.ndarray], reply: str, buckets: int) -> DataFrame:
    """Rows of chunk and ``answers``: the replies to each chunk, by bucket.

    ``sent`` gives a chunk's distinct ascending 64-bit keys as ``key``, which
    name the bucket, and arrays as long as that; ``fields`` says which of them
    travel, and as what numpy type. ``answer`` sees a bucket's entries of all
    chunks, with ``chunk`` for each, and gives a number of type ``reply`` for
    each. ``replies`` reads them back.
    """
    kinds = {name: np.dtype(kind) for name, kind in fields.items()}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owned("near duplicates")
        for batch in batches:
            for k, chunk in opened(batch):
                found = sent(batch, k, chunk)
                ends = limits(found["key"], buckets)
                used = np.flatnonzero(np.diff(ends))
                columns = [pa.array(used, pa.int64()), pa.array(np.full(len(used), chunk.number)), pa.array(np.diff(ends)[used].astype(np.int32))]
                columns += [pa.array([_pack(found[name][ends[b] : ends[b + 1]].astype(kind)) for b in used], pa.binary()) for name, kind in kinds.items()]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "chunk", "n", *kinds])

    def answered(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("chunk", "ascending")])
        sizes = table.column("n").to_numpy()
        entries = {name: np.concatenate([_unpack(x, int(n), kind) for x, n in zip(table.column(name), sizes, strict=True)]) for name, kind in kinds.items()}
        entries["chunk"] = np.repeat(table.column("chunk").to_numpy(), sizes)
        values = answer(entries).astype(reply)
        cut = np.split(values, np.cumsum(sizes)[:-1])
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "n": table.column("n"), "answer": pa.array([_pack(x) for x in cut], pa.binary())})

    columns = "".join(f", {name} binary" for name in kinds)
    rows = table.mapInArrow(send, "bucket long, chunk long, n int" + columns)
    found = rows.groupBy("bucket").applyInArrow(answered, "chunk long, bucket long, n int, answer binary")
    return found.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "answer"))).alias("answers"))


def replies(column: pa.ListArray, k: int, reply: str) -> np.ndarray:
    """The answers to a chunk, one for each of its keys, in their order."""
    cell = column[k]
    if not cell.is_valid or not len(cell.values):
        return np.zeros(0, reply)
    rows, kind = cell.values, np.dtype(reply)
    return np.concatenate([_unpack(b, n.as_py(), kind) for b, n in zip(rows.field("answer"), rows.field("n"), strict=True)])
