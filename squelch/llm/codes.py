"""Token ids in directly addressable codes.

An id is cut into chunks of eight bits. Level 0 holds the low chunk of every
id; a bitmap tells which ids go on, and level 1 holds the next chunk of those
alone, and so forth. A rank directory counts the set bits before each block of
512, so the place of an id's next chunk is one look-up away: any token is read
without decoding the ones before it.

Format of a payload, all little-endian: b"DAC1", uint32 levels, uint64 n; then
for each level uint64 n, the n chunk bytes, the bitmap (bit i of byte i // 8
for chunk i), and one uint32 per started block of 512 bits.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from squelch.llm.shared import pieces, stored
from squelch.llm.tokens import encoder

BLOCK = 512
#: Cuts of text that each process remembers, some 200 MB: few of its cuts are then encoded twice.
MEMORY = 1_000_000
_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def pack_ids(ids: np.ndarray) -> bytes:
    """The payload of an array of ids below 2^32."""
    levels, rest = [], np.asarray(ids, np.uint32)
    n = len(rest)
    while True:
        go_on = rest > 0xFF
        bits = np.packbits(go_on, bitorder="little")
        counts = np.add.reduceat(go_on, np.arange(0, len(rest), BLOCK), dtype=np.uint32) if len(rest) else np.zeros(0, np.uint32)
        ranks = np.zeros(len(counts), np.uint32)
        np.cumsum(counts[:-1], out=ranks[1:])
        levels.append(struct.pack("<Q", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + ranks.astype("<u4").tobytes())
        rest = rest[go_on] >> np.uint32(8)
        if not len(rest):
            return b"DAC1" + struct.pack("<IQ", len(levels), n) + b"".join(levels)


@dataclass
class Codes:
    """A payload opened for reading, without copying it."""

    n: int
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def open(cls, payload: bytes) -> Codes:
        if payload[:4] != b"DAC1":
            raise ValueError("not a payload of directly addressable codes")
        count, n = struct.unpack_from("<IQ", payload, 4)
        at, levels = 16, []
        for _ in range(count):
            (size,) = struct.unpack_from("<Q", payload, at)
            chunks = np.frombuffer(payload, np.uint8, size, at + 8)
            at += 8 + size
            bits = np.frombuffer(payload, np.uint8, -(-size // 8), at)
            at += len(bits)
            ranks = np.frombuffer(payload, "<u4", -(-size // BLOCK), at)
            at += 4 * len(ranks)
            levels.append((chunks, bits, ranks))
        return cls(n, levels)

    def rank(self, level: int, i: int) -> int:
        """Set bits before i: one look-up in the directory, then the bytes of one block at most."""
        _, bits, ranks = self.levels[level]
        if i == len(self.levels[level][0]) and i % BLOCK == 0:
            if not i:
                return 0
            i, extra = i - 1, int(bits[(i - 1) // 8] >> ((i - 1) % 8) & 1)
        else:
            extra = 0
        block = i // BLOCK
        whole = int(_ONES[bits[block * BLOCK // 8 : i // 8]].sum())
        part = bin(int(bits[i // 8]) & ((1 << i % 8) - 1)).count("1") if i % 8 else 0
        return int(ranks[block]) + whole + part + extra

    def at(self, i: int) -> int:
        """Token i, by one step for each of its chunks."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not bits[i // 8] >> (i % 8) & 1:
                break
            i, shift = self.rank(level, i), shift + 8
        return value

    def span(self, start: int, end: int) -> np.ndarray:
        """Tokens start to end (not included): the chunks of a span are a span on every level."""
        if not 0 <= start <= end <= self.n:
            raise IndexError((start, end))
        values = places = None  # level 0 has all places
        a, b, shift = start, end, 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            if values is None:
                values = chunks[a:b].astype(np.uint32)
            else:
                values[places] |= chunks[a:b].astype(np.uint32) << np.uint32(shift)
            on = np.flatnonzero(np.unpackbits(bits[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a])
            if not len(on):
                break
            places = on if places is None else places[on]
            a = self.rank(level, a)
            b, shift = a + len(places), shift + 8
        return values


SEGMENT = "part int, seq int, doc_ids array<long>, ends array<long>, n_tokens long, payload binary"


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", doc_id: str = "doc_id", parts: int | None = None, path: str | None = None) -> DataFrame:
    """Encodes whole texts and writes segments in ascending order of ids; returns the written table.

    Rows are dealt by ranges of (id, hash of text), so parts follow each other
    in id order and repeated ids can't fill one part. Null ids come first; rows
    with the same id are ordered by their text; a null text is empty and gives
    ``end_id`` alone. An empty table gives a table without rows. One row holds
    some MB of text: its documents' ids, the end of each in it, its payload; a
    single document has a payload of its own, which Spark bounds at 2 GB.
    """
    spark = docs.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "text").drop("h")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer, MEMORY)
        for batch in batches:
            for some in pieces(batch, "text"):
                ids, counts = enc.encode_column(some.column("text"))
                payload = pack_ids(np.insert(ids, np.cumsum(counts), end_id))
                ends = np.cumsum(counts + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([some.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([ends.tolist()], pa.list_(pa.int64())), pa.array([int(ends[-1])], pa.int64()), pa.array([payload], pa.binary())],
                    names=["part", "seq", "doc_ids", "ends", "n_tokens", "payload"],
                )
                seq += 1

    segments = rows.mapInArrow(encode, SEGMENT)
    if path is None:
        return stored(segments, "tokens")
    segments.write.parquet(path)
    return spark.read.schema(SEGMENT).parquet(path)


def bases(segments: DataFrame) -> DataFrame:
    """part, seq and ``base``, the ids of all segments before: sums by part first, then within each part.

    The window over all parts has one row for each part, none for a document.
    """
    sums = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("part_base"))
    own = segments.select("part", "seq", "n_tokens").withColumn("in_part", F.coalesce(F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return own.join(before, "part").select("part", "seq", (F.col("part_base") + F.col("in_part")).alias("base"))


def read_digests(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the written segments.

    Payloads are read where they are; only the digests meet their segment's base.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                codes = Codes.open(batch.column("payload")[k].as_buffer().to_pybytes())
                ends = np.array(batch.column("ends")[k].values, np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                ids = codes.span(0, codes.n).astype("<u4", copy=False)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                part, seq = (np.full(len(ends), batch.column(x)[k].as_py(), np.int32) for x in ("part", "seq"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part), pa.array(seq), batch.column("doc_ids")[k].values, pa.array(begins), pa.array(ends - begins), pa.array(crc, pa.int64())], names=["part", "seq", "doc_id", "begin", "n_tokens", "ids_crc32"]
                )

    digests = segments.mapInArrow(digest, "part int, seq int, doc_id long, begin long, n_tokens long, ids_crc32 long")
    return digests.join(bases(segments), ["part", "seq"]).select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")
