"""Substring dedup by recompression.

Rounds over the words name runs of equal symbols, then pairs of a left-class
and a right-class symbol. A name is a fingerprint of what it stands for, so
every task gives equal content the same name. Away from its ends, a repeated
passage therefore has the same symbols wherever it stands.

1. Texts are stored in chunks of a few MB.
2. Each chunk sends the distinct symbols of the last round, 32 bits each, to
   the bucket of the rest of their bits, and learns which occur elsewhere.
3. A window of words with a symbol inside that occurs nowhere else can't be a
   repeat. The other windows send their 64-bit fingerprints (one for each
   distinct window of a chunk, with its document) to their buckets, and learn
   which occur in an earlier document.
4. Each chunk removes the words that repeated windows cover.

What a chunk sends for a window or symbol is one entry however often it occurs
there, so a passage in a third of all documents makes one entry for each chunk.
Entries travel as arrays, one row for each chunk and bucket.

A window without any symbol whose limits are certain (a long run of one word)
is a candidate, so step 3 decides it. Equal fingerprints count as equal
windows: the bucket adds its bits to the 64, and as buckets grow with the
input, n windows collide with probability below n * 2 MB / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from squelch.llm.shared import owned, pieces, stored, text_buffer
from squelch.llm.words import Words, fingerprints, mixed, whole, windows, words_of

WINDOW = 20
ROUNDS = 2
CHUNK_BYTES = 4_000_000
#: Chunks whose symbols share a bucket: some MB of entries for each task that compares them.
CHUNKS_PER_BUCKET = 4
_FAR = np.int64(1) << 40


def chunks(docs: DataFrame, text: str, doc_id: str, keep: list[str] | None = None) -> DataFrame:
    """Whole documents in rows of some MB: chunk, doc_ids, lengths, the compressed bytes, and the ``keep`` columns as structs."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owned("repeated passages")
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in pieces(batch, "text", CHUNK_BYTES):
                some = some.sort_by([("doc_id", "ascending")])
                raw, offsets = text_buffer(some.column("text"))
                blob = pa.compress(raw.tobytes(), codec="zstd", asbytes=True) if len(raw) else b""
                row = {
                    "chunk": pa.array([part * (1 << 32) + seq], pa.int64()),
                    "doc_ids": pa.array([some.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    "lengths": pa.array([np.diff(offsets).tolist()], pa.list_(pa.int64())),
                    "blob": pa.array([blob], pa.binary()),
                }
                if keep:
                    row["docs"] = pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column("doc"))
                yield pa.RecordBatch.from_arrays(list(row.values()), names=list(row))
                seq += 1

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *([F.struct(*keep).alias("doc")] if keep else []))
    schema = T.StructType().add("chunk", "long").add("doc_ids", T.ArrayType(T.LongType())).add("lengths", T.ArrayType(T.LongType())).add("blob", "binary")
    return rows.mapInArrow(build, schema.add("docs", T.ArrayType(rows.schema["doc"].dataType)) if keep else schema)


def _open(row: dict) -> tuple[Words, np.ndarray]:
    lengths = np.array(row["lengths"], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    raw = np.frombuffer(pa.decompress(row["blob"], int(offsets[-1]), codec="zstd"), np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
    w = words_of(raw, offsets)
    return w, fingerprints(w)


def symbols(prints: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names after the rounds, and the words (start, end) that make each certain.

    A symbol is certain in every text that has these words; where a text's end
    took part in a decision, no words make it certain, and the span is endless.
    """
    n = len(prints)
    name, text = prints, np.repeat(np.arange(len(first) - 1), np.diff(first))
    low, high = np.arange(n), np.arange(n) + 1
    for k in range(rounds):
        if not len(name):
            break
        # Runs: a symbol and how often it stands there, in a text.
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(name))).astype(np.uint64)
        run_text = text[at]
        before = np.full(len(at), -_FAR)
        after = np.full(len(at), _FAR)
        same = run_text[1:] == run_text[:-1]
        last = np.append(at[1:], len(name)) - 1
        before[1:][same] = low[last[:-1]][same]
        after[:-1][same] = high[at[1:]][same]
        low, high = np.minimum(low[at], before), np.maximum(high[last], after)
        name = np.where(size > 1, mixed(name[at] * np.uint64(0x9E3779B97F4A7C15) + size), name[at])
        text = run_text
        # Pairs: left class before right class; classes are a bit of the name, anew in each round.
        right = (mixed(name + np.uint64(2 * k + 1)) >> np.uint64(63)).astype(bool)
        same = np.zeros(len(name), bool)
        same[:-1] = text[1:] == text[:-1]
        pair = np.zeros(len(name), bool)
        pair[:-1] = ~right[:-1] & right[1:] & same[:-1]
        second = np.zeros(len(name), bool)
        second[1:] = pair[:-1]
        # An unpaired left one is certain with its right neighbour, an unpaired right one with its left.
        nxt = np.append(high[1:], _FAR)
        nxt[~same] = _FAR
        prv = np.insert(low[:-1], 0, -_FAR)
        prv[1:][~same[:-1]] = -_FAR
        new_low = np.where(right, np.minimum(low, prv), low)
        new_high = np.where(~right, np.maximum(high, nxt), high)
        new_low[pair] = np.minimum(low[pair], np.append(low[1:], 0)[pair])
        keep = ~second
        joint = mixed(name * np.uint64(0xD6E8FEB86659FD93) + np.append(name[1:], np.uint64(0)) + np.uint64(k))
        name, text, low, high = np.where(pair, joint, name)[keep], text[keep], new_low[keep], new_high[keep]
    return name, low, high


def _split(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin in ascending keys (buckets + 1 places)."""
    shift = np.uint64(64 - (buckets - 1).bit_length()) if buckets > 1 else None
    if shift is None:
        return np.array([0, len(keys)])
    return np.searchsorted(keys >> shift, np.arange(buckets + 1, dtype=np.uint64))


def _replies(column: list | None) -> dict[int, np.ndarray]:
    """bucket -> bits, as they were sent."""
    return {r["bucket"]: np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")[: r["n"]].astype(bool) for r in column or []}


def _symbols_of(w: Words, prints: np.ndarray) -> tuple[np.ndarray, ...]:
    name, low, high = symbols(prints, w.first)
    sure = (high - low <= WINDOW) & (low >= 0)
    name, low, high = name[sure], low[sure], high[sure]
    distinct, of, count = np.unique(name, return_inverse=True, return_counts=True)
    return distinct, of, count, low, high


def _candidates(row: dict, buckets: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """Windows (their first words) without a symbol that occurs once, and their fingerprints."""
    w, prints = _open(row)
    distinct, of, count, low, high = _symbols_of(w, prints)
    shared = count > 1
    ends = _split(distinct, buckets)
    for b, bits in _replies(row["shared"]).items():
        shared[ends[b] : ends[b + 1]] |= bits
    alone = ~shared[of]
    edge = np.zeros(w.n + 2, np.int32)
    np.add.at(edge, np.maximum(high[alone] - WINDOW, 0), 1)
    np.add.at(edge, low[alone] + 1, -1)
    good = whole(w.first, w.n, WINDOW)
    good &= np.cumsum(edge)[: len(good)] == 0
    start = np.flatnonzero(good)
    return w, start, windows(prints, WINDOW)[start]


def _first_ones(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys by bucket and then by first place: (their first places, bucket limits, key of each window, order)."""
    distinct, first, of = np.unique(keys, return_index=True, return_inverse=True)
    ends = _split(distinct, buckets)
    bucket = np.repeat(np.arange(buckets), np.diff(ends))
    order = np.lexsort((first, bucket))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return first[order], ends, rank[of], distinct[order]


_SENT = "bucket int, chunk long, n int, keys binary, docs binary"
_REPLY = "chunk long, bucket int, n int, bits binary"


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _send(rows: list[tuple]) -> pa.RecordBatch:
    return _rows(rows, ["bucket", "chunk", "n", "keys", "docs"], [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()])


def _answer(table: pa.Table, flags: np.ndarray, sizes: list[int]) -> pa.Table:
    parts = np.split(flags, np.cumsum(sizes)[:-1]) if sizes else []
    rows = [(c, b, n, np.packbits(x, bitorder="little").tobytes()) for c, b, n, x in zip(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), sizes, parts, strict=True)]
    return pa.Table.from_batches([_rows(rows, ["chunk", "bucket", "n", "bits"], [pa.int64(), pa.int32(), pa.int32(), pa.binary()])])


def _occurs_elsewhere(table: pa.Table) -> pa.Table:
    """Of each entry, whether another chunk sent the same key."""
    sizes = table.column("n").to_pylist()
    keys = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("keys").to_pylist()])
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    equal = np.zeros(len(keys) + 1, bool)
    equal[1:-1] = ranked[1:] == ranked[:-1]
    flags = np.empty(len(keys), bool)
    flags[order] = equal[1:] | equal[:-1]
    return _answer(table, flags, sizes)


def _occurs_earlier(table: pa.Table) -> pa.Table:
    """Of each entry, whether the same key came from an earlier document (of the same id: from a smaller chunk)."""
    table = table.sort_by([("chunk", "ascending")])
    sizes = table.column("n").to_pylist()
    keys = np.concatenate([np.frombuffer(x, "<u8") for x in table.column("keys").to_pylist()])
    runs = [np.frombuffer(x, "<i8").reshape(-1, 2) for x in table.column("docs").to_pylist()]
    docs = np.concatenate([np.repeat(r[:, 0], r[:, 1]) for r in runs])
    order = np.argsort(keys, kind="stable")
    ranked, by_key = keys[order], docs[order]
    head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    least = np.repeat(np.minimum.reduceat(by_key, head), np.diff(np.append(head, len(keys))))
    place = np.where(by_key == least, np.arange(len(keys)), len(keys))
    winner = np.minimum.reduceat(place, head)
    later = np.ones(len(keys), bool)
    later[winner] = False
    flags = np.empty(len(keys), bool)
    flags[order] = later
    return _answer(table, flags, sizes)


def kept_text(w: Words, gone: np.ndarray) -> pa.Array:
    """Each text's words that aren't gone, joined by one blank."""
    raw = w.raw.copy()
    edge = np.zeros(len(raw) + 1, np.int8)
    keep = np.flatnonzero(~gone)
    edge[w.start[keep]] += 1
    edge[w.end[keep]] -= 1
    mask = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    text = w.text_of()[keep]
    blank = w.end[keep[:-1]][text[1:] == text[:-1]]
    raw[blank] = 0x20
    mask[blank] = True
    sizes = np.zeros(len(w.first) - 1, np.int64)
    np.add.at(sizes, text, w.end[keep] - w.start[keep])
    np.add.at(sizes, text[1:][text[1:] == text[:-1]], 1)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[mask].tobytes())])


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of every document.

    With ``keep``, these columns come along in a struct ``doc``, and
    ``clean_text`` is the text as it was where nothing was removed.

    Removed is each word in a window of 20 words that also starts earlier:
    in a smaller id, or earlier in the same document. A null text has no words;
    texts shorter than a window stay whole. Null ids count as after all others;
    rows that share an id count as later ones of it in the order of their
    chunks. Windows are judged on the input. An empty table stays empty.
    """
    text_chunks = stored(chunks(docs, text, doc_id, keep), "chunks")
    buckets = 1
    while buckets * CHUNKS_PER_BUCKET < text_chunks.count() and buckets < 1 << 16:
        buckets *= 2

    def send_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owned("repeated passages")
        for batch in batches:
            for row in batch.to_pylist():
                distinct = _symbols_of(*_open(row))[0]
                ends, low = _split(distinct, buckets), distinct.astype("<u4")
                yield _send([(b, row["chunk"], int(ends[b + 1] - ends[b]), low[ends[b] : ends[b + 1]].tobytes(), b"") for b in range(buckets) if ends[b + 1] > ends[b]])

    bare = text_chunks.drop("docs")
    sent = bare.mapInArrow(send_symbols, _SENT)
    shared = stored(sent.groupBy("bucket").applyInArrow(_occurs_elsewhere, _REPLY), "shared-symbols")
    shared = shared.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias("shared"))

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owned("repeated passages")
        for batch in batches:
            for row in batch.to_pylist():
                w, start, keys = _candidates(row, buckets)
                first, ends, _, distinct = _first_ones(keys, buckets)
                ids = np.array([_FAR << 20 if x is None else x for x in row["doc_ids"]], np.int64)
                doc = ids[w.text_of()[start[first]]] if len(first) else np.zeros(0, np.int64)
                rows = []
                for b in range(buckets):
                    mine = slice(ends[b], ends[b + 1])
                    if ends[b + 1] > ends[b]:
                        cut = np.flatnonzero(np.concatenate([[True], doc[mine][1:] != doc[mine][:-1]]))
                        runs = np.stack([doc[mine][cut], np.diff(np.append(cut, ends[b + 1] - ends[b]))], 1)
                        rows.append((b, row["chunk"], int(ends[b + 1] - ends[b]), distinct[mine].astype("<u8").tobytes(), runs.astype("<i8").tobytes()))
                yield _send(rows)

    with_shared = bare.join(shared, "chunk", "left")
    earlier = stored(with_shared.mapInArrow(send_windows, _SENT).groupBy("bucket").applyInArrow(_occurs_earlier, _REPLY), "earlier-windows")
    earlier = earlier.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias("earlier"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owned("repeated passages")
        for batch in batches:
            kept_docs = batch.column("docs") if keep else None
            for k, row in enumerate(batch.drop_columns(["docs"] if keep else []).to_pylist()):
                w, start, keys = _candidates(row, buckets)
                first, ends, of, _ = _first_ones(keys, buckets)
                late = np.zeros(len(first), bool)
                for b, bits in _replies(row["earlier"]).items():
                    late[ends[b] : ends[b + 1]] = bits
                again = np.ones(len(start), bool)
                again[first] = False
                repeat = start[again | late[of]]
                edge = np.zeros(w.n + WINDOW + 1, np.int32)
                edge[repeat] += 1
                edge[repeat + WINDOW] -= 1
                gone = np.cumsum(edge)[: w.n] > 0
                removed = np.zeros(w.n + 1, np.int64)
                np.cumsum(gone, out=removed[1:])
                out = {
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "n_words": pa.array(np.diff(w.first), pa.int64()),
                    "n_removed": pa.array(np.diff(removed[w.first]), pa.int64()),
                    "kept_text": kept_text(w, gone).cast(pa.string()),
                }
                if keep:
                    offsets = np.concatenate([[0], np.cumsum(row["lengths"])]).astype(np.int64)
                    whole_text = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(w.raw.tobytes())]).cast(pa.string())
                    out["clean_text"] = pc.if_else(pc.equal(out["n_removed"], 0), whole_text, out["kept_text"])
                    out["doc"] = kept_docs[k].values
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    both = text_chunks.join(shared, "chunk", "left").join(earlier, "chunk", "left")
    schema = T.StructType().add("doc_id", "long").add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    if keep:
        schema = schema.add("clean_text", "string").add("doc", text_chunks.schema["docs"].dataType.elementType)
    return both.mapInArrow(remove, schema)


def cleaned(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents with repeated windows of words taken out of their texts.

    Untouched texts stay as they are, white space included; in the others the
    kept words are joined by one blank. A null text becomes empty; a document
    of which nothing is left stays, with an empty text.
    """
    found = remove_repeats(docs, text, doc_id, [c for c in docs.columns if c != text])  # the text comes back as clean_text
    return found.select(*[(F.col("clean_text") if c == text else F.col("doc").getField(c)).alias(c) for c in docs.columns])
