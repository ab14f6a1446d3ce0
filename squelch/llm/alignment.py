"""Alignment of two tokenizers over the same bytes, with each distinct segment aligned once.

A text (after one blank) is split before white space, at places where neither
vocabulary can merge: one cuts every text there itself, the other has no piece
that goes from another character over to that white space, which
``safe_blanks`` reads off its vocabulary. So the tokens of a text are those of
its segments, one after another.

1. Documents become chunks of some MB. A chunk sends its distinct segments, and
   one row of places: for each segment of each document, its number in the chunk.
2. Sorted by segment, equal ones of all chunks stand together; each is encoded
   by both tokenizers and aligned once, and the alignment goes back to each
   chunk that sent it: the ids of both sides, and for every stretch between two
   ends which side ends there.
3. A chunk composes its documents from that, and tells which pairs of ids each
   one links. Pairs are counted over documents, and each first id's highest
   count is found.
4. The chunks' distinct pairs learn their counts, and documents add them up.

What is shuffled is a row for each distinct segment and each distinct pair of a
chunk, so one that stands in every document is one row for each chunk.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squelch.llm.shared import pieces, stored, text_buffer
from squelch.llm.words import Words, fingerprints

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CHUNK_BYTES = 8_000_000
#: Bytes of text that are cut and named at a time.
PIECE_BYTES = 2_000_000
#: A pair of ids as one number.
PAIR = 1 << 20
_UNDERLINE = "\u2581"
#: White space beyond ASCII, and what some libraries count as it (the mark for a blank too): no cut after these.
_WIDE = "\u2581\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200C)))
_LAST_BYTES = sorted({c.encode()[-1] for c in _WIDE})


def _byte_letters() -> dict[str, int]:
    """The public byte-level alphabet, from letter to byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(shown))
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Pair:
    """Both tokenizers and the bytes of each of their tokens."""

    def __init__(self, byte_level: str, pieces_model: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_model)
        letters = _byte_letters()
        vocabulary = {i: x for x, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [bytes(letters[c] for c in vocabulary.get(i, "") if c in letters) for i in range(self.a.get_vocab_size())]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in v]) for v in (self.a_bytes, self.b_bytes))
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << 16:
            raise ValueError("ids have to fit 16 bits")
        self.blank = self.b.piece_to_id(_UNDERLINE)

    def _piece(self, i: int) -> bytes:
        x = self.b.id_to_piece(i)
        return bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace(_UNDERLINE, " ").encode()

    def safe_blanks(self) -> bytes:
        """ASCII white space that no piece has right after another character, so no merge can cross a cut before it."""
        crossed = set()
        for i, x in enumerate(self.b_bytes):
            if not self.b.is_byte(i):
                text = x.decode()
                crossed |= {c for before, c in zip(text, text[1:]) if not before.isspace()}
        return bytes(c for c in b" \n\t\r\x0b\x0c" if chr(c) not in crossed)

    def encoded(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each segment by the first and the second tokenizer; the second puts a blank before each."""
        a = [x.ids for x in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        b = self.b.encode([x[1:] if x[:1] == " " else x for x in segments], num_threads=1)
        for k, x in enumerate(segments):
            if x[:1] == " ":
                if len(x) == 1:  # nothing but the blank, for which the library gives no piece
                    b[k] = [self.blank]
            elif b[k][:1] == [self.blank]:
                b[k] = b[k][1:]  # inside a text there is no blank before it
            else:
                b[k] = []
        return a, b


@lru_cache(4)
def pair_of(byte_level: str, pieces_model: str) -> Pair:
    """One for each process."""
    return Pair(byte_level, pieces_model)


def cuts(raw: np.ndarray, offsets: np.ndarray, safe: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where segments begin in the texts' bytes, and which text each is of: before safe white space after anything else."""
    blank = np.zeros(256, bool)
    blank[list(b" \t\n\r\x0b\x0c")] = True
    safe_at = np.zeros(256, bool)
    safe_at[list(safe)] = True
    begins = np.zeros(len(raw), bool)
    if len(raw) > 1:
        begins[1:] = safe_at[raw[1:]] & ~blank[raw[:-1]]
        last = np.zeros(256, bool)
        last[_LAST_BYTES] = True
        maybe = np.flatnonzero(begins[1:] & last[raw[:-1]]) + 1  # the character before may be wide white space
        for at in maybe.tolist():
            head = at - 1
            while head > 0 and raw[head] & 0xC0 == 0x80:
                head -= 1
            if raw[head:at].tobytes().decode(errors="replace") in _WIDE:
                begins[at] = False
    sizes = np.diff(offsets)
    begins[offsets[:-1][sizes > 0]] = True
    start = np.flatnonzero(begins)
    return start, np.searchsorted(offsets, start, side="right") - 1


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers below 2^32, as compressed planes of bytes."""
    planes = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(blob, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


class _Gathered:
    """A chunk while its texts come in."""

    def __init__(self) -> None:
        self.ids: list[pa.Array] = []
        self.counts: list[np.ndarray] = []
        self.names: list[np.ndarray] = []
        self.segments: dict[int, bytes] = {}
        self.size = 0

    def add(self, some: pa.RecordBatch, safe: bytes) -> None:
        raw, offsets = text_buffer(some.column("text"))
        start, of_text = cuts(raw, offsets, safe)
        end = np.append(start[1:], len(raw))
        names = fingerprints(Words(raw, start, end, np.zeros(1, np.int64))) if len(start) else np.zeros(0, np.uint64)
        distinct, first, number = np.unique(names, return_index=True, return_inverse=True)
        self._verify(raw, start, end, first[number])
        for name, a, b in zip(distinct.tolist(), start[first].tolist(), end[first].tolist(), strict=True):
            bytes_ = raw[a:b].tobytes()
            if self.segments.setdefault(name, bytes_) != bytes_:
                raise RuntimeError("two segments share a fingerprint")
        self.ids.append(some.column("doc_id"))
        self.counts.append(np.bincount(of_text, minlength=len(some)))
        self.names.append(names)
        self.size += len(raw)

    @staticmethod
    def _verify(raw: np.ndarray, start: np.ndarray, end: np.ndarray, like: np.ndarray) -> None:
        """Segments of one name must have the same bytes (64 bits can't promise that)."""
        size = end - start
        shift = np.repeat(start[like] - start, size)
        if (size != size[like]).any() or (raw[np.arange(len(raw)) + shift] != raw).any():
            raise RuntimeError("two segments share a fingerprint")

    def rows(self, chunk: int) -> Iterator[pa.RecordBatch]:
        """The row of places, then the distinct segments, the most frequent ones first."""
        names = np.concatenate(self.names)
        distinct, number, count = np.unique(names, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ids, n = pa.concat_arrays(self.ids), len(distinct)
        head = {
            "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "counts": pa.array([_packed(np.concatenate(self.counts))]), "places": pa.array([_packed(place[number])]),
            "n_places": pa.array([len(names)]), "n_segments": pa.array([n]),
        }
        yield self._batch(chunk, np.array([-1]), [_as_bytes(pa.RecordBatch.from_arrays(list(head.values()), names=list(head)))])
        for at in range(0, n, 20_000):
            some = [self.segments[x] for x in distinct[order[at : at + 20_000]].tolist()]
            yield self._batch(chunk, np.arange(at, at + len(some)), some)

    @staticmethod
    def _batch(chunk: int, places: np.ndarray, content: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(content), chunk)), pa.array(places.astype(np.int32)), pa.array(content, pa.binary())], names=["chunk", "place", "content"])


def _as_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


#: place -1: the chunk's places; from 0 on: a segment, later its alignment.
_ROW = "chunk bigint, place int, content binary"


def segment_rows(docs: DataFrame, text: str, doc_id: str, tokenizers: tuple[str, str]) -> DataFrame:
    """Of each chunk of whole documents, a row of places (place -1) and a row for each distinct segment."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, safe, held = TaskContext.get().partitionId(), 0, pair_of(*tokenizers).safe_blanks(), _Gathered()
        for batch in batches:
            for some in pieces(batch, "text", PIECE_BYTES):
                held.add(some, safe)
                if held.size >= CHUNK_BYTES:
                    yield from held.rows(part << 32 | seq)
                    seq, held = seq + 1, _Gathered()
        if held.ids:
            yield from held.rows(part << 32 | seq)

    blank_before = F.when(F.length(text) > 0, F.concat(F.lit(" "), F.col(text))).otherwise("")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(blank_before, F.lit("")).alias("text")).mapInArrow(build, _ROW)


def stretches(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of either side in order, and which side each is of: bit 0 the first, bit 1 the second.

    Each stretch between two neighbouring ends lies in one token of each side,
    and two tokens share at most one stretch, so stretches are links.
    """
    ends = np.union1d(a_ends, b_ends)
    marks = np.zeros(len(ends), np.uint8)
    marks[np.searchsorted(ends, a_ends)] = 1
    marks[np.searchsorted(ends, b_ends)] |= 2
    return ends, marks


_LONG = 255


def _alignments(tokenizers: Pair, segments: list[bytes]) -> list[bytes]:
    """Of each segment: how many ids each side has (a byte each, or a mark and 32 bits each), the ids (16 bits each), a byte for each stretch.

    A stretch's byte has bit 0 where the first side ends, bit 1 where the second
    does. Nothing where either side's bytes aren't the segment's.
    """
    a, b = tokenizers.encoded([x.decode() for x in segments])
    spelled = [b"".join(map(tokenizers.a_bytes.__getitem__, p)) == x == b"".join(map(tokenizers.b_bytes.__getitem__, q)) for x, p, q in zip(segments, a, b, strict=True)]
    a, b = ([x if good else [] for x, good in zip(ids, spelled, strict=True)] for ids in (a, b))
    a_ids, b_ids = (np.fromiter((i for x in ids for i in x), np.int64) for ids in (a, b))
    a_ends, b_ends = np.cumsum(tokenizers.a_sizes[a_ids]), np.cumsum(tokenizers.b_sizes[b_ids])
    ends, marks = stretches(a_ends, b_ends)
    limits = np.cumsum([len(x) if good else 0 for x, good in zip(segments, spelled, strict=True)])
    cut = np.searchsorted(ends, limits, side="right").tolist()
    a_raw, b_raw, mark_raw = a_ids.astype("<u2").tobytes(), b_ids.astype("<u2").tobytes(), marks.tobytes()
    found, p, q, r = [], 0, 0, 0
    for k, good in enumerate(spelled):
        n, m = len(a[k]), len(b[k])
        p2, q2, r2 = p + 2 * n, q + 2 * m, cut[k]
        head = bytes((n, m)) if n < _LONG and m < _LONG else bytes((_LONG,)) + struct.pack("<II", n, m)
        found.append(head + a_raw[p:p2] + b_raw[q:q2] + mark_raw[r:r2] if good else b"")
        p, q, r = p2, q2, r2
    return found


def aligned(rows: DataFrame, tokenizers: tuple[str, str]) -> DataFrame:
    """The rows with each segment's alignment in its stead; they have to come sorted by ``place >= 0`` and content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, last = pair_of(*tokenizers), (None, None)
        for batch in batches:
            n = int((batch.column("place").to_numpy() < 0).sum())  # rows of places come first
            if n:
                yield batch.slice(0, n)
            coded = batch.column("content").slice(n).dictionary_encode()  # equal ones stand together, so each is there once
            segments = coded.dictionary.to_pylist()
            fresh = segments[1:] if segments and segments[0] == last[0] else segments
            found = []
            for at in range(0, len(fresh), 4096):
                found += _alignments(both, fresh[at : at + 4096])
            if len(fresh) < len(segments):
                found.insert(0, last[1])  # the batch before ended with it
            if segments:
                last = (segments[-1], found[-1])
                column = pa.array(found, pa.binary()).take(coded.indices)
                yield pa.RecordBatch.from_arrays([batch.column("chunk").slice(n), batch.column("place").slice(n), column], names=["chunk", "place", "content"])

    return rows.mapInArrow(run, _ROW)


def _slices(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of many slices, one after another."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


#: Decimal numbers of ids, shared by all that are written.
_NUMBERS = [str(i) for i in range(1 << 16)]


class _Decoded:
    """The alignments of a chunk's segments, by their places."""

    def __init__(self, column: pa.Array):
        whole = column.cast(pa.large_binary())
        offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
        raw = np.frombuffer(whole.buffers()[2], np.uint8) if whole.buffers()[2] is not None else np.zeros(0, np.uint8)
        size, start = np.diff(offsets), offsets[:-1]
        self.ok = size > 0
        at = start[self.ok]
        long, n_a, n_b = raw[at] == _LONG, raw[at].astype(np.int64), raw[np.minimum(at + 1, len(raw) - 1)].astype(np.int64)
        wide = raw[_slices(at[long] + 1, np.full(long.sum(), 8))].view("<u4").reshape(-1, 2).astype(np.int64)
        n_a[long], n_b[long] = wide[:, 0], wide[:, 1]
        head = np.zeros(len(size), np.int64)
        head[self.ok] = np.where(long, 9, 2)
        self.n_a, self.n_b, self.n_links = (np.zeros(len(size), np.int64) for _ in range(3))
        self.n_a[self.ok], self.n_b[self.ok] = n_a, n_b
        self.n_links = size - head - 2 * (self.n_a + self.n_b)
        two = lambda at, n: raw[_slices(at, 2 * n)].view("<u2").astype(np.int64)
        self.a = two(start + head, self.n_a)
        self.b = two(start + head + 2 * self.n_a, self.n_b)
        start = start + head
        self.marks = raw[_slices(start + 2 * (self.n_a + self.n_b), self.n_links)]
        a_end, b_end = self.marks & 1, self.marks >> 1
        self.a_of, self.b_of = np.cumsum(a_end) - a_end, np.cumsum(b_end) - b_end  # both sides end with a segment
        self.pairs = self.a[self.a_of] * PAIR + self.b[self.b_of]
        self.first = np.concatenate([[0], np.cumsum(self.n_links)])
        both = np.concatenate([[0], np.cumsum(self.marks == 3)])
        self.n_groups = both[self.first[1:]] - both[self.first[:-1]]

    def groups(self) -> list[bytes]:
        """Each segment's groups as text."""
        a, b = ([_NUMBERS[i] for i in ids.tolist()] for ids in (self.a, self.b))
        at = np.flatnonzero(self.marks == 3)
        a_stop, b_stop = (self.a_of[at] + 1).tolist(), (self.b_of[at] + 1).tolist()
        each = [f"{','.join(a[p:q])}|{','.join(b[r:s])}" for p, q, r, s in zip([0, *a_stop], a_stop, [0, *b_stop], b_stop)]
        stop = np.cumsum(self.n_groups).tolist()
        return [";".join(each[p:q]).encode() for p, q in zip([0, *stop], stop)]


_DOCS = ("n_a", "n_b", "n_groups", "n_links")
_COMPOSED = "chunk bigint, doc_ids array<bigint>, " + ", ".join(f"{x} array<bigint>" for x in _DOCS) + ", digests array<string>, pairs array<bigint>, docs array<bigint>, sizes binary, steps binary, times binary, n_held bigint"
#: Links that are looked at in a go.
_LINKS = 1 << 20


def _held_pairs(doc: np.ndarray, place: np.ndarray, d: _Decoded, number: np.ndarray, n_docs: int, n_pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's distinct pairs: (document, pair's number, times), in this order."""
    sizes = d.n_links[place]
    ends = np.cumsum(sizes)
    found, begin = [], 0
    while begin < len(doc):
        end = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + _LINKS, side="right"))
        end = int(np.searchsorted(doc, doc[min(max(end, begin + 1), len(doc)) - 1], side="right"))  # whole documents
        links = np.repeat(doc[begin:end], sizes[begin:end]) * n_pairs + number[_slices(d.first[place[begin:end]], sizes[begin:end])]
        found.append(np.unique(links, return_counts=True))
        begin = end
    keys = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
    times = np.concatenate([n for _, n in found]) if found else np.zeros(0, np.int64)
    return keys // max(n_pairs, 1), keys % max(n_pairs, 1), times


def _compose(rows: pa.Table) -> pa.Table:
    """A chunk's documents: their sums and digests, the chunk's distinct pairs, how many documents hold each, and which."""
    rows = rows.sort_by([("place", "ascending")]).combine_chunks()
    alone = rows.column("place")[0].as_py() == -1
    head = next(iter(pa.ipc.open_stream(rows.column("content")[0].as_buffer()))) if alone else None
    head = {n: head.column(n)[0] for n in head.schema.names} if alone else {}
    if not alone or rows.num_rows != head["n_segments"].as_py() + 1:
        raise RuntimeError("a chunk was built anew with other rows; store the documents first")
    n_docs = len(head["doc_ids"].values)
    doc = np.repeat(np.arange(n_docs), _unpacked(head["counts"].as_py(), n_docs))
    place = _unpacked(head["places"].as_py(), head["n_places"].as_py())
    d = _Decoded(rows.column("content").slice(1).combine_chunks() if rows.num_rows > 1 else pa.array([], pa.binary()))
    good = np.zeros(n_docs, bool)
    good[doc] = True
    good[doc[~d.ok[place]]] = False
    at = np.searchsorted(doc, np.arange(n_docs + 1)).tolist()
    written = d.groups()
    digests = [hashlib.sha256(b";".join(map(written.__getitem__, place[a:b].tolist()))).hexdigest() if g else "" for a, b, g in zip(at, at[1:], good.tolist())]
    del written
    kept = good[doc]
    doc, place = doc[kept], place[kept]
    distinct, number = np.unique(d.pairs, return_inverse=True)
    of_doc, pair, times = _held_pairs(doc, place, d, number, n_docs, len(distinct))
    held = np.bincount(pair, minlength=len(distinct))
    used = np.flatnonzero(held)  # pairs of documents without tokens don't count
    short = np.cumsum(held > 0) - 1
    pair = short[pair]
    step = np.diff(pair, prepend=0)
    new = np.flatnonzero(np.diff(of_doc, prepend=-1))
    step[new] = pair[new]
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    sums = {n: np.bincount(doc, getattr(d, n)[place], n_docs).astype(np.int64) for n in _DOCS}
    return pa.table({
        "chunk": pa.array([rows.column("chunk")[0].as_py()]), "doc_ids": one(head["doc_ids"].values), **{n: one(pa.array(v)) for n, v in sums.items()}, "digests": one(pa.array(digests, pa.string())),
        "pairs": one(pa.array(distinct[used])), "docs": one(pa.array(held[used])), "sizes": pa.array([_packed(np.bincount(of_doc, minlength=n_docs))], pa.binary()),
        "steps": pa.array([_packed(step)], pa.binary()), "times": pa.array([_packed(times)], pa.binary()), "n_held": pa.array([len(pair)]),
    })


_ROWS = "doc_id bigint, " + ", ".join(f"{x} bigint" for x in (*_DOCS, "n_best", "count_sum")) + ", groups_sha256 string"


def _documents(chunk: pa.Table, rows: pa.Table) -> pa.Table:
    """The result's rows of a chunk's documents, with what its pairs (in the order of their places) count."""
    if not chunk.num_rows:
        return pa.table({x.split()[0]: pa.array([], pa.string() if "string" in x else pa.int64()) for x in _ROWS.split(", ")})
    ids = chunk.column("doc_ids")[0].values
    rows = rows.sort_by([("place", "ascending")])
    docs, best = rows.column("docs").to_numpy(), rows.column("best").to_numpy(zero_copy_only=False)
    n = chunk.column("n_held")[0].as_py()
    sizes = _unpacked(chunk.column("sizes")[0].as_py(), len(ids))
    steps, times = (_unpacked(chunk.column(c)[0].as_py(), n) for c in ("steps", "times"))
    total = np.concatenate([[0], np.cumsum(steps)])
    before = np.repeat(total[np.cumsum(sizes) - sizes], sizes)
    pair, of_doc = total[1:] - before, np.repeat(np.arange(len(ids)), sizes)
    sums = [np.zeros(len(ids), np.int64) for _ in range(2)]
    np.add.at(sums[0], of_doc, np.where(best[pair], times, 0) if n else times)
    np.add.at(sums[1], of_doc, docs[pair] * times if n else times)
    out = {"doc_id": ids, **{c: chunk.column(c)[0].values for c in _DOCS}, "n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1]), "groups_sha256": chunk.column("digests")[0].values}
    return pa.table(out)


def align_documents(docs: DataFrame, byte_level: str, pieces_model: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document.

    The first tokenizer sees a blank and the text, the second the text. Groups
    end where tokens of both end; links are the pairs of tokens that share
    bytes. A pair of ids counts the documents, of all, in which it is linked;
    ``n_best`` are the links whose pair has the highest count of its first id.

    Null and empty texts, and those that either side's tokens don't spell out,
    have no tokens: zeros and ''. Every row is a document of its own, whatever
    ids repeat or are null. A text of any length stays whole. Other columns are
    ignored; an empty table gives an empty result. If a lost executor makes a
    chunk be built anew from rows in another order, that is refused, not mixed.
    """
    tokenizers = (byte_level, pieces_model)
    rows = segment_rows(docs, text, doc_id, tokenizers)
    segment = F.col("place") >= 0
    by_content = F.when(segment, F.col("content")).otherwise(F.col("chunk").cast("string").cast("binary"))  # rows of places go anywhere
    back = aligned(rows.repartition(by_content).sortWithinPartitions(segment, "content"), tokenizers)
    composed = stored(back.groupBy("chunk").applyInArrow(_compose, _COMPOSED), "aligned-chunks")

    first = F.floor(F.col("pair") / PAIR).alias("first")
    counts = composed.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("docs"))
    counts = stored(counts, "pair-counts")
    highest = counts.groupBy(first).agg(F.max("docs").alias("most"))
    judged = counts.withColumn("first", first).join(highest, "first").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))
    asked = composed.select(F.col("chunk").alias("of_chunk"), F.posexplode("pairs").alias("place", "pair")).join(judged, "pair").drop("pair")
    return composed.drop("pairs", "docs").groupBy("chunk").cogroup(asked.groupBy("of_chunk")).applyInArrow(_documents, _ROWS)
