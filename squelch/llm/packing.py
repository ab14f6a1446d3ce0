"""Packing pieces of documents into sequences by a configuration linear program.

A configuration is a set of piece lengths that fits a sequence. The fractional
program - fewest sequences that cover the histogram of lengths - is solved by
multiplicative weights: each round, a knapsack over the weighted lengths prices
the best configuration, and the lengths it covers lose weight. The same prices
bound the fewest sequences from below, so the rounds end when the mixture is
near that bound. It is rounded down to whole sequences, and what is left of the
histogram, best-fit decreasing, goes into the gaps and into new sequences.

Only the histogram reaches the driver, at most one counter for each length, and
the plan that goes back is bounded by the lengths too, not by the pieces.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from squelch.llm.shared import owned, pieces, stored, trimmed
from squelch.llm.tokens import encoder

ROUNDS, GAP = 3000, 0.004  # at most so many rounds; fewer once the mixture is so near the bound
CLASSES = 96  # classes of long lengths in the program
GRID = 512  # units of a sequence in the knapsack


def _classes(hist: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """Ranges (low, high) of lengths, each with about as many pieces; short pieces are left for the gaps."""
    lengths = np.flatnonzero(hist[: capacity + 1])
    lengths = lengths[lengths > capacity // 16]
    lengths = lengths[lengths < capacity]
    if not len(lengths):
        return []
    share = np.cumsum(hist[lengths]) / hist[lengths].sum()
    group = np.minimum((share * CLASSES).astype(int), CLASSES - 1)
    return [(int(lengths[group == g].min()), int(lengths[group == g].max())) for g in np.unique(group)]


def _best(value: np.ndarray, units: np.ndarray) -> dict[int, int]:
    """The knapsack's best multiset of classes for one sequence, by dynamic programming over its units."""
    best, pick = np.zeros(GRID + 1), np.full(GRID + 1, -1)
    for c in range(int(units.min()), GRID + 1):
        n = np.searchsorted(units, c, side="right")  # units ascend with the lengths
        gain = best[c - units[:n]] + value[:n]
        k = int(gain.argmax())
        if gain[k] > best[c - 1]:
            best[c], pick[c] = gain[k], k
        else:
            best[c] = best[c - 1]
    found: Counter[int] = Counter()
    c = GRID
    while c > 0:
        if pick[c] < 0:
            c -= 1
            continue
        found[int(pick[c])] += 1
        c -= int(units[pick[c]])
    return dict(found)


def configurations(hist: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[int, int]], list[tuple[dict[int, int], float]]]:
    """The classes, and the configurations with the (fractional) number of sequences for each."""
    classes = _classes(hist, capacity)
    if not classes:
        return [], []
    high = np.array([b for _, b in classes])
    demand = np.array([hist[a : b + 1].sum() for a, b in classes], float)
    units = -(-high * GRID // capacity)
    log_weight, covered, used = np.log(high / capacity), np.zeros(len(classes)), Counter()
    bound = 0.0
    for done in range(1, rounds + 1):
        weight = np.exp(log_weight - log_weight.max())
        value = weight * demand.mean() / demand
        config = _best(value, units)
        # Prices over the best configuration's worth satisfy the dual program.
        bound = max(bound, float(value @ demand) / sum(n * value[g] for g, n in config.items()))
        for g, n in config.items():
            covered[g] += n / demand[g]
            log_weight[g] -= 0.05 * n * demand.mean() / demand[g]
        used[tuple(sorted(config.items()))] += 1
        if covered.min() > 0 and done / covered.min() <= bound * (1 + GAP):
            break
    scale = 1 / max(np.median(covered), 1e-12)
    return classes, [(dict(c), n * scale) for c, n in used.most_common()]


def plan(hist: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Sequences as (how many, lengths in each): together exactly the histogram.

    Where best-fit decreasing alone needs fewer sequences than the program's
    rounded mixture (few pieces, lengths that hardly combine), it is taken.
    """
    made = [_filled(hist, capacity, *configurations(np.append(hist[:capacity], 0), capacity)), _filled(hist, capacity, [], [])]
    return min(made, key=lambda bins: sum(n for n, _ in bins))


def _filled(hist: np.ndarray, capacity: int, classes: list[tuple[int, int]], mixture: list[tuple[dict[int, int], float]]) -> list[tuple[int, list[int]]]:
    left = hist.astype(np.int64).copy()
    bins: list[tuple[int, list[int]]] = []
    if left[capacity]:
        bins.append((int(left[capacity]), [capacity]))
        left[capacity] = 0
    open_bins: list[tuple[int, list[int]]] = []
    for config, amount in mixture:
        todo = int(amount)
        while todo > 0:
            slots: list[int] = []
            take: Counter[int] = Counter()
            for g, n in sorted(config.items(), reverse=True):
                low, high = classes[g]
                for _ in range(n):
                    room = capacity - sum(slots)
                    fitting = [x for x in range(high, low - 1, -1) if x <= room and left[x] > take[x]]
                    if not fitting:
                        break
                    slots.append(fitting[0])
                    take[fitting[0]] += 1
            if sum(slots) < capacity * 3 // 4:
                break
            n = min([todo, *(int(left[x]) // k for x, k in take.items())])
            for x, k in take.items():
                left[x] -= n * k
            open_bins.append((n, slots))
            todo -= n
    gaps: dict[int, list[tuple[int, list[int]]]] = {}
    for n, slots in open_bins:
        gaps.setdefault(capacity - sum(slots), []).append((n, slots))
    rooms = sorted(gaps)
    for length in range(capacity - 1, 0, -1):
        while left[length]:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                each = min(capacity // length, int(left[length]))
                n, slots, room = int(left[length]) // each, [length] * each, capacity
                left[length] -= n * each
            else:
                room = rooms[k]
                have, slots = gaps[room].pop()
                if not gaps[room]:
                    del gaps[room], rooms[k]
                each = min(room // length, int(left[length]))
                n = min(have, int(left[length]) // each)
                left[length] -= n * each
                if have > n:
                    if room not in gaps:
                        gaps[room] = []
                        bisect.insort(rooms, room)
                    gaps[room].append((have - n, slots))
                slots = [*slots, *[length] * each]
            room = capacity - sum(slots)
            if room not in gaps:
                gaps[room] = []
                bisect.insort(rooms, room)
            gaps[room].append((n, slots))
    return bins + [x for room in rooms for x in gaps[room]]


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, as little-endian uint32 bytes) of every piece.

    A document is its ids and then ``end_id``; a null text is empty. Documents
    longer than ``capacity`` are cut into pieces of that length, the last one
    shorter. Repeated rows make pieces of their own.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for some in pieces(batch, "text", 4_000_000):
                rows = []
                for key, ids in zip(some.column("doc_id").to_pylist(), enc.encode(some.column("text")), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((key, k, at // 4, len(part) // 4, zlib.crc32(part), part)[: len(names)])
                columns = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owned("packing")
        yield from cut(batches)
        trimmed()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(task, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack(items: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (a column of lengths from 1 to ``capacity``).

    Pieces of one length are interchangeable: each gets a rank among them, and
    the plan says which ranks go to which sequence and place. Ranks are dealt
    within each task and shifted by the counts of the tasks before, so a length
    that a third of all pieces share needs no sort and no single task. Columns
    of the input with one of the two names are replaced; a null, empty or too
    long length is an error. Equal rows are pieces of their own.
    Sequences are filled from 0 without gaps; an empty table stays empty.
    """
    spark = items.sparkSession
    names = [c for c in items.columns if c not in ("sequence_id", "offset")]
    rows = items.select(F.struct(*names).alias("item"), F.col(length).cast("int").alias("_length"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            if batch.column("_length").null_count:
                raise ValueError("a piece has no length")
            lengths = batch.column("_length").to_numpy(zero_copy_only=False).astype(np.int64)
            if len(lengths) and (lengths.min() < 1 or lengths.max() > capacity):
                raise ValueError("a piece is empty or longer than a sequence")
            order = np.argsort(lengths, kind="stable")
            counts = np.bincount(lengths, minlength=capacity + 1)
            within = np.arange(len(lengths)) - np.repeat(np.cumsum(counts) - counts, counts)
            local = np.empty(len(lengths), np.int64)
            local[order] = within
            local += seen[lengths]
            seen += counts
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(lengths), part, np.int32)), pa.array(local)], names=[*batch.schema.names, "_part", "_local"])

    schema = T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType())])
    rows = stored(rows.mapInArrow(numbered, schema), "pieces")
    counts = stored(rows.groupBy("_part", "_length").count(), "piece-counts")
    hist = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("_length").agg(F.sum("count").alias("n")).collect():  # at most `capacity` rows
        hist[r._length] = r.n
    # The plan as rows (length, first rank, per sequence, first sequence, offset of the first place).
    layout, rank, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for n, lengths in plan(hist, capacity):
        offset = 0
        for x, k in sorted(Counter(lengths).items(), reverse=True):
            layout.append((x, int(rank[x]), k, sequence, offset))
            rank[x] += n * k
            offset += x * k
        sequence += n
    starts: dict[int, list[tuple]] = {}
    for x, first, k, seq, off in layout:
        starts.setdefault(x, []).append((first, k, seq, off))
    shared = spark.sparkContext.broadcast({x: np.array(v, np.int64) for x, v in starts.items()})
    before = counts.withColumn("_before", F.sum("count").over(W.partitionBy("_length").orderBy("_part")) - F.col("count")).select("_part", "_length", "_before")
    rows = rows.join(before.hint("merge"), ["_part", "_length"]).select("item", "_length", (F.col("_local") + F.col("_before")).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("_length").to_numpy(zero_copy_only=False)
            ranks = batch.column("_rank").to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for x in np.unique(lengths):
                mine, table = np.flatnonzero(lengths == x), shared.value[int(x)]
                row = table[np.searchsorted(table[:, 0], ranks[mine], side="right") - 1]
                nth = ranks[mine] - row[:, 0]
                seq[mine] = row[:, 2] + nth // row[:, 1]
                off[mine] = row[:, 3] + nth % row[:, 1] * int(x)
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(seq), pa.array(off)], names=["item", "sequence_id", "offset"])

    schema = T.StructType([rows.schema["item"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return rows.mapInArrow(place, schema).select("item.*", "sequence_id", "offset")
