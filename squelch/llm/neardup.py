"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five consecutive words (all words of a shorter text), known by 48
bits. Its weight is its count in the text times a smoothed inverse document
frequency from 1 to 1.25 (a wider range would let a large group of near copies
dissolve: the more there are, the less their common shingles would count against
each copy's own); the documents that hold it are counted over all
documents, exactly but for one shingle in a thousand that shares 32 bits with
another of its bucket, at any size of the input.

For each hash function the shingle with the least ln a = ln c - r (t - beta + 1)
is sampled, where t = floor(ln w / r + beta); r and c are Gamma(2, 1), by
65,536 quantiles each, and beta is uniform, all three functions of shingle and
hash function. The sample is the pair (shingle, t), so two texts have it in
common with the probability of their weighted Jaccard similarity.

Bands of four samples make buckets. In each bucket every text is compared with
the first one. Where a bucket still holds several classes, every pair of texts
of different classes is compared, block by block, in the first bucket that the
two share. A link is a weighted Jaccard similarity of 0.8 or more, worked out
on the shingles and weights themselves; classes are the components of links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from squelch.llm import exchange
from squelch.llm.components import components
from squelch.llm.exchange import PLACE_BITS, Chunk
from squelch.llm.shared import owned, stored
from squelch.llm.words import Words, fingerprints, mixed, whole, windows, words_of

SHINGLE = 5
BANDS, ROWS = 16, 4
SIMILAR = 0.8
#: How much more a shingle of one document alone weighs than one that all share.
RARITY = 0.25
#: Members that are compared with one text in one run of rows.
MEMBERS = 128
#: Shingles in a block of a bucket; two blocks are compared by one task.
BLOCK_SHINGLES = 1 << 18
#: Shingles that are sampled at once, so that the arrays stay in a core's cache.
BLOCK = 1 << 14

_rng = np.random.default_rng(733)
_PICK = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_gamma: list[np.ndarray] = []


def shingles(w: Words, prints: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text of a batch: (text, 48-bit shingle, count), ascending."""
    ok = whole(w.first, w.n, k)
    text = w.text_of()
    all_text, all_hash = [text[: len(ok)][ok]], [windows(prints, k)[ok]]
    sizes = np.diff(w.first)
    for n in range(1, k):
        short = np.flatnonzero(sizes == n)
        if len(short):
            all_text.append(short)
            all_hash.append(windows(prints, n)[w.first[short]])
    joint = (np.concatenate(all_text).astype(np.uint64) << np.uint64(48)) | (np.concatenate(all_hash) >> np.uint64(16))
    joint, count = np.unique(joint, return_counts=True)
    return (joint >> np.uint64(48)).astype(np.int64), joint & np.uint64((1 << 48) - 1), count


def shingles_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = words_of(raw, offsets)
    return shingles(w, fingerprints(w))


def _sent(batch: pa.RecordBatch, k: int, chunk: Chunk) -> exchange.Entries:
    _, shingle, _ = shingles_of(chunk.raw, chunk.offsets)
    distinct, docs = np.unique(shingle, return_counts=True)
    return {"key": distinct << np.uint64(16), "low": distinct & np.uint64(0xFFFFFFFF), "docs": docs}


def _sums(entries: exchange.Entries) -> np.ndarray:
    """For each entry, the documents of all chunks that hold its shingle."""
    order = np.argsort(entries["low"], kind="stable")
    ranked = entries["low"][order]
    head = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    total = np.add.reduceat(entries["docs"][order].astype(np.int64), head)
    out = np.empty(len(ranked), np.int64)
    out[order] = np.repeat(total, np.diff(np.append(head, len(ranked))))
    return np.minimum(out, 2**32 - 1)


def with_frequencies(chunks: DataFrame) -> DataFrame:
    """Chunks with ``answers``: for each distinct shingle, in ascending order, the documents of the corpus that hold it."""
    counts = exchange.ask(chunks, _sent, {"low": "<u4", "docs": "<u4"}, _sums, "<u4", exchange.bucket_count(chunks))
    return chunks.join(stored(counts, "frequencies"), "chunk", "left")


def weights(count: np.ndarray, holders: np.ndarray, documents: int) -> np.ndarray:
    """count x (1 + RARITY x ln((n + 1) / (df + 1)) / ln(n + 1)), in single precision."""
    rare = np.log((documents + 1) / (np.minimum(holders, documents) + 1.0)) / max(np.log(documents + 1), 1e-9)
    return (count * (1 + RARITY * rare)).astype(np.float32)


def weighted(batch: pa.RecordBatch, k: int, chunk: Chunk, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of a chunk with frequencies."""
    text, shingle, count = shingles_of(chunk.raw, chunk.offsets)
    holders = exchange.replies(batch.column("answers"), k, "<u4")
    _, of = np.unique(shingle, return_inverse=True)
    return text, shingle, weights(count, holders[of], documents)


def _gamma_quantiles() -> np.ndarray:
    """Gamma(2, 1) at 65,536 even quantiles: where 1 - (1 + x) exp(-x) is the quantile, by halving."""
    if not _gamma:
        aim = (np.arange(1 << 16) + 0.5) / (1 << 16)
        low, high = np.zeros(1 << 16), np.full(1 << 16, 40.0)
        for _ in range(50):
            x = (low + high) / 2
            under = 1 - (1 + x) * np.exp(-x) < aim
            low, high = np.where(under, x, low), np.where(under, high, x)
        _gamma.append((low + high) / 2)
    return _gamma[0]


@dataclass
class _Draws:
    r: np.ndarray
    inverse: np.ndarray
    ln_c: np.ndarray


def samples(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have shingles, and for each the 32 bits of (shingle, t) that every hash function samples."""
    if not len(text):
        return np.zeros(0, np.int64), np.zeros((0, BANDS * ROWS), np.uint32)
    gamma = _gamma_quantiles()
    draws = _Draws(gamma.astype(np.float32), (1 / gamma).astype(np.float32), np.log(gamma).astype(np.float32))
    head = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    spread, ln_w = mixed(shingle), np.log(weight)
    out = np.empty((len(head), BANDS * ROWS), np.uint32)
    ends = np.append(head[1:], len(text))
    at = 0
    while at < len(head):  # whole texts, about a block of shingles at once
        to = max(int(np.searchsorted(ends, head[at] + BLOCK, "right")), at + 1)
        mine = slice(head[at], ends[to - 1])
        out[at:to] = _sampled(spread[mine], ln_w[mine], head[at:to] - head[at], draws)
        at = to
    return text[head], out


def _sampled(spread: np.ndarray, ln_w: np.ndarray, head: np.ndarray, draws: _Draws) -> np.ndarray:
    out = np.empty((len(head), BANDS * ROWS), np.uint32)
    for j, pick in enumerate(_PICK):
        h = spread * pick
        field = h.view(np.uint16).reshape(-1, 4)  # little-endian: [3] are the highest bits
        pr, pc = field[:, 3], field[:, 2]
        beta = field[:, 1] * np.float32(1 / (1 << 16))
        t = np.floor(ln_w * draws.inverse[pr] + beta)
        ln_a = draws.ln_c[pc] - draws.r[pr] * (t - beta + np.float32(1))
        bits = ln_a.view(np.int32)
        key = (bits ^ ((bits >> np.int32(31)) & np.int32(0x7FFFFFFF))).astype(np.int64) << np.int64(32)
        # Which shingle and which t: 32 mixed bits of both, below the 32 bits that order them.
        key |= (((h ^ (t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).view(np.int64)
        out[:, j] = np.minimum.reduceat(key, head) & np.int64(0xFFFFFFFF)
    return out


def banded(sample: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    keys = np.zeros((len(sample), BANDS), np.uint64)
    for band in range(BANDS):
        h = np.full(len(sample), band + 1, np.uint64)
        for j in range(ROWS):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + sample[:, band * ROWS + j])
        keys[:, band] = h
    return keys.view(np.int64)


def signatures(chunks: DataFrame, documents: int) -> DataFrame:
    """row, doc_id, h1 and h2 (128 bits of a cryptographic hash of the text) and bands; null bands where there are no words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owned("near duplicates")
        for batch in batches:
            for k, chunk in exchange.opened(batch):
                have, sample = samples(*weighted(batch, k, chunk, documents))
                flat, ends = banded(sample), np.zeros(len(chunk) + 1, np.int32)
                ends[have + 1] = BANDS
                known = np.zeros(len(chunk), bool)
                known[have] = True
                bands = pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32), mask=np.append(~known, False)), pa.array(flat.ravel()))
                text = chunk.raw.tobytes()
                digests = b"".join(hashlib.blake2b(text[a:b], digest_size=16).digest() for a, b in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist(), strict=True))
                h = np.frombuffer(digests, "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(chunk.rows()), chunk.doc_ids, pa.array(h[:, 0]), pa.array(h[:, 1]), bands], names=["row", "doc_id", "h1", "h2", "bands"])

    return chunks.mapInArrow(sign, "row long, doc_id long, h1 long, h2 long, bands array<long>")


_VECTOR = "node long, n int, shingles binary, weights binary"


def vectors(chunks: DataFrame, nodes: DataFrame, documents: int) -> DataFrame:
    """The shingles and weights of the texts of some nodes, read from their chunks."""
    picked = nodes.groupBy(F.shiftrightunsigned("node", PLACE_BITS).alias("chunk")).agg(F.collect_list("node").alias("picked"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owned("near duplicates")
        for batch in batches:
            for k, chunk in exchange.opened(batch):
                text, shingle, weight = weighted(batch, k, chunk, documents)
                rows = np.sort(batch.column("picked")[k].values.to_numpy())
                place = rows - (chunk.number << PLACE_BITS)
                low, high = np.searchsorted(text, place, "left"), np.searchsorted(text, place, "right")
                parts = [(shingle[a:b].tobytes(), weight[a:b].tobytes()) for a, b in zip(low, high, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array((high - low).astype(np.int32)), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())], names=["node", "n", "shingles", "weights"])

    return chunks.join(picked, "chunk").mapInArrow(read, _VECTOR)


def _arrays(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(batch.column("shingles")[k].as_buffer(), np.uint64), np.frombuffer(batch.column("weights")[k].as_buffer(), np.float32)


_LINK = "a long, b long, weighted double"


def _links(found: list[tuple[int, int, float]]) -> list[pa.RecordBatch]:
    if not found:
        return []
    a, b, s = zip(*found, strict=True)
    return [pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "weighted"])]


def similarity(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two texts' (ascending shingles, weights)."""
    _, i, j = np.intersect1d(one[0], other[0], assume_unique=True, return_indices=True)
    common = np.minimum(one[1][i], other[1][j]).sum(dtype=np.float64)
    every = one[1].sum(dtype=np.float64) + other[1].sum(dtype=np.float64) - common
    return float(common / every) if every else 0.0


#: What the order of sums can change in a similarity.
_ROUNDING = 1e-9


def _checked(pairs: DataFrame, vecs: DataFrame) -> DataFrame:
    """The pairs (a: member, b: pivot) that are similar enough.

    A pivot's rows lie before its members'; it has one run of rows for each
    ``MEMBERS`` members, so a pivot with very many is dealt over many tasks.
    """
    size = pairs.groupBy("b").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("ways"))
    members = pairs.join(size, "b").select("b", F.pmod(F.xxhash64("a"), F.col("ways")).cast("int").alias("run"), F.col("a").alias("node"), F.lit(1).alias("member"))
    pivots = size.select("b", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("run"), F.col("b").alias("node"), F.lit(0).alias("member"))
    parts = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = members.unionByName(pivots).join(vecs, "node").repartition(parts, "b", "run").sortWithinPartitions("b", "run", "member", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pivot = None, None
        for batch in batches:
            found = []
            for k, (b, run, node, member) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("b", "run", "node", "member")), strict=True)):
                mine = _arrays(batch, k)
                if not member:
                    group, pivot = (b, run), (mine[0].copy(), mine[1].copy())
                elif group == (b, run):
                    s = similarity(mine, pivot)
                    if s >= SIMILAR - _ROUNDING:
                        found.append((node, b, s))
            yield from _links(found)

    return stored(rows.mapInArrow(compare, _LINK), "links")


@dataclass
class _Member:
    side: int
    node: int
    root: int
    bands: list[int]
    shingles: np.ndarray
    weights: np.ndarray


def _block_links(key: int, left: list[_Member], right: list[_Member]) -> Iterator[tuple[int, int, float]]:
    """Links across two blocks of a bucket, or within one if ``right`` is ``left``; pairs that share an earlier bucket are left to that."""
    roots, bands = np.array([m.root for m in right]), np.array([m.bands for m in right])
    band = int(np.argmax(bands[0] == key))
    owner = np.repeat(np.arange(len(right)), [len(m.shingles) for m in right])
    shingle, weight = np.concatenate([m.shingles for m in right]), np.concatenate([m.weights for m in right]).astype(np.float64)
    order = np.argsort(shingle, kind="stable")
    owner, shingle, weight = owner[order], shingle[order], weight[order]
    mass = np.array([m.weights.sum(dtype=np.float64) for m in right])
    for k, one in enumerate(left):
        own_mass = one.weights.sum(dtype=np.float64)
        asked = (roots != one.root) & ~(bands[:, :band] == np.array(one.bands[:band], np.int64)).any(1)
        # What is common can't exceed the lesser sum of weights.
        asked &= np.minimum(mass, own_mass) >= (SIMILAR - _ROUNDING) * np.maximum(mass, own_mass)
        if left is right:
            asked[: k + 1] = False
        if not asked.any():
            continue
        low, high = np.searchsorted(shingle, one.shingles, "left"), np.searchsorted(shingle, one.shingles, "right")
        n = high - low
        at = np.repeat(low - n.cumsum() + n, n) + np.arange(n.sum())
        common = np.bincount(owner[at], np.minimum(weight[at], np.repeat(one.weights.astype(np.float64), n)), len(right))
        similar = common / (mass + own_mass - common)
        for other in np.flatnonzero(asked & (similar >= SIMILAR - _ROUNDING)):
            yield one.node, right[other].node, float(similar[other])


def _crossed(labelled: DataFrame, nodes: DataFrame, vecs: DataFrame) -> DataFrame:
    """The similar pairs (a, b) of all that share a bucket (columns key, node, root) but not the root.

    A bucket's greatest class and all its others are dealt into blocks; each
    block of the others meets every block, so that rows grow with the pairs
    to compare divided by the texts in a block.
    """
    spark = labelled.sparkSession
    by_root = labelled.groupBy("key", "root").agg(F.sum("n").alias("n"))
    mixed_ones = by_root.groupBy("key").agg(F.count("*").alias("roots"), F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n")).filter("roots > 1")
    ways = mixed_ones.select("key", F.col("main.root").alias("main"), F.ceil((F.col("n") - F.col("main.n")) / BLOCK_SHINGLES).cast("int").alias("others"), F.ceil(F.col("main.n") / BLOCK_SHINGLES).cast("int").alias("mains"))
    is_main = F.col("root") == F.col("main")
    block = F.when(is_main, F.col("others") + F.pmod(F.xxhash64("node"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("node"), F.col("others"))).cast("int")
    met = F.explode(F.sequence(F.lit(0), F.when(is_main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1))
    placed = labelled.join(ways, "key").withColumn("x", block).withColumn("y", met)
    placed = stored(placed.select("key", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), (F.col("x") > F.col("y")).cast("int").alias("side"), "node", "root"), "blocks")
    if placed.isEmpty():
        return spark.createDataFrame([], _LINK)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    known = vecs.join(nodes.select("node", "bands"), "node")
    rows = placed.join(known, "node").repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "node")

    def links_of(group: tuple, held: list[_Member]) -> list[pa.RecordBatch]:
        left = [m for m in held if not m.side]
        right = left if group[1] == group[2] else [m for m in held if m.side]
        return _links(list(_block_links(group[0], left, right))) if left and right else []

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            for k, (key, i, j, *member) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("key", "i", "j", "side", "node", "root", "bands")), strict=True)):
                if group != (key, i, j):
                    if held:
                        yield from links_of(group, held)
                    group, held = (key, i, j), []
                shingle, weight = _arrays(batch, k)
                held.append(_Member(*member, shingle.copy(), weight.copy()))
        if held:
            yield from links_of(group, held)

    return stored(rows.mapInArrow(compare, _LINK), "links")


def _relabelled(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _classed(chunks: DataFrame) -> DataFrame:
    """row, doc_id, class_id, class_size, and ``keeper`` (the row that stands for its class)."""
    documents = chunks.agg(F.sum(F.size("doc_ids"))).first()[0] or 0
    informed = with_frequencies(chunks)
    signed = stored(signatures(informed, documents), "signatures")
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    texts = stored(
        signed.filter("bands is not null").groupBy("h1", "h2").agg(F.min("row").alias("node"), F.min(first).alias("first"), F.count("*").alias("copies"), F.first("bands").alias("bands")),
        "texts",
    )
    band = texts.select("node", F.explode("bands").alias("key"))
    hot = band.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("pivot")).filter("size > 1")
    members = stored(band.join(hot.select("key", "pivot"), "key"), "buckets")
    nodes = texts.join(members.select("node").distinct(), "node", "left_semi").select("node", "bands")
    vecs = stored(vectors(informed, nodes.select("node"), documents), "vectors")
    pairs = stored(members.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), "pairs")
    # Each text's least pivot first; what that joins needn't be checked again.
    tried = pairs.groupBy("a").agg(F.min("b").alias("b"))
    links = _checked(tried, vecs)
    roots = components(links.select("a", "b"))
    of_a = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    of_b = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    todo = pairs.join(tried, ["a", "b"], "left_anti").join(of_a, "a", "left").join(of_b, "b", "left")
    todo = stored(todo.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"), "pairs")
    if not todo.isEmpty():
        links = links.unionByName(_checked(todo, vecs))
        roots = components(links.select("a", "b"))
    # Buckets that still hold several classes: all their pairs across classes.
    labelled = _relabelled(members.select("key", "node").join(vecs.select("node", "n"), "node"), roots)
    crossed = _crossed(stored(labelled, "labelled"), nodes, vecs)
    if not crossed.isEmpty():
        roots = components(links.unionByName(crossed).select("a", "b"))
    rooted = _relabelled(texts.select("node", "h1", "h2", "first", "copies"), roots)
    least = rooted.groupBy("root").agg(F.min("first").alias("first"), F.sum("copies").alias("class_size"))
    known = stored(rooted.select("h1", "h2", "root").join(least, "root").select("h1", "h2", F.col("first.doc_id").alias("class_id"), "class_size", F.col("first.row").alias("keeper")), "classes")
    wordless = signed.filter("bands is null").select("row", "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.col("row").alias("keeper"))
    return signed.filter("bands is not null").select("row", "doc_id", "h1", "h2").join(known, ["h1", "h2"]).drop("h1", "h2").unionByName(wordless)


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, class_id and class_size of every document.

    ``class_id`` is the least id in the class. Equal texts are one class, however
    many; texts that are null or have no word link to nothing, not even to each
    other. A null id comes after all others; a class of null ids alone has a
    null ``class_id``. Rows that share an id are classed by their texts. An empty
    table gives an empty result; other columns of the input are ignored.
    """
    return _classed(stored(exchange.chunks(docs, text, doc_id), "chunks")).select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents without those of a class that come after its first (least id, null last; one row of equal ones).

    Texts that are null or have no word all stay.
    """
    names = docs.columns
    others = [c for c in names if c != text]
    held = stored(exchange.chunks(docs, text, doc_id, others), "chunks")
    gone = _classed(held.drop("docs")).filter("row <> keeper")
    gone = stored(gone.groupBy(F.shiftrightunsigned("row", PLACE_BITS).alias("chunk")).agg(F.collect_list("row").alias("gone")), "gone")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owned("near duplicates")
        for batch in batches:
            for k, chunk in exchange.opened(batch):
                stays = np.ones(len(chunk), bool)
                cell = batch.column("gone")[k]
                if cell.is_valid:
                    stays[cell.values.to_numpy() - (chunk.number << PLACE_BITS)] = False
                doc = batch.column("docs")[k].values.flatten()
                columns = [chunk.texts().cast(pa.string()) if c == text else doc[others.index(c)] for c in names]
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stays))

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema])
    return held.join(gone, "chunk", "left").mapInArrow(keep, schema)
