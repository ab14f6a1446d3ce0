"""Nearest neighbours over learned partitions.

A neighbour graph over a bounded sample is cut into balanced parts; a small
classifier learns the part from the vector. It then gives every vector of the
table its most probable part, and each query its several most probable ones,
in which all vectors are compared exactly.

How many parts a query visits is measured, not guessed: on sample rows that
the classifier hasn't seen, the fewest parts that reach ``TARGET`` recall.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from squelch.llm.shared import stored

#: The bound of the sample: so many distinct vectors to learn from, and so many to measure recall on.
LEARN_ROWS, MEASURE_ROWS = 12_000, 6_000
MEASURE_QUERIES = 400
TARGET = 0.96
GRAPH_LINKS = 10
PART_ROWS, MOST_PARTS, SMALL = 1_000, 512, 200
HIDDEN, STEPS, BATCH = 96, 1_500, 256
#: Vectors of a part that one group of rows holds; a larger part is several groups.
BLOCK_ROWS = 4_096
BLOCK_QUERIES = 2_048


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by the inner products (rounded: for choosing, not for scores)."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0)


def _nearest(queries: np.ndarray, rows: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Indexes of the k nearest rows, in blocks of queries; ``own`` is each query's own row."""
    found = []
    for at in range(0, len(queries), 256):
        d = _distances(queries[at : at + 256], rows)
        if own is not None:
            d[np.arange(len(d)), own[at : at + 256]] = np.inf
        found.append(np.argpartition(d, k - 1, axis=1)[:, :k])
    return np.concatenate(found)


def balanced_parts(graph: np.ndarray, vectors: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """A part for each node: equal halves by main directions, then moves to where most neighbours are, within room."""
    n = len(vectors)
    rng = np.random.default_rng(5)
    label = np.zeros(n, np.int64)
    made = 1
    while made < parts:
        for p in range(made):
            mine = np.flatnonzero(label == p)
            x = vectors[mine] - vectors[mine].mean(0)
            axis = rng.normal(size=x.shape[1])
            for _ in range(4):
                axis = x.T @ (x @ axis)
                axis /= max(np.linalg.norm(axis), 1e-12)
            order = np.argsort(x @ axis, kind="stable")
            label[mine[order[len(order) // 2 :]]] = p + made
        made *= 2
    room = int(np.ceil(n / parts * 1.05))
    a = np.concatenate([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()])
    b = np.concatenate([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])
    for _ in range(rounds):
        votes = np.bincount(a * parts + label[b], minlength=n * parts).reshape(n, parts)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), label]
        movers = np.flatnonzero((gain > 0) & (rng.random(n) < 0.5))
        movers = movers[np.argsort(-gain[movers], kind="stable")]
        size = np.bincount(label, minlength=parts)
        for p in range(parts):
            into = movers[best[movers] == p][: max(room - size[p], 0)]
            label[into] = p
    return label


@dataclass
class Router:
    """The classifier: one hidden layer. Bounded by dimensions x HIDDEN + HIDDEN x MOST_PARTS floats."""

    middle: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    visits: int = 1

    @property
    def parts(self) -> int:
        return len(self.b2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(((x - self.middle) / self.scale) @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def part(self, x: np.ndarray) -> np.ndarray:
        return self.logits(x).argmax(1)


def _trained(x: np.ndarray, aims: np.ndarray) -> Router:
    """Cross-entropy with the shares of parts among each node's neighbours, by Adam."""
    rng = np.random.default_rng(11)
    n, d = x.shape
    m = aims.shape[1]
    middle, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = (x - middle) / scale
    weights = [rng.normal(size=(d, HIDDEN)) * np.sqrt(2 / d), np.zeros(HIDDEN), rng.normal(size=(HIDDEN, m)) * np.sqrt(1 / HIDDEN), np.zeros(m)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, STEPS + 1):
        some = rng.integers(0, n, min(BATCH, n))
        xs, ys = z[some], aims[some]
        h = np.maximum(xs @ weights[0] + weights[1], 0)
        out = h @ weights[2] + weights[3]
        out = np.exp(out - out.max(1, keepdims=True))
        d_out = (out / out.sum(1, keepdims=True) - ys) / len(some)
        d_h = (d_out @ weights[2].T) * (h > 0)
        grads = [xs.T @ d_h, d_h.sum(0), h.T @ d_out, d_out.sum(0)]
        rate = 3e-3 * (1 - step / (STEPS + 1))
        for w, g, a, b in zip(weights, grads, first, second, strict=True):
            a *= 0.9
            a += 0.1 * g
            b *= 0.999
            b += 0.001 * g * g
            w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Router(middle, scale, *weights)


def learn(sample: np.ndarray, rows: int, k: int) -> Router:
    """The router from a sample of distinct vectors, for a table of so many rows."""
    dims = sample.shape[1] if len(sample) else 0
    if rows < SMALL or len(sample) < SMALL:
        return Router(np.zeros(dims), np.ones(dims), np.zeros((dims, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    known = min(LEARN_ROWS, len(sample) * 2 // 3)
    x, rest = sample[:known], sample[known : known + MEASURE_ROWS]
    parts = 4
    while parts < MOST_PARTS and parts * PART_ROWS < rows and parts * 32 < known:
        parts *= 2
    graph = _nearest(x, x, min(GRAPH_LINKS, len(x) - 1), np.arange(len(x)))
    label = balanced_parts(graph, x, parts)
    aims = np.zeros((len(x), parts))
    np.add.at(aims, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph.ravel()]), 0.5 / graph.shape[1])
    aims[np.arange(len(x)), label] += 0.5
    router = _trained(x, aims)
    asked = np.arange(min(MEASURE_QUERIES, len(rest)))
    near = _nearest(rest[asked], rest, min(k, len(rest) - 1), asked)
    order = np.argsort(np.argsort(-router.logits(rest[asked]), axis=1, kind="stable"), axis=1)
    place = order[asked[:, None], router.part(rest)[near]]
    recall = (np.bincount(place.ravel(), minlength=parts) / place.size).cumsum()
    router.visits = int(np.searchsorted(recall, TARGET) + 1) if recall[-1] >= TARGET else parts
    router.visits = min(max(router.visits, 2), parts)
    return router


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


class _Best:
    """The k nearest (score, id) of each query of a group so far."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.score, self.ids = [np.zeros(0)] * len(queries), [np.zeros(0, np.int64)] * len(queries)

    def add(self, vectors: np.ndarray, ids: list[list[int]]) -> None:
        counts = np.array([len(x) for x in ids])
        flat, start = np.concatenate([np.array(x, np.int64) for x in ids]), np.cumsum(counts) - counts
        near = _distances(self.queries, vectors)
        k = min(self.k, len(vectors))
        # What rounding could bring to either side of the k-th is measured exactly.
        limit = np.partition(near, k - 1, axis=1)[:, k - 1]
        limit = limit + 1e-9 * ((self.queries**2).sum(1) + (vectors**2).sum(1).max())
        for q in range(len(self.queries)):
            some = np.flatnonzero(near[q] <= limit[q])
            exact = np.sqrt(((vectors[some] - self.queries[q]) ** 2).sum(1))
            if len(some) > k:
                # Few are ever within rounding of the k-th; equal ones stay, as ids decide.
                cut = np.partition(exact, k - 1)[k - 1]
                some, exact = some[exact <= cut], exact[exact <= cut]
            score = np.concatenate([self.score[q], np.repeat(exact, counts[some])])
            got = np.concatenate([self.ids[q], np.concatenate([flat[start[s] : start[s] + counts[s]] for s in some])])
            order = np.lexsort((got, score))[: self.k]
            self.score[q], self.ids[q] = score[order], got[order]


def distinct_vectors(vectors: DataFrame, vec: str, vec_id: str, ids: int) -> DataFrame:
    """h1, h2 (128 bits that stand for the vector), vec, and the ``ids`` smallest ids that have it.

    The limit within equal vectors works before the shuffle too, so a vector
    that a third of all rows share sends a few rows from each task.
    """
    same = W.partitionBy("h1", "h2").orderBy("vec_id")
    return (
        vectors.withColumn("nth", F.dense_rank().over(same)).filter(F.col("nth") <= ids)
        .groupBy("h1", "h2").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_set("vec_id")).alias("ids"))
    )


def usable(vectors: DataFrame, vec: str, vec_id: str) -> DataFrame:
    """vec_id, vec, h1, h2 of the rows that take part (see ``search``)."""
    x = F.col("vec")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).alias("vec")).filter(
        "vec_id is not null and vec is not null and size(vec) > 0"
        " and forall(vec, v -> coalesce(not isnan(v) and abs(v) < double('infinity'), false)) and exists(vec, v -> v <> 0)"
    )
    usual = rows.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if usual is None:
        return rows.withColumns({"h1": F.xxhash64(x), "h2": F.xxhash64(x, F.lit(1))})
    return rows.filter(F.size("vec") == usual.dims).withColumns({"h1": F.xxhash64(x), "h2": F.xxhash64(x, F.lit(1))})


def search(vectors: DataFrame, asked: Column, k: int = 10, vec: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest rows found for each row with ``asked`` (a condition on ``vec_id``).

    The score is the Euclidean distance in double precision; ties go to the
    smaller id. A row with the query's own id is no candidate. Vectors that are
    null or zero, that hold a null or non-finite component, or that have another
    length than the most common one (the shorter on ties), and rows without an
    id take no part. Repeated rows count once; rows that share an id but not the
    vector are rows of their own. An empty table gives an empty result; other
    columns of the input are ignored.

    Equal vectors are one entry of the index with its k + 1 smallest ids, which
    is all that any query can need; equal queries are asked once.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, vec, vec_id)
    index = stored(distinct_vectors(rows, vec, vec_id, k + 1), "vectors")
    n = index.count()
    share = min(1.0, 1.02 * (LEARN_ROWS + MEASURE_ROWS) / max(n, 1))
    sample = index.filter(F.pmod("h1", F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("h2", "vec")

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            dims = len(held[0].column("vec")[0])
            vectors = np.concatenate([_matrix(b.column("vec"), dims) for b in held])
            order = np.argsort(np.concatenate([b.column("h2").to_numpy() for b in held]), kind="stable")
            router = learn(vectors[order[: LEARN_ROWS + MEASURE_ROWS]], n, k)
            yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([pickle.dumps(router)], pa.binary())], names=["dims", "router"])

    # The sample's bound lets one task learn; what the driver gets is the classifier.
    taught = sample.repartition(1).mapInArrow(teach, "dims int, router binary").first()
    dims, router = (taught.dims, pickle.loads(bytes(taught.router))) if taught else (0, learn(np.zeros((0, 0)), 0, k))
    shared = spark.sparkContext.broadcast(router)

    def to_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = shared.value.part(_matrix(batch.column("vec"), dims))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], names=[*batch.schema.names, "part"])

    kind = index.schema["vec"].dataType.simpleString()
    placed = stored(index.mapInArrow(to_part, f"h1 long, h2 long, vec {kind}, ids array<long>, part int"), "placed-vectors")
    sizes = np.zeros(router.parts, np.int64)
    for r in placed.groupBy("part").count().collect():  # at most MOST_PARTS rows
        sizes[r.part] = r["count"]

    def to_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(-shared.value.logits(_matrix(batch.column("vec"), dims)), axis=1, kind="stable")
            # Further parts where the first ones are too small to hold k others.
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            take = (np.arange(router.parts)[None] < router.visits) | (before < 4 * k)
            visits = [row[t].tolist() for row, t in zip(order, take, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(visits, pa.list_(pa.int32()))], names=[*batch.schema.names, "parts"])

    queries = rows.filter(asked).select("vec_id", "h1", "h2", "vec")
    one = queries.groupBy("h1", "h2").agg(F.first("vec").alias("vec"))
    visits = stored(one.mapInArrow(to_visits, f"h1 long, h2 long, vec {kind}, parts array<int>"), "visits")
    visits = visits.select("h1", "h2", "vec", F.explode("parts").alias("part"))
    asks = np.zeros(router.parts, np.int64)
    for r in visits.groupBy("part").count().collect():
        asks[r.part] = r["count"]
    # A part's vectors make so many blocks, its queries so many runs; every block meets every run.
    blocks = [int(-(-x // BLOCK_ROWS)) or 1 for x in sizes]
    runs = [int(-(-x // BLOCK_QUERIES)) or 1 for x in asks]
    of_blocks, of_runs = F.array(*[F.lit(x) for x in blocks]), F.array(*[F.lit(x) for x in runs])
    n_blocks, n_runs = F.get(of_blocks, F.col("part")), F.get(of_runs, F.col("part"))
    left = visits.select("part", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"), F.pmod("h2", n_runs).cast("int").alias("run"), F.lit(0).alias("kind"), "h1", "h2", "vec", F.lit(None).cast("array<long>").alias("ids"))
    right = placed.select("part", F.pmod("h2", n_blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), n_runs - 1)).alias("run"), F.lit(1).alias("kind"), "h1", "h2", "vec", "ids")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    group = ["part", "block", "run"]
    met = left.unionByName(right).repartition(tasks, *group).sortWithinPartitions(*group, "kind")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heads, waiting, best = None, [], [], None

        def result() -> Iterator[pa.RecordBatch]:
            if best is not None:
                of = np.repeat(np.arange(len(heads)), [len(x) for x in best.ids])
                h1, h2 = (np.array([h[j] for h in heads], np.int64)[of] for j in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(np.concatenate(best.score)), pa.array(np.concatenate(best.ids))], names=["h1", "h2", "score", "vec_id"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in (*group, "kind")], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            vectors = _matrix(batch.column("vec"), dims)
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if key != tuple(keys[a][:3]):
                    yield from result()
                    key, heads, waiting, best = tuple(keys[a][:3]), [], [], None
                if keys[a][3] == 0:
                    heads += list(zip(batch.column("h1")[a:b].to_pylist(), batch.column("h2")[a:b].to_pylist(), strict=True))
                    waiting.append(vectors[a:b])
                elif waiting:
                    best = best or _Best(np.concatenate(waiting), k + 1)
                    best.add(vectors[a:b], batch.column("ids")[a:b].to_pylist())
        yield from result()

    found = met.mapInArrow(compare, "h1 long, h2 long, score double, vec_id long")
    first = W.partitionBy("h1", "h2").orderBy("score", "vec_id")
    found = stored(found.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k + 1).drop("nth"), "neighbours")
    per_query = W.partitionBy("query_id", "h1", "h2").orderBy("score", "vec_id")
    joined = queries.select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct().join(found, ["h1", "h2"]).filter("vec_id <> query_id")
    return joined.withColumn("rank", F.row_number().over(per_query)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
