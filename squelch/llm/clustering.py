"""Centroid clustering in whole numbers: a float32 screen with proven error bounds, exact where it can't decide.

Components become integers once, so sums and means are exact and no result
depends on how the rows lie. Each round is one pass over stored blocks of
vectors: a task adds up its rows by cluster and sends one row for each cluster
it has, so what is shuffled or seen by the driver is clusters x components,
whatever the number of vectors or copies.

For a row x and a centroid c the screen takes |c|^2 - 2 x.c from a float32
matrix product. In float32 a product of d terms, its inputs rounded, errs by at
most g |x| |c| with g = m u / (1 - m u), m = d + 4, u = 2^-24, in whatever
order it is added up. A centroid whose interval lies above the least upper end
can't be nearest; a row with one centroid left is decided, the others are
computed again in 64-bit integers, ties to the smaller number.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from squelch.llm.shared import stored

BLOCK_ROWS = 4096
UNIT = 2.0**-24
_BLOCK = "ids array<bigint>, n int, data binary"


def largest(dims: int) -> int:
    """The largest component for which every squared distance fits a signed 64-bit integer."""
    return math.isqrt((2**63 - 1) // max(dims, 1)) // 2


def whole_vectors(column: pa.ListArray, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part (``dims`` components, none null or not finite), and floor(scale * x) of those."""
    column = column.cast(pa.large_list(pa.float64()))
    good = np.zeros(len(column), bool)
    at = column.offsets.to_numpy()
    there = ~column.is_null().to_numpy(zero_copy_only=False)
    good[there & (np.diff(at) == dims)] = True
    rows = np.flatnonzero(good)
    values = column.values.to_numpy(zero_copy_only=False)  # a null component becomes nan
    found = values[at[rows][:, None] + np.arange(dims)] if len(rows) else np.zeros((0, dims))
    finite = np.isfinite(found).all(1)
    good[rows[~finite]] = False
    found = np.floor(found[finite] * scale)
    if len(found) and np.abs(found).max() > largest(dims):
        raise ValueError(f"a component beyond {largest(dims)} / {scale}: its squared distances wouldn't fit 64 bits")
    return good, found.astype(np.int32)


def blocks(vectors: DataFrame, vec_id: str, embedding: str, dims: int, scale: int) -> DataFrame:
    """Rows of up to ``BLOCK_ROWS`` vectors that take part: ids, n, and the components as little-endian 32-bit integers."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(start, BLOCK_ROWS)
                good, x = whole_vectors(some.column("v"), dims, scale)
                if len(x):
                    ids = some.column("id").filter(pa.array(good))
                    row = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), ids), pa.array([len(x)], pa.int32()), pa.array([x.astype("<i4").tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(row, names=["ids", "n", "data"])

    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    return rows.mapInArrow(build, _BLOCK)


def _opened(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for k in range(batch.num_rows):
        yield batch.column("ids")[k].values, np.frombuffer(batch.column("data")[k].as_buffer(), "<i4").reshape(-1, dims)


def screened(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Rows x centroids: whether the centroid can still be nearest. The nearest ones always can."""
    dims = x.shape[1]
    steps = dims + 4
    gamma = steps * UNIT / (1 - steps * UNIT)
    dots = (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    squares = (centroids * centroids).sum(1).astype(np.float64)
    length = np.sqrt((x.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
    far = np.sqrt(squares) * (1 + 1e-9)
    score = squares - 2 * dots
    error = 2 * gamma * length[:, None] * far + 2.0**-50 * (squares + 2 * np.abs(dots))
    return score - error <= (score + error).min(1)[:, None]


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The number of each row's nearest centroid, exactly; ties: the smaller number."""
    near = screened(x, centroids)
    label = near.argmax(1)
    unsure = np.flatnonzero(near.sum(1) > 1)
    if len(unsure):
        row, number = np.nonzero(near[unsure])
        apart = x[unsure[row]].astype(np.int64) - centroids[number]
        exact = np.full((len(unsure), len(centroids)), np.iinfo(np.int64).max)
        exact[row, number] = (apart * apart).sum(1)
        label[unsure] = exact.argmin(1)
    return label


def _seeds(table: DataFrame, dims: int, k: int, salt: str) -> np.ndarray:
    """The k vectors of smallest hash of their ids; equal hashes by their components; null ids last."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in _opened(batch, dims):
                names = ["~" if i is None else hashlib.sha256(f"{salt}:{i}".encode()).hexdigest() for i in ids.to_pylist()]
                best = sorted(zip(names, x.tolist(), strict=True))[:k]
                yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in best]), pa.array([b[1] for b in best], pa.list_(pa.int64()))], names=["hash", "vector"])

    rows = table.mapInArrow(least, "hash string, vector array<bigint>").orderBy("hash", "vector").limit(k).collect()
    return np.array([r.vector for r in rows], np.int64).reshape(-1, dims)


def _by_cluster(table: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """Of each cluster that has rows: their number, the sum of their squared distances, their sum."""
    dims = centroids.shape[1]
    names = [f"s{i}" for i in range(dims)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far, total = np.zeros(len(centroids), np.int64), np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dims), np.int64)
        for batch in batches:
            for _, x in _opened(batch, dims):
                label = nearest(x, centroids)
                order = np.argsort(label, kind="stable")
                used, at = np.unique(label[order], return_index=True)
                ranked = x[order].astype(np.int64)
                apart = ranked - centroids[label[order]]
                n[used] += np.diff(np.append(at, len(x)))
                far[used] += np.add.reduceat((apart * apart).sum(1), at)
                total[used] += np.add.reduceat(ranked, at)
        used = np.flatnonzero(n)
        columns = [pa.array(used, pa.int32()), pa.array(n[used]), pa.array(far[used]), *(pa.array(total[used, i]) for i in range(dims))]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "far", *names])

    schema = "cluster int, n bigint, far bigint, " + ", ".join(f"{x} bigint" for x in names)
    sums = table.mapInArrow(add, schema).groupBy("cluster").agg(*[F.sum(x).alias(x) for x in ("n", "far", *names)])
    return {r.cluster: (r.n, r.far, [r[x] for x in names]) for r in sums.collect()}  # k rows


def cluster(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dims: int = 64, scale: int = 1024, k: int = 8, rounds: int = 10, salt: str = "3") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid of every vector that takes part.

    A vector takes part if it has exactly ``dims`` components, none null or not
    finite; component x counts as floor(scale * x). Centroids start as the k
    vectors with the smallest SHA-256 of ``salt:id`` (null ids last; of equal
    ids the smaller vector first); fewer vectors give fewer centroids, none an
    empty result. Each round assigns all vectors and replaces each centroid
    that has some by floor(sum / count) of every component; the last
    assignment follows the last round. Repeated ids and vectors count each
    time. Other columns of the input are ignored, whatever their names. A
    component whose distances wouldn't fit 64 bits is refused.
    """
    spark = vectors.sparkSession
    table = stored(blocks(vectors, vec_id, embedding, dims, scale), "vectors")
    centroids = _seeds(table, dims, k, salt)
    schema = T.StructType().add("vec_id", "long").add("cluster", "integer").add("distance", "long").add("cluster_inertia", "long").add("inertia", "long").add("centroid", T.ArrayType(T.LongType()))
    if not len(centroids):
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        for j, (n, _, total) in _by_cluster(table, centroids).items():
            centroids[j] = [s // n for s in total]
    inertia = np.zeros(len(centroids), np.int64)
    for j, (_, far, _) in _by_cluster(table, centroids).items():
        inertia[j] = far
    whole = int(sum(inertia.tolist()))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in _opened(batch, dims):
                label = nearest(x, centroids)
                apart = x.astype(np.int64) - centroids[label]
                wide = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dims), pa.array(centroids[label].ravel()))
                columns = [ids, pa.array(label.astype(np.int32)), pa.array((apart * apart).sum(1)), pa.array(inertia[label]), pa.array(np.full(len(x), whole)), wide]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return table.mapInArrow(assign, schema)
