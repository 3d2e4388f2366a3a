"""Centroid clustering by Exponion search, in exact integers.

Every vector keeps its centroid, an upper bound of the distance to it and a lower bound of the distance to every other centroid.  When
centroids have moved, both bounds give way by the moves; a vector whose upper bound stays below the lower bound, or below half the
distance from its centroid to the nearest other one, keeps its centroid unseen.  Any other vector scans only the centroids inside a
ball around its own: with upper bound ``u`` and nearest other centroid ``s`` away, the nearest and the second nearest centroid are
within ``2 * u + s`` of the own one, so the scan follows that centroid's sorted list of distances up to this radius, included, which
keeps ties.  Bounds are rounded outwards; distances that decide are integers, so the result is that of the plain algorithm.

Vectors lie in blocks of ``BLOCK`` rows together with their bounds.  A round is one pass over the blocks without a shuffle, written
below the shared checkpoint folder with each block's sums; the sums of all blocks, a few numbers a centroid, make the next centroids.

Defined results: vectors take part if they have ``DIMENSIONS`` components, none null, non-finite or beyond 131,072 (whose squares would
leave 64 bits); with fewer vectors than centroids each is a centroid; rows that share an id or have none keep a row each, those without
an id are never a starting centroid; without vectors there are no rows; extra columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import textops as X
from gleaner.operators.storage import remove, written

DIMENSIONS, CENTROIDS, ROUNDS = 64, 8, 10
#: Components become integers by this factor.
SCALE = 1024
LARGEST = 1 << 27
BLOCK = 4096
#: Bounds are rounded outwards by this share, which is far more than their rounding errors.
SLACK = 1e-12
BLOCKS = "ids array<long>, vectors binary, cluster binary, upper binary, lower binary, distance binary, sums binary"


class Centroids:
    """Integer centroids, their distances from each other in sorted order, and how far they have moved."""

    def __init__(self, places: np.ndarray, before: np.ndarray | None = None):
        self.places = places
        k = len(places)
        apart = np.sqrt(squares(places, places).astype(np.float64)) * (1 - SLACK)
        np.fill_diagonal(apart, -1)  # a centroid leads its own list
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, 1)
        self.nearest = self.apart[:, 1] if k > 1 else np.full(k, np.inf)
        moved = np.zeros(k) if before is None else np.sqrt(((places - before) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
        self.moved = moved
        # the largest move of any other centroid
        top = np.sort(moved)[::-1]
        self.others = np.where((moved == top[0]) & ((moved == top[0]).sum() == 1), top[1] if k > 1 else 0, top[0])


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` from all of ``b``, exactly."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < 1 << 21:  # sums below 2**53: exact in floating point
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * (x @ y.T)).astype(np.int64)
    return np.stack([((a - row) ** 2).sum(1) for row in b], 1) if len(b) else np.zeros((len(a), 0), np.int64)


def first(vectors: np.ndarray, at: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number) and both bounds, from all distances."""
    d = squares(vectors, at.places)
    own = d.argmin(1)
    rest = d.astype(np.float64)
    rest[np.arange(len(d)), own] = np.inf
    return own, _up(d.min(1)), np.sqrt(rest.min(1)) * (1 - SLACK)


def _up(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(np.float64)) * (1 + SLACK)


def _own(vectors: np.ndarray, at: Centroids, cluster: np.ndarray) -> np.ndarray:
    return ((vectors - at.places[cluster]) ** 2).sum(1)


def again(vectors: np.ndarray, at: Centroids, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Centroids and bounds after the centroids' move, and how many distances it took."""
    cluster, seen = cluster.copy(), 0
    upper = (upper + at.moved[cluster]) * (1 + SLACK)
    lower = lower - at.others[cluster]
    lower -= np.abs(lower) * SLACK
    limit = np.maximum(lower, at.nearest[cluster] / 2)
    open_ = np.flatnonzero(upper >= limit)
    upper[open_] = _up(_own(vectors[open_], at, cluster[open_]))
    seen += len(open_)
    open_ = open_[upper[open_] >= limit[open_]]
    for c in np.unique(cluster[open_]):
        rows = open_[cluster[open_] == c]
        # scans go along the sorted list as far as each vector's ball reaches; that order groups them
        reach = np.searchsorted(at.apart[c], (2 * upper[rows] + at.nearest[c]) * (1 + SLACK), "right")
        order = np.argsort(-reach, kind="stable")
        rows, reach = rows[order], reach[order]
        best = np.full(len(rows), np.iinfo(np.int64).max)
        second, who = best.copy(), np.full(len(rows), len(at.places))
        for step, j in enumerate(at.order[c][: reach[0]].tolist()):
            n = int(np.searchsorted(-reach, -step, "left"))  # those that reach beyond this step
            d = ((vectors[rows[:n]] - at.places[j]) ** 2).sum(1)
            seen += n
            nearer = (d < best[:n]) | ((d == best[:n]) & (j < who[:n]))
            second[:n] = np.where(nearer, best[:n], np.minimum(second[:n], d))
            best[:n], who[:n] = np.where(nearer, d, best[:n]), np.where(nearer, j, who[:n])
        cluster[rows], upper[rows] = who, _up(best)
        lower[rows] = np.where(second == np.iinfo(np.int64).max, np.inf, np.sqrt(second.astype(np.float64)) * (1 - SLACK))
    return cluster, upper, lower, seen


def _block(ids: pa.Array, vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, at: Centroids, last: bool) -> pa.RecordBatch:
    k = len(at.places)
    # sums of components and, behind them, numbers of vectors
    sums = np.zeros((k, vectors.shape[1] + 1), np.int64)
    for c in range(k):
        own = vectors[cluster == c]
        sums[c, :-1], sums[c, -1] = own.sum(0), len(own)
    distance = _own(vectors, at, cluster) if last else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    packed = [vectors.astype(np.int32), cluster.astype(np.int32), upper, lower, distance, sums]
    return pa.RecordBatch.from_arrays([lists, *(pa.array([x.tobytes()], pa.binary()) for x in packed)], ["ids", "vectors", "cluster", "upper", "lower", "distance", "sums"])


def _start(at: Centroids, scale: int, last: bool):
    """Packs vectors into blocks, each vector with its centroid and bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                flat = part.column("vector").flatten().to_numpy(zero_copy_only=False)
                vectors = np.floor(scale * flat.astype(np.float64)).astype(np.int64).reshape(part.num_rows, -1)
                yield _block(part.column("id"), vectors, *first(vectors, at), at, last)

    return run


def _array(value: pa.Scalar, dtype) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype)


def _round(at: Centroids, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name, dtype: _array(batch.column(name)[i], dtype)  # noqa: B023, E731
                vectors = get("vectors", np.int32).astype(np.int64).reshape(-1, at.places.shape[1])
                state = again(vectors, at, get("cluster", np.int32).astype(np.int64), get("upper", np.float64), get("lower", np.float64))
                yield _block(batch.column("ids")[i].values, vectors, *state[:3], at, last)

    return run


def _added(shape: tuple[int, int]):
    """One row for each component of each centroid that has vectors in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for batch in batches:
            for value in batch.column("sums"):
                total += _array(value, np.int64).reshape(shape)
        c, d = np.nonzero(np.broadcast_to(total[:, -1:] > 0, shape))
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(total[c, d])], ["cluster", "component", "total"])

    return run


def _moved(blocks: DataFrame, places: np.ndarray) -> np.ndarray:
    """The next centroids: means rounded down, added up over all tasks beyond 64 bits."""
    shape = (len(places), places.shape[1] + 1)
    sums = blocks.select("sums").mapInArrow(_added(shape), "cluster int, component int, total long")
    rows = sums.groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect()
    total = {(r["cluster"], r["component"]): int(r["total"]) for r in rows}
    out = places.copy()
    for c in range(len(places)):
        if n := total.get((c, places.shape[1])):
            out[c] = [total[c, d] // n for d in range(places.shape[1])]
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(_array(batch.column("cluster")[i], np.int32)), pa.array(_array(batch.column("distance")[i], np.int64))], ["id", "cluster", "distance"])


def exponion(vectors: DataFrame, start: np.ndarray, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every row of ``vectors`` (id, vector), and the final centroids.

    ``start`` are the first centroids, in integers (components times ``scale``, rounded down); ``distance`` is the square in these units.
    """
    spark, places, path = vectors.sparkSession, start.astype(np.int64), ""
    blocks = vectors.mapInArrow(_start(Centroids(places), scale, rounds == 0), BLOCKS)
    for done in range(1, rounds + 1):
        blocks, now = written(blocks, "blocks")
        if path:
            remove(spark, path)
        path, before = now, places
        places = _moved(blocks, before)
        blocks = blocks.select("ids", "vectors", "cluster", "upper", "lower").mapInArrow(_round(Centroids(places, before), done == rounds), BLOCKS)
    found, _ = written(blocks.select("ids", "cluster", "distance").mapInArrow(_rows, "id long, cluster int, distance long"), "clusters")
    if path:
        remove(spark, path)
    return found, places


def usable(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(id, vector) of the rows that take part, components as doubles."""
    most = LARGEST / scale
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < most)
    return rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where((F.size("vector") == dimensions) & F.forall("vector", fine))


def starting(vectors: DataFrame, order: Column, k: int = CENTROIDS, scale: int = SCALE) -> np.ndarray:
    """The first ``k`` vectors by ``order``, of equal ones the smaller vector; a few rows for the driver."""
    rows = vectors.where(F.col("id").isNotNull()).orderBy(order, "vector").limit(k).collect()
    return np.floor(scale * np.array([r["vector"] for r in rows], np.float64)).astype(np.int64)


def report(embeddings: DataFrame) -> DataFrame:
    """Cluster and squared distance of every vector, with the sums of its cluster and of all, and a digest of its centroid."""
    spark, kept = embeddings.sparkSession, usable(embeddings)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    start = starting(kept, F.sha2(F.concat(F.lit("3:"), F.col("id").cast("string")).cast("binary"), 256))
    if not len(start):
        return spark.createDataFrame([], schema)
    found, places = exponion(kept, start)
    digests = spark.createDataFrame([(c, hashlib.sha256(",".join(map(str, p)).encode()).hexdigest()) for c, p in enumerate(places.tolist())], "cluster int, centroid_sha256 string")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    # one row a centroid, and one in all
    each = sums.join(digests, "cluster").join(F.broadcast(total))
    return found.join(F.broadcast(each), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
