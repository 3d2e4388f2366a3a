"""Approximate nearest neighbours by collision counting (query-aware hashing).

Vectors are scaled to length one, so that the largest cosine is the least distance.  A shard of the vectors is indexed by
``PROJECTIONS`` single random projections, each a sorted array.  A query opens a window centred on its own projection in each
array and widens all windows together (virtual rehashing: the radius grows by ``GROWTH``); a vector that falls into enough windows
is verified by its exact cosine in double precision.  A query ends in a shard when it has enough verified vectors
within the radius.  Every vector is indexed; if the windows come to span everything, all vectors are verified.

Equal vectors are indexed and searched once: their members are cut to as many of the smallest ids as a result can hold,
before the shuffle.  Queries pass each shard in blocks as a stream.

Defined results: vectors that are null, zero or hold null or non-finite components take no part; a query never finds rows
with its own vec_id; equal cosines rank by smaller vec_id; only vectors of the query's length are candidates; without vectors or
queries there are no rows; other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm import textops as X

PROJECTIONS = 48
#: Window width for radius 1; a vector within the radius falls into a window with probability 0.84.
WIDTH = 2.8
#: Share of the windows that a vector must fall into to be verified.
THRESHOLD = 0.75
FIRST_RADIUS, GROWTH = 0.3, 1.25
#: The last radius spans everything, so a query that got so far has verified all vectors.
ROUNDS = 13
SHARD_ROWS = 25_000


class Shard:
    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors.astype(np.float64)
        self.norms = np.sqrt((self.vectors**2).sum(1))
        rng = np.random.default_rng(2024)
        self.axes = rng.standard_normal((vectors.shape[1], PROJECTIONS))
        values = (self.vectors / self.norms[:, None]) @ self.axes
        self.order = np.argsort(np.ascontiguousarray(values.T), axis=1, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(values.T, self.order, axis=1))

    def search(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of verified vectors; the best ``k`` are among them."""
        n = len(self.vectors)
        q = query.astype(np.float64)
        length = np.sqrt((q**2).sum())
        at = (q / length) @ self.axes
        count = np.zeros(n, np.int64)
        need = int(np.ceil(THRESHOLD * PROJECTIONS))
        checked = np.zeros(n, bool)
        found, cosines = [], []
        # bounds of the windows of every radius, nested around the query's own place
        radii = np.concatenate([[0.0], FIRST_RADIUS * GROWTH ** np.arange(ROUNDS)])
        low = np.array([np.searchsorted(self.sorted[j], at[j] - WIDTH / 2 * radii) for j in range(PROJECTIONS)])
        high = np.array([np.searchsorted(self.sorted[j], at[j] + WIDTH / 2 * radii) for j in range(PROJECTIONS)])
        for r in range(1, ROUNDS + 1):
            radius = radii[r]
            new = []
            for order, (b, a), (c, d) in zip(self.order, low[:, r - 1 : r + 1].tolist(), high[:, r - 1 : r + 1].tolist()):
                if a < b:
                    new.append(order[a:b])
                if c < d:
                    new.append(order[c:d])
            if new:
                count += np.bincount(np.concatenate(new), minlength=n)
            everything = r == ROUNDS
            new = np.flatnonzero(~checked if everything else (count >= need) & ~checked)
            if len(new):
                checked[new] = True
                found.append(new)
                # many at once are cheaper as one product over the shard than row by row
                dots = (self.vectors @ q)[new] if 8 * len(new) > n else self.vectors[new] @ q
                cosines.append(dots / (self.norms[new] * length))
            if found:
                near = 1 - radius**2 / 2  # cosine at this distance
                if sum(int((c >= near).sum()) for c in cosines) >= k:
                    break
        return np.concatenate(found), np.concatenate(cosines)


def _search(k: int):
    """Partitions hold shards one after the other: first a shard's vectors, then the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        shards: dict[int, tuple[Shard, np.ndarray, np.ndarray]] = {}
        current: int | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column("shard").to_numpy()
            kind = batch.column("kind").to_numpy()
            keys = np.column_stack([batch.column("k1").to_numpy(), batch.column("k2").to_numpy()])
            ids = batch.column("least_id").to_numpy()
            column = batch.column("vector")
            size = np.diff(column.offsets.to_numpy())
            values, offs = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0) | (np.diff(size) != 0)) + 1
            for a, b in zip(np.append(0, cuts), np.append(cuts, batch.num_rows)):
                a, b = int(a), int(b)
                if shard[a] != current:
                    current, gathered, shards = int(shard[a]), [], {}
                block = values[offs[a] : offs[b]].reshape(b - a, size[a])
                if kind[a] == 0:
                    gathered.append((block.copy(), keys[a:b], ids[a:b]))
                    continue
                if gathered:
                    for dim in {g[0].shape[1] for g in gathered}:
                        own = [g for g in gathered if g[0].shape[1] == dim]
                        shards[dim] = Shard(np.concatenate([g[0] for g in own])), np.concatenate([g[1] for g in own]), np.concatenate([g[2] for g in own])
                    gathered = []
                if int(size[a]) not in shards:
                    continue
                index, own_keys, own_ids = shards[int(size[a])]
                rows = []
                for i in range(a, b):
                    found, cosines = index.search(block[i - a], k)
                    best = np.lexsort((own_ids[found], -cosines))[:k]
                    rows.append((np.repeat(i, len(best)), found[best], cosines[best]))
                at, found, cosines = (np.concatenate([r[x] for r in rows]) for x in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(keys[at, 0]), pa.array(keys[at, 1]), pa.array(own_keys[found, 0]), pa.array(own_keys[found, 1]), pa.array(own_ids[found]), pa.array(cosines)], ["q1", "q2", "k1", "k2", "least_id", "score"])

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The ``k`` nearest rows of each query: query_id, rank, vec_id, score.  Both tables have ``key`` and ``vector``."""
    spark = rows.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("vector")
        df = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")).where(F.col("id").isNotNull() & v.isNotNull())
        df = df.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
        return df.withColumns({"k1": F.xxhash64("vector"), "k2": F.xxhash64("vector", F.lit(1))})

    members = usable(rows).withColumn("n", F.row_number().over(W.partitionBy("k1", "k2").orderBy("id"))).where(F.col("n") <= k + 1)
    groups = members.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.first("vector").alias("vector"))
    asked = usable(queries).select("id", "k1", "k2", "vector")
    searched = asked.groupBy("k1", "k2").agg(F.first("vector").alias("vector"))
    n = rows.count()
    shards = max(1, -(-n // shard_rows))
    data = groups.select(F.pmod(F.col("k1"), F.lit(shards)).alias("shard"), F.lit(0).alias("kind"), "k1", "k2", F.col("ids")[0].alias("least_id"), "vector")
    blocks = searched.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")).alias("shard"), F.lit(1).alias("kind"), "k1", "k2", F.lit(0).cast("long").alias("least_id"), "vector")
    parts = max(1, min(shards, X.shuffle_parts(spark)))
    stream = data.unionByName(blocks).repartition(parts, "shard").sortWithinPartitions("shard", "kind")
    found = stream.transform(X.arrow, _search(k + 1), "q1 long, q2 long, k1 long, k2 long, least_id long, score double")
    best = found.withColumn("n", F.row_number().over(W.partitionBy("q1", "q2").orderBy(F.desc("score"), "least_id"))).where(F.col("n") <= k + 1)
    lists = best.join(groups.select("k1", "k2", "ids"), ["k1", "k2"]).select("q1", "q2", F.explode(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("id")))).alias("c"))
    lists = lists.groupBy("q1", "q2").agg(F.slice(F.array_sort(F.collect_list("c")), 1, k + 1).alias("c"))
    out = asked.select(F.col("id").alias("query_id"), F.col("k1").alias("q1"), F.col("k2").alias("q2")).join(lists, ["q1", "q2"])
    return out.select("query_id", F.posexplode(F.slice(F.filter("c", lambda c: c["id"] != F.col("query_id")), 1, k)).alias("p", "c")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("c.id").alias("vec_id"), (-F.col("c.s")).alias("score"))


def report(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings, embeddings.where(F.col("vec_id") % 50 == 0))
