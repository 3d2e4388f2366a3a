"""Disjoint sets: connected components and unions in order, by repeated contraction of the edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.storage import remove, written

#: Edges that a task contracts at once; bounds its memory.
CHUNK = 1_000_000


def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For vertices 0 .. n - 1 the least vertex that the edges connect them with."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(label, up := label[label]):
            label = up


def _stars(chunk: int):
    """Replaces a task's edges, ``chunk`` at a time, by stars around the least vertex of each of their components."""

    def close(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        ends = pa.chunked_array([*rows["a"].chunks, *rows["b"].chunks])
        values = ends.unique()
        values = values.take(pc.sort_indices(values))
        at = pc.index_in(ends, values).to_numpy().astype(np.int64)
        label = least_labels(at[: len(rows)], at[len(rows) :], len(values))
        out = np.flatnonzero(label != np.arange(len(values)))
        return pa.RecordBatch.from_arrays([values.take(pa.array(label[out])), values.take(pa.array(out))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n > chunk:
                yield close(held)
                held, n = [], 0
        if n:
            yield close(held)

    return run


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id``, ``label`` for every end of an edge; the label is the least id of the component.

    In each round every task first contracts its own edges to stars.  Then every vertex goes to its least neighbour, one jump further
    along these pointers, and edges are relabelled; loops and repeats drop out.  Stars, cliques and whatever lies in one task vanish
    in one round, long chains shrink by a constant factor.  Rounds are written below the shared checkpoint folder and read again, so
    neither lineage nor size estimates grow.  Null ends are ignored.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    e, e_path = written(e.distinct(), "edges")
    labels = e.select(F.col("a").alias("id")).union(e.select("b")).distinct().select("id", F.col("id").alias("label"))
    schema, paths = e.schema, [e_path]
    e, e_path = written(e.where("a <> b").mapInArrow(_stars(CHUNK), schema).distinct(), "edges")
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("label"), F.least("a", "m").alias("to"))
        # one jump along the pointers
        far = least.select(F.col("label").alias("to"), F.col("to").alias("far"))
        least, least_path = written(least.join(far, "to", "left").select("label", F.coalesce("far", "to").alias("to")), "pointers")
        labels, labels_path = written(labels.join(least, "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
        to_a, to_b = (least.select(F.col("label").alias(x), F.col("to").alias(f"to_{x}")) for x in "ab")
        moved = e.join(to_a, "a").join(to_b, "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).where("a <> b")
        e, next_path = written(moved.mapInArrow(_stars(CHUNK), schema).distinct(), "edges")
        remove(spark, *paths, e_path, least_path)
        paths, e_path = [labels_path], next_path
    return labels


def groups(vertices: DataFrame, edges: DataFrame, id: str = "id") -> DataFrame:
    """Label of every vertex, single ones included; edges with an end that is no vertex are ignored."""
    known = vertices.select(F.col(id).alias("k")).distinct()
    inner = edges.join(known, edges["a"] == known["k"], "left_semi").join(known, edges["b"] == known["k"], "left_semi")
    labels = components(inner.select("a", "b"))
    return vertices.select(F.col(id).alias("id")).distinct().join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def connected(pairs: DataFrame, labels: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Adds ``connected``: whether both ends have one label (id, label).  An end without a label is a set of its own; null is in none."""
    left, right = (labels.select(F.col("id").alias(f"_id_{x}"), F.col("label").alias(f"_of_{x}")) for x in "ab")
    out = pairs.join(left, F.col(a) == F.col("_id_a"), "left").join(right, F.col(b) == F.col("_id_b"), "left")
    same = F.coalesce("_of_a", a) == F.coalesce("_of_b", b)
    return out.withColumn("connected", F.coalesce(same, F.lit(False))).drop("_id_a", "_id_b", "_of_a", "_of_b")


def forest(a: np.ndarray, b: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    """Which edges between vertices 0 .. n - 1 join different sets if they are taken by ``rank`` (all different).

    In rounds, every set takes the first edge that leaves it; whatever order the others come in, that edge finds its ends apart.
    """
    taken, label, left = np.zeros(len(a), bool), np.arange(n), np.flatnonzero(a != b)
    first = np.empty(n, np.int64)
    by_rank = np.argsort(rank)
    place = np.empty(len(a), np.int64)
    place[by_rank] = np.arange(len(a))
    while len(left):
        x, y = label[a[left]], label[b[left]]
        first.fill(len(a))
        np.minimum.at(first, x, place[left])
        np.minimum.at(first, y, place[left])
        new = by_rank[np.unique(first[first < len(a)])]
        taken[new] = True
        label = least_labels(label[a[new]], label[b[new]], n)[label]
        left = left[label[a[left]] != label[b[left]]]
    return taken


def _forests(chunk: int):
    """Of a task's edges, ``chunk`` at a time, those that their own forest takes: an edge that closes a circle here closes it anywhere."""

    def close(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        ends = pa.chunked_array([*rows["a"].chunks, *rows["b"].chunks])
        at = pc.index_in(ends, ends.unique()).to_numpy().astype(np.int64)
        by = pc.sort_indices(rows, [("at", "ascending")])
        rank = np.empty(len(rows), np.int64)
        rank[by.to_numpy()] = np.arange(len(rows))
        taken = forest(at[: len(rows)], at[len(rows) :], rank, int(at.max()) + 1)
        return rows.filter(pa.array(taken)).to_batches()[0] if taken.any() else held[0].slice(0, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n > chunk:
                yield close(held)
                held, n = [], 0
        if n:
            yield close(held)

    return run


def unions(edges: DataFrame, order: str, a: str = "a", b: str = "b") -> DataFrame:
    """Adds ``merged``: whether the union of both ends, taken one edge after the other by ``order``, joins two sets.

    ``order`` is unique.  The edges that merge are the spanning forest of least order, and that is found in rounds without going
    through the edges one by one: every set takes the first edge that leaves it, sets become one along these edges, and edges inside a
    set drop out.  Each round halves the number of sets at least.  Before each round every task drops what closes a circle among its own
    edges, and rounds end once ``CHUNK`` edges are left.  An edge from a vertex to itself, or without an end, never merges.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(order).alias("at"), F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    # of parallel edges only the first can merge
    e = e.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("at").alias("at")).select("at", "a", "b")
    e, path = written(e.mapInArrow(_forests(CHUNK), e.schema), "edges")
    merged = spark.createDataFrame([], e.select("at").schema)
    while e.count() > CHUNK:
        both = e.select("a", "b", "at").union(e.select("b", "a", "at"))
        taken, _ = written(both.groupBy("a").agg(F.min(F.struct("at", "b")).alias("first")).select("a", F.col("first.b").alias("b"), F.col("first.at").alias("at")), "taken")
        merged = merged.union(taken.select("at"))
        labels = components(taken)
        to_a, to_b = (labels.select(F.col("id").alias(x), F.col("label").alias(f"to_{x}")) for x in "ab")
        moved = e.join(to_a, "a", "left").join(to_b, "b", "left").select("at", F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b")).where("a <> b")
        moved = moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("at").alias("at")).select("at", "a", "b")
        e, next_path = written(moved.mapInArrow(_forests(CHUNK), e.schema), "edges")
        remove(spark, path)
        path = next_path
    # one task can take what is left
    merged = merged.union(e.coalesce(1).mapInArrow(_forests(CHUNK), e.schema).select("at"))
    there = merged.distinct().select(F.col("at").alias("_at"))
    return edges.join(there, edges[order] == there["_at"], "left").withColumn("merged", F.col("_at").isNotNull()).drop("_at")
