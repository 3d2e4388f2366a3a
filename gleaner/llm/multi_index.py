"""Near-duplicate vectors by an inverted multi-index.

Vectors of length one are cut into two halves with a codebook each; the pairs of nearest centroids form a grid of cells, and every
vector lies in one cell.  A vector visits cells by multi-sequence traversal: both codebooks are sorted by how far the half must at least
move to get into a centroid's region (the distance to the plane between that centroid and the nearest one), and cells are taken in
order of the summed squares until the traversal's reach.  The reach is calibrated: vectors of the sample are turned in random
directions by exactly the largest angle that still links, and it is the reach within which a share ``RECALL`` of them are found.  Cells
are numbered and only larger numbers are visited, so a pair meets in one place at most: the larger of its two cells.

Whatever meets is verified by the cosine in double precision.  Neither pairs nor groups leave a task: it gives each vector the number
of its links there and the least id of what they connect it with, and connected components join these over tasks.

Equal vectors of one label are searched once and counted as often as they occur.  A cell with over ``BLOCK`` different vectors is dealt
out: its vectors are cut into blocks by hash, and each pair of blocks is a group of its own.

Defined results: only vectors of equal labels and equal lengths are compared; rows whose label or id is null, and vectors that are null,
empty, zero or hold null or non-finite components, link with nothing but keep their row; repeated rows are different vectors; rows that
share an id count as one in components; without rows there is no result; extra columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm import sampling
from gleaner.llm import textops as X
from gleaner.operators.components import components, least_labels
from gleaner.operators.storage import written

COSINE = 0.98
RECALL = 0.9995
#: Vectors that codebooks and reach are fitted on.
SAMPLE = 16_384
#: Different vectors of a label that a cell should hold, which sets the size of the codebooks, and the largest codebook.
CELL, LARGEST = 512, 1024
BLOCK = 16_384
#: Rows of classes with more copies than this are joined apart from the others.
OFTEN = 10_000
#: Numbers of a table of distances held at once.
TABLE = 1 << 22


def fit_codebook(half: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Means of ``k`` groups at most, by Lloyd's rounds from random rows."""
    if not half.shape[1]:  # vectors of one component have no second half
        return np.zeros((1, 0))
    rows = np.unique(half, axis=0)
    book = rows[rng.permutation(len(rows))[:k]]
    for _ in range(rounds):
        own = _distances(half, book).argmin(1)
        n = np.bincount(own, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, own, half)
        book = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], book)
    return np.unique(book, axis=0)


def _distances(a: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (a**2).sum(1)[:, None] + (book**2).sum(1)[None, :] - 2 * (a @ book.T)


class Grid:
    """Two codebooks and the squared reach of a visit."""

    def __init__(self, sample: np.ndarray, k: int, cosine: float, recall: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.cut = (sample.shape[1] + 1) // 2
        self.books = [fit_codebook(h, k, rng) for h in (sample[:, : self.cut], sample[:, self.cut :])]
        # between centroids, for the distance to the plane in the middle
        self.between = [np.sqrt(np.maximum(_distances(b, b), 1e-300)) for b in self.books]
        self.reach = 0.0
        self.reach = self._calibrated(sample, cosine, recall, rng)

    def bounds(self, unit: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For both halves: the nearest centroid, and the squared distance that leads into each centroid's region at least."""
        out = []
        for half, book, between in zip((unit[:, : self.cut], unit[:, self.cut :]), self.books, self.between):
            d = _distances(half, book)
            own = d.argmin(1)
            far = np.maximum(d - d[np.arange(len(d)), own][:, None], 0) / (2 * between[own])
            far[np.arange(len(d)), own] = 0
            out.append((own, far**2))
        return out

    def _calibrated(self, sample: np.ndarray, cosine: float, recall: float, rng: np.random.Generator) -> float:
        needed = []
        for rows in np.array_split(sample, max(1, len(sample) * max(map(len, self.books)) // TABLE)):
            aside = rng.standard_normal(rows.shape)
            aside -= (aside * rows).sum(1)[:, None] * rows
            length = np.sqrt((aside**2).sum(1))
            rows, aside = rows[length > 1e-9], aside[length > 1e-9] / length[length > 1e-9][:, None]
            turned = cosine * rows + np.sqrt(1 - cosine**2) * aside
            (a1, f1), (a2, f2) = self.bounds(rows)
            (b1, g1), (b2, g2) = self.bounds(turned)
            at = np.arange(len(rows))
            there, back = f1[at, b1] + f2[at, b2], g1[at, a1] + g2[at, a2]
            # the vector in the smaller cell is the one that visits
            needed.append(np.where(a1 * len(self.books[1]) + a2 < b1 * len(self.books[1]) + b2, there, back))
        needed = np.concatenate(needed)
        return float(np.quantile(needed, recall, method="higher")) if len(needed) else 0.0

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each vector's own cell, and (vector, cell) of its visits."""
        (a1, f1), (a2, f2) = self.bounds(unit)
        wide = len(self.books[1])
        home = a1 * wide + a2
        o1, o2 = np.argsort(f1, 1, kind="stable"), np.argsort(f2, 1, kind="stable")
        s1, s2 = np.take_along_axis(f1, o1, 1), np.take_along_axis(f2, o2, 1)
        who, where = [], []
        # along the first sequence; the second one goes as far as the rest of the reach
        for i in range(f1.shape[1]):
            rows = np.flatnonzero(s1[:, i] <= self.reach)
            if not len(rows):
                break
            inside = s2[rows] <= (self.reach - s1[rows, i])[:, None]
            r, j = np.nonzero(inside)
            cell = o1[rows[r], i] * wide + o2[rows[r], j]
            larger = cell > home[rows[r]]
            who.append(rows[r][larger])
            where.append(cell[larger])
        return home, np.concatenate(who), np.concatenate(where)


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _lengths(column: pa.Array) -> list[tuple[int, int]]:
    """Stretches of lists of one length."""
    n = np.diff(column.offsets.to_numpy())
    cuts = np.flatnonzero(np.diff(n)) + 1
    return list(zip(np.append(0, cuts).tolist(), np.append(cuts, len(n)).tolist())) if len(n) else []


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; the largest component goes first, so that no square is lost or overflows."""
    scaled = vectors / np.abs(vectors).max(1)[:, None]
    return scaled / np.sqrt((scaled**2).sum(1))[:, None]


def _deal(grids: dict[int, Grid], visits: bool = True):
    """Every vector once for its own cell (kind 0) and once for each visit (kind 1); without ``visits`` only label, length and cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _lengths(batch.column("vector")):
                dim = len(batch.column("vector")[a])
                grid = grids.get(dim)
                step = b - a if grid is None else max(1, TABLE // max(map(len, grid.books)))
                for x in range(a, b, step):
                    part = batch.slice(x, min(step, b - x))
                    n = part.num_rows
                    home, who, where = (np.zeros(n, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)) if grid is None else grid.cells(unit(matrix(part.column("vector"))))
                    if not visits:
                        yield pa.RecordBatch.from_arrays([part.column("lab"), pa.array(np.full(n, dim, np.int32)), pa.array(home)], ["lab", "dim", "cell"])
                        continue
                    rows = part.take(pa.array(np.append(np.arange(n), who)))
                    kind = np.append(np.zeros(n, np.int32), np.ones(len(who), np.int32))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(len(kind), dim, np.int32)), pa.array(np.append(home, where)), pa.array(kind)], [*rows.schema.names, "dim", "cell", "kind"])

    return run


class Meeting:
    """One group of vectors that meet: those at home in it, in one block or two, and the visitors that come after them."""

    def __init__(self, rows: dict[str, np.ndarray], cosine: float):
        self.rows, self.cosine = rows, cosine
        self.links = np.zeros(len(rows["id"]), np.int64)
        self.label = np.arange(len(self.links))
        everyone = np.arange(len(self.links))
        side = rows["block"] != rows["block"][0]
        left, right = (everyone[~side], everyone[side]) if side.any() else (everyone, everyone)
        for some, i, j in self._hits(rows["unit"][left], rows["unit"][right]):
            i, j = left[i], right[some + j]
            if not side.any():
                i, j = i[i < j], j[i < j]
            self._count(self.links, i, rows["copies"][j])
            self._count(self.links, j, rows["copies"][i])
            self._connect(i, j)

    def _hits(self, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        step = max(1, TABLE // max(1, len(left)))
        for x in range(0, len(right), step):
            yield x, *np.nonzero(left @ right[x : x + step].T >= self.cosine)

    @staticmethod
    def _count(links: np.ndarray, at: np.ndarray, copies: np.ndarray) -> None:
        links += np.bincount(at, copies, len(links)).astype(np.int64)

    def _connect(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self.label[a], self.label[b]
        if (x != y).any():
            self.label = least_labels(x, y, len(self.label))[self.label]

    def visit(self, rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        """Links of visitors, each with an edge to one of the vectors that it links; these get connected."""
        counts, to = np.zeros(len(rows["id"]), np.int64), np.zeros(len(rows["id"]), np.int64)
        for some, i, j in self._hits(self.rows["unit"], rows["unit"]):
            j += some
            self._count(self.links, i, rows["copies"][j])
            self._count(counts, j, self.rows["copies"][i])
            to[j] = i  # any of them
            self._connect(i, to[j])
        return _result(rows, counts, self.rows["id"][to])

    def close(self) -> pa.RecordBatch:
        """Links of those at home, each with an edge to the first of its component."""
        return _result(self.rows, self.links, self.rows["id"][self.label])


def _result(rows: dict[str, np.ndarray], links: np.ndarray, to: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(links > 0)
    return pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (rows["k1"], rows["k2"], links, rows["id"], to)], ["k1", "k2", "links", "id", "other"])


def _search(cosine: float):
    """Groups one after the other: first who is at home, then the visitors as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, home, meeting = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([batch.column(c).to_numpy() for c in ("lab", "dim", "cell", "low", "high", "kind")], 1)
            cuts = np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1
            for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(group)).tolist()):
                part = batch.slice(a, b - a)
                rows = {c: part.column(c).to_numpy() for c in ("k1", "k2", "id", "copies", "block")} | {"unit": unit(matrix(part.column("vector")))}
                key = tuple(group[a, :5].tolist())
                if key != current:
                    if home or meeting:
                        yield (meeting or Meeting(_together(home), cosine)).close()
                    current, home, meeting = key, [], None
                if group[a, 5] == 0:
                    home.append(rows)
                elif home or meeting:
                    meeting = meeting or Meeting(_together(home), cosine)
                    home = []
                    yield meeting.visit(rows)
        if home or meeting:
            yield (meeting or Meeting(_together(home), cosine)).close()

    return run


def _together(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def near(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """``key``, n_links, component_id and kept (whether the row is the least of its component) of every row."""
    spark = rows.sparkSession
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    takes_part = F.coalesce(F.col("id").isNotNull() & F.col("lab").isNotNull() & fine, F.lit(False))
    all_rows = rows.select(F.col(key).cast("long").alias("id"), F.when(F.col(label).isNotNull(), F.xxhash64(label)).alias("lab"), F.col(vector).alias("vector"))
    all_rows = all_rows.withColumns({"k1": F.when(takes_part, F.xxhash64("lab", "vector")), "k2": F.when(takes_part, F.xxhash64("vector", "lab", F.lit(1)))})
    classes, _ = written(all_rows.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("lab").alias("lab"), F.first("vector").alias("vector")), "classes")
    grids = _grids(classes, cosine, recall)
    # cells with too many different vectors are cut into blocks
    own = classes.select("lab", "vector").transform(X.arrow, _deal(grids, visits=False), "lab long, dim int, cell long")
    crowded, _ = written(own.groupBy("lab", "dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1"), "crowded")
    dealt = classes.transform(X.arrow, _deal(grids), T.StructType([*classes.schema, T.StructField("dim", T.IntegerType()), T.StructField("cell", T.LongType()), T.StructField("kind", T.IntegerType())]))
    dealt = dealt.join(crowded, ["lab", "dim", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("k1", "k2", F.lit(7)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    at_home = F.col("kind") == 0
    dealt = dealt.withColumns({"low": F.when(at_home, F.least("block", "other")).otherwise(F.col("other")), "high": F.when(at_home, F.greatest("block", "other")).otherwise(F.col("other"))})
    group = ["lab", "dim", "cell", "low", "high"]
    stream = dealt.select(*group, "kind", "k1", "k2", "id", "copies", "block", "vector").repartition(X.shuffle_parts(spark), *group).sortWithinPartitions(*group, "kind")
    met, _ = written(stream.transform(X.arrow, _search(cosine), "k1 long, k2 long, links long, id long, other long"), "met")
    links = met.groupBy("k1", "k2").agg(F.sum("links").alias("links"))
    found = components(met.where("id <> other"), "id", "other").withColumnRenamed("label", "component")
    info = classes.select("k1", "k2", "id", "copies").join(links, ["k1", "k2"], "left").join(found, "id", "left")
    info = info.select("k1", "k2", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    info, _ = written(info, "info")
    # rows of classes with very many copies don't meet in one task
    often = info.where(F.col("copies") > OFTEN)
    many = all_rows.select("id", "k1", "k2").join(often, ["k1", "k2"])
    few = all_rows.select("id", "k1", "k2").join(often, ["k1", "k2"], "left_anti").join(info.where(F.col("copies") <= OFTEN), ["k1", "k2"], "left")
    component = F.coalesce("component", "id")
    return many.unionByName(few).select(F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _grids(classes: DataFrame, cosine: float, recall: float) -> dict[int, Grid]:
    """A grid for every length of the sample's vectors; vectors of other lengths share one cell."""
    n = classes.count()
    k = int(np.clip(round((n / CELL) ** 0.5), 2, LARGEST))
    by_length: dict[int, list[list[float]]] = {}
    for r in sampling.bounded(classes.select("k1", "vector"), "k1", SAMPLE).collect():
        by_length.setdefault(len(r["vector"]), []).append(r["vector"])
    return {dim: Grid(unit(np.array(v, np.float64)), k, cosine, recall) for dim, v in by_length.items()}


def report(embeddings: DataFrame) -> DataFrame:
    return near(embeddings)
