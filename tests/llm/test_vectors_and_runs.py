"""Periodic runs, near vectors and centroids against brute force and odd inputs."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

pytest.importorskip("gleaner.llm")
from pyspark.sql import functions as F  # noqa: E402

from gleaner.llm import centroids, multi_index, periodic  # noqa: E402
from gleaner.llm import textops as X  # noqa: E402

#: Extra columns are named like columns that operators add.
DOCS = "doc_id long, text string, id string, wrap long, runs string, n long"
VECTORS = "vec_id long, embedding array<float>, label int, id string, k1 long, cluster int, vector string"


def plain_runs(w, least=24, exponent=3):
    out = []
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            size = j - i + p
            if j > i and size >= max(least, exponent * p) and not any(all(w[t] == w[t + q] for t in range(i, i + size - q)) for q in range(1, p)):
                out.append((i, size, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def word_lists():
    rng, out = random.Random(5), []
    for _ in range(250):
        w = []
        for _ in range(rng.randint(0, 6)):
            unit = [rng.randrange(rng.choice([1, 2, 3, 20])) for _ in range(rng.randint(1, 12))]
            w += unit * rng.randint(1, 14)
            if rng.random() < 0.4:
                w += [rng.randrange(5) for _ in range(rng.randint(0, 20))]
        if rng.random() < 0.2:
            unit = w[: rng.randint(0, 30)]
            w = (unit * 5)[: max(0, len(unit) * 5 - rng.randint(0, 3))] + w
        out.append(w)
    return [*out, [0] * 300, [], ([0, 1] * 30 + [2]) * 6, [0] * 23, [0] * 24, [0, 1, 2] * 8, [*range(9)] * 3]


@pytest.mark.parametrize("heavy", [8, 0.01])
def test_runs_equal_all_lags_and_all_periods(monkeypatch, heavy):
    """With the low bound most words are counted by transforms, with the usual one by differences."""
    monkeypatch.setattr(periodic, "HEAVY", heavy)
    docs = word_lists()
    at = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    found = [[] for _ in docs]
    for d, *run in zip(*periodic.runs(X.mix(np.array([x for d in docs for x in d], np.uint64)), at)):
        found[d].append(tuple(int(x) for x in run))
    assert found == [plain_runs(d) for d in docs]


def test_matches_of_lags_are_exact():
    rng = np.random.default_rng(3)
    words = X.mix((rng.zipf(1.4, 3000) % 50).astype(np.uint64))
    at = np.array([0, 0, 7, 1500, 3000])
    counts, base = periodic.matches(words, at)
    for d in range(4):
        w = words[at[d] : at[d + 1]]
        for p in range(1, len(w) // 3 + 1):
            assert counts[base[d] + p] == (w[:-p] == w[p:]).sum()


def plain_report(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + size for s, size, q in runs)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(kept)))


def test_report_of_runs(spark):
    rng = random.Random(9)
    texts = [None, "", " \t\n", "a", "é日 " * 40, "no run here at all", "x\x0by\x0cz " * 30 + "end", "　 　 " * 20]
    texts += [" ".join(str(x) for x in w) for w in word_lists()[::3]]
    texts += [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(1, 400))) for _ in range(40)]
    rows = [*enumerate(texts), (None, "q " * 30), (3, "t u " * 20), (3, "t u " * 20), (-8, "m n o " * 20)]
    df = spark.createDataFrame([(i, t, "x", 7, "r", 1) for i, t in rows], DOCS).repartition(5)
    got = periodic.report(df)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((plain_report(*r) for r in rows), key=repr)


def test_runs_of_long_texts_and_empty_tables(spark):
    long = "w" * 500_000 + " " + " ".join(f"{i % 1000}" for i in range(200_000))
    found = periodic.find(spark.createDataFrame([(1, long), (2, "a " * 300_000)], "doc_id long, text string"))
    rows = {r["doc_id"]: r for r in found.collect()}
    assert rows[1]["n_words"] == 200_001 and [tuple(r) for r in rows[1]["runs"]] == [(1, 200_000, 1000)]
    assert rows[1]["collapsed"] == "w" * 500_000 + " " + " ".join(f"{i}" for i in range(1000))
    assert [tuple(r) for r in rows[2]["runs"]] == [(0, 300_000, 1)] and rows[2]["collapsed"] == "a"
    assert periodic.report(spark.createDataFrame([], DOCS)).count() == 0


def near_vectors():
    rng = np.random.default_rng(4)
    rows = [rng.standard_normal(16) for _ in range(300)]
    for k in range(40):
        for _ in range(k % 7):
            v = rows[k] / np.linalg.norm(rows[k])
            aside = rng.standard_normal(16)
            rows.append(3 * (v + rng.choice([0.05, 0.12, 0.19, 0.21]) * aside / np.linalg.norm(aside)))
    centre = rng.standard_normal(16)
    rows += [centre + 0.05 * rng.standard_normal(16) for _ in range(150)]  # a crowded cell
    rows = [r.astype(np.float32).tolist() for r in rows]
    rows += rows[:10] + rows[-3:] * 4
    labels = [int(x) for x in rng.choice([0, 0, 0, 1, 2], len(rows))]
    odd = [(None, 0), ([0.0] * 16, 0), ([], 0), ([float("nan")] * 16, 0), ([None, *[1.0] * 15], 0), ([float("inf"), *[1.0] * 15], 0), (rows[0], None), (rows[0][:7], 0), (rows[0][:7], 0), ([2.0], 1), ([5.0], 1), ([-5.0], 1), ([1e-30, 1e-30], 1), ([2e-30, 2e-30], 1)]
    return [(r, k) for r, k in zip(rows, labels)] + odd


def plain_near(rows):
    """Links and least reachable id by comparing all pairs."""
    ok = [i for i, (v, k) in enumerate(rows) if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][0], np.float64) / np.linalg.norm(np.array(rows[i][0], np.float64)) for i in ok}
    links = {i: [j for j in ok if j != i and rows[i][1] == rows[j][1] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98] for i in ok}
    out = {}
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (i, len(links.get(i, ())), min(seen), i == min(seen))
    return out


@pytest.mark.parametrize("block, cell", [(16_384, 512), (40, 4)])
def test_near_vectors_equal_all_pairs(spark, monkeypatch, block, cell):
    """In one large cell of each label, and in many small ones whose crowded groups are cut into blocks."""
    monkeypatch.setattr(multi_index, "BLOCK", block)
    monkeypatch.setattr(multi_index, "CELL", cell)
    monkeypatch.setattr(multi_index, "OFTEN", 3)
    rows = near_vectors()
    df = spark.createDataFrame([(i, v, k, "x", 1, 2, "y") for i, (v, k) in enumerate(rows)], VECTORS).repartition(6)
    got = multi_index.near(df)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    found, expected = {r["vec_id"]: tuple(r) for r in got.collect()}, plain_near(rows)
    assert len(found) == len(rows)
    # never a link below the threshold, and nearly all above it
    assert all(found[i][1] <= expected[i][1] for i in expected)
    assert sum(r[1] for r in found.values()) >= 0.99 * sum(r[1] for r in expected.values())
    assert sum(found[i] == expected[i] for i in expected) >= 0.98 * len(expected)


def test_near_vectors_without_ids_or_rows(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(None, v, 1), (5, v, 1), (5, v, 1), (4, v, 1), (9, v, 2)], "vec_id long, embedding array<double>, label long")
    assert sorted(map(tuple, multi_index.report(df).collect()), key=repr) == sorted([(None, 0, None, False), (5, 2, 4, False), (5, 2, 4, False), (4, 2, 4, True), (9, 0, 9, True)], key=repr)
    assert multi_index.report(spark.createDataFrame([], VECTORS)).count() == 0


def test_grid_visits_cells_by_least_way(monkeypatch):
    """What the traversal visits is every larger cell within the reach, by plain comparison of all cells."""
    rng = np.random.default_rng(2)
    vectors = multi_index.unit(rng.standard_normal((400, 12)))
    grid = multi_index.Grid(vectors, 9, 0.98, 0.999)
    home, who, where = grid.cells(vectors)
    visits = set(zip(who.tolist(), where.tolist()))
    (a1, f1), (a2, f2) = grid.bounds(vectors)
    wide = len(grid.books[1])
    assert visits == {(x, i * wide + j) for x in range(400) for i in range(len(grid.books[0])) for j in range(wide) if f1[x, i] + f2[x, j] <= grid.reach and i * wide + j > home[x]}
    assert (home == a1 * wide + a2).all()


def plain_clusters(vectors, start, rounds):
    x, c = vectors.astype(object), [list(map(int, s)) for s in start]
    for r in range(rounds + 1):
        d = [[sum((int(p) - q) ** 2 for p, q in zip(v, row)) for row in c] for v in x]
        own = [min(range(len(c)), key=lambda k: (row[k], k)) for row in d]
        if r < rounds:
            for k in range(len(c)):
                members = [v for v, o in zip(x, own) if o == k]
                if members:
                    c[k] = [sum(int(m[i]) for m in members) // len(members) for i in range(len(c[k]))]
    return own, [row[o] for row, o in zip(d, own)], c


@pytest.mark.parametrize("spread", [2, 40, 60_000_000])
def test_clusters_equal_the_plain_algorithm(spark, monkeypatch, spread):
    """Small integers give many ties, equal vectors and empty clusters; large ones leave floating point."""
    rng = np.random.default_rng(spread)
    vectors = rng.integers(-spread, spread, (300, 4))
    vectors[150:] += 3 * spread // 2
    start = vectors[[0, 0, 7, 160, 161, 3]]  # two equal ones: the second stays empty
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, vector array<double>").repartition(3)
    found, places = centroids.exponion(df, start, rounds=6, scale=1)
    own, distance, c = plain_clusters(vectors, start, 6)
    assert sorted(map(tuple, found.collect())) == list(zip(range(300), own, distance))
    assert places.tolist() == c


def test_bounds_leave_out_centroids():
    rng = np.random.default_rng(8)
    centres = rng.integers(-5000, 5000, (60, 8))
    vectors = np.repeat(centres, 40, 0) + rng.integers(-30, 30, (2400, 8))
    at = centroids.Centroids(centres)
    own, upper, lower = centroids.first(vectors, at)
    moved = centres + rng.integers(-40, 40, centres.shape)
    new, up, low, seen = centroids.again(vectors, centroids.Centroids(moved, centres), own, upper, lower)
    d = centroids.squares(vectors, moved)
    assert (new == d.argmin(1)).all() and seen < 0.2 * d.size
    second = np.sort(d, 1)[:, 1]
    assert (up**2 >= d.min(1)).all() and (low.clip(0) ** 2 <= second).all()


def test_report_of_centroids(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(64).astype(np.float32)], 1) for i in range(40)]
    rows += [(3, rows[3][1], 1), (None, rows[5][1], 1), (50, None, 1), (51, [1.0] * 63, 1), (52, [float("nan")] + [1.0] * 63, 1), (53, [None] + [1.0] * 63, 1), (54, [1e30] + [1.0] * 63, 1), (55, [0.0] * 64, None)]
    df = spark.createDataFrame([(i, v, k, "x", 1, 2, "y") for i, v, k in rows], VECTORS)
    got = centroids.report(df).collect()
    used = [(i, np.floor(1024 * np.float32(v).astype(np.float64)).astype(np.int64)) for i, v, _ in rows if i not in (50, 51, 52, 53, 54)]
    start = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), tuple(v)) for i, v in used if i is not None)[:8]
    own, distance, c = plain_clusters(np.array([v for _, v in used]), [s[1] for s in start], 10)
    total = [sum(d for d, o in zip(distance, own) if o == k) for k in range(8)]
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    expected = [(i, o, d, total[o], sum(distance), sha[o]) for (i, _), o, d in zip(used, own, distance)]
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    few = centroids.report(df.where("vec_id in (1, 2)")).collect()
    assert sorted((r["cluster"], r["distance"]) for r in few) == [(0, 0), (1, 0)]
    empty = centroids.report(df.where(F.lit(False)))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
