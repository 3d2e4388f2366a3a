"""Unions in order, running totals, filters that are probed before they are added to, null keys, white space, boxes of all sizes."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import hashing as H
from gleaner.functions import text as X
from gleaner.operators import collect as C
from gleaner.operators import components as U
from gleaner.operators import corpus as O
from gleaner.operators import layout as L


# --- unions -----------------------------------------------------------------------------------------------------------

def union_loop(edges):
    """One union after the other; each returns whether it joined two sets."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    out = []
    for a, b in edges:
        x, y = (None, None) if a is None or b is None else (find(a), find(b))
        out.append(x != y)
        if x != y:
            parent[y] = x
    return out


def edge_lists():
    rng = random.Random(3)
    yield [(rng.randrange(60), rng.randrange(60)) for _ in range(150)]
    yield [(i, i + 1) for i in range(400)]  # a chain
    yield [(0, i) for i in range(300)] + [(i, 0) for i in range(300)] + [(5, 5), (None, 3), (3, None)]  # a hub, met again
    yield [(i, j) for i in range(0, 200, 10) for j in range(i, i + 10)] * 2 + [(i, i + 10) for i in range(0, 190, 10)]
    yield []


@pytest.mark.parametrize("case, chunk", [(0, 7), (1, 90), (2, 90), (3, 7), (4, 7), (0, 1_000_000), (2, 1_000_000), (3, 1_000_000)])
def test_unions_equal_the_loop(spark, monkeypatch, case, chunk):
    """With small chunks tasks can drop little, and rounds follow."""
    monkeypatch.setattr(U, "CHUNK", chunk)
    edges = list(edge_lists())[case]
    random.Random(case).shuffle(edges)
    df = spark.createDataFrame([(n, a, b, "x") for n, (a, b) in enumerate(edges)], "n long, a long, b long, payload string").repartition(4)
    got = U.unions(df, "n")
    assert got.columns == ["n", "a", "b", "payload", "merged"]
    assert [r["merged"] for r in sorted(got.collect(), key=lambda r: r["n"])] == union_loop(edges)


def test_unions_of_names_in_any_order(spark):
    rng = random.Random(8)
    edges = [(f"v{rng.randrange(40)}", f"v{rng.randrange(40)}", rng.random()) for _ in range(120)]
    df = spark.createDataFrame(edges, "x string, y string, weight double")
    got = {(r["x"], r["y"], r["weight"]): r["merged"] for r in U.unions(df, "weight", "x", "y").collect()}
    edges.sort(key=lambda e: e[2])
    assert [got[e] for e in edges] == union_loop([e[:2] for e in edges])


def test_connected(spark):
    labels = U.components(spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long"))
    pairs = spark.createDataFrame([(1, 3), (3, 7), (9, 9), (9, 1), (None, 1), (8, 7), (None, None)], "a long, b long")
    got = {(r["a"], r["b"]): r["connected"] for r in U.connected(pairs, labels).collect()}
    assert got == {(1, 3): True, (3, 7): False, (9, 9): True, (9, 1): False, (None, 1): False, (8, 7): True, (None, None): False}


def test_forest_takes_the_first_edge_between_sets():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 50, (2, 400))
    rank = rng.permutation(400)
    taken = U.forest(a, b, rank, 50)
    order = np.argsort(rank)
    assert taken[order].tolist() == union_loop(list(zip(a[order].tolist(), b[order].tolist())))


# --- running totals ---------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("buckets", [1, 8, 23])
def test_ordinals_of_a_million_rows(spark, buckets):
    """More rows than the sample behind a range partitioning holds, with a payload that one side of the plan doesn't need."""
    n = 1_000_000
    rows = spark.range(n).select(F.xxhash64("id").alias("k"), F.sha1(F.col("id").cast("string")).alias("payload"), "id")
    got = C.running_count(rows, [F.col("k")], buckets)
    t = got.agg(F.count("*").alias("n"), F.count_distinct("ordinal").alias("d"), F.min("ordinal").alias("a"), F.max("ordinal").alias("b")).first()
    assert tuple(t) == (n, n, 1, n)
    late = got.alias("x").join(got.alias("y"), F.col("y.ordinal") == F.col("x.ordinal") + 1).where(F.col("y.k") < F.col("x.k"))
    assert late.isEmpty()


def test_totals_with_ties_nulls_and_descending_order(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2, 2, 2, 3]), n, rng.choice([0, 1, 5])) for n in range(3000)]
    df = spark.createDataFrame(rows, "k int, n long, v long")
    got = C.running_total(df, [F.col("k").desc(), F.col("n")], F.col("v"), "total", 7).collect()
    total, expected = 0, {}
    for k, n, v in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1])):
        total += v
        expected[n] = total
    assert {r["n"]: r["total"] for r in got} == expected
    ties = C.running_count(df, [F.col("k")], 5)
    assert sorted(r["ordinal"] for r in ties.collect()) == list(range(1, 3001))


def test_early_stop_on_many_pages(spark):
    pages = spark.range(400_000).select(F.col("id").alias("page"), F.lit(1).cast("long").alias("new"), F.sha1(F.col("id").cast("string")).alias("payload"))
    assert C.early_stop(pages, "page", "new", 200_000).agg(F.count("*"), F.max("page")).first()[:] == (300_000, 299_999)


# --- filters ----------------------------------------------------------------------------------------------------------

def positions(item, m, k):
    return {int(hashlib.md5(f"{i}:{item}".encode()).hexdigest(), 16) % m for i in range(k)}


def probe_then_add(items, m, k, held=()):
    bits, out = set(held), []
    for x in items:
        if x is None:
            out.append(None)
            continue
        p = positions(x, m, k)
        out.append(p <= bits)
        bits |= p if not out[-1] else set()
    return out


@pytest.mark.parametrize("m, k", [(64, 3), (700, 4), (1 << 16, 6)])
@pytest.mark.parametrize("broadcast", [1 << 28, 1])
def test_probe_then_add_equals_the_loop(spark, monkeypatch, m, k, broadcast):
    monkeypatch.setattr(O, "BROADCAST_BITS", broadcast)
    rng = random.Random(m)
    items = [rng.choice([None, "", f"u{rng.randrange(250)}"]) if rng.random() < 0.05 else f"u{rng.randrange(250)}" for _ in range(500)]
    df = spark.createDataFrame([(n, x, 1) for n, x in enumerate(items)], "n long, item string, _at int").drop("_at").repartition(5)
    got = [r["seen"] for r in sorted(O.bloom_first_seen(df, "item", "n", m, k).collect(), key=lambda r: r["n"])]
    assert got == probe_then_add(items, m, k)
    # false positives: items that are new but count as seen
    first = {x: n for n, x in reversed(list(enumerate(items))) if x is not None}
    if m == 64:
        assert any(got[n] for n in first.values())
    before = [f"u{i}" for i in range(0, 250, 9)]
    bloom = O.bloom_build(spark.createDataFrame([(x,) for x in before], "item string"), "item", m, k)
    got = [r["seen"] for r in sorted(O.bloom_first_seen(df, "item", "n", m, k, bloom).collect(), key=lambda r: r["n"])]
    assert got == probe_then_add(items, m, k, set().union(*(positions(x, m, k) for x in before)))
    assert H.bloom_size(250, 0.1)[0] > 64


# --- null keys --------------------------------------------------------------------------------------------------------

def test_rows_with_null_keys_stay(spark):
    rows = spark.createDataFrame([(1, "a", "s"), (2, None, "s"), (3, None, None), (4, "a", None), (5, "b", "t"), (6, None, None)], "id long, k string, g string")
    assert {r["id"]: r["kept"] for r in O.first_of_equal(rows, F.md5("k"), "id").collect()} == {1: 1, 2: 2, 3: 2, 4: 1, 5: 5, 6: 2}
    assert {r["id"] for r in C.upsert(rows, "k", "id").collect()} == {4, 5, 6}
    assert {r["id"] for r in O.add_once(rows, "k", "id").collect()} == {1, 2, 5}
    assert [r["id"] for r in C.quota_sample(rows, "g", "id", 1, 4).collect()] == [1, 3, 5, 2]
    files = spark.createDataFrame([(1, "h", "p1"), (2, None, "p2"), (3, None, "p3"), (4, "h", "p4"), (5, "old", "p5")], "ord long, file_hash string, local_path string")
    known = spark.createDataFrame([("old", "store"), (None, "nothing")], "file_hash string, local_path string")
    assert {r["ord"]: r["status"] for r in C.content_status(files, known).collect()} == {1: "new", 2: "new", 3: "new", 4: "duplicate_content:p1", 5: "duplicate_content:store"}
    boxes = spark.createDataFrame([(None, 1, 0.0, 0.0, 9.0, 9.0), (None, 2, 0.0, 0.0, 10.0, 10.0), (1, 1, 0.0, 0.0, 9.0, 9.0), (None, 3, 50.0, 50.0, 51.0, 51.0)], "page int, ord int, x0 double, y0 double, x1 double, y1 double")
    assert {(r["page"], r["ord"]) for r in L.merge_boxes(boxes, ["page"], "ord").collect()} == {(None, 2), (None, 3), (1, 1)}
    assert {(r["page"], r["ord"]): r["group"] for r in L.overlap_groups(boxes, ["page"], "ord").collect()} == {(None, 1): 1, (None, 2): 1, (None, 3): 3, (1, 1): 1}


# --- white space and palindromes --------------------------------------------------------------------------------------

def test_words_are_those_of_split(spark):
    texts = ["a　b c d", "\x1ca\x1db\x1ec\x1fd\x85e\x0bf\x0cg", " 　 ", "", "한국　어 글", "a b​c d﻿e  f　　g"]
    rows = spark.createDataFrame(enumerate(texts), "n int, t string").select("n", X.words(F.col("t")).alias("w"), X.strip(F.col("t")).alias("s"), X.preprocess(F.col("t")).alias("p")).orderBy("n").collect()
    assert [r["w"] for r in rows] == [t.split() for t in texts]
    assert [r["s"] for r in rows] == [t.strip() for t in texts]
    import re

    assert [r["p"] for r in rows] == [re.sub(r"[^\w\s]", "", re.sub(r"\s+", " ", t.lower())).strip() for t in texts]


def test_longest_palindromes_equal_all_substrings(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab" if n % 2 else "abcé한😀") for _ in range(rng.randint(0, 40))) for n in range(300)] + ["", "x", "abba", "aa", "a" * 500, "ab" * 300, None]

    def plain(t):
        best = ""
        for i in range(len(t or "")):
            for j in range(len(t), i + len(best), -1):
                if t[i:j] == t[i:j][::-1]:
                    best = t[i:j]
                    break
        return best if t else t

    got = spark.createDataFrame(enumerate(texts), "n int, t string").select("n", X.longest_palindrome("t").alias("p")).orderBy("n").collect()
    assert [r["p"] for r in got] == [plain(t) for t in texts]


# --- boxes ------------------------------------------------------------------------------------------------------------

def plain_overlaps(rows):
    out = {}
    for p, i, a0, b0, a1, b1 in rows:
        for q, j, c0, d0, c1, d1 in rows:
            if p == q and i < j:
                w, h = min(a1, c1) - max(a0, c0), min(b1, d1) - max(b0, d0)
                if w > 0 and h > 0:
                    out[p, i, j] = w * h / ((a1 - a0) * (b1 - b0) + (c1 - c0) * (d1 - d0) - w * h)
    return out


BOXES = "page int, ord int, x0 double, y0 double, x1 double, y1 double"


def random_boxes():
    rng = random.Random(6)
    rows = []
    for page in (1, 2, None):
        for n in range(120):
            size = rng.choice([0.001, 0.3, 1, 8, 8, 40, 700])
            x, y = rng.choice([rng.uniform(-50, 50), rng.randint(-20, 20)]), rng.uniform(-50, 50)
            rows.append((page, n, float(x), y, x + size * rng.choice([1, 0.2, rng.random()]), y + size * rng.choice([1, 0.2, rng.random()])))
        rows = [(p, n, *map(float, b)) for p, n, *b in rows]
        rows += [(page, 200, 0.0, 0.0, 0.0, 5.0), (page, 201, 8.0, 8.0, 16.0, 16.0), (page, 202, 0.0, 8.0, 8.0, 16.0)]
    return rows


def test_overlaps_of_boxes_of_all_sizes(spark):
    rows = random_boxes()
    got = L.overlapping(spark.createDataFrame(rows, BOXES), ["page"], "ord").collect()
    found = {(r["page"], r["i"], r["j"]): r["iou"] for r in got}
    assert len(got) == len(found) and found == pytest.approx(plain_overlaps(rows))


@pytest.mark.parametrize("most", [1_000_000, 150, 5])
def test_overlap_groups_of_pages_in_tasks_and_in_rounds(spark, monkeypatch, most):
    """Pages with more overlaps than the bound take rounds over all tasks; the groups are the same."""
    monkeypatch.setattr(L, "PAGE_EDGES", most)
    rows = random_boxes()
    got = {(r["page"], r["ord"]): r["group"] for r in L.overlap_groups(spark.createDataFrame(rows, BOXES), ["page"], "ord", 0.1).collect()}
    least = {(p, i): i for p, i, *_ in rows}
    links = [k for k, v in plain_overlaps(rows).items() if v >= 0.1]
    for _ in rows:
        for p, i, j in links:
            least[p, i] = least[p, j] = min(least[p, i], least[p, j])
    assert got == least


def test_one_large_box_among_small_ones_stays_linear(spark):
    small = spark.range(3000).selectExpr("1 AS page", "CAST(id AS INT) AS ord", "id % 55 * 55.0D AS x0", "floor(id / 55) * 55.0D AS y0", "id % 55 * 55.0D + 1 AS x1", "floor(id / 55) * 55.0D + 1 AS y1")
    rows = small.unionByName(spark.createDataFrame([(1, 5000, 0.0, 0.0, 3000.0, 3000.0)], BOXES))
    assert L.overlapping(rows, ["page"], "ord").count() == 3000
    plan = L.overlapping(rows, ["page"], "ord")
    # cells of the largest box: four at most
    assert plan.where("j = 5000").select("i").distinct().count() == 3000
    shares = small.selectExpr("page", "ord", "x0 / 3025 AS x0", "y0 / 3025 AS y0", "x1 / 3025 AS x1", "y1 / 3025 AS y1")
    assert L.overlapping(shares, ["page"], "ord").count() == 0


# --- vocabularies -----------------------------------------------------------------------------------------------------

def test_vocabulary_tree():
    tree = O.vocabulary_tree(["an", "and", "ant", "b", "", "abcdefgh"], depth=3)
    assert tree.split("\n") == ["a", "  b", "    c", "  n*", "    d*", "    t*", "b*"]


def test_merged_boxes_of_small_large_and_missing_pages(spark):
    """Small pages are compared as they are, large ones and boxes without a page on grids; all give the plain loop's boxes."""
    rng = random.Random(3)
    rows = random_boxes() + [(page, n, float(x := rng.randint(0, 30)), float(y := rng.randint(0, 30)), x + 9.0, y + 9.0) for page in (None, 7, 8, 9) for n in range(12)]
    links = {k for k, v in plain_overlaps(rows).items() if v > 0.1}
    group = {(p, i): i for p, i, *_ in rows}
    for _ in rows:
        for p, i, j in links:
            group[p, i] = group[p, j] = min(group[p, i], group[p, j])
    best = {}
    for p, i, x0, y0, x1, y1 in rows:
        best[p, group[p, i]] = max(best.get((p, group[p, i]), (-1, 0)), ((x1 - x0) * (y1 - y0), -i))
    df = spark.createDataFrame(rows, BOXES)
    assert {(r["page"], r["ord"]) for r in L.merge_boxes(df, ["page"], "ord", 0.1).collect()} == {(p, -at) for (p, _), (_, at) in best.items()}


def test_boxes_of_small_pages_are_not_copied(spark):
    """One row a box and side instead of one for each of four cells and each size."""
    df = spark.range(4000).selectExpr("CAST(id / 8 AS INT) AS page", "CAST(id AS INT) AS ord", "id % 8 * 3.0D AS x0", "0.0D AS y0", "id % 8 * 3.0D + 5 AS x1", "5.0D AS y1")
    pairs = L.overlapping(df, ["page"], "ord", 0.1)
    assert pairs.count() == 7 * 500 and "Generate" not in pairs._jdf.queryExecution().toString()


def test_tables_of_pages_without_text_are_not_merged(spark, monkeypatch):
    rows = [(p, k, 10.0 * k, 0.0, 10.0 * k + 5, 5.0, "자본금 1 유동부채 2 부채총계 3 4" if p == 3 and k == 1 else None) for p in (None, 1, 2, 3, 4) for k in range(3)]
    rows.append((None, 9, 90.0, 0.0, 95.0, 5.0, "FCF 1 CAPEX 2 3 4"))
    c = spark.createDataFrame(rows, f"{BOXES}, text_content string")
    texts = spark.createDataFrame([(1, "FCF 1 CAPEX 2 3 4"), (2, "nothing of the kind"), (None, "FCF 1 CAPEX 2 3 4"), (3, "FCF 1 CAPEX 2 3 4")], "page int, page_text string")
    seen, merge = [], L.merge_boxes
    monkeypatch.setattr(L, "merge_boxes", lambda boxes, *more: seen.append({r["page"] for r in boxes.collect()}) or merge(boxes, *more))
    got = [(r["page"], r["ord"], r["category"]) for r in L.financial_tables(c, ["page"], "ord", texts, size_ok=F.col("x0") < 95).collect()]
    assert sorted(got, key=repr) == sorted([(None, 9, "cash_flow"), (3, 1, "balance_sheet"), *((p, k, "cash_flow") for p in (1, 3) for k in range(3) if (p, k) != (3, 1))], key=repr)
    assert seen == [{None, 1, 3}]
