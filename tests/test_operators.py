"""Operators on small inputs with known answers."""

import os
import random

import pytest
from pyspark.sql import functions as F

from gleaner.functions import hashing as H
from gleaner.functions import text as X
from gleaner.operators import collect as C
from gleaner.operators import components as components_module
from gleaner.operators import corpus as O
from gleaner.operators import layout as L
from gleaner.operators.components import components, groups
from gleaner.sources import html, labelstudio

BOX = "image_id string, det_idx long, label string, x double, y double, width double, height double"


def detections(spark, boxes):
    return spark.createDataFrame([("i", k, b[4] if len(b) > 4 else "t", *map(float, b[:4])) for k, b in enumerate(boxes)], BOX)


@pytest.mark.parametrize(
    ("p", "g", "t", "want"),
    [
        ([(3, 4, 11, 7)], [(3, 4, 11, 7)], 0.9, (1, 0, 0)),
        ([(3, 4, 11, 7), (61, 4, 11, 7)], [], 0.5, (0, 2, 0)),
        ([], [(3, 4, 11, 7), (61, 4, 11, 7), (3, 71, 11, 7)], 0.5, (0, 0, 3)),
        # 6 of 8 columns are shared: IoU 6 / 10
        ([(12, 30, 8, 5)], [(14, 30, 8, 5)], 0.6, (1, 0, 0)),
        ([(12, 30, 8, 5)], [(14, 30, 8, 5)], 0.61, (0, 1, 1)),
        # the second truth has no partner, the third prediction neither
        ([(1, 1, 16, 9), (40, 1, 16, 9), (80, 60, 3, 3)], [(40, 1, 16, 9), (70, 1, 16, 9), (1, 1, 16, 9)], 0.5, (2, 1, 1)),
        # two overlap one box: the closer one gets it
        ([(25, 25, 30, 30)], [(27, 27, 30, 30), (25, 26, 30, 30)], 0.5, (1, 0, 1)),
        ([(25, 25, 30, 30), (26, 25, 30, 30)], [(25, 25, 30, 30)], 0.5, (1, 1, 0)),
    ],
)
def test_matching(spark, p, g, t, want):
    p, g = detections(spark, p), detections(spark, g)
    m = L.metrics(L.detection_counts(p, g, L.match_detections(p, g, threshold=t))).first()
    assert (m["tp"], m["fp"], m["fn"]) == want


def test_category_accuracy_and_threshold(spark):
    p = detections(spark, [(2, 3, 14, 6, "red"), (33, 44, 8, 8, "blue"), (70, 3, 5, 5, "red"), (70, 20, 5, 5, "red")])
    g = detections(spark, [(2, 3, 14, 6, "red"), (33, 44, 8, 8, "green"), (70, 3, 5, 5, "red"), (70, 20, 5, 5, "red")])
    assert L.metrics(L.detection_counts(p, g, L.match_detections(p, g))).first()["category_accuracy"] == 0.75
    with pytest.raises(ValueError):
        L.match_detections(p, g, threshold=1.5)


@pytest.mark.parametrize(
    ("boxes", "t", "n"),
    [
        # IoU 7/13 on one page, nothing on the other
        ([(4, 10, 10, 20, 30), (4, 13, 10, 23, 30), (4, 60, 60, 70, 70)], 0.5, 2),
        ([(4, 10, 10, 20, 30), (4, 13, 10, 23, 30), (4, 60, 60, 70, 70)], 0.6, 3),
        # a row of five, each overlapping the next by half
        ([(1, 8 * k, 0, 8 * k + 16, 9) for k in range(5)], 0.3, 1),
        ([(page, 5, 5, 45, 25) for page in (1, 2, 3)], 0.2, 3),
        # a box inside a box inside a box
        ([(9, 0, 0, 64, 64), (9, 4, 4, 52, 52), (9, 8, 8, 44, 44)], 0.5, 1),
        ([], 0.5, 0),
    ],
)
def test_box_merge(spark, boxes, t, n):
    df = spark.createDataFrame([("f", b[0], k, *map(float, b[1:])) for k, b in enumerate(boxes)], "file string, page int, ord int, x0 double, y0 double, x1 double, y1 double")
    assert L.merge_boxes(df, ["file", "page"], "ord", t).count() == n


def test_classifier(spark):
    # keywords are fixed values of the rules; the sentences around them are made up
    rows = {
        "four of income, one inside another": "세전순이익 88 법인세 21 매출원가 310 2031F 2030 99%",
        "two of balance": "유동부채 17 이익잉여금 4,400 7 8 9",
        "one word only": "매출총이익 5 6 7 8",
        "three of cash": "CAPEX 12 FCF 30 현금증감 (18) 5",
        "no numbers": "EPS BPS DPS nothing but words in this line at all",
        "empty": "",
        "null": None,
    }
    df = spark.createDataFrame(list(rows.items()), "i string, text_content string")
    got = {r["i"]: (r["category"], round(r["confidence"], 3)) for r in L.classify_tables(df).collect()}
    assert got == {"four of income, one inside another": ("income_statement", 0.767), "two of balance": ("balance_sheet", 0.333), "three of cash": ("cash_flow", 0.5)}
    text = spark.createDataFrame([("FY31 2Q33",), ("2033E 2033E",), ("2년 11분기 12분기",), ("",)], "t string")
    assert [r[0] for r in text.select(L.temporal_evidence(F.col("t"))).collect()] == [2, 1, 2, 0]


def test_components_match_a_simple_model(spark, monkeypatch):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 501 + i) for i in range(30)] + [(700, 700), (None, 3), (4, None)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    want = {x: find(x) for x in up}
    for chunk in (1_000_000, 7):  # all of a task's edges at once, and a few at a time
        monkeypatch.setattr(components_module, "CHUNK", chunk)
        got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
        assert got == want


def test_components_of_a_long_chain(spark):
    order = list(range(5001))
    random.Random(9).shuffle(order)
    chain = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long").repartition(16)
    assert components(chain).agg(F.count("*"), F.count_distinct("label"), F.min("label")).first() == (5001, 1, 0)
    assert components(chain.where("a < 0")).count() == 0


def test_groups_ignore_unknown_ends(spark):
    v = spark.createDataFrame([(x,) for x in ("oak", "elm", "ash", "fir", "yew")], "id string")
    e = spark.createDataFrame([("yew", "elm"), ("fir", "yew"), ("ash", "reed"), ("reed", "oak")], "a string, b string")
    assert {r[0]: r[1] for r in groups(v, e).collect()} == {"oak": "oak", "ash": "ash", "elm": "elm", "fir": "elm", "yew": "elm"}


def test_suffixes_and_vocabulary(spark):
    texts = {1: "tattoo a tattoo", 2: "aaaa", 3: "no", 4: ""}
    t = spark.createDataFrame(list(texts.items()), "id int, text string")
    got = {i: [] for i in texts}
    for r in O.suffix_array(t, "id").orderBy("id", "sa_rank").collect():
        got[r["id"]].append((r["pos"], r["lcp"]))
    for i, s in texts.items():
        order = sorted(range(len(s)), key=lambda k: s[k:])
        common = [0] + [len(os.path.commonprefix([s[a:], s[b:]])) for a, b in zip(order, order[1:])]
        assert got[i] == list(zip(order, common))[: len(s)]
    assert {r[0]: r[1] for r in O.longest_repeated_substring(t, "id").collect()} == {1: "tattoo", 2: "aaa", 3: "", 4: ""}
    tokens = ("s", "sea", "seal", "season", "saw", "w")
    v = spark.createDataFrame([(x,) for x in tokens], "token string")
    asked = ["seasoning", "seals", "sawdust", "wood", "oar", "se", ""]
    words = spark.createDataFrame([(x,) for x in asked], "w string")
    got = {r["w"]: (r["all_prefixes"], r["longest_prefix"]) for r in O.vocabulary_prefixes(words, "w", v).collect()}
    for w in asked:
        found = sorted((x for x in tokens if w.startswith(x)), key=len)
        assert got[w] == (found, found[-1] if found else None)
    pieces = ["sea", "##son", "##s", "saw", "##dust", "##"]
    w = spark.createDataFrame([("seasons",), ("sawdust",), ("sea",), ("seam",), ("",)], "w string")
    assert [r[0] for r in w.select(O.wordpiece(F.col("w"), pieces)).collect()] == [["sea", "##son", "##s"], ["saw", "##dust"], ["sea"], ["[UNK]"], []]


def test_bpe_training(spark):
    t = spark.createDataFrame([(1, "mud mud mud mudflat"), (2, "tide tide")], "id int, text string")
    merges, words = O.train_bpe(O.word_table(t, "id"), 3)
    assert [(a, b) for a, b, _ in merges][:2] == [("m", "u"), ("mu", "d")]
    one = spark.createDataFrame([("mud",)], "w string").select(O.tokenize_bpe(F.col("w"), [(a, b) for a, b, _ in merges[:2]])).first()[0]
    assert one == ["mud", "</w>"]


def test_minhash_kernel_is_exact():
    import hashlib

    import numpy as np

    words = [int(hashlib.sha1(str(i).encode()).hexdigest()[:16], 16) for i in range(50)]
    a, b = H.permutations(16)
    want = [min(((x * v + y) % H.PRIME) & 0xFFFFFFFF for v in words) for x, y in zip(a, b)]
    assert H.minhash_kernel(np.array(words, np.uint64).view(np.int64), 16, 42).tolist() == want
    assert H.minhash_kernel(np.zeros(0, np.int64), 4, 42).tolist() == [0xFFFFFFFF] * 4
    assert H.bloom_size(1000, 0.01)[1] == 6
    with pytest.raises(ValueError):
        H.bloom_size(0)


@pytest.mark.parametrize("links", [100_000, 0])
def test_greedy_follows_the_loop(spark, monkeypatch, links):
    monkeypatch.setattr(O, "GREEDY_LINKS", links)  # in one task each, and in rounds
    rng = random.Random(11)
    base = [[rng.randrange(1000) for _ in range(16)] for _ in range(4)]
    sigs = []
    for i in range(60):
        s = list(rng.choice(base))
        for _ in range(rng.randrange(0, 7)):
            s[rng.randrange(16)] = rng.randrange(1000)
        sigs.append((i, s if i % 5 else sigs[i // 2][1] if i else s))
    similar = lambda a, b: sum(x == y for x, y in zip(a, b)) / 16 >= 0.7 and any(a[k : k + 2] == b[k : k + 2] for k in range(0, 16, 2))
    kept = []
    for i, s in sigs:
        if not any(similar(s, sigs[k][1]) for k in kept):
            kept.append(i)
    got = O.greedy_near_duplicates(spark.createDataFrame(sigs, "id long, sig array<long>"), 0.7, 16, 8)
    assert sorted(r["id"] for r in got.where("kept").collect()) == kept and got.count() == 60


def test_quota_sample_follows_the_loop(spark):
    rng = random.Random(5)
    for _ in range(3):
        rows = [(i, rng.choice("abcd")) for i in range(30)]
        m, target = rng.randrange(0, 4), rng.randrange(1, 30)
        queues, out = {}, []
        for i, g in rows:
            queues.setdefault(g, []).append(i)
        for g in queues:
            for _ in range(m):
                if queues[g] and len(out) < target:
                    out.append(queues[g].pop(0))
        while len(out) < target and any(queues.values()):
            for g in queues:
                if queues[g] and len(out) < target:
                    out.append(queues[g].pop(0))
        df = spark.createDataFrame(rows, "ord int, g string")
        assert sorted(r[0] for r in C.quota_sample(df, "g", "ord", m, target).collect()) == sorted(out)


def test_html(spark):
    row = '<tr><td><a class="stock_item">S</a></td><td><a href="r">T</a></td><td>B</td><td class="file"><a href="x.pdf">p</a></td><td>25.01.15</td></tr>'
    page = f'<table class="type_1"><tr><th>h</th></tr><tr><td class="blank_07"></td></tr>{row}{row.replace("x.pdf", "x.doc")}</table><td class="pgRR"><a href="?page=58">last</a></td>'
    df = spark.createDataFrame([(1, page), (2, "<p>none</p>"), (3, None)], "page_id int, html string")
    got = html.report_list(df).collect()
    assert [(r["page_id"], r["title"], r["pdf_url"]) for r in got] == [(1, "T", "x.pdf")]
    assert [r[0] for r in df.where("html IS NOT NULL").select(html.total_pages(F.col("html"))).collect()] == [58, 1]


def test_annotations(spark):
    task = '{"data": {"image": "a.png"}, "predictions": [{"result": [{"type": "rectanglelabels", "value": {"x": 1, "y": 2, "width": 3, "height": 4, "rectanglelabels": ["t"]}}, {"type": "choices", "value": {}}, {"type": "rectanglelabels", "value": {"x": 1, "y": 2, "width": 3, "height": 4}}]}]}'
    df = spark.createDataFrame([(f'[{task.replace("a.png", "b.png")}, {task}, {{"data": {{"image": "b.png"}}, "predictions": []}}, {{"data": {{}}}}]',)], "value string")
    got = labelstudio.detections(labelstudio.read_tasks(df), "predictions").orderBy("image_id", "det_idx").collect()
    assert [(r["image_id"], r["det_idx"], r["label"]) for r in got] == [("a.png", 0, "t"), ("a.png", 1, "unknown"), ("b.png", None, None)]


def test_text_functions(spark):
    df = spark.createDataFrame([("a , b",), ("é_가1²!",), ("",)], "t string")
    assert [r[0] for r in df.select(X.preprocess(F.col("t"))).collect()] == ["a  b", "é_가1²", ""]
    d = spark.createDataFrame([("24.11.07",), ("next week",)], "t string")
    assert [r[0] for r in d.select(X.report_date(F.col("t"))).collect()] == ["2024-11-07", "next week"]
    p = spark.createDataFrame([("xlevelx y",), ("noon ono",), ("",), (None,)], "t string")
    assert [r[0] for r in p.select(X.longest_palindrome("t")).collect()] == ["xlevelx", "noon", "", None]
