"""Stores, streams, documents and suffix kernels on small inputs with known answers."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.functions import geometry as G
from gleaner.functions import hashing as H
from gleaner.functions import suffixes as S
from gleaner.functions import text as X
from gleaner.operators import corpus as O
from gleaner.operators import documents as D
from gleaner.operators import layout as L
from gleaner.plans import catalog
from gleaner.sources import files, labelstudio
from gleaner.streaming import streams


def small_texts():
    rng = random.Random(2)
    return ["", "z", "zz", "zzzzzz", "abcabcab", "a#b$a#b$", "é日é日", *("".join(rng.choice("ab c") for _ in range(rng.randrange(2, 40))) for _ in range(60))]


def test_suffixes_equal_sorted_slices():
    for t in small_texts():
        order, common = S.sort_suffixes(S.code_points(t))
        want = sorted(range(len(t)), key=lambda k: t[k:])
        assert order.tolist() == want
        for r in range(1, len(t)):
            x, y = t[want[r - 1] :], t[want[r] :]
            k = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
            assert common[r] == k
        n = Counter(t[i : i + k] for i in range(len(t)) for k in range(1, len(t) - i + 1))
        best = max((len(s) for s, c in n.items() if c > 1), default=0)
        assert S.longest_repeat(t) == min((s for s, c in n.items() if c > 1 and len(s) == best), default="")


def test_repeated_substrings_count_overlaps(spark):
    texts = small_texts()
    df = spark.createDataFrame([*enumerate(texts), (900, None)], "id long, text string")
    got = {(r["id"], r["substring"]): r["cnt"] for r in O.repeated_substrings(df, "id").collect()}
    want = {}
    for i, t in enumerate(texts):
        n = Counter(t[a : a + k] for a in range(len(t)) for k in range(2, len(t) - a + 1) if k < len(t))
        want |= {(i, s): c for s, c in n.items() if c > 1}
    assert got == want
    lrs = {r["id"]: r["lrs"] for r in O.longest_repeated_substring(df, "id").collect()}
    assert lrs[900] == "" and all(lrs[i] == S.longest_repeat(t) for i, t in enumerate(texts))


def test_common_runs_keep_the_separators_out(spark):
    pairs = [(1, "harbour wall", "the harbour"), (2, "a#b#c a#b", "a#b#c"), (3, None, "x"), (4, "same", "same")]
    df = spark.createDataFrame(pairs, "id long, a string, b string")
    got = {}
    for r in O.common_substrings(df, "id", "a", "b", 3).orderBy("id", "ord").collect():
        got.setdefault(r["id"], []).append(r["substring"])
    assert "harbour" in got[1] and all("#" not in s for v in got.values() for s in v) and 3 not in got and got[4][-1] == "same"


def learned(words, steps):
    """Merges of a plain loop over symbol lists with frequencies, in order of first occurrence."""
    out = []
    for _ in range(steps):
        n = Counter()
        for w, f in words:
            for p in zip(w, w[1:]):
                n[p] += f
        if not n or max(n.values()) < 2:
            break
        best = max(n, key=n.get)  # the first one on ties
        out.append((*best, n[best]))
        merged = []
        for w, f in words:
            new, k = [], 0
            while k < len(w):
                if w[k : k + 2] == list(best):
                    new.append("".join(best))
                    k += 2
                else:
                    new.append(w[k])
                    k += 1
            merged.append((new, f))
        words = merged
    return out


def test_bpe_training_follows_the_loop(spark):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(9)) for _ in range(6)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    n = Counter(w for t in texts for w in t.split())
    merges, _ = O.train_bpe(O.word_table(df, "id"), 6)
    assert merges == learned([([*w, "</w>"], f) for w, f in n.items()], 6)
    cut = [" ".join([*w, "_"]) for w in ("plumage", "plum", "sluma", "lump", "plums")]
    rows = spark.createDataFrame(list(enumerate(cut)), "id int, symbols string")
    assert O.train_bpe(O.symbol_table(rows, "id"), 10)[0] == learned([(c.split(), 1) for c in cut], 10)


def test_accuracy_study(spark):
    df = spark.createDataFrame([(0, "one two three four five six"), (1, "one two three four five seven"), (2, "lone")], "id long, text string")
    shingles = lambda c: X.word_shingles(c, 2)
    got = {r["num_perm"]: (r["pairs"], r["mean_error"]) for r in O.accuracy_study(df, "text", shingles, F.floor(F.col("id") / 2), "id", [16, 512], range(3)).collect()}
    import hashlib

    sets = [{" ".join(w[k : k + 2]) for k in range(5)} for w in (t.split() for t in ("one two three four five six", "one two three four five seven"))]
    for n in (16, 512):
        errors = []
        for seed in range(3):
            sig = [H.minhash_kernel(__import__("numpy").array([int(hashlib.sha1(s.encode()).hexdigest()[:16], 16) for s in x], "u8").view("i8"), n, seed) for x in sets]
            errors.append(abs((sig[0] == sig[1]).mean() - 4 / 6))
        assert got[n] == (1, pytest.approx(sum(errors) / 3))


def test_discovery_and_detectors(spark, tmp_path):
    for name in ("one/b.pdf", "one/a.PDF", "two/c.pdf", "two/notes.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"%PDF")
    found = files.discover(spark, [f"{tmp_path}/two", f"{tmp_path}/one", f"{tmp_path}/*/c.pdf"])
    names = lambda df: [r["path"].rsplit("/", 1)[1] for r in df.collect()]
    assert names(found) == ["c.pdf", "a.PDF", "b.pdf"]
    assert names(files.discover(spark, f"{tmp_path}/*", 2)) == ["a.PDF", "b.pdf"]

    def good(f):
        return f.select(F.col("path").alias("file"), F.lit(1).alias("page"), F.lit(0).alias("ord"), F.lit(9.0).alias("x0"), F.lit(1.0).alias("x1"), F.lit(2.0).alias("y0"), F.when(F.col("path").endswith("c.pdf"), 2.0).otherwise(5.0).alias("y1"))

    def late(f):
        return good(f).withColumn("ord", F.raise_error(F.lit("broken reader")).cast("int"))

    def early(f):
        return f.select("no_such_column")

    got = files.detect(found, {"good": good, "late": late, "early": early})
    assert sorted((r["x0"], r["x1"]) for r in got.where("error IS NULL").collect()) == [(1.0, 9.0)] * 2
    assert {r["detector"] for r in got.where("error IS NOT NULL").collect()} == {"late", "early"}
    assert files.successful(got).count() == 2


def test_metadata_store(spark, tmp_path):
    path = str(tmp_path / "store")
    assert files.read_reports(spark, path).count() == 0
    make = lambda n: spark.createDataFrame([(f"u{k}", "b", "s", "t", "d", f"p{k}", f"h{k % 2}", "now") for k in range(n)], files.REPORTS)
    files.write_reports(make(3), path)
    files.write_reports(files.read_reports(spark, path).unionAll(make(1)), path)  # the version that is read stays
    assert files.read_reports(spark, path).count() == 4
    for _ in range(3):
        files.write_reports(make(2), path)
    assert len(list((tmp_path / "store").iterdir())) == 2
    asked = spark.createDataFrame([("h0",), ("h1",), ("other",), (None,)], "h string")
    got = {r["h"]: (r["known"], r["report"] and r["report"]["pdf_url"]) for r in files.lookup(asked, "h", files.read_reports(spark, path), "file_hash").collect()}
    assert got == {"h0": (True, "u0"), "h1": (True, "u1"), "other": (False, None), None: (False, None)}
    newest = max((tmp_path / "store").iterdir())
    for f in newest.glob("*.json"):
        f.write_text("{not json")
    for f in newest.glob(".*.crc"):
        f.unlink()
    assert files.read_reports(spark, path).count() == 0
    saved = {r["pdf_url"]: r["batch"] for r in files.checkpoints(make(25), "pdf_url").collect()}
    assert Counter(saved.values()) == {0: 10, 1: 10, 2: 5}


def test_streams_go_on_from_what_is_stored(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, o long").write.parquet(str(source))
    read = lambda: spark.readStream.schema("k long, v string, o long").parquet(str(source))
    streams.upsert_into(read(), f"{tmp_path}/t", "k", "o", f"{tmp_path}/c").awaitTermination()
    spark.createDataFrame([(1, "z", 2), (3, "c", 2)], "k long, v string, o long").write.mode("append").parquet(str(source))
    streams.upsert_into(read(), f"{tmp_path}/t", "k", "o", f"{tmp_path}/c").awaitTermination()
    assert sorted(tuple(r) for r in streams.stored(spark, f"{tmp_path}/t", "k", "o").collect()) == [(1, "z", 2), (2, "b", 1), (3, "c", 2)]
    # without its progress the stream starts at batch 0, and the table goes on all the same
    streams.upsert_into(read(), f"{tmp_path}/t", "k", "o", f"{tmp_path}/other").awaitTermination()
    assert sorted(tuple(r) for r in streams.stored(spark, f"{tmp_path}/t", "k", "o").collect()) == [(1, "z", 2), (2, "b", 1), (3, "c", 2)]


def test_stream_of_near_duplicates(spark, tmp_path):
    rng = random.Random(6)
    base = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)) for _ in range(4)]
    batches = [[(10, base[0]), (11, base[1]), (12, base[0])], [(3, base[1]), (4, base[2]), (5, base[2] + " more")], [(20, base[3]), (21, None)]]
    source, held = tmp_path / "in", {}
    for b in batches:
        spark.createDataFrame(b, "doc_id long, text string").write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("doc_id long, text string").parquet(str(source))
        streams.keep_distinct(stream, f"{tmp_path}/t", f"{tmp_path}/c", "text", lambda c: X.word_shingles(c, 3), threshold=0.7).awaitTermination()
        # one folder a batch, the others stay as they are
        now = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
        assert len(list((tmp_path / "t").iterdir())) == batches.index(b) + 1 and all(now[k] == v for k, v in held.items())
        held = now
    assert sorted(r["id"] for r in streams.stored(spark, f"{tmp_path}/t").collect()) == [4, 10, 11, 20, 21]


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_of_near_duplicates_equal_the_loop(spark, tmp_path, seed):
    """Chains of similar texts in random order, copies, ids that come again; decided one after the other."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for _ in range(6):
        w = [word() for _ in range(60)]
        for _ in range(rng.randint(2, 9)):
            texts.append(" ".join(w))
            w[rng.randrange(60)] = word()
            w[rng.randrange(60)] = rng.choice([word(), w[0]])
    texts += texts[::4] + ["", None, "one two"]
    rng.shuffle(texts)
    ids = rng.sample(range(1000), len(texts))
    rows = list(zip(ids, texts)) + [(ids[0], "another text with an id that was there")]
    cuts = [0, len(rows) // 3, len(rows) // 2, len(rows)]
    sigs = {}
    for r in O.signatures(spark.createDataFrame([(i, t) for i, t in enumerate(t for _, t in rows)], "doc_id long, text string"), "text", lambda c: X.word_shingles(c, 3)).collect():
        sigs[r["id"]] = r["sig"]
    kept = []
    for a, b in zip(cuts, cuts[1:]):
        for n in sorted(range(a, b), key=lambda n: rows[n][0]):
            share = lambda o: sum(x == y for x, y in zip(sigs[n], sigs[o])) / 128  # noqa: B023, E731
            bucket = lambda o: any(sigs[n][k : k + 8] == sigs[o][k : k + 8] for k in range(0, 128, 8))  # noqa: B023, E731
            if rows[n][0] not in {rows[o][0] for o in kept} and not any(bucket(o) and share(o) >= 0.6 for o in kept):
                kept.append(n)
    source = tmp_path / "in"
    for a, b in zip(cuts, cuts[1:]):
        spark.createDataFrame(rows[a:b], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(source))
    streams.keep_distinct(stream, f"{tmp_path}/t", f"{tmp_path}/c", "text", lambda c: X.word_shingles(c, 3), threshold=0.6).awaitTermination()
    assert sorted(r["id"] for r in streams.stored(spark, f"{tmp_path}/t").collect()) == sorted(rows[n][0] for n in kept)


def test_text_that_was_passed_over_is_kept_once(spark, tmp_path):
    """A text comes first with an id that is kept already, then with new ids: one of these stays."""
    a, b = ("".join(random.Random(s).choice("abcdefgh ") for _ in range(400)) for s in (1, 2))
    source = tmp_path / "in"
    for rows in ([(5, a)], [(5, b)], [(9, b), (10, b)], [(11, b)]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(source))
    streams.keep_distinct(stream, f"{tmp_path}/t", f"{tmp_path}/c", "text", lambda c: X.word_shingles(c, 3), threshold=0.7).awaitTermination()
    assert sorted(r["id"] for r in streams.stored(spark, f"{tmp_path}/t").collect()) == [5, 9]


def test_stream_of_many_different_texts_ends_soon(spark, tmp_path):
    """Work for each bucket by itself took minutes here."""
    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30))) for i in range(4000)]
    source = tmp_path / "in"
    for some in (rows[:2000], rows[2000:]):
        spark.createDataFrame(some, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(source))
    began = time.time()
    query = streams.keep_distinct(stream, f"{tmp_path}/t", f"{tmp_path}/c", "text", lambda c: X.word_shingles(c, 3), threshold=0.7)
    ended = query.awaitTermination(90)
    query.stop()
    assert ended and time.time() - began < 90
    assert streams.stored(spark, f"{tmp_path}/t").count() == 4000


def arriving(spark, path, batches, schema):
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_windows_are_counted_over_batches_and_late_rows_go(spark, tmp_path):
    batches = [[("2024-01-01 10:10:00", "a"), ("2024-01-01 10:50:00", "a")], [("2024-01-01 10:59:00", "a"), ("2024-01-01 14:00:00", "b")], [("2024-01-01 14:10:00", "b")], [("2024-01-01 10:20:00", "a"), ("2024-01-01 14:30:00", "b"), (None, "a")]]
    counts = streams.windowed_counts(arriving(spark, tmp_path / "in", batches, "ts string, g string"), "ts", "g")
    got = {(str(r["window_start"])[11:13], r["g"]): r["cnt"] for r in streams.drain(counts, "counts", ["window_start", "g"]).collect()}
    # the watermark after the second batch (13:00) has passed the window of 10 o'clock when the fourth one's row comes
    assert got == {("10", "a"): 3, ("14", "b"): 3}


def test_first_seen_with_a_watermark(spark, tmp_path):
    batches = [[("2024-01-01 10:00:00", "a"), ("2024-01-01 10:00:00", "a")], [("2024-01-01 10:30:00", "a"), ("2024-01-01 20:00:00", "b")], [("2024-01-01 20:05:00", "b")], [("2024-01-01 20:10:00", "a"), ("2024-01-01 20:20:00", "b"), ("2024-01-01 09:00:00", "c")]]
    seen = streams.first_seen(arriving(spark, tmp_path / "in", batches, "ts string, g string"), ["g"], "ts")
    # the second a was forgotten by then, c is too late
    assert sorted((r["g"], str(r["ts"])[11:16]) for r in streams.drain(seen, "seen").collect()) == [("a", "10:00"), ("a", "20:10"), ("b", "20:00")]


def test_pages_without_items_and_numbers_out_of_range(spark):
    pages = spark.createDataFrame([("f", 1, None, None), ("f", 2, 300.0, 400.0)], "file string, page int, width double, height double")
    box = "file string, page int, ord int, x0 double, y0 double, x1 double, y1 double"
    tables = spark.createDataFrame([("f", 2, 0, 100.0, 100.0, 0.0, 0.0)], box)
    images = spark.createDataFrame([("f", 9, 0, 1.0, 1.0, 2.0, 2.0)], box)
    blocks = spark.createDataFrame([("f", 2, 1, 10.0, 30.0, 20.0, 10.0, "b1", "in", None), ("f", 2, 0, 90.0, 90.0, 190.0, 190.0, "b0", "out", "title")], box + ", id string, text string, label string")
    got = D.assemble_pages(pages, tables, blocks, images)
    rows = {r["page"]: r for r in got.collect()}
    assert (rows[1]["width"], rows[1]["height"], rows[1]["text_blocks"], rows[1]["images"]) == (612.0, 792.0, [], [])
    assert [(b["text"], b["label"], b["in_table"], b["x0"], b["y0"]) for b in rows[2]["text_blocks"]] == [("out", "title", False, 90.0, 90.0), ("in", "text", True, 10.0, 10.0)]
    assert D.analyze_page(got, "f", 2).count() == 1
    with pytest.raises(ValueError):
        D.analyze_page(got, "f", 3)
    with pytest.raises(ValueError):
        D.on_pages(tables, [2, 3], pages)
    stats = D.file_statistics(D.document_info(got), tables).first()
    assert (stats["page_count"], stats["text_blocks"], stats["images"], stats["tables"]) == (2, 2, 0, 1)
    art = {r["page"]: r["raster"] for r in D.page_raster(blocks.withColumn("kind", F.lit("text")).unionByName(tables.withColumn("kind", F.lit("table")), allowMissingColumns=True), pages.fillna(1.0), 3, 4).collect()}
    assert art == {1: "   \n   \n   \n   ", 2: "   \n   \n.. \n## "}


def test_detection_results(spark):
    o = spark.createDataFrame([("a", 3, None), ("b", 2, "x" * 40), ("c", 1, None)], "file string, pages int, error string")
    t = spark.createDataFrame([("a", 1, 0, "red", 0.9), ("a", 2, 1, "blue", 0.5), ("a", 2, 2, "red", 0.4)], "file string, page int, ord int, category string, confidence double")
    got = {(r["kind"], r["file"]): (r["pages"], r["tables"], r["categories"]) for r in D.detection_summary(o, t).collect()}
    assert got == {("file", "a"): (3, 3, "red:2, blue:1"), ("error", "b"): (None, None, "Error: " + "x" * 30 + "..."), ("file", "c"): (1, 0, "-"), ("total", None): (4, 3, "")}
    shots = spark.createDataFrame([("a", 1, "a1.png")], "file string, page int, image string")
    js = {r["file"]: r["json"] for r in D.result_json(o, t, shots).collect()}
    assert '"page_results":[{"page":1,"image":"a1.png"}]' in js["a"] and "error" not in js["a"] and "page_results" not in js["c"] and '"error":"' in js["b"]


def test_text_of_the_page_and_order_of_tables(spark):
    rows = [(1, 1, 0.0, 0.0, 9.0, 9.0, None, None), (1, 2, 50.0, 0.0, 60.0, 9.0, "", None), (2, 1, 0.0, 0.0, 9.0, 9.0, "자본금 1 유동부채 2 부채총계 3 4 5", None), (3, 1, 0.0, 0.0, 9.0, 9.0, "FCF CAPEX 1", "failed")]
    c = spark.createDataFrame(rows, "page int, ord int, x0 double, y0 double, x1 double, y1 double, text_content string, error string")
    texts = spark.createDataFrame([(1, "FCF 1 CAPEX 2 3 4")], "page int, page_text string")
    got = L.financial_tables(c, ["page"], "ord", texts).collect()
    assert [(r["page"], r["ord"], r["category"]) for r in got] == [(2, 1, "balance_sheet"), (1, 1, "cash_flow"), (1, 2, "cash_flow")]


def test_unknown_labels_and_filters(spark, monkeypatch):
    f = spark.createDataFrame([("i", "oak"), ("i", "elm"), ("j", "elm"), ("k", None)], "image_id string, label string")
    assert [tuple(r) for r in labelstudio.unknown_labels(f, ["oak", "ash"]).collect()] == [("elm", 2)]
    items = spark.createDataFrame([("a",), ("b",), ("b",)], "x string")
    counts = O.counting_bloom(items, spark.createDataFrame([("b",), ("nowhere",)], "x string"), "x", 10_007, 4)
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "x string")
    assert {r["item"]: r["maybe"] for r in O.counting_contains(asked, "x", counts, 10_007, 4).collect()} == {"a": True, "b": True, "c": False}
    some = spark.range(300).select(F.concat(F.lit("item"), F.col("id").cast("string")).alias("x"))
    bloom = O.bloom_build(some, "x", 70_001, 5)
    probes = spark.range(250, 400).select(F.concat(F.lit("item"), F.col("id").cast("string")).alias("x"))
    whole = {r["x"]: r["maybe"] for r in O.bloom_contains(probes, "x", bloom, 70_001, 5).collect()}
    monkeypatch.setattr(O, "BROADCAST_BITS", 1)  # in pieces
    assert whole == {r["x"]: r["maybe"] for r in O.bloom_contains(probes, "x", bloom, 70_001, 5).collect()}
    assert all(whole[f"item{k}"] for k in range(250, 300)) and sum(whole.values()) < 60
    stats = spark.createDataFrame([(0.1,), (0.11,)], "estimated_fpr double")
    assert [r["ok"] for r in O.has_capacity(stats).collect()] == [True, False]


def test_chunks_of_one_sequence(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 1.0]), 1.0, rng.choice([0.0, 3.0])], 1) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, v array<double>, p int").repartition(5)
    whole = {r["id"]: r["chunk"] for r in L.semantic_chunks(df, "id", "v", None, 0.6).collect()}
    assert whole == {r["id"]: r["chunk"] for r in L.semantic_chunks(df, "id", "v", "p", 0.6).collect()} and len(set(whole.values())) > 5


def test_annotations_labels_and_pages_without_tables(spark):
    task = '[{"data": {"image": "p/7.png"}, "annotations": [{"result": [{"type": "rectanglelabels", "value": {"x": 5, "y": 6, "width": 7, "height": 8, "rectanglelabels": ["chart"]}}, {"type": "rectanglelabels", "value": {"x": 5, "y": 6, "width": -7, "height": 8}}]}]}]'
    read = labelstudio.read_tasks(spark.createDataFrame([(task,)], "value string"))
    got = labelstudio.detections(read, "annotations").collect()
    assert [(r["image_id"], r["det_idx"], r["source"], r["label"], r["width"]) for r in got] == [("p/7.png", 0, "ground_truth", "chart", 7.0)]
    with pytest.raises(Exception, match="negative size"):
        labelstudio.detections(read, "annotations", strict=True).collect()
    pages = spark.createDataFrame([("d/1.png",), ("d/2.png",)], "image string")
    boxes = spark.createDataFrame([("d/2.png", 1, "t", 1.0, 2.0, 3.0, 4.0)], "image string, ord int, label string, x double, y double, width double, height double")
    tasks = {r["image"]: r["task"] for r in labelstudio.export_tasks(pages, boxes, "own").collect()}
    assert tasks["d/1.png"] == '{"data":{"image":"/data/local-files/?d=own/1.png"}}' and '"rectanglelabels":["t"]' in tasks["d/2.png"]


def test_small_functions(spark):
    urls = spark.createDataFrame([("WWW.Oak.org/a//",), ("http://www.oak.org",), ("wwwoak.org/",)], "u string")
    assert [r[0] for r in urls.select(X.normalize_url(F.col("u"), www=True)).collect()] == ["oak.org/a", "http://www.oak.org", "wwwoak.org"]
    boxes = spark.createDataFrame([(0.0, 0.0, 50.0, 50.0, 3, 2), (0.0, 0.0, 50.0, 50.0, 2, 2), (0.0, 0.0, 50.0, 50.0, 3, 1), (0.0, 0.0, 20.0, 20.0, 3, 2), (0.0, 0.0, 100.0, 96.0, 3, 2)], "x0 double, y0 double, x1 double, y1 double, r int, c int")
    assert [r[0] for r in boxes.select(G.valid_table_size(G.corners(), F.lit(100.0), F.lit(100.0), F.col("r"), F.col("c"))).collect()] == [True, False, False, False, False]
    sigs = spark.createDataFrame([([1, 2], [1, 2, 3])], "a array<long>, b array<long>")
    with pytest.raises(Exception, match="different lengths"):
        sigs.select(H.similarity(F.col("a"), F.col("b"), 2)).collect()


def test_bpe_counts_stay_right_from_merge_to_merge(spark, monkeypatch):
    """Ties beyond the head, words beside the entries, repeated and null rows, merges that make a symbol that exists already."""
    monkeypatch.setattr(O._PairIndex, "HEAD", 3)
    monkeypatch.setattr(O._PairIndex, "INLINE", 6)
    rng = random.Random(4)
    cut = [" ".join(rng.choice(["a", "b", "c", "ab", "bc", "</w>"]) for _ in range(rng.randrange(1, 12))) for _ in range(14)]
    rows = [(k, c) for k, c in enumerate(cut)] + [(13, cut[13]), (20, None), (21, "")]
    got, words = O.train_bpe(O.symbol_table(spark.createDataFrame(rows, "id int, symbols string"), "id"), 9)
    assert got == learned([(c.split(), 1) for c in [*cut, cut[13]]], 9)
    last = {r["word"]: r["symbols"] for r in words.collect()}
    for c in cut:
        symbols = c.split()
        for left, right, _ in got:
            out = []
            for x in symbols:
                if out and not out[-1][1] and (out[-1][0], x) == (left, right):
                    out[-1] = (left + right, True)
                else:
                    out.append((x, False))
            symbols = [x for x, _ in out]
        assert last[c] == symbols
    assert last[None] is None and last[""] == []
    none = O.train_bpe(O.word_table(spark.createDataFrame([(1, None), (2, "a b")], "id int, text string"), "id"), 3)
    assert none[0] == [] and none[1].count() == 2


def test_queries_without_sql(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r["lrs"] for r in catalog.QUERIES["longest_repeat_of_documents"](spark, sf).collect()}
    for r in docs.collect():
        s = got[r["doc_id"]]
        at = r["text"].find(s)
        assert at >= 0 and r["text"].find(s, at + 1) >= 0
    assert len(got) == docs.count()
    merges = [(r["l"], r["r"], r["cnt"]) for r in catalog.QUERIES["bpe_train"](spark, sf).orderBy("step").collect()]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect()
    n = Counter(w for r in bench for w in r["text"].split())
    assert merges == learned([([*w, "</w>"], f) for w, f in n.items()], 10)
    assert catalog.QUERIES["bpe_train_documents"](spark, sf).count() == 10
    parts = [r["p_name"].split(" ")[0] for r in spark.read.parquet(f"{sf}/part.parquet").orderBy("p_partkey").collect()]
    spaced = [(r["l"], r["r"], r["cnt"]) for r in catalog.QUERIES["bpe_pretokenized"](spark, sf).orderBy("step").collect()]
    assert spaced == learned([([*p, "_"], 1) for p in parts], 10)
    study = {r["num_perm"]: r["mean_error"] for r in catalog.QUERIES["minhash_accuracy"](spark, sf).collect()}
    assert study[64] < study[16] < 0.1
