"""Brute-force versions and odd inputs: empty tables, nulls, ties, repeated rows, long texts, clashing names."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("gleaner.llm")
from pyspark.sql import functions as F  # noqa: E402

from gleaner.llm import bpe, decontaminate, jaccard, langid, language_model, licenses, neighbours, quality, suffix_dedup, toxicity  # noqa: E402
from gleaner.llm import textops as X  # noqa: E402
from gleaner.llm.queries import VOCABULARY  # noqa: E402

#: Extra columns are named like columns that operators add.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, d int, item_id string, start double, part int"


def documents(spark, rows):
    full = [(i, t, "en" if n % 2 else None, "s", len(t or ""), "x", 1, "y", 0.5, 2) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def labels_of(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def plain_words(t):
    """Lower-cased runs of letters and digits."""
    return [w.lower() for w in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", t or "")]


OPERATORS = {
    "op1": lambda s, d: licenses.scan(d),
    "op2": lambda s, d: quality.report(d, labels_of(s)),
    "op4": lambda s, d: suffix_dedup.report(d),
    "op5": lambda s, d: bpe.digests(d, VOCABULARY),
    "op6": lambda s, d: decontaminate.find(d, s.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string")),
    "op7": lambda s, d: langid.report(d),
    "op8": lambda s, d: jaccard.clusters(d),
    "op9": lambda s, d: language_model.report(d),
    "op10": lambda s, d: toxicity.report(d, labels_of(s)),
}
COLUMNS = {
    "op1": ["doc_id", "license", "matched", "coverage", "start", "end"],
    "op2": ["doc_id", "held_out", "score", "predicted"],
    "op4": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "repeats"],
    "op5": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op6": ["doc_id", "item_id", "n_overlaps", "first_word", "n_words", "matches", "coverage", "start", "end"],
    "op7": ["doc_id", "held_out", "lang_pred", "score"],
    "op8": ["doc_id", "n_shingles", "component_id"],
    "op9": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op10": ["doc_id", "held_out", "score", "predicted", "n_spans"],
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables_nulls_and_repeated_rows(spark, name):
    run = OPERATORS[name]
    assert run(spark, documents(spark, [])).count() == 0
    rows = [(5, None), (5, None), (None, ""), (7, "same words here again"), (7, "same words here again"), (None, "same words here again"), (8, "\n \t")]
    got = run(spark, documents(spark, rows))
    assert got.columns == COLUMNS[name]
    if name not in ("op1", "op6"):
        out = got.collect()
        key = lambda i: (i is None, i or 0)
        assert sorted((r["doc_id"] for r in out), key=key) == sorted((i for i, _ in rows), key=key)
        rest = [c for c in got.columns if c not in ("doc_id", "held_out", "component_id")]
        assert len({tuple(r[c] for c in rest) for r in out if r["doc_id"] == 7}) == 1  # repeated rows tie


def test_empty_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, score int")
    assert neighbours.report(none).count() == 0
    tied = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, 1.0], 1, 2) for i in range(60)] + [(50, None, 1, 2), (None, [1.0, 1.0], 1, 2)], "vec_id long, embedding array<float>, label int, score int")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in neighbours.report(tied).collect()}
    assert [got[0, k][0] for k in range(1, 6)] == [2, 4, 6, 8, 10] and {q for q, _ in got} == {0, 50}


def test_stages_keep_empty_tables_and_columns(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, documents(spark, []), sf)
        assert got.count() == 0
        if name != "byte_bpe":
            assert got.columns == documents(spark, []).columns
    rng = random.Random(4)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200))
    rows = [(None, long), (3, long[:-7]), (3, "short text of its own"), (3, "short text of its own"), (None, None), (9, "")]
    docs = documents(spark, rows)
    near = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert sorted(r["text"] or "" for r in near.collect()) == sorted(["", "", "short text of its own", long[:-7]])
    clean = corpus_pipeline.drop_benchmark_leaks(spark, docs, sf)
    assert clean.count() == len(rows) and clean.columns == docs.columns
    tokens = corpus_pipeline.tokenize(spark, docs, sf).collect()
    assert sorted(r["text"] for r in tokens) == sorted(t or "" for _, t in rows)


def test_a_text_longer_than_a_slice(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    text = " ".join(rng.choice(words) for _ in range(360_000))
    assert len(text) > 2 * X.SLICE_BYTES
    passage = " ".join(words[:80])
    text = f"{text} {passage} Released under the MIT License. {text[:3000]}"
    docs = documents(spark, [(1, text), (2, passage), (3, "word")])
    assert {(r["doc_id"], r["license"]) for r in licenses.scan(docs).collect()} == {(1, "MIT-notice")}
    got = {r["doc_id"]: r for r in suffix_dedup.report(docs).collect()}
    assert got[1]["n_removed"] >= len(passage) + 2 * 2990 and got[2]["n_removed"] == len(passage) and got[2]["repeats"] and got[1]["repeats"]
    shingles = {tuple(w) for w in (lambda ws: (ws[k : k + 5] for k in range(len(ws) - 4)))(text.lower().split())}
    assert {r["doc_id"]: r["n_shingles"] for r in jaccard.clusters(docs).collect()}[1] == len(shingles)
    import hashlib

    assert {r["doc_id"]: r["decoded_sha256"] for r in bpe.digests(docs, VOCABULARY).collect()}[1] == hashlib.sha256(text.encode()).hexdigest()
    items = spark.createDataFrame([(4, passage)], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.find(docs, items).collect()} == {1, 2}
    assert {r["doc_id"]: r["n_tokens"] for r in language_model.report(docs).collect()}[1] == len(text.split()) + 1


def smith_waterman(a, b):
    """Matched words of the best local alignment, over the whole table."""
    best, rows = (0, 0), [(0, 0)] * (len(b) + 1)
    for x in a:
        new = [(0, 0)]
        for j, y in enumerate(b):
            s, m = rows[j]
            cell = (s + licenses.MATCH, m + 1) if x == y else (s + licenses.MISMATCH, m)
            cell = max(cell, (rows[j + 1][0] + licenses.GAP, rows[j + 1][1]), (new[j][0] + licenses.GAP, new[j][1]), key=lambda c: c[0])
            new.append(cell if cell[0] > 0 else (0, 0))
            best = max(best, new[-1], key=lambda c: c[0])
        rows = new
    return best[1]


def test_licenses_equal_whole_alignments(spark):
    rng = random.Random(5)
    names = sorted(licenses.TEMPLATES)
    filler = ["lorem", "ipsum", "dolor", "amet", "elit", "sed"]
    texts = []
    for n in range(60):
        words = re.findall(r"\S+", licenses.TEMPLATES[rng.choice(names)])
        for _ in range(rng.randrange(0, 1 + len(words) // 6)):
            k = rng.randrange(len(words))
            words[k : k + 1] = rng.choice([[], [rng.choice(filler)], [words[k], rng.choice(filler)]])
        if n % 5 == 0:
            words = words[: len(words) // 3]
        texts.append(" ".join([*rng.choices(filler, k=rng.randrange(9)), *words, *rng.choices(filler, k=4)]))
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(documents(spark, list(enumerate(texts)))).collect()}
    want = set()
    for i, t in enumerate(texts):
        for name in names:
            a = plain_words(licenses.TEMPLATES[name])
            m = smith_waterman(a, plain_words(t))
            if m >= max(licenses.LEAST_WORDS, licenses.LEAST_COVERAGE * len(a)) or m >= licenses.LONG_MATCH:
                want.add((i, name))
    assert got <= want and len(got) >= 0.97 * len(want)  # a fingerprint of three words must survive


def test_license_blocks_give_the_same_rows(spark, monkeypatch):
    docs = documents(spark, [(i, f"x {t} y") for i, t in enumerate(licenses.TEMPLATES.values())])
    rows = lambda: sorted(tuple(r) for r in licenses.scan(docs).collect())
    whole = rows()
    monkeypatch.setattr(licenses, "MOST_WORDS", 40)
    assert len(licenses.blocks(licenses.TEMPLATES, 40)) > 5 and rows() == whole and len(whole) >= len(licenses.TEMPLATES)


def diagonal_overlaps(item, doc):
    """Best run of each diagonal that a seed hits, by comparing words one by one."""
    found = []
    for shift in range(-len(item) + 1, len(doc)):
        at = [k for k in range(len(item)) if 0 <= k + shift < len(doc)]
        same = {k: item[k] == doc[k + shift] for k in at}
        if not any(all(same.get(k + m, False) for m in mask) and k + mask[-1] in same for mask in decontaminate.MASKS for k in at):
            continue
        best = (0, 0)
        run = [(1 if same[k] else decontaminate.MISMATCH, same[k]) for k in at]
        for stop in range(len(run)):  # the first end and the shortest run of ties
            total = matches = 0
            for g, s in run[stop::-1]:
                total, matches = total + g, matches + s
                best = max(best, (total, matches), key=lambda x: x[0])
        if best[1] >= min(decontaminate.LEAST_MATCHES, math.ceil(decontaminate.LEAST_SHARE * len(item))):
            found.append(best[1])
    return found


@pytest.mark.parametrize("most", [1_000_000, 60])
def test_overlaps_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", most)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    items = [" ".join(rng.choices(words, k=rng.choice([4, 6, 9, 25, 40]))) for _ in range(12)]
    texts = []
    for _ in range(25):
        own = rng.choice(items).split()
        for _ in range(rng.randrange(0, 5)):
            own[rng.randrange(len(own))] = rng.choice(words).upper()
        texts.append(" ".join([*rng.choices(words, k=rng.randrange(12)), *own, *rng.choices(words, k=rng.randrange(12))]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = documents(spark, list(enumerate(texts)))
    got = {(r["doc_id"], r["item_id"]): (r["n_overlaps"], r["matches"]) for r in decontaminate.find(docs, bench).collect()}
    want = {}
    for i, t in enumerate(texts):
        for j, b in enumerate(items):
            if len(b.split()) >= decontaminate.LEAST_ITEM and (found := diagonal_overlaps(plain_words(b), plain_words(t))):
                want[i, j] = len(found), max(found)
    assert got == want and len(want) > 10
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == set(range(len(texts))) - {i for i, _ in want}


def test_language_features_equal_a_loop():
    rng = random.Random(9)
    texts = ["", "12 !!", "É", "aß Ça va?", *("".join(rng.choice("abcdé ñ1.") for _ in range(rng.randrange(60))) for _ in range(50))]
    import pyarrow as pa

    data, off = X.string_bytes(pa.array(texts, pa.large_string()))

    def bucket(h):
        h %= 1 << 32
        h = (h ^ (h >> 15)) * 0x2C1B3C6D % (1 << 32)
        return (h ^ (h >> 13)) & (langid.BUCKETS - 1)

    for t, (where, count) in zip(texts, langid.features(data, off)):
        c = [ord(x.lower()) if x.isalpha() and len(x.lower()) == 1 else 0 for x in t]
        want = Counter()
        for i, x in enumerate(c):
            y, z = (c[i + 1] if i + 1 < len(c) else 0), (c[i + 2] if i + 2 < len(c) else 0)
            if x:
                want[bucket(x * 0x9E3779B1 + 7)] += 1
            if x or y:
                want[bucket(x * 0x85EBCA6B + y * 0xC2B2AE35 + 77)] += 1
            if y and (x or z):
                want[bucket(x * 0x27D4EB2F + y * 0x165667B1 + z * 0x9E3779B1 + 777)] += 1
        assert dict(zip(where.tolist(), count.tolist())) == (dict(want) if any(c) else {})


def test_scores_equal_the_formula_where_seats_are_certain(spark):
    """One learning text without a repeated word: every customer has its own table, so nothing is drawn."""
    M = language_model
    learn, asked = "alpha beta gamma delta", ["alpha beta", "beta alpha unseen", "", "gamma delta"]
    docs = documents(spark, [(0, learn), *enumerate(asked, 1)])
    got = {r["doc_id"]: r["score"] for r in M.score(docs, F.col("doc_id") == 0).collect()}
    words = [*learn.split(), "END"]
    types = list(zip(["BEGIN", *words], words))
    tables, after = Counter(c for c, _ in types), Counter(c for c, _ in types)
    customers = Counter(w for _, w in types)
    distinct, mass = len(words), sum(customers.values())
    base = lambda w: (customers[w] - M.D0 * (w in customers) + (M.S0 + M.D0 * distinct) / (distinct + 1)) / (M.S0 + mass)

    def p(c, w):
        if not after[c]:
            return base(w)
        seen = (c, w) in types
        return (seen - M.D1 * seen + (M.S1 + M.D1 * tables[c]) * base(w)) / (M.S1 + after[c])

    for i, t in enumerate([learn, *asked]):
        w = [*t.split(), "END"]
        assert got[i] == pytest.approx(sum(math.log10(p(c, x)) for c, x in zip(["BEGIN", *w], w)))
    total = sum(p("alpha", w) for w in words) + p("alpha", "unseen")
    assert total == pytest.approx(1)  # known words and one unknown


def test_quality_scores_depend_on_the_text_alone(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    one = {r["doc_id"]: r["score"] for r in quality.report(d, labels).collect()}
    other = {r["doc_id"]: r["score"] for r in quality.report(d.drop("source", "lang").repartition(7).withColumn("score", F.lit("x")), labels).collect()}
    assert one == pytest.approx(other) and all(zlib.crc32(b"1") >= 0 and 0 <= s <= 1 for s in one.values())


def test_names_of_colliding_sets():
    c1, c2 = np.array([1, 1, 2], np.uint64), np.array([7, 8, 9], np.uint64)
    assert jaccard.named(c1, c2, np.array([1], np.uint64)).tolist() == [7, 8, 2]
    assert jaccard.named(c1, c2, np.zeros(0, np.uint64)).tolist() == [1, 1, 2]


def test_components_in_a_crowd(spark):
    """Shingles that more than ``CROWD`` sets have link them as stars."""
    rng = random.Random(14)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    texts = []
    for _ in range(3 * jaccard.CROWD):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(base[:30] + [f"y{rng.randrange(10**6)}" for _ in range(30)]) for _ in range(60)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.clusters(documents(spark, list(enumerate(texts)))).collect()} == {i: find(i) for i in range(len(texts))}
