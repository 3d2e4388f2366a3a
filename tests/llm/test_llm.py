"""Operators of the training-data subpackage against brute force, round trips and held-out accuracy."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("gleaner.llm")
import public_tokenizers as P  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from gleaner.llm import bpe, decontaminate, jaccard, langid, language_model, licenses, neighbours, quality, suffix_dedup, toxicity  # noqa: E402
from gleaner.llm import textops as X  # noqa: E402
from gleaner.llm.queries import VOCABULARY  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, part int"


def some_texts():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(1, 7))).strip() or "x" for _ in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 220))) for _ in range(25)]
    texts = list(base)
    for b in base[:8]:
        texts.append(b)
        w = b.split(" ")
        w[len(w) // 2] = "edited"
        texts.append(" ".join(w))
    passage = " ".join(rng.choice(words) for _ in range(120))
    texts += [f"{base[k]}\n{passage} {k}" for k in (3, 5, 9)]
    return [*texts, None, "", " ", "one two", "one two", "ab " * 900, "x" * 3000, "日本語 テスト  　it's WE'RE ÉÀ 12³"]


def documents(spark, texts=None):
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or ""), "clash", 1) for i, t in enumerate(some_texts() if texts is None else texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def test_bpe_equals_the_library(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    odd = ["".join(rng.choice(["a", "b", "'", "s", "t", "re", "ll", " ", "\n", "\t", "é", "日", "1", "!", " ", "😀"]) for _ in range(rng.randint(0, 50))) for _ in range(400)]
    texts = some_texts() + odd
    for r, t in zip(bpe.decode(bpe.encode(documents(spark, texts), VOCABULARY), VOCABULARY).orderBy("doc_id").collect(), texts):
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert ids == enc.encode_ordinary(t or "")
        assert bytes(r["decoded"]) == (t or "").encode()
        assert r["n_tokens"] == len(ids) and (not ids or np.frombuffer(bytes(r["ends"]), "<u4")[-1] == len((t or "").encode()))


def test_jaccard_components(spark):
    texts = some_texts()
    sets = []
    for t in texts:
        w = words_of(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    got = {r[0]: (r[1], r[2]) for r in jaccard.clusters(documents(spark, texts)).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}
    assert jaccard.clusters(documents(spark, [])).count() == 0


def test_signature_tree_finds_what_all_pairs_find():
    rng = np.random.default_rng(4)
    base = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(400) < rng.uniform(0.6, 1)], rng.integers(0, 2**63, rng.integers(1, 60)).astype(np.uint64)])) for _ in range(60)]
    forest = jaccard.SignatureTree(sets).components()
    model = jaccard.Forest(60)
    for i in range(60):
        for j in range(i):
            if jaccard.linked(sets[i], sets[j]):
                model.join(i, j)
    assert [forest.find(i) for i in range(60)] == [model.find(i) for i in range(60)]


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(12)
    short = " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60))  # under 400 bytes
    line = " ".join(str(rng.randrange(9)) for _ in range(30))
    texts = [*some_texts(), f"one {short} x", f"{short.replace(' ', '  ')}\ttwo", f"{short[:101]}! three", f"{short[:99]} four", f"{line}\n" * 4, f"{line} {line} " + short[4:], ""]
    raw = [(t or "").encode() for t in texts]
    n = Counter(b[s : s + 400] for b in raw for s in range(len(b) - 399))
    got = {r["doc_id"]: r for r in suffix_dedup.report(documents(spark, texts)).collect()}
    for i, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 399):
            if n[b[s : s + 400]] > 1:
                gone[s : s + 400] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    # passages: windows of 51 words that also stand in another document
    owners = {}
    tokens = [re.findall(r"[^\x20\x09-\x0d]+", t or "") for t in texts]
    for i, w in enumerate(tokens):
        for k in range(len(w) - 50):
            owners.setdefault(tuple(w[k : k + 51]), set()).add(i)
    for i, w in enumerate(tokens):
        inside = np.zeros(len(w), bool)
        for k in range(len(w) - 50):
            if len(owners[tuple(w[k : k + 51])]) > 1:
                inside[k : k + 51] = True
        want = int((np.diff(np.append(0, inside.astype(int))) == 1).sum())
        assert (got[i]["n_passages"], got[i]["repeats"]) == (want, want > 0)


def test_cover_sample_sorts_windows():
    rng = np.random.default_rng(1)
    base = rng.integers(97, 100, 3000).astype(np.uint8)
    parts = []
    for _ in range(30):
        a, size = rng.integers(0, 2000), rng.integers(420, 900)
        p = base[a : a + size].copy()
        if rng.random() < 0.6:
            p[rng.integers(0, len(p))] = 65
        parts.append(p)
    text = np.concatenate(parts)
    at = np.cumsum([0] + [len(p) for p in parts])
    starts = np.concatenate([np.arange(a, a + len(p) - 399) for a, p in zip(at, parts)])
    n = Counter(text[s : s + 400].tobytes() for s in starts)
    assert suffix_dedup.repeated_windows(text, starts).tolist() == [n[text[s : s + 400].tobytes()] > 1 for s in starts]


def test_language_model(spark):
    texts = some_texts()
    rows = {r["doc_id"]: r for r in language_model.report(documents(spark, texts)).collect()}
    tokens = [[*words_of(t), None] for t in texts]
    c = Counter(w for i, t in enumerate(tokens) if zlib.crc32(str(i).encode()) % 5 != 1 for w in t)
    total, distinct = sum(c.values()), len(c)
    for i, t in enumerate(tokens):
        r = rows[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t))
        assert r["score"] < 0
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_seats_lie_between_one_and_all():
    rng = np.random.default_rng(0)
    n = rng.integers(0, 5000, 2000)
    t = language_model.seat(n, np.full(2000, 3.0), 0.75, rng.integers(0, 2**63, 2000).astype(np.uint64))
    assert ((t >= np.minimum(n, 1)) & (t <= n)).all()


def test_nearest(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((400, 16))
    v[7] = v[50]
    v[9] = 2 * v[100]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(401, None), (402, [0.0] * 16), (450, [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = np.array(v, np.float32).astype(float)
    got = neighbours.report(df).toPandas()
    hit = 0
    for q in range(0, 400, 50):
        cos = v @ v[q] / np.sqrt((v**2).sum(1) * (v[q] ** 2).sum())
        cos[q] = -2
        want = np.argsort(-cos)[:5]
        mine = got[got.query_id == q].sort_values("rank")
        hit += len(set(want) & set(mine.vec_id))
        assert np.allclose(mine.score, cos[mine.vec_id])
    assert hit >= 0.9 * 40 and set(got.query_id) == set(range(0, 400, 50))
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert neighbours.report(few).count() == 2


def test_licenses_and_decontamination(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    changed = passage.replace("epsilon", "other").replace("nu xi", "nu changed")
    texts = ["text before. Released under the MIT License. after", "LICENSED under the apache license version 2.0", f"start {passage} end", f"start {changed.upper()} end", "alpha beta gamma delta only", None, ""]
    d = documents(spark, texts)
    assert {(r["doc_id"], r["license"]) for r in licenses.scan(d).collect()} == {(0, "MIT-notice"), (1, "Apache-2.0-notice")}
    r = licenses.scan(d).where("doc_id = 0").first()
    assert texts[0][r["start"] : r["end"]] == "Released under the MIT License"
    b = spark.createDataFrame([(1, passage), (2, "short"), (3, None)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find(d, b).collect()} == {(2, 1), (3, 1)}
    assert {r["doc_id"] for r in decontaminate.clean(d, b).collect()} == {0, 1, 4, 5, 6}
    assert decontaminate.find(d, b.limit(0)).count() == 0


def test_language_id(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = langid.report(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95
    model = langid.Model(["en"], np.ones(langid.BUCKETS), np.ones((langid.BUCKETS, 1)), np.zeros(1), 1.0)
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(documents(spark, [None, "", "12 !!", "word"]), model).collect()}
    assert odd == {0: ("und", 0.0), 1: ("und", 0.0), 2: ("und", 0.0), 3: ("en", 1.0)}


def test_quality_and_toxicity(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    for op, label in ((quality, "quality"), (toxicity, "toxic")):
        got = op.report(d, labels).join(labels, "doc_id").where("held_out").toPandas()
        y, rank, n1 = got[label], got.score.rank(), (got[label] == 1).sum()
        auc = (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(got) - n1))
        assert auc > 0.85, (label, auc)
    assert op.report(documents(spark), labels.limit(0)).where("score > 0").count() == 0


def test_chain_marginals_match_enumeration():
    import itertools

    rng = np.random.default_rng(3)
    e, chain, first = rng.standard_normal(40), rng.standard_normal((2, 2)), rng.standard_normal(2)
    opens = np.zeros(40, bool)
    opens[[0, 9, 10, 18, 26, 34]] = True
    got = toxicity.chain_marginals(e, opens, chain, first)
    cuts = [*np.flatnonzero(opens), 40]
    for a, b in zip(cuts, cuts[1:]):
        total, ones = 0.0, np.zeros(b - a)
        for y in itertools.product((0, 1), repeat=int(b - a)):
            w = math.exp(first[y[0]] + sum(e[a + k] * v for k, v in enumerate(y)) + sum(chain[y[k], y[k + 1]] for k in range(len(y) - 1)))
            total += w
            ones += w * np.array(y)
        assert np.allclose(got[a:b], ones / total)


def sequences(e, chain, first):
    """Probability of each labelling of one short sequence."""
    import itertools

    weight = {y: math.exp(first[y[0]] + sum(a * b for a, b in zip(e, y)) + sum(chain[i, j] for i, j in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=len(e))}
    return {y: w / sum(weight.values()) for y, w in weight.items()}


def test_pairs_and_document_labels_match_enumeration():
    rng = np.random.default_rng(5)
    sizes, owner = [4, 3, 5, 2], np.repeat([0, 1, 0, 1], [4, 3, 5, 2])
    begin = np.append(0, np.cumsum(sizes))[:-1]
    opens = np.zeros(14, bool)
    opens[begin] = True
    inner = np.flatnonzero(~opens)
    for strength in (0.1, 1.0, 4.0):  # odds ratios on both sides of 1
        for chain in (np.array([[strength, 0.2], [0, strength]]), np.array([[0, strength], [strength, 0.3]])):
            e, first = rng.standard_normal(14) * 2, rng.standard_normal(2)
            p = toxicity.chain_marginals(e, opens, chain, first)
            pairs = toxicity.pair_marginals(p[inner - 1], p[inner], chain)
            each = [sequences(e[b : b + n], chain, first) for b, n in zip(begin, sizes)]
            want = [[sum(w for y, w in s.items() if (y[k], y[k + 1]) == ij) for ij in ((0, 0), (0, 1), (1, 0), (1, 1))] for s in each for k in range(len(next(iter(s))) - 1)]
            assert np.allclose(pairs.T, want, atol=1e-9)
            none = toxicity.none_toxic(p, pairs, begin, inner, owner)
            logs = [math.log(s[(0,) * n]) for s, n in zip(each, sizes)]
            assert np.allclose(none, [logs[0] + logs[2], logs[1] + logs[3]])

            def loss(e):
                q = [math.prod(sequences(e[b : b + n], chain, first)[(0,) * n] for b, n, own in zip(begin, sizes, (0, 1, 0, 1)) if own == d) for d in (0, 1)]
                return [-math.log((1 - toxicity.NOISE) * (1 - x) + toxicity.NOISE * x) for x in q]

            got = toxicity.document_weights(none)[owner] * p
            for t in range(14):
                step = np.eye(14)[t] * 1e-5
                assert abs((sum(loss(e + step)) - sum(loss(e - step))) / 2e-5 - got[t]) < 1e-5


def test_balanced_layer_is_stationary():
    rng = np.random.default_rng(6)
    x = np.column_stack([np.ones(300), rng.standard_normal((300, 2))])
    y = (x[:, 1] + rng.standard_normal(300) > 1.2).astype(float)
    w = toxicity.balanced_logistic(x, y)
    each = np.where(y == 1, 150 / y.sum(), 150 / (300 - y.sum()))
    slope = x.T @ (each * (1 / (1 + np.exp(-x @ w)) - y)) + 5e-5 * 300 * np.array([0, 1, 1]) * w
    assert np.abs(slope).max() < 1e-6


def test_toxic_documents_and_spans(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.report(d, labels).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").toPandas()
    assert got.predicted[got.toxic == 1].mean() >= 0.85 and got.predicted[got.toxic == 0].mean() <= 0.02
    rng = np.random.default_rng(8)
    model = toxicity.Model(*(rng.standard_normal(toxicity.BUCKETS) for _ in range(3)), -0.5, rng.standard_normal((2, 2)), rng.standard_normal(2), np.array([-1.0, 0.5, 0.2, 0.1]), 1)
    texts = [None, "", "..", "one", "Ünder the sea, don't go there again", "a b c d e f g h", "a a a a a"]
    for r in toxicity.tag(documents(spark, texts), model).collect():
        raw = (r["text"] or "").encode()
        at = [m.span() for m in re.finditer(rb"[A-Za-z\x80-\xff']+", raw)]
        if not at:
            assert r["spans"] == []
            continue
        h = toxicity.tokens(*X.string_bytes(pa.array([r["text"]])))[0]
        before, after = np.append(X.U64(1), h[:-1]), np.append(h[1:], X.U64(1))
        e = model.word[toxicity.buckets(h)] + model.before[toxicity.buckets(before)] + model.after[toxicity.buckets(after)] + model.bias
        p = [sum(w for y, w in sequences(e, model.chain, model.first).items() if y[k]) for k in range(len(at))]
        spans, k = [], 0
        while k < len(p):
            j = k
            while j < len(p) and p[j] >= toxicity.SPAN_FROM:
                j += 1
            if j > k:
                spans.append((at[k][0], at[j - 1][1], max(p[k:j])))
            k = max(j, k + 1)
        assert [(s["start"], s["end"]) for s in r["spans"]] == [s[:2] for s in spans]
        assert np.allclose([s["probability"] for s in r["spans"]], [s[2] for s in spans])


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    got = corpus_pipeline.run(spark, sf)
    rows = got.toPandas()
    assert 0 < len(rows) <= n and rows.doc_id.is_unique
    first = corpus_pipeline.identify_language(spark, documents(spark), sf)
    assert first.columns == documents(spark).columns
    cut = corpus_pipeline.cut_repeats(spark, documents(spark), sf)
    assert cut.schema.names == documents(spark).schema.names and cut.count() == documents(spark).count()
    assert {r["doc_id"] for r in cut.where("text IS NULL").collect()} == {r["doc_id"] for r in documents(spark).where("text IS NULL").collect()}


def test_slices_keep_every_row():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * k for k in range(200)] + [None]})
    assert sum(b.num_rows for b in X.slices(iter([batch]), "text", 500)) == 201
    assert F is not None


def test_rare_contexts_have_their_own_restaurants(spark, monkeypatch):
    pairs = [f"before{k} after{k}" for k in range(40)]
    learn = [f"{p} . {p} . {p}" for p in pairs for _ in range(3)]
    asked = [*pairs, *(f"before{k} after{(k + 7) % 40}" for k in range(40))]
    docs = documents(spark, learn + asked).withColumn("learn", F.col("doc_id") < len(learn))
    scores = []
    for most in (1, 65_000):
        monkeypatch.setattr(language_model, "CONTEXTS", most)
        got = language_model.score(docs, F.col("learn")).toPandas().sort_values("doc_id")
        scores.append(got.score.to_numpy()[len(learn) :])
        assert (scores[-1][:40] > scores[-1][40:] + 1).all()  # seen pairs against others of the same words
    assert np.allclose(scores[0], scores[1], rtol=1e-9)  # where the counts lie doesn't matter
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:  # nor does the number of partitions
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        other = language_model.score(docs.repartition(3), F.col("learn")).toPandas().sort_values("doc_id")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert np.allclose(other.score.to_numpy()[len(learn) :], scores[1], rtol=1e-9)


def test_language_model_keeps_extreme_and_missing_ids(spark):
    rows = [(-(2**63) + 1, "a b"), (-(2**63), "a"), (2**63 - 1, None), (None, "a b c")]
    got = language_model.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in got) == sorted((i is None, i or 0, len((t or "").split()) + 1) for i, t in rows)
    assert language_model.report(documents(spark, [])).count() == 0


def test_poisson_draws_have_the_right_mean_and_variance():
    key = np.random.default_rng(5).integers(0, 2**63, 40_000).astype(np.uint64)
    for mean in (0.3, 4.0, 100.0):
        got = language_model._poisson(np.full(len(key), mean), key, 50)
        assert abs(got.mean() - mean) < 0.05 * mean and abs(got.var() - mean) < 0.07 * mean


def test_repeated_notices_are_all_found(spark):
    line = "Licensed under CC BY-NC 4.0.\n"
    texts = [line * 9, f"one {line}" * 5 + "Released under the MIT License. " * 4, f"{line} a b c d e f g h i j k l m n {line}"]
    got = licenses.scan(documents(spark, texts)).collect()
    for i, t in enumerate(texts):
        for name, notice in (("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0"), ("MIT-notice", "Released under the MIT License")):
            want = [(m.start(), m.end()) for m in re.finditer(re.escape(notice), t)]
            assert sorted((r["start"], r["end"]) for r in got if (r["doc_id"], r["license"]) == (i, name)) == want


def test_pipeline_keeps_one_row_of_repeated_ids_and_missing_ids(spark):
    import corpus_pipeline

    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(150)) for _ in range(5)]
    rows = [(1, texts[0])] * 3 + [(None, texts[1])] * 3 + [(7, texts[2]), (5, texts[2]), (None, texts[2]), (5, texts[3]), (9, texts[3])] + [(None, texts[4])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "clash", 1) for i, t in rows], SCHEMA).withColumnRenamed("score", "Row")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(3), "")
    assert kept.columns == docs.columns
    want = {(1, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (None, texts[4])}
    assert kept.count() == 5 and {(r["doc_id"], r["text"]) for r in kept.collect()} == want
    assert {(r["doc_id"], r["text"]) for r in corpus_pipeline.cut_repeats(spark, kept.withColumnRenamed("Row", "score"), "").collect()} == want


def test_strange_texts_are_rejected_and_known_ones_stay(spark):
    import corpus_pipeline

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(1)
    strange = ["Это предложение написано на русском языке", "日本語の文章はここでは認識されません。", "Ten tekst jest napisany w języku polskim i powinien zostać odrzucony", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300)), "123 !!", "", None]
    odd = spark.createDataFrame([(10**9 + i, t, None, "s", 1) for i, t in enumerate(strange)], d.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, d.unionByName(odd), "").select("doc_id").collect()}
    known = [r["doc_id"] for r in d.where("lang IS NOT NULL AND text RLIKE '\\\\p{L}'").select("doc_id").collect()]
    assert not {k for k in kept if k >= 10**9} and len(set(known) - kept) <= 0.001 * len(known)


def test_repeated_ids_dont_unbound_the_samples(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    many = d.unionByName(d).unionByName(d)
    assert len(quality._statistics_of(many, labels.select("doc_id"))) == labels.join(d, "doc_id").select("doc_id").distinct().count()
    assert np.allclose(langid.fit(langid.learning_rows(many)).bias, langid.fit(langid.learning_rows(d)).bias, atol=0.5)
