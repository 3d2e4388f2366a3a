"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of lower-cased letters with word bounds, weighted by 1 + log(tf) times the inverse document
frequency over all learning documents, and scaled to length one.  The weights come from follow-the-regularised-leader
(proximal, per-coordinate rates) with an elastic net; a temperature fitted on rows kept out of that training calibrates
the probabilities.

Bounded parameter: ``rows``, the number of labelled rows that fit the weights and the temperature (all languages share it
equally; rows that repeat count once).  Document frequencies cover every learning document, and whole texts count everywhere.

``accept`` doesn't rest on the learned classes alone: a text is strange if the mean inverse document frequency of its n-grams is
well above what learning texts have, which holds for other languages and for letters without language.

Defined results: null, empty and letterless texts give ``und`` with score 0; so does every text if nothing was learned.
Rows with null lang teach nothing.  Equal probabilities go to the language that sorts first.  An empty table gives no rows; of the
input's columns only ``lang_pred`` and ``score`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm import textops as X
from gleaner.llm.bpe import LETTER, code_classes

BUCKETS = 1 << 14
UNKNOWN = "und"
#: A text is strange beyond so many times the highest mean frequency weight of learning texts (without one in a thousand of them) ...
STRANGE = 1.2
#: ... if it has so many n-grams.
LEAST_GRAMS = 12


@lru_cache(1)
def folded() -> np.ndarray:
    """Lower-case letter of each code point, 0 for what is not a letter."""
    kinds = code_classes()
    out = np.zeros(len(kinds), np.uint32)
    letters = np.flatnonzero(kinds == LETTER)
    out[letters] = letters
    for cp in letters[letters < 0x20000].tolist():
        low = chr(cp).lower()
        if len(low) == 1:
            out[cp] = ord(low)
    return out


def letters_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all characters and each document's offset among them."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    cp = data[lead].astype(np.int64)
    for at in (np.flatnonzero(cp >= 0xC0),):
        b0, pos = cp[at], lead[at]
        size = 2 + (b0 >= 0xE0) + (b0 >= 0xF0)
        value = np.where(size == 2, b0 & 31, np.where(size == 3, b0 & 15, b0 & 7))
        for k in (1, 2, 3):
            on = size > k
            value[on] = (value[on] << 6) | (data[pos[on] + k] & 63)
        cp[at] = value
    return folded()[cp], np.searchsorted(lead, offsets)


def grams(chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams that begin at each character, -1 where there is none: three arrays, n = 1, 2, 3.

    A run of characters that are no letters counts as one bound; n-grams hold one bound at most, at an end.
    """
    c = chars.astype(np.uint32)
    n = len(c)
    gap = c == 0
    last = np.zeros(n, bool)
    last[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    nxt = np.append(c[1:], np.uint32(0))
    nxt[last] = 0
    nx2 = np.append(nxt[1:], np.uint32(0))
    nx2[last] = 0

    def bucket(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        return ((h ^ (h >> np.uint32(13))) & np.uint32(BUCKETS - 1)).astype(np.int32)

    one = bucket(c * np.uint32(0x9E3779B1) + np.uint32(7))
    two = bucket(c * np.uint32(0x85EBCA6B) + nxt * np.uint32(0xC2B2AE35) + np.uint32(77))
    three = bucket(c * np.uint32(0x27D4EB2F) + nxt * np.uint32(0x165667B1) + nx2 * np.uint32(0x9E3779B1) + np.uint32(777))
    one[gap] = -1
    two[gap & (nxt == 0)] = -1
    three[(nxt == 0) | (gap & (nx2 == 0))] = -1
    return one, two, three


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each document the buckets that occur, and their counts (none if the text has no letter)."""
    chars, at = letters_of(data, offsets)
    if not len(chars):
        yield from ((np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in offsets[1:])
        return
    one, two, three = (g + 1 for g in grams(chars, at))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        count = np.bincount(one[a:b], minlength=BUCKETS + 1)
        if count[0] < b - a:
            count += np.bincount(two[a:b], minlength=BUCKETS + 1) + np.bincount(three[a:b], minlength=BUCKETS + 1)
            count[0] = 0
            where = np.flatnonzero(count)
            yield where - 1, count[where]
        else:
            yield np.zeros(0, np.int64), np.zeros(0, np.int64)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    strange: float = float("inf")

    def is_strange(self, where: np.ndarray, count: np.ndarray) -> bool:
        return bool(count.sum() >= LEAST_GRAMS) and mean_weight(self.idf, where, count) > self.strange

    def vector(self, where: np.ndarray, count: np.ndarray) -> np.ndarray:
        x = (1 + np.log(count)) * self.idf[where]
        return x / max(np.sqrt(x @ x), 1e-12)

    def probabilities(self, where: np.ndarray, count: np.ndarray) -> np.ndarray:
        z = (self.vector(where, count) @ self.weights[where] + self.bias) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()


def mean_weight(idf: np.ndarray, where: np.ndarray, count: np.ndarray) -> float:
    return float((count * idf[where]).sum() / max(count.sum(), 1))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(BUCKETS + 1, np.int64)
    for batch in X.slices(batches, "text"):
        for where, _ in features(*X.string_bytes(batch.column("text"))):
            seen[where] += 1
            seen[BUCKETS] += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["bucket", "n"])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in X.slices(batches, "text"):
        found = list(features(*X.string_bytes(batch.column("text"))))
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("rank"), pa.array([w.astype("<u2").tobytes() for w, _ in found], pa.binary()), pa.array([np.minimum(c, 2**31 - 1).astype("<i4").tobytes() for _, c in found], pa.binary())], ["lang", "rank", "buckets", "counts"])


def fit(learn: DataFrame, rows: int = 4000, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> Model:
    """``learn``: doc_id, text, lang of the documents to learn from."""
    learn = learn.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in learn.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    each = max(1, rows // len(languages))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, int(min(1.0, each / sizes[k]) * (1 << 62)))])
    rank = F.xxhash64("doc_id", "text", F.lit(7)).bitwiseAND(F.lit((1 << 62) - 1))
    sample = learn.where(rank <= share[F.col("lang")]).select("lang", "text", rank.alias("rank")).dropDuplicates(["lang", "rank"])
    counts = learn.select("text").transform(X.arrow, _frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(BUCKETS + 1)
    for b, n in counts:
        df[b] = n
    idf = np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1
    got = sorted((r["rank"], r["lang"], bytes(r["buckets"]), bytes(r["counts"])) for r in sample.transform(X.arrow, _examples, "lang string, rank long, buckets binary, counts binary").collect())
    model = Model(languages, idf, np.zeros((BUCKETS, len(languages))), np.zeros(len(languages)), 1.0)
    data = [(model.vector(w, c), w, languages.index(k)) for _, k, w, c in ((r, k, np.frombuffer(w, "<u2").astype(np.int64), np.frombuffer(c, "<i4").astype(float)) for r, k, w, c in got) if len(w)]
    weights = [mean_weight(idf, np.frombuffer(w, "<u2").astype(np.int64), np.frombuffer(c, "<i4").astype(float)) for _, _, w, c in got if len(w)]
    model.strange = STRANGE * float(np.quantile(weights, 0.999)) if weights else float("inf")
    aside, train = data[::5], [x for i, x in enumerate(data) if i % 5] or data
    _ftrl(model, train, epochs, alpha, beta, l1, l2)
    model.temperature = _temperature(model, aside)
    return model


def _ftrl(model: Model, train: list, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> None:
    k = len(model.languages)
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) > l1, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(train)):
            x, where, y = train[i]
            at, x = np.append(where, BUCKETS), np.append(x, 1.0)
            w = weights(at)
            p = x @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y] -= 1
            g = np.outer(x, p)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    model.weights, model.bias = w[:BUCKETS], w[BUCKETS]


def _temperature(model: Model, aside: list) -> float:
    if not aside or len(model.languages) < 2:
        return 1.0
    logits = np.array([x @ model.weights[w] + model.bias for x, w, _ in aside])
    y = np.array([k for _, _, k in aside])

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean()) + 1e-4 * np.log(t) ** 2

    return float(min(np.exp(np.linspace(-4, 3, 141)), key=loss))


def predict(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (calibrated probability); drops the text if it isn't to be kept."""
    docs = docs.drop("lang_pred", "score")
    kept = [f for f in docs.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches, text):
            names, scores = [], []
            for where, count in features(*X.string_bytes(batch.column(text))):
                if len(where) and model.languages:
                    p = model.probabilities(where, count)
                    best = int(p.argmax())
                    names.append(model.languages[best])
                    scores.append(float(p[best]))
                else:
                    names.append(UNKNOWN)
                    scores.append(0.0)
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [f.name for f in schema.fields])

    return docs.transform(X.arrow, run, schema)


def accept(docs: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """The documents that aren't strange and whose language is known with a probability of ``least`` or more, unchanged."""

    def known(w: np.ndarray, c: np.ndarray) -> bool:
        return len(w) > 0 and bool(model.languages) and not model.is_strange(w, c) and float(model.probabilities(w, c).max()) >= least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches, text):
            keep = [known(w, c) for w, c in features(*X.string_bytes(batch.column(text)))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.transform(X.arrow, run, docs.schema)


def learning_rows(docs: DataFrame) -> DataFrame:
    return docs.where(X.remainder(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang")


def report(docs: DataFrame) -> DataFrame:
    model = fit(learning_rows(docs))
    held_out = X.remainder(F.col("doc_id"), 4) == 2
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model, keep_text=False)
