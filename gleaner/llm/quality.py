"""Quality classifier by positive-unlabelled learning.

A linear model over quantile bins of text statistics minimises the non-negative unbiased risk: trusted positives (label 1)
against unlabelled web text, with a class prior estimated from the data (ratio of unlabelled to positive mass above the
score threshold where its upper confidence bound is least).  Negative labels are never used.

Bounded parameters: ``positives`` and ``unlabelled``, the rows that fit the model.  Whole texts count, in learning and scoring.

Defined results: null and empty texts get the score of a text without words; without positives or unlabelled rows every score is 0.5.
Null labels and labels of absent documents teach nothing; a document labelled more than once counts as positive if any label is 1;
of rows that share an id the smallest text teaches, and every one is scored.  Scores depend on the text alone, so repeated rows tie;
a value on a bin's edge belongs to the bin above.  An empty table gives no rows; other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm import sampling
from gleaner.llm import textops as X

BINS = 12
_UPPER, _LOW, _DIGIT, _PUNCT, _SYMBOL, _HIGH, _LINE = range(7)


def _class_table() -> np.ndarray:
    out = np.full(256, 99, np.uint8)
    out[65:91], out[97:123], out[48:58], out[128:], out[10] = _UPPER, _LOW, _DIGIT, _HIGH, _LINE
    out[[ord(c) for c in ".,;:'\"-?!()"]] = _PUNCT
    out[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = _SYMBOL
    return out


CLASSES = _class_table()
NAMES = ["log_bytes", "log_words", "word_length", "upper", "lower", "digit", "punctuation", "symbol", "high", "lines", "distinct_words", "repeats_previous", "distinct_pairs", "no_letter_words", "first_upper", "mark_ends", "exclaims", "long_words", "top_share"]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of NAMES for each document."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    per = np.maximum(size, 1)[:, None]
    sums = np.zeros((len(data) + 1,), np.int64)
    shares = np.empty((n, 7))
    cls = CLASSES[data]
    for k in range(7):
        np.cumsum(cls == k, out=sums[1:])
        shares[:, k] = sums[offsets[1:]] - sums[offsets[:-1]]
    shares /= per
    s, e, at = X.words(data, offsets)
    doc = X.doc_of(at)
    count = np.diff(at)
    many = np.maximum(count, 1)
    h = X.span_hashes(X.LOWER[data], s, e)

    def total(x: np.ndarray) -> np.ndarray:
        c = np.append(0, np.cumsum(x, dtype=np.float64))
        return c[at[1:]] - c[at[:-1]]

    inner = doc[1:] == doc[:-1] if len(doc) else np.zeros(0, bool)
    again = np.append(False, (h[1:] == h[:-1]) & inner)[: len(h)]
    key = X.mix(h ^ (doc.astype(X.U64) * X.U64(0x9E3779B97F4A7C15)))
    order = np.argsort(key)
    sorted_key = key[order]
    head = np.append(True, sorted_key[1:] != sorted_key[:-1])[: len(key)]
    begin = np.flatnonzero(head)
    owner = doc[order[begin]]
    distinct = np.bincount(owner, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, owner, np.diff(np.append(begin, len(key))))
    # pairs are counted by document through their own key, which holds the document already
    pairs = X.mix(key[:-1] * X.U64(3) + key[1:])[inner] if len(key) > 1 else np.zeros(0, X.U64)
    if len(pairs):
        o = np.argsort(pairs)
        fresh = np.append(True, pairs[o][1:] != pairs[o][:-1])
        distinct_pairs = np.bincount(doc[1:][inner][o[fresh]], minlength=n)
    else:
        distinct_pairs = np.zeros(n)
    letter = (cls == _UPPER) | (cls == _LOW) | (cls == _HIGH)
    lc = np.append(0, np.cumsum(letter))
    letters = lc[e] - lc[s]
    length = e - s
    last = data[e - 1] if len(e) else data[:0]
    ends_mark = (CLASSES[last] == _PUNCT) | (CLASSES[last] == _SYMBOL)
    doubled = ends_mark & (length > 1) & (data[np.maximum(e - 2, 0)] == last) if len(e) else ends_mark
    return np.column_stack([np.log1p(size), np.log1p(count), total(length) / many, shares[:, [_UPPER, _LOW, _DIGIT, _PUNCT, _SYMBOL, _HIGH, _LINE]], distinct / many, total(again) / many, distinct_pairs / np.maximum(count - 1, 1), total(letters == 0) / many, total(cls[s] == _UPPER) / many if len(s) else np.zeros(n), total(ends_mark) / many, total(doubled) / many, total(length > 20) / many, top / many])


@dataclass
class Model:
    edges: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def design(self, x: np.ndarray) -> np.ndarray:
        """Indices of the bins, one column for each statistic."""
        return np.column_stack([np.searchsorted(self.edges[:, k], x[:, k], side="right") + k * (BINS + 1) for k in range(x.shape[1])]) if len(x) else np.zeros((0, x.shape[1]), int)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[self.design(x)].sum(1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in X.slices(batches, "text"):
        x = statistics(*X.string_bytes(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])


def _statistics_of(docs: DataFrame, ids: DataFrame) -> np.ndarray:
    """Statistics of the documents with these (few, bounded) ids, in order of the ids."""
    few = docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi")
    few = few.groupBy("doc_id").agg(F.min("text").alias("text"))  # of rows with the same id one counts
    got = sorted((r[0], tuple(r[1])) for r in few.transform(X.arrow, _rows, "doc_id long, x array<double>").collect())
    return np.array([x for _, x in got]).reshape(-1, len(NAMES))


def fit(docs: DataFrame, labels: DataFrame, positives: int = 4000, unlabelled: int = 8000) -> Model:
    """``labels``: doc_id and quality of the rows to learn from; only those with label 1 are used."""
    good = sampling.bounded(labels.where("quality = 1").select("doc_id").distinct(), "doc_id", positives, 11)
    some = docs.where("doc_id IS NOT NULL").select("doc_id").distinct()
    web = some.join(labels.where("quality IS NOT NULL").select("doc_id"), "doc_id", "left_anti")
    p, u = _statistics_of(docs, good), _statistics_of(docs, sampling.bounded(web, "doc_id", unlabelled, 12))
    if len(u) < 50:  # nearly everything is labelled
        u = _statistics_of(docs, sampling.bounded(some, "doc_id", unlabelled, 12))
    if not len(p) or not len(u):
        return Model(np.zeros((BINS, len(NAMES))), np.zeros((BINS + 1) * len(NAMES)), 0.0, 0.5)
    edges = np.quantile(np.concatenate([p, u]), np.linspace(0, 1, BINS + 2)[1:-1], axis=0)
    model = Model(edges, np.zeros((BINS + 1) * len(NAMES)), 0.0, 0.5)
    priors = []
    for k in (0, 1):  # the prior is read off rows that the scorer wasn't fitted on
        model.weights[:], model.bias = 0, 0.0
        _descend(model, p[k::2], u[k::2], 0.5, None, steps=150, l2=3e-3)
        priors.append(_prior(model.scores(p[1 - k :: 2]), model.scores(u[1 - k :: 2])))
    model.prior = float(np.mean(priors))
    model.weights[:], model.bias = 0, 0.0
    _descend(model, p, u, model.prior, True)
    return model


def _prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives among the unlabelled: least upper bound of the mass ratio above a threshold."""
    t = np.quantile(p, np.linspace(0.02, 0.75, 60))
    qp, qu = (p[None] >= t[:, None]).mean(1), (u[None] >= t[:, None]).mean(1)
    width = np.sqrt(np.log(100) / (2 * len(u))) + np.sqrt(np.log(100) / (2 * len(p)))
    best = ((qu + width) / np.maximum(qp, 1e-9)).argmin()
    return float(np.clip(qu[best] / max(qp[best], 1e-9), 0.05, 0.97))


def _descend(model: Model, p: np.ndarray, u: np.ndarray, prior: float, nonnegative: bool | None, steps: int = 400, rate: float = 0.05, l2: float = 3e-4) -> None:
    """Adam on the PU risk; with ``nonnegative`` None it only tells positives from unlabelled rows."""
    ip, iu = model.design(p), model.design(u)
    size = len(model.weights)
    m, v = np.zeros(size + 1), np.zeros(size + 1)

    def pull(index: np.ndarray, g: np.ndarray) -> np.ndarray:
        out = np.bincount(index.ravel(), np.repeat(g, index.shape[1]), minlength=size)
        return np.append(out, g.sum()) / len(g)

    for step in range(1, steps + 1):
        sp = 1 / (1 + np.exp(-np.clip(model.weights[ip].sum(1) + model.bias, -30, 30)))
        su = 1 / (1 + np.exp(-np.clip(model.weights[iu].sum(1) + model.bias, -30, 30)))
        if nonnegative is None:
            grad = pull(ip, sp - 1) + pull(iu, su)
        else:
            negative = -np.log(np.maximum(1 - su, 1e-12)).mean() + prior * np.log(np.maximum(1 - sp, 1e-12)).mean()
            grad = prior * pull(ip, sp - 1) + pull(iu, su) - prior * pull(ip, sp) if negative >= 0 else prior * pull(ip, sp) - pull(iu, su)
        grad[:size] += l2 * model.weights
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        model.weights -= move[:size]
        model.bias -= move[size]


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds ``score`` to the documents."""
    docs = docs.drop("score")
    kept = [f for f in docs.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches, text):
            got = model.scores(statistics(*X.string_bytes(batch.column(text))))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(got)], [f.name for f in schema.fields])

    return docs.transform(X.arrow, run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = X.remainder(F.col("doc_id"), 4) == 2
    model = fit(docs, labels.where(~held_out))
    got = score(docs.select("doc_id", held_out.alias("held_out"), "text"), model, keep_text=False)
    return got.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
