"""Toxicity: a linear-chain conditional random field tags toxic spans; its marginals give document scores.

Tokens are words of letters, ASCII lower-cased.  The two-state chain has hashed features of the word and its two neighbours
and is fitted by exact likelihood (forward-backward) on windows of tokens around all evidence, and one at a fixed place of each
document; it tags whole documents.  Tokens have no labels of their own.  A word is evidence of toxicity if the distinct contexts
(neighbours) in which it stands are mostly in toxic documents, so that copies of one document count once.  All tokens of a
clean document are labelled 0, evidence included, so that the words around it can decide; evidence in a toxic document is
labelled 1.  A toxic document without evidence only says that at least one of its tokens is 1, unless its label is wrong
(chance ``NOISE``); its gradient comes from the probability that all are 0.  A logistic layer on the marginals (probability
of no toxic token, expected number, expected share of the text) turns them into a document score; there both labels weigh the
same in total, however rare toxic documents are.

Bounded parameters: ``toxic_rows`` and ``clean_rows``, the labelled documents that fit the model (of rows that repeat an id one
counts).  Whole texts count everywhere.

Defined results: null and empty texts have no spans and get the score of no evidence; without toxic rows every score is 0.
Null labels and labels of absent documents teach nothing; a document labelled more than once is toxic if any label is 1.  Scores
depend on the text alone, so repeated rows tie; a probability of exactly ``SPAN_FROM`` belongs to a span.  An empty table gives no rows; of the
input's columns only ``score`` and ``spans`` are replaced.
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
from gleaner.operators.storage import written

BUCKETS = 1 << 16
LANES = 512
#: Marginal probability from which a token belongs to a reported span.
SPAN_FROM = 0.5
#: Chance that a document's label is wrong.
NOISE = 0.02
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(65, 91), *range(97, 123), *range(128, 256), 39]] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each token, and each document's first token."""
    s, e, at = X.runs(WORD_BYTE[data], offsets)
    return X.span_hashes(X.LOWER[data], s, e), s, e, at


def neighbours(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the token before and after, 1 at a document's bounds."""
    before, after = np.append(X.U64(1), h[:-1])[: len(h)], np.append(h[1:], X.U64(1))[: len(h)]
    has = at[:-1] < at[1:]
    before[at[:-1][has]] = 1
    after[at[1:][has] - 1] = 1
    return before, after


def buckets(h: np.ndarray) -> np.ndarray:
    return (h >> X.U64(48)).astype(np.int64)


@dataclass
class Model:
    word: np.ndarray  # log-odds that a token is toxic, by its bucket
    before: np.ndarray
    after: np.ndarray
    bias: float
    chain: np.ndarray  # log potentials from state to state
    first: np.ndarray  # of a document's first token
    layer: np.ndarray  # logistic weights of the document features
    lexicon: int = 0

    def describe(self) -> str:
        return f"{self.lexicon} words of evidence; bias {self.bias:.2f}; chain {self.chain.round(2).tolist()}; layer {self.layer.round(2).tolist()}"

    def marginals(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not len(h):
            return np.zeros(0)
        before, after = neighbours(h, at)
        e = self.word[buckets(h)] + self.before[buckets(before)] + self.after[buckets(after)] + self.bias
        opens = np.zeros(len(h), bool)
        opens[at[:-1][at[:-1] < at[1:]]] = True
        return chain_marginals(e, opens, self.chain, self.first)

    def document_features(self, p: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Per document: 1, minus the log-probability of no toxic token, their expected number, and their share, damped for short texts."""
        n, own = len(at) - 1, X.doc_of(at)
        strong = np.where(p > 0.05, p, 0.0)
        expected = np.bincount(own, strong, minlength=n)
        none = np.bincount(own, -np.log1p(-np.minimum(strong, 1 - 1e-6)), minlength=n)
        return np.column_stack([np.ones(n), np.minimum(none, 6.0), np.minimum(expected, 3.0), 100 * expected / (np.diff(at) + 100)])

    def scores(self, p: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not self.lexicon:
            return np.zeros(len(at) - 1)
        return 1 / (1 + np.exp(-np.clip(self.document_features(p, at) @ self.layer, -30, 30)))


def chain_marginals(e: np.ndarray, opens: np.ndarray, chain: np.ndarray, first: np.ndarray) -> np.ndarray:
    """P(state 1) of every token of one long sequence in which ``opens`` marks first tokens, by forward-backward.

    The sequence is cut into lanes of equal length.  Products of each lane's transition matrices, taken in lock step, carry
    the messages across lanes; two more passes in lock step give the messages inside.
    """
    n = len(e)
    lanes = min(LANES, max(1, n // 16))
    steps = -(-n // lanes)
    total = lanes * steps
    f = np.exp(np.clip(np.append(e, np.zeros(total - n)), -30, 30))
    o = np.append(opens, np.ones(total - n, bool))
    t, s = np.exp(chain), np.exp(first)
    # m[i][j]: from state i to state j, with the evidence of the token that is entered
    m00, m10 = np.where(o, s[0], t[0, 0]).reshape(lanes, steps).T, np.where(o, s[0], t[1, 0]).reshape(lanes, steps).T
    m01, m11 = (np.where(o, s[1], t[0, 1]) * f).reshape(lanes, steps).T, (np.where(o, s[1], t[1, 1]) * f).reshape(lanes, steps).T
    m00, m10, m01, m11 = (np.ascontiguousarray(x) for x in (m00, m10, m01, m11))
    a, b, c, d = np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)
    for k in range(steps):
        a, b, c, d = a * m00[k] + b * m10[k], a * m01[k] + b * m11[k], c * m00[k] + d * m10[k], c * m01[k] + d * m11[k]
        scale = a + b + c + d
        a, b, c, d = a / scale, b / scale, c / scale, d / scale
    into = np.empty((lanes, 2))
    x, y = 0.5, 0.5
    for i in range(lanes):
        into[i] = x, y
        x, y = x * a[i] + y * c[i], x * b[i] + y * d[i]
        x, y = x / (x + y), y / (x + y)
    out_of = np.empty((lanes, 2))
    x, y = 0.5, 0.5
    for i in range(lanes - 1, -1, -1):
        out_of[i] = x, y
        x, y = a[i] * x + b[i] * y, c[i] * x + d[i] * y
        x, y = x / (x + y), y / (x + y)
    forward = np.empty((steps, lanes))
    x, y = into[:, 0].copy(), into[:, 1].copy()
    for k in range(steps):
        x, y = x * m00[k] + y * m10[k], x * m01[k] + y * m11[k]
        z = x + y
        x, y = x / z, y / z
        forward[k] = y
    p = np.empty((steps, lanes))
    x, y = out_of[:, 0].copy(), out_of[:, 1].copy()
    for k in range(steps - 1, -1, -1):
        w1 = forward[k] * y
        p[k] = w1 / (w1 + (1 - forward[k]) * x)
        x, y = m00[k] * x + m01[k] * y, m10[k] * x + m11[k] * y
        z = x + y
        x, y = x / z, y / z
    return p.T.reshape(-1)[:n]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct word, context and label in a slice."""
    for batch in X.slices(batches, "text"):
        h, _, _, at = tokens(*X.string_bytes(batch.column("text")))
        before, after = neighbours(h, at)
        toxic = batch.column("y").to_numpy(zero_copy_only=False)[X.doc_of(at)].astype(np.int64)
        context = X.mix(before * X.U64(5) + after)
        key, one = np.unique(X.mix(h * X.U64(7) + context), return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(h[one].view(np.int64)), pa.array(context[one].view(np.int64)), pa.array(toxic[one])], ["word", "context", "toxic"])


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = 3000, clean_rows: int = 5000, least_contexts: int = 3) -> Model:
    """``labels``: doc_id and toxic of the rows to learn from."""
    zero = np.zeros(BUCKETS)
    model = Model(zero, zero.copy(), zero.copy(), -6.0, np.zeros((2, 2)), np.zeros(2), np.zeros(4))
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    ids = sampling.bounded(known.where("y = 1"), "doc_id", toxic_rows, 21).unionByName(sampling.bounded(known.where("y = 0"), "doc_id", clean_rows, 22))
    texts = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    texts, _ = written(texts, "labelled")
    evidence = texts.transform(X.arrow, _contexts, "word long, context long, toxic long").groupBy("word", "context").agg(F.max("toxic").alias("toxic"))
    # words with enough distinct contexts; their number is at most the sample's contexts over ``least_contexts``
    counts = evidence.groupBy("word").agg(F.sum("toxic").alias("bad"), F.count("*").alias("all"))
    totals = counts.agg(F.sum("bad"), F.sum("all")).first()
    if not totals[0]:
        return model
    share = totals[0] / totals[1]
    # one standard error below the share of toxic contexts (Wilson): enough to start from, the likelihood decides
    p, n = F.col("bad") / F.col("all"), F.col("all")
    low = (p + 1 / (2 * n) - F.sqrt((p * (1 - p) + 1 / (4 * n)) / n)) / (1 + 1 / n)
    seeds = counts.where((F.col("bad") >= least_contexts) & (low > 0.5 + 0.5 * share))
    lexicon = np.array([r[0] for r in seeds.select("word").collect()], np.int64).view(X.U64)
    model.lexicon = len(lexicon)
    if not len(lexicon):
        return model
    lexicon = np.sort(lexicon)
    got = sorted((r[0], r[1], bytes(r[2])) for r in texts.transform(X.arrow, _windows(lexicon), "doc_id long, y int, words binary").collect())
    _, owners = np.unique([g[0] for g in got], return_inverse=True)
    _likelihood(model, [np.frombuffer(w, X.U64) for _, _, w in got], owners, np.array([g[1] for g in got]), lexicon)
    _layer(model, texts)
    return model


def _windows(lexicon: np.ndarray, width: int = 24):
    """Windows of tokens around all evidence, overlapping ones put together, and one at a fixed place of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches, "text"):
            h, _, _, at = tokens(*X.string_bytes(batch.column("text")))
            toxic = batch.column("y").to_numpy(zero_copy_only=False)
            ids, ys, out = [], [], []
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                own = h[a:b]
                begin = np.unique(np.append(np.maximum(0, np.flatnonzero(np.isin(own, lexicon)) - width // 2), (b - a) // 2))
                head = np.flatnonzero(np.append(True, np.diff(begin) > width))
                stop = np.append(begin[head[1:] - 1], begin[-1]) + width
                for c, e in zip(begin[head].tolist(), stop.tolist()):
                    window = own[c:e]
                    if len(window) >= 2:
                        ids.append(int(batch.column("doc_id")[i].as_py()))
                        ys.append(int(toxic[i]))
                        out.append(window.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array(out, pa.binary())], ["doc_id", "y", "words"])

    return run


def _likelihood(model: Model, windows: list[np.ndarray], owners: np.ndarray, toxic: np.ndarray, lexicon: np.ndarray, steps: int = 120, rate: float = 0.3, l2: float = 1e-4) -> None:
    """Adam on the mean log-likelihood of the windows' token labels; from half of the steps on, toxic documents without evidence take part.

    ``owners`` numbers the document of each window from 0, ``toxic`` is that document's label.
    """
    h = np.concatenate(windows)
    sizes = [len(w) for w in windows]
    at = np.append(0, np.cumsum(sizes))
    owner = np.repeat(owners, sizes)
    bad = np.zeros(owners.max() + 1, bool)
    bad[owners] = toxic == 1
    y = (np.isin(h, lexicon) & bad[owner]).astype(float)
    before, after = (buckets(x) for x in neighbours(h, at))
    word = buckets(h)
    opens = np.zeros(len(h), bool)
    opens[at[:-1]] = True
    inner, begin = np.flatnonzero(~opens), at[:-1]
    unmarked = (bad & (np.bincount(owner, y) == 0))[owner]
    real, all_0 = pair_table(y[inner - 1], y[inner], y[inner - 1] * y[inner]), np.array([[1.0], [0], [0], [0]])
    parts = [model.word, model.before, model.after]
    state = [np.zeros((2, BUCKETS)) for _ in range(3)] + [np.zeros((2, 1)), np.zeros((2, 4)), np.zeros((2, 2))]
    seen = [np.bincount(i, minlength=BUCKETS) > 0 for i in (word, before, after)]
    scale = 1 / len(windows)
    for step in range(1, steps + 1):
        e = model.word[word] + model.before[before] + model.after[after] + model.bias
        p = chain_marginals(e, opens, model.chain, model.first)
        pairs = pair_marginals(p[inner - 1], p[inner], model.chain)
        g = p - y
        tables = pairs - real
        if step > steps // 2:
            weight = document_weights(none_toxic(p, pairs, begin, inner, owner))[owner]
            g = np.where(unmarked, weight * p, g)
            tables = np.where(unmarked[inner], weight[inner] * (pairs - all_0), tables)
        grads = [(np.bincount(i, g, minlength=BUCKETS) * scale + l2 * w) * on for i, w, on in zip((word, before, after), parts, seen)]
        grads.append(np.array([g.sum() * scale]))
        grads.append(tables.sum(1) * scale + l2 * model.chain.ravel())
        grads.append(np.array([-g[begin].sum(), g[begin].sum()]) * scale + l2 * model.first)
        moves = []
        for s, grad in zip(state, grads):
            s[0] = 0.9 * s[0] + 0.1 * grad
            s[1] = 0.99 * s[1] + 0.01 * grad**2
            moves.append(rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-6))
        for w, move in zip(parts, moves):
            w -= move
        model.bias -= float(moves[3][0])
        model.chain -= moves[4].reshape(2, 2)
        model.first -= moves[5]


def pair_table(a: np.ndarray, b: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Probabilities of 00, 01, 10 and 11 (rows) of neighbours that are 1 with ``a`` and ``b``, and together with ``both``."""
    return np.stack([1 - a - b + both, b - both, a - both, both])


def pair_marginals(a: np.ndarray, b: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """The pair table of neighbouring tokens from their single marginals.

    The messages from both sides multiply rows and columns of the potentials, so the table keeps the potentials' odds ratio;
    with the two margins that leaves one root of a quadratic equation.
    """
    ratio = np.exp(chain[0, 0] + chain[1, 1] - chain[0, 1] - chain[1, 0])
    x = 1 + (a + b) * (ratio - 1)
    root = np.sqrt(np.maximum(x * x - 4 * ratio * (ratio - 1) * a * b, 0))
    # x can only be negative if the ratio is below 1; the other form of the root has no cancellation there
    both = np.where(x > 0, 2 * ratio * a * b / np.maximum(x + root, 1e-300), (x - root) / (2 * min(ratio - 1, -1e-300)))
    return np.maximum(pair_table(a, b, np.minimum(both, np.minimum(a, b))), 0)


def none_toxic(p: np.ndarray, pairs: np.ndarray, begin: np.ndarray, inner: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Log-probability of each document that all tokens of its windows are 0."""
    least = 1e-12
    first = np.log1p(-np.minimum(p[begin], 1 - least))
    rest = np.log1p(-np.minimum(pairs[1] / np.maximum(pairs[0] + pairs[1], 1e-300), 1 - least))
    return np.bincount(owner[begin], first, minlength=owner.max() + 1) + np.bincount(owner[inner], rest, minlength=owner.max() + 1)


def document_weights(none: np.ndarray) -> np.ndarray:
    """The factor of each toxic document's expected features in the gradient of minus its label's log-likelihood.

    With q the probability that all tokens are 0, the label has (1 - NOISE) (1 - q) + NOISE q.  That depends on the parameters
    through log q alone, whose gradient is the features of the all-0 sequence less the expected ones.
    """
    q, some = np.exp(none), -np.expm1(none)
    return -(1 - 2 * NOISE) * q / ((1 - NOISE) * some + NOISE * q)


def _layer(model: Model, texts: DataFrame) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches, "text"):
            h, _, _, at = tokens(*X.string_bytes(batch.column("text")))
            x = model.document_features(model.marginals(h, at), at)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    got = sorted((r[0], r[1], tuple(r[2])) for r in texts.transform(X.arrow, run, "doc_id long, y int, x array<double>").collect())
    x, y = np.array([r[2] for r in got]), np.array([r[1] for r in got], float)
    model.layer = balanced_logistic(x, y)


def balanced_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 5e-5) -> np.ndarray:
    """Weights of a logistic regression in which both labels weigh the same in total; the first column is 1 and has no ridge."""
    share = np.maximum(np.bincount(y.astype(int), minlength=2), 1)
    each = len(y) / (2 * share[y.astype(int)])
    pull = ridge * len(y) * np.append(0, np.ones(x.shape[1] - 1))
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve(x.T @ (x * (each * p * (1 - p) + 1e-9)[:, None]) + np.diag(pull + 1e-9), x.T @ (each * (p - y)) + pull * w)
    return w


def tag(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds ``score`` and ``spans``: start, end (bytes of the text) and largest probability of each toxic span."""
    docs = docs.drop("score", "spans")
    kept = [f for f in docs.schema.fields if keep_text or f.name != text]
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("probability", T.DoubleType())])
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    arrow = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches, text):
            data, off = X.string_bytes(batch.column(text))
            h, s, e, at = tokens(data, off)
            p = model.marginals(h, at) if model.lexicon else np.zeros(len(h))
            hot = np.flatnonzero(p >= SPAN_FROM)
            doc = X.doc_of(at)[hot] if len(hot) else hot
            head = np.append(True, (np.diff(hot) > 1) | (np.diff(doc) > 0))[: len(hot)]
            begin = np.flatnonzero(head)
            stop = np.append(begin[1:], len(hot))[: len(begin)]
            own = doc[begin]
            best = np.maximum.reduceat(p[hot], begin) if len(begin) else np.zeros(0)
            flat = pa.StructArray.from_arrays([pa.array(s[hot[begin]] - off[own]), pa.array(e[hot[stop - 1]] - off[own]), pa.array(best)], fields=list(arrow))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(len(off))), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(model.scores(p, at)), lists], [f.name for f in schema.fields])

    return docs.transform(X.arrow, run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = X.remainder(F.col("doc_id"), 3) == 1
    model = fit(docs, labels.where(~held_out))
    got = tag(docs.select("doc_id", held_out.alias("held_out"), "text"), model, keep_text=False)
    return got.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))
