"""Language-model scoring with a hierarchical Pitman-Yor model of word pairs.

Three levels: a restaurant for every context (the preceding word), the restaurant of words that all contexts share as their parent, and a
uniform base over the known words and one unknown.  A context's customers are the tokens seen after it; every table of it sends a
customer to the parent.  Seatings are sampled by Gibbs sweeps over dish types: given the parent's probabilities and
the contexts' table counts of the sweep before, each (context, word) type seats its customers anew.  Predictive probabilities
are averaged over the last sweeps.  Random numbers come from a hash of the type, the sweep and the customer, so neither the number
of partitions nor the choice of frequent words changes a score by more than rounding.

The vocabulary is open-ended: every preceding word has its own restaurant, texts start in one more, and words are dealt out by hash.
What is known of the ``CONTEXTS`` most frequent words (as contexts and as words) are vectors of fixed size on the driver.  Entries with
a rarer word lie in that word's partition, those of a rarer context and a frequent word in the context's; the table counts of
rarer contexts go to the context's partition in every sweep, are added up there and come back as totals, packed.  Each document's
distinct (context, word) pairs travel once, packed, to where their counts are; partial sums come back.  That one shuffle serves all sweeps
and the scoring (an RDD keeps its shuffle files between jobs), and messages between partitions are dealt like it.

Defined results: null and empty texts are one end token; without learning rows all tokens are unknown (N = V = 0, each has
probability 1); repeated rows are learned from and scored as often as they occur; null ids stay null; an empty table gives no rows;
other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import exchange
from gleaner.llm import textops as X

#: So many words have their counts on the driver; those of all others are dealt out.
CONTEXTS = 65_000
#: Words and contexts under SLOTS are places of frequent words, others hashes.
SLOTS = 1 << 16
BEGIN = SLOTS - 1
END = X.U64(0x0E0D0F7E47)
#: Discount and strength of the context restaurants and of their parent.
D1, S1, D0, S0 = 0.75, 2.0, 0.4, 5.0
SWEEPS, AVERAGED = 3, 2
FLUSH = 1_000_000


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each document with an end token after them, and offsets."""
    data = X.LOWER[data]
    s, e, at = X.words(data, offsets)
    h = X.span_hashes(data, s, e)
    n = len(offsets) - 1
    to = at + np.arange(n + 1)
    out = np.full(len(h) + n, END, X.U64)
    inside = np.ones(len(out), bool)
    inside[to[1:] - 1] = False
    out[inside] = h
    return out, to


def _counts(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in X.slices(batches, "text"):
        h, _ = tokens(*X.string_bytes(batch.column("text")))
        held.append(np.unique(h, return_counts=True))
        n += len(held[-1][0])
        if n > FLUSH:
            yield from _cut_counts(held, bits)
            held, n = [], 0
    yield from _cut_counts(held, bits)


def _cut_counts(held: list, bits: int) -> Iterator[pa.RecordBatch]:
    if held:
        keys, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([c for _, c in held]), minlength=len(keys)).astype(np.int64)
        yield from exchange.cut(X.mix(keys), {"h": keys, "n": counts}, bits)


def _frequent(most: int):
    """Totals of a partition's words (kind 1), and its most frequent ones (kind 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = exchange.gather(batches, {"h": X.U64, "n": np.int64})
        h, back = np.unique(got["h"], return_inverse=True)
        n = np.bincount(back, got["n"], minlength=len(h)).astype(np.int64)
        top = np.lexsort((h, -n))[:most]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.zeros(len(top), np.int32), np.int32(1))), pa.array(np.append(h[top].view(np.int64), len(h))), pa.array(np.append(n[top], n.sum()))], ["kind", "h", "n"])

    return run


@dataclass
class Vocabulary:
    """The frequent words (sorted hashes) with their counts, and totals of all words."""

    hashes: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each word, -1 for words that are not frequent."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)


def vocabulary(learn: DataFrame) -> Vocabulary:
    parts, bits = X.shuffle_parts(learn.sparkSession), exchange.part_bits(learn.sparkSession)
    packed = learn.select("text").transform(X.arrow, lambda b: _counts(b, bits), "part int, h binary, n binary")
    rows = exchange.deal(packed).transform(X.arrow, _frequent(max(64, 2 * CONTEXTS // parts)), "kind int, h long, n long")
    got = rows.collect()
    totals = [(r["h"], r["n"]) for r in got if r["kind"] == 1]
    top = sorted(((r["n"], r["h"]) for r in got if r["kind"] == 0), reverse=True)[:CONTEXTS]
    hashes = np.array([h for _, h in top], np.int64).view(X.U64)
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], np.array([n for n, _ in top], np.int64)[order], sum(n for _, n in totals), sum(v for v, _ in totals))


def _deal_parts(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> X.U64(32)) * X.U64(parts)) >> X.U64(32)


def _emit(vocab: Vocabulary, parts: int):
    """Packed entries of all documents: frequent words after frequent ones by (context, word), others by their rarer word, and headers."""

    def close(held: list) -> Iterator[pa.RecordBatch]:
        h = np.concatenate([x[0] for x in held])
        sizes = np.concatenate([np.diff(x[1]) for x in held])
        rid = np.concatenate([x[2] for x in held])
        train = np.concatenate([x[3] for x in held])
        no_id = np.concatenate([x[5] for x in held])
        doc_id = np.concatenate([x[4] for x in held])
        at = np.append(0, np.cumsum(sizes))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        word = vocab.find(h)
        frequent = np.flatnonzero(word >= 0)
        # what is known of frequent words already
        base = np.bincount(doc[frequent], np.log10(vocab.counts[word[frequent]] + 0.5), minlength=len(sizes))
        known = np.bincount(doc[frequent], minlength=len(sizes))
        word = np.where(word >= 0, word.astype(X.U64), np.where(h < X.U64(SLOTS), h + X.U64(SLOTS), h))
        context = np.append(X.U64(BEGIN), word[:-1])
        context[at[:-1]] = X.U64(BEGIN)
        hot = (word < X.U64(SLOTS)) & (context < X.U64(SLOTS))
        pair = context[hot] << X.U64(16) | word[hot]
        key = (_deal_parts(X.mix(pair), parts) << X.U64(48)) | (pair << X.U64(16)) | doc[hot].astype(X.U64)
        key = np.sort(key)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        times = np.minimum(np.diff(np.append(first, len(key))), 2**31 - 1).astype(np.int32)
        key = key[first]
        hot_at = np.searchsorted(key >> X.U64(48), np.arange(parts + 1).astype(X.U64))
        cold = np.flatnonzero(~hot)
        to = _deal_parts(np.where(word[cold] < X.U64(SLOTS), context[cold], word[cold]), parts)
        order = np.lexsort((doc[cold], context[cold], word[cold], to))
        cold, to = cold[order], to[order]
        ch, cc, cd = word[cold], context[cold], doc[cold]
        first = np.flatnonzero(np.append(True, (ch[1:] != ch[:-1]) | (cc[1:] != cc[:-1]) | (cd[1:] != cd[:-1]))[: len(ch)])
        ct = np.diff(np.append(first, len(ch))).astype(np.int32)
        ch, cc, cd = ch[first], cc[first], cd[first]
        cold_at = np.searchsorted(to[first], np.arange(parts + 1).astype(X.U64))
        home = _deal_parts(X.mix(rid.view(X.U64)), parts).astype(np.int64)
        for p in range(parts):
            a, b, c, d = int(hot_at[p]), int(hot_at[p + 1]), int(cold_at[p]), int(cold_at[p + 1])
            mine = np.flatnonzero(home == p)
            if a == b and c == d and not len(mine):
                continue
            docs, local = np.unique(np.concatenate([(key[a:b] & X.U64(0xFFFF)).astype(np.int64), cd[c:d]]), return_inverse=True)
            local = local.astype(np.uint16)
            head = np.column_stack([rid[mine], doc_id[mine], train[mine] + 2 * no_id[mine], sizes[mine], known[mine]]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([v], pa.binary()) for v in (
                exchange.planes(((key[a:b] >> X.U64(16)) & X.U64(0xFFFFFFFF)).astype(np.uint32)), exchange.planes(ch[c:d]), exchange.planes(cc[c:d]),
                exchange.planes(local), exchange.planes(np.concatenate([times[a:b], ct[c:d]])), exchange.planes(np.column_stack([rid[docs], train[docs]]).astype(np.int64).reshape(-1)), exchange.planes(head.reshape(-1)), exchange.planes(base[mine])))], _COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, docs = [], 0, 0
        for batch in X.slices(batches, "text"):
            for small in (batch.slice(k, 30_000) for k in range(0, batch.num_rows, 30_000)):
                h, at = tokens(*X.string_bytes(small.column("text")))
                held.append((h, at, small.column("rid").to_numpy(), small.column("train").to_numpy(zero_copy_only=False).astype(np.int64), small.column("doc").fill_null(0).to_numpy(), np.asarray(small.column("doc").is_null()).astype(np.int64)))
                n, docs = n + len(h), docs + small.num_rows
                if n > FLUSH or docs > 30_000:
                    yield from close(held)
                    held, n, docs = [], 0, 0
        if held:
            yield from close(held)

    return run


_COLUMNS = ["part", "pair", "word", "context", "doc", "times", "docs", "head", "base"]


@dataclass
class Seats:
    """A sweep's statistics of fixed size: tables by context, customers of the parent by frequent word, and the parent's totals."""

    tables: np.ndarray
    parent: np.ndarray
    parent_tables: np.ndarray
    cold_customers: float = 0.0
    cold_tables: float = 0.0

    def totals(self) -> tuple[float, float]:
        return self.parent.sum() + self.cold_customers, self.parent_tables.sum() + self.cold_tables


@dataclass
class State:
    customers: np.ndarray  # by frequent context
    hashes: np.ndarray  # of the frequent words
    distinct: int
    sweeps: list[Seats] = field(default_factory=list)

    def names(self, places: np.ndarray) -> np.ndarray:
        """Hashes of words or contexts that are given as places of frequent ones or as hashes."""
        near = places < X.U64(SLOTS)
        return np.where(near, self.hashes[np.where(near, places, X.U64(0)).astype(np.int64)], places)

    def parent_tables(self, sweep: int) -> float:
        """Tables of the parent before a sweep: one for each word at first."""
        return self.sweeps[sweep - 1].totals()[1] if sweep else float(self.distinct)


def parent_probability(customers: np.ndarray, tables: np.ndarray, seats: Seats, distinct: int) -> np.ndarray:
    c, t = seats.totals()
    return (customers - D0 * tables + (S0 + D0 * t) / (distinct + 1)) / (S0 + c)


def _uniform(key: np.ndarray, draw: int) -> np.ndarray:
    """A number in (0, 1) for each key, another one for each draw."""
    return ((X.mix(key + X.U64(draw * 0x9E3779B97F4A7C15 % 2**64)) >> X.U64(11)).astype(float) + 0.5) * 2.0**-53


def _poisson(mean: np.ndarray, key: np.ndarray, draw: int) -> np.ndarray:
    """Poisson numbers: by inversion where the mean is small, from a rounded normal one elsewhere."""
    u = _uniform(key, draw)
    large = mean > 30
    normal = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * _uniform(key, draw + 1))
    out = np.where(large, np.maximum(np.rint(mean + np.sqrt(mean) * normal), 0), 0)
    live = np.flatnonzero(~large)
    term = np.exp(-mean[live])
    below = term.copy()
    for k in range(1, 200):
        live, term, below = (x[u[live] > below] for x in (live, term, below)) if len(live) else (live, term, below)
        if not len(live):
            break
        out[live] = k
        term = term * mean[live] / k
        below = below + term
    return out


def seat(count: np.ndarray, pull: np.ndarray, discount: float, key: np.ndarray) -> np.ndarray:
    """Numbers of tables after ``count`` customers of one dish sat down; ``pull`` is the weight of a new table, ``key`` seeds the draws.

    The first 48 customers are seated one by one; further ones in blocks of doubling size, with the expected number of new
    tables of a block as the mean of a Poisson draw.
    """
    tables = (count > 0).astype(float)
    live = np.flatnonzero(count > 1)
    for i in range(1, 48):
        if not len(live):
            return tables
        t = tables[live]
        new = pull[live] / np.maximum(i - discount * t + pull[live], 1e-12)
        tables[live] = t + (_uniform(key[live], i) < new)
        live = live[count[live] > i + 1]
    start, draw = 48, 48
    while len(live):
        stop = np.minimum(count[live], 2 * start)
        t, a = tables[live], pull[live]
        mean = a * np.log(np.maximum(stop - discount * t + a, 1e-9) / np.maximum(start - discount * t + a, 1e-9))
        tables[live] = t + np.minimum(_poisson(np.maximum(mean, 0), key[live], draw), stop - start)
        start, draw = 2 * start, draw + 2
        live = live[count[live] > start]
    return tables


def seats_of_words(customers: np.ndarray, tables: float, distinct: int, word: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of words in the parent; ``tables`` is how many it had in the sweep before."""
    return seat(customers.astype(np.int64), np.full(len(customers), (S0 + D0 * tables) / (distinct + 1)), D0, _key(word, word, sweep))


def _key(context: np.ndarray, word: np.ndarray, sweep: int) -> np.ndarray:
    return X.mix(context * X.U64(0x2545F4914F6CDD1D) + word + X.U64(sweep * 0xD1342543DE82EF95 % 2**64))


class Shard:
    """The entries of one partition, sorted by type, and what other partitions told it of earlier sweeps."""

    def __init__(self, number: int, rows: Iterator[tuple[int, tuple]]):
        parts: dict[str, list] = {k: [] for k in ("hot", "cold", "context", "hot_doc", "cold_doc", "hot_times", "cold_times", "rid", "train", "head", "base")}
        self.number = number
        #: Customers and tables of the partition's words in the parent, by sweep.
        self.own: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        replies: dict[int, dict[int, tuple[bytes, bytes]]] = {}
        docs = 0
        for _, (kind, *values) in rows:
            if kind == "own":
                sweep, customers, tables, _ = values
                self.own[sweep] = exchange.unplane(customers, np.int64).astype(float), exchange.unplane(tables, np.int64).astype(float)
            elif kind == "totals":
                sweep, home, tables, customers = values
                replies.setdefault(sweep, {})[home] = tables, customers
            if kind != "entries":
                continue
            r = dict(zip(_COLUMNS[1:], values))
            pair, word, context = (exchange.unplane(bytes(r[n]), t) for n, t in (("pair", np.uint32), ("word", X.U64), ("context", X.U64)))
            of_row = exchange.unplane(bytes(r["docs"]), np.int64).reshape(-1, 2)
            local = exchange.unplane(bytes(r["doc"]), np.uint16).astype(np.int32) + np.int32(docs)
            times = exchange.unplane(bytes(r["times"]), np.int32)
            docs += len(of_row)
            n = len(pair)
            found = {"hot": pair, "cold": word, "context": context, "hot_doc": local[:n], "cold_doc": local[n:], "hot_times": times[:n], "cold_times": times[n:], "rid": of_row[:, 0].copy(), "train": of_row[:, 1] > 0}
            found |= {"head": exchange.unplane(bytes(r["head"]), np.int64).reshape(-1, 5), "base": exchange.unplane(bytes(r["base"]), np.float64)}
            for k, v in found.items():
                parts[k].append(v)
        types = {"hot": np.uint32, "cold": X.U64, "context": X.U64, "train": bool, "base": float, "hot_doc": np.int32, "cold_doc": np.int32, "hot_times": np.int32, "cold_times": np.int32}
        got = {}
        for k in list(parts):
            v = parts.pop(k)
            got[k] = np.concatenate(v) if v else np.zeros((0, 5) if k == "head" else 0, types.get(k, np.int64))
        self.head, self.base, self.rid = got["head"], got["base"], got["rid"]
        self.hot_doc, self.cold_doc, self.hot_times, self.cold_times = (got[k] for k in ("hot_doc", "cold_doc", "hot_times", "cold_times"))
        train = got["train"]
        # frequent words: types are (context, word) pairs
        self.hot, hot_of = np.unique(got.pop("hot"), return_inverse=True)
        self.hot, self.hot_of = self.hot.astype(np.int64), hot_of.astype(np.int32)
        del hot_of
        self.hot_count = np.bincount(self.hot_of, self.hot_times * train[self.hot_doc], minlength=len(self.hot)).astype(np.int64)
        # others: all contexts of a rarer word are here, and all frequent words of a rarer context
        self.words, of_word = np.unique(got.pop("cold"), return_inverse=True)
        self.contexts, of_context = np.unique(got.pop("context"), return_inverse=True)
        self.frequent, self.near = (int(np.searchsorted(x, X.U64(SLOTS))) for x in (self.words, self.contexts))
        width = max(1, len(self.contexts))
        types, cold_of = np.unique(of_word.astype(np.int64) * width + of_context, return_inverse=True)
        self.cold_of = cold_of.astype(np.int32)
        del of_word, of_context, cold_of
        self.cold_context, self.cold_word = types % width, types // width
        self.cold_count = np.bincount(self.cold_of, self.cold_times * train[self.cold_doc], minlength=len(types)).astype(np.int64)
        self.word_count = np.bincount(self.cold_word, self.cold_count, minlength=len(self.words))
        #: Tables and customers of the rarer contexts as all partitions have them; contexts are sorted, so are their homes.
        self.tables, self.far_customers = {}, np.zeros(len(self.contexts) - self.near)
        for sweep, found in replies.items():
            tables, customers = (np.concatenate([exchange.unplane(found[home][k], np.int64) for home in sorted(found)]).astype(float) for k in (0, 1))
            self.tables[sweep] = tables
            if sweep == 0:
                self.far_customers = customers

    def of_contexts(self, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Values of the partition's contexts, from the frequent contexts' vector and those of the others."""
        return np.concatenate([near[self.contexts[: self.near].astype(np.int64)], far])

    def of_words(self, customers: np.ndarray, tables: np.ndarray, seats: Seats, distinct: int) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities in the parent: of all frequent words, and of the partition's words."""
        parent = parent_probability(seats.parent, seats.parent_tables, seats, distinct)
        own = parent_probability(customers, tables, seats, distinct)
        own[: self.frequent] = parent[self.words[: self.frequent].astype(np.int64)]
        return parent, own

    def seating(self, state: State, sweep: int, distinct: int) -> tuple[np.ndarray, ...]:
        """Tables of the hot and cold types, and customers and tables of the rarer words in the parent."""
        if sweep == 0:
            hot, cold = (self.hot_count > 0).astype(float), (self.cold_count > 0).astype(float)
        else:
            last = state.sweeps[sweep - 1]
            word, context = self.hot & 0xFFFF, self.hot >> 16
            p, own = self.of_words(*self.own.get(sweep - 1, (np.zeros(0), np.zeros(0))), last, distinct)
            hot = seat(self.hot_count, (S1 + D1 * last.tables[context]) * p[word], D1, _key(state.hashes[context], state.hashes[word], sweep))
            tables = self.of_contexts(last.tables, self.tables.get(sweep - 1, self.far_customers))
            key = _key(state.names(self.contexts)[self.cold_context], state.names(self.words)[self.cold_word], sweep)
            cold = seat(self.cold_count, (S1 + D1 * tables[self.cold_context]) * own[self.cold_word], D1, key)
        customers = np.bincount(self.cold_word, cold, minlength=len(self.words))
        customers[: self.frequent] = 0
        tables = seats_of_words(customers, state.parent_tables(sweep), distinct, state.names(self.words), sweep)
        return hot, cold, customers, tables

    def sums(self, hot: np.ndarray, cold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of values of the types: by frequent context, by frequent word, and by the partition's other contexts."""
        of_context = np.bincount(self.cold_context, cold, minlength=len(self.contexts))
        of_word = np.bincount(self.cold_word, cold, minlength=len(self.words))
        by_context, by_word = (np.bincount(x, hot, minlength=SLOTS).astype(float) for x in (self.hot >> 16, self.hot & 0xFFFF))
        by_context[self.contexts[: self.near].astype(np.int64)] += of_context[: self.near]
        by_word[self.words[: self.frequent].astype(np.int64)] += of_word[: self.frequent]
        return by_context, by_word, of_context[self.near :]

    def messages(self, state: State, sweep: int, parts: int, distinct: int) -> Iterator[tuple[int, tuple]]:
        """What a sweep gives to each partition: sums by its share of the slots and by the contexts that have their home there."""
        hot, cold, customers, tables = self.seating(state, sweep, distinct)
        by_context, by_word, far = self.sums(hot, cold)
        slots, far_customers = [by_context, by_word], np.zeros(len(far))
        if sweep == 0:
            by_customer, _, far_customers = self.sums(self.hot_count.astype(float), self.cold_count.astype(float))
            slots.append(by_customer)
        slots = np.stack(slots).astype(np.int64)
        contexts = self.contexts[self.near :]
        at = np.searchsorted(_deal_parts(contexts, parts), np.arange(parts + 1).astype(X.U64))
        for p in range(parts):
            mine, i = slots[:, _share(p, parts)], slice(int(at[p]), int(at[p + 1]))
            if mine.any() or i.stop > i.start:
                names = exchange.planes(contexts[i]) if sweep == 0 else b""
                yield p, ("sums", sweep, self.number, exchange.planes(mine.reshape(-1)), names, exchange.planes(far[i].astype(np.int64)), exchange.planes(far_customers[i].astype(np.int64)) if sweep == 0 else b"")
        yield self.number, ("own", sweep, exchange.planes(customers.astype(np.int64)), exchange.planes(tables.astype(np.int64)), (float(customers.sum()), float(tables.sum())))

    def score(self, state: State, parts: int, distinct: int) -> Iterator[tuple]:
        hot_p, cold_p = np.zeros(len(self.hot)), np.zeros(len(self.cold_count))
        kept = range(max(0, len(state.sweeps) - AVERAGED), len(state.sweeps))
        for sweep in kept:
            seats = state.sweeps[sweep]
            hot, cold, customers, tables = self.seating(state, sweep, distinct)
            parent, own = self.of_words(customers, tables, seats, distinct)
            all_customers = self.of_contexts(state.customers, self.far_customers)
            all_tables = self.of_contexts(seats.tables, self.tables.get(sweep, self.far_customers))
            for count, t, c, k, p, out in (
                (self.hot_count, hot, state.customers[self.hot >> 16], seats.tables[self.hot >> 16], parent[self.hot & 0xFFFF], hot_p),
                (self.cold_count, cold, all_customers[self.cold_context], all_tables[self.cold_context], own[self.cold_word], cold_p),
            ):
                out += np.where(c > 0, (count - D1 * t + (S1 + D1 * k) * p) / (S1 + c), p) / len(kept)
        docs = len(self.rid)
        # the base of frequent words is known already
        rare = self.cold_word >= self.frequent
        count = self.word_count[self.cold_word]
        of_doc = lambda values: np.bincount(self.cold_doc, values[self.cold_of] * self.cold_times, minlength=docs).astype(float)
        sums = [of_doc(np.log10(np.maximum(cold_p, 1e-300))), of_doc(np.log10(count + 0.5) * rare), of_doc((count > 0) * rare)]
        sums[0] += np.bincount(self.hot_doc, np.log10(np.maximum(hot_p, 1e-300))[self.hot_of] * self.hot_times, minlength=docs)
        keys = self.rid
        part = _deal_parts(X.mix(keys.view(X.U64)), parts)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(parts + 1).astype(X.U64))
        h = self.head
        for p in range(parts):
            i = order[bounds[p] : bounds[p + 1]]
            mine = p == self.number  # headers were dealt by the same rule
            if len(i) or (mine and len(h)):
                heads = h if mine else h[:0]
                yield p, keys[i].tobytes(), *(x[i].tobytes() for x in sums), np.ascontiguousarray(heads[:, [0, 3, 1, 4, 2]]).astype(np.int64).tobytes(), (self.base if mine else self.base[:0]).tobytes()


def _same(part: int) -> int:
    return part


def _share(part: int, parts: int) -> slice:
    """The slots that a partition adds up."""
    return slice(SLOTS * part // parts, SLOTS * (part + 1) // parts)


def _slots(number: int, rows: Iterator[tuple[int, tuple]]) -> Iterator[tuple[int, np.ndarray | None, tuple[float, float]]]:
    """Sums over all partitions of this one's share of the slots, and its rarer words' customers and tables."""
    total, rare = None, (0.0, 0.0)
    for _, (kind, _, *values) in rows:
        if kind == "sums":
            got = exchange.unplane(values[1], np.int64)
            total = got if total is None else total + got
        elif kind == "own":
            rare = values[-1]
    yield number, total, rare


def _totals(sweep: int):
    """Of the contexts that have their home here: tables in a sweep, and customers, added up and sent back to who asked."""

    def run(number: int, rows: Iterator[tuple[int, tuple]]) -> Iterator[tuple[int, tuple]]:
        names, tables, customers = {}, {}, {}
        for _, (kind, at, *values) in rows:
            if kind == "sums":
                source, _, named, t, c = values
                if at == 0:
                    names[source], customers[source] = exchange.unplane(named, X.U64), exchange.unplane(c, np.int64)
                if at == sweep:
                    tables[source] = exchange.unplane(t, np.int64)
        sources = [k for k in sorted(names) if len(names[k])]
        if not sources:
            return
        _, back = np.unique(np.concatenate([names[k] for k in sources]), return_inverse=True)
        sums = [np.bincount(back, np.concatenate([x[k] for k in sources])).astype(np.int64)[back] for x in (tables, customers)]
        stops = np.cumsum([len(names[k]) for k in sources])
        for k, stop in zip(sources, stops):
            i = slice(int(stop) - len(names[k]), int(stop))
            yield k, ("totals", sweep, number, exchange.planes(sums[0][i]), exchange.planes(sums[1][i]) if sweep == 0 else b"")

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document of a partition, from the partial sums and its header."""
    found: list[list[np.ndarray]] = [[] for _ in range(6)]
    for batch in batches:
        for i in range(batch.num_rows):
            for k, t in enumerate((np.int64, np.float64, np.float64, np.float64, np.int64, np.float64)):
                found[k].append(np.frombuffer(batch.column(k + 1)[i].as_buffer(), t))
    if not found[0]:
        return
    rid, score, base, known, head, head_base = (np.concatenate(f) for f in found)
    head = head.reshape(-1, 5)
    order = np.argsort(head[:, 0])
    head, head_base = head[order], head_base[order]
    at = np.searchsorted(head[:, 0], rid)
    sums = [np.bincount(at, x, minlength=len(head)) for x in (score, base, known)]
    yield pa.RecordBatch.from_arrays([pa.array(head[:, 2], mask=head[:, 4] > 1), pa.array(head[:, 1]), pa.array((sums[2] + head[:, 3]).astype(np.int64)), pa.array(sums[1] + head_base), pa.array(sums[0])], ["doc", "n_tokens", "n_known", "base", "score"])


def score(docs: DataFrame, train, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: ``key``, n_tokens, n_known, train_tokens, base_score, score.  ``train``: column of the learning rows."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    vocab = vocabulary(rows.where("train"))
    parts = min(X.shuffle_parts(spark), 1 << 15)
    marked = rows.withColumn("rid", F.monotonically_increasing_id()).select("rid", F.col("id").alias("doc"), "train", "text")
    packed = marked.transform(X.arrow, _emit(vocab, parts), ", ".join(["part int", *(f"{c} binary" for c in _COLUMNS[1:])]))
    deal = lambda rdd: rdd.partitionBy(parts, _same)
    shards = deal(packed.rdd.map(lambda r: (r[0], ("entries", *r[1:]))))

    def tidy(run):
        """As in ``X.arrow``: the worker gives its memory back at the end of a task."""

        def inner(i, rows):
            try:
                yield from run(i, rows)
            finally:
                X.give_back()

        return inner

    def together(*rdds):
        """Partition by partition: all are dealt alike, so nothing is moved."""
        out = spark.sparkContext.union(list(rdds))
        assert out.getNumPartitions() == shards.getNumPartitions()
        return out

    distinct, total = vocab.distinct, vocab.total
    hashes = np.full(SLOTS, X.mix(np.array([BEGIN], X.U64))[0])
    hashes[: len(vocab.hashes)] = vocab.hashes
    state = State(np.zeros(SLOTS), hashes, distinct)
    told, totals = [], []
    for sweep in range(SWEEPS + 1):
        known = together(shards, told[-1], totals[-1]) if sweep else shards
        told.append(deal(known.mapPartitionsWithIndex(tidy(lambda i, it, state=state, sweep=sweep: Shard(i, it).messages(state, sweep, parts, distinct)))))
        slots, rare = np.zeros((2 if sweep else 3, SLOTS)), np.zeros(2)
        for part, got, (customers, tables) in told[-1].mapPartitionsWithIndex(_slots).collect():
            rare += customers, tables
            if got is not None:
                slots[:, _share(part, parts)] = got.reshape(len(slots), -1)
        if not sweep:
            state.customers = slots[2]
        totals.append(deal((together(told[0], told[-1]) if sweep else told[0]).mapPartitionsWithIndex(tidy(_totals(sweep)))))
        by_word = slots[1]
        at_root = seats_of_words(by_word, state.parent_tables(sweep), distinct, hashes, sweep)
        state.sweeps.append(Seats(slots[0], by_word, at_root, *rare.tolist()))

    # the sweeps that are averaged, and what they were drawn from
    first = max(0, SWEEPS - AVERAGED)
    known = together(shards, *told[first:-1], *totals[:1], *totals[max(1, first) :])
    final = known.mapPartitionsWithIndex(tidy(lambda i, it: Shard(i, it).score(state, parts, distinct)))
    sums = spark.createDataFrame(final, "part int, rid binary, score binary, base binary, known binary, head binary, head_base binary")
    out = sums.repartitionById(parts, F.col("part")).transform(X.arrow, _add_up, "doc long, n_tokens long, n_known long, base double, score double")
    norm = float(np.log10(total + 0.5 * (distinct + 1)))
    return out.select(F.col("doc").alias(key), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * norm).alias("base_score"), "score")


def report(docs: DataFrame) -> DataFrame:
    held_out = X.remainder(F.col("doc_id"), 5) == 1
    got = score(docs, ~held_out)
    return got.select("doc_id", (X.remainder(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
