"""Periodic runs of words, found by counting lags.

A run is a stretch of words with smallest period ``p`` that no neighbouring word extends, at least ``exponent`` periods and ``least``
words long.  At lag ``p`` it holds ``max(least - p, (exponent - 1) * p)`` matches (equal words ``p`` apart) in a row, so only lags with
that many matches in the whole text can have runs.  Matches are counted heavy/light: a frequent word's indicator vector is
autocorrelated by FFT (one inverse transform of the summed power spectra, rounded to exact integers), the positions of rare words are
subtracted pair by pair.

Lags with enough matches get an island scan.  An island of ``2 * p`` matches covers a whole cell of the grid with step ``p``, so a
cell whose words equal the next cell's (compared by prefix hashes) marks every island that can matter; its ends are found by comparing
words.  Lags are taken from the smallest, and cells inside a run whose period divides the lag are left out: such islands are that run.

Texts are never cut: a long one is handled by its task as a whole, in memory proportional to its length.  Words are told apart by
64-bit hashes of their bytes.

Defined results: null and empty texts have no words and no runs; rows that share an id or have none keep a row each; extra columns play
no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import textops as X

LEAST, EXPONENT = 24, 3
#: A word is frequent if its pairs cost more than this many transforms' steps.
HEAVY = 8
#: Cells compared at once.
CELLS = 1 << 21


def _light(first: np.ndarray, left: np.ndarray, most: np.ndarray, base: np.ndarray, total: int) -> np.ndarray:
    """Counts of differences up to ``most`` between positions of one word, added up from ``base``.

    ``first`` holds positions sorted by word, ``left`` how many of the same word follow.
    """
    counts = np.zeros(total, np.int64)
    alive, k = np.flatnonzero(left > 0), 1
    while len(alive):
        lag = first[alive + k] - first[alive]
        near = lag <= most[alive]
        # positions of a word ascend: beyond the largest lag nothing follows
        alive, lag = alive[near], lag[near]
        counts += np.bincount(base[alive] + lag, minlength=total)
        k += 1
        alive = alive[left[alive] >= k]
    return counts


def _heavy(word: np.ndarray, heavy: np.ndarray, most: int) -> np.ndarray:
    """Matches at lags 0 .. ``most`` of the words ``heavy`` of one text."""
    size = 1 << int(np.ceil(np.log2(len(word) + most + 1)))
    power = np.zeros(size // 2 + 1)
    for w in heavy:
        t = np.fft.rfft(word == w, size)
        power += t.real**2 + t.imag**2
    return np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)


def matches(word: np.ndarray, at: np.ndarray, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray]:
    """Equal words at each lag, text by text: counts, and where each text's lag 0 stands.  Lags end at n // ``exponent``.

    ``word`` are the words of all texts, ``at`` the offsets of the texts.
    """
    n = np.diff(at)
    most = n // exponent
    base = np.concatenate([[0], np.cumsum(most + 1)])
    doc = X.doc_of(at)
    order = np.lexsort((word, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (word[order][1:] == word[order][:-1])
    head = np.flatnonzero(np.append(True, ~same)) if len(order) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(order)))
    owner = doc[order[head]]
    often = size.astype(np.float64) ** 2 > HEAVY * n[owner] * np.log2(np.maximum(n[owner], 2))
    rare = np.repeat(~often, size)
    left = (np.repeat(head + size, size) - np.arange(len(order)) - 1) * rare
    counts = _light(order, left, most[doc[order]], base[doc[order]], int(base[-1]))
    frequent, owner = word[order[head[often]]], owner[often]
    for x, y in zip(*_bounds(owner)):
        d = int(owner[x])
        counts[base[d] : base[d + 1]] += _heavy(word[at[d] : at[d + 1]], frequent[x:y], int(most[d]))
    return counts, base


def _equal_cells(word: np.ndarray, at: np.ndarray, docs: np.ndarray, lags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, lag, first word) of the cells that equal the next one, for the given texts and lags."""
    p, _ = X.powers(len(word) + 1)
    sums = np.concatenate([np.zeros(1, X.U64), np.cumsum(X.mix(word) * p[: len(word)], dtype=X.U64)])
    n = np.diff(at)
    cells = n[docs] // lags - 1
    found = []
    step = np.cumsum(cells) // CELLS
    for k in range(int(step[-1]) + 1 if len(step) else 0):
        a, b = np.searchsorted(step, [k, k + 1])
        lag = np.repeat(lags[a:b], cells[a:b])
        j = np.arange(len(lag)) - np.repeat(np.cumsum(cells[a:b]) - cells[a:b], cells[a:b])
        start = at[np.repeat(docs[a:b], cells[a:b])] + j * lag
        middle = sums[start + lag]
        hit = np.flatnonzero((middle - sums[start]) * p[lag] == sums[start + 2 * lag] - middle)
        found.append((np.repeat(docs[a:b], cells[a:b])[hit], lag[hit], start[hit]))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))


def _island(word: np.ndarray, first: int, last: int, p: int, begin: int, end: int) -> tuple[int, int]:
    """The whole stretch of period ``p`` around words ``begin`` .. ``end`` of the text ``first`` .. ``last``."""
    low = max(first, begin - p)
    before = np.flatnonzero(word[low:begin] != word[low + p : begin + p])
    high = min(last, end + p)
    after = np.flatnonzero(word[end - p : high - p] != word[end:high])
    return (low + int(before[-1]) + 1 if len(before) else low), (end + int(after[0]) if len(after) else high)


def runs(word: np.ndarray, at: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, by text, start and period; starts count from the text's first word."""
    counts, base = matches(word, at, exponent)
    doc = X.doc_of(base)
    lag = np.arange(len(counts)) - base[doc]
    enough = np.flatnonzero((lag > 0) & (counts >= np.maximum(least - lag, (exponent - 1) * lag)))
    docs, lags, cells = _equal_cells(word, at, doc[enough], lag[enough])
    order = np.lexsort((cells, lags, docs))
    docs, lags, cells = docs[order], lags[order], cells[order]
    found = []
    for a, b in zip(*_bounds(docs)):
        d = int(docs[a])
        first, last = int(at[d]), int(at[d + 1])
        lag, cell = lags[a:b], cells[a:b]
        while len(lag):
            p = int(lag[0])
            n = int(np.searchsorted(lag, p, "right"))
            own, lag, cell = cell[:n], lag[n:], cell[n:]
            heads, stops = _bounds(own - p * np.arange(n))
            for x, y in zip(own[heads].tolist(), own[stops - 1].tolist()):
                start, stop = _island(word, first, last, p, x, y + 2 * p)
                if stop - start >= max(least, exponent * p):
                    found.append((d, start - first, stop - start, p))
                    keep = (lag % p != 0) | (cell < start) | (cell + 2 * lag > stop)
                    lag, cell = lag[keep], cell[keep]
    out = np.array(found, np.int64).reshape(-1, 4)
    return tuple(out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))].T)


def _bounds(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches of one value."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.append(0, cut), np.append(cut, len(values))


def _wrapped(at: np.ndarray, wrap: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Index of the word that stands at each place once texts with a ``given`` wrap repeat their tail (see ``find``)."""
    n = np.diff(at)
    g = np.where(given & (n > 0), wrap, 0)
    a = np.where(n > 0, g % np.maximum(n, 1), 0)
    p = 1 + (n - a) // (3 + g % 8)
    doc = X.doc_of(at)
    i = np.arange(len(doc)) - at[doc]
    turned = given[doc] & (i >= a[doc])
    return at[doc] + np.where(turned, a[doc] + (i - a[doc]) % p[doc], i)


def _find(least: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches, "text"):
            data, offsets = X.string_bytes(batch.column("text"))
            s, e, at = X.words(data, offsets)
            n = np.diff(at)
            if batch.column("wrap").null_count < batch.num_rows:
                given = batch.column("wrap").is_valid().to_numpy(zero_copy_only=False)
                place = _wrapped(at, batch.column("wrap").fill_null(0).to_numpy(), given)
                s, e = s[place], e[place]
            word = X.span_hashes(data, s, e)
            doc, start, length, period = runs(word, at, least, exponent)
            # words that a run repeats: after its first period
            edge = np.zeros(len(word) + 1, np.int64)
            np.add.at(edge, at[doc] + start + period, 1)
            np.add.at(edge, at[doc] + start + length, -1)
            kept = np.cumsum(edge)[:-1] == 0
            size = (e - s + 1)[kept]
            text = data[np.minimum(X.ragged(s[kept], size), len(data) - 1)]
            ends = np.cumsum(size)
            text[ends - 1] = 32
            here = np.bincount(X.doc_of(at)[kept], minlength=len(n))
            stops = np.append(0, ends)[np.append(0, np.cumsum(here))]
            # the space after a text's last word isn't part of it
            drop = np.ones(len(text), bool)
            drop[stops[1:][here > 0] - 1] = False
            lengths = np.diff(stops) - (here > 0)
            collapsed = pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(np.append(0, np.cumsum(lengths)).astype(np.int64)), pa.py_buffer(text[drop].tobytes())])
            fields = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(n) + 1)).astype(np.int32)), fields)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), lists, collapsed], ["id", "n_words", "runs", "collapsed"])

    return run


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", wrap: Column | None = None, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """``key``, n_words, runs (an array of start, length, period, in this order of importance) and collapsed: the text without what runs
    repeat, words joined by one space.

    Where ``wrap`` gives a number g, the words from a = g % n on are first replaced by repeats of the p words at a, with
    p = 1 + (n - a) // (3 + g % 8): a test pattern with known periods.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), (F.lit(None) if wrap is None else wrap).cast("long").alias("wrap"))
    schema = f"id {docs.schema[key].dataType.simpleString()}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return rows.transform(X.arrow, _find(least, exponent), schema).withColumnRenamed("id", key)


def report(docs: DataFrame) -> DataFrame:
    """Digests of the runs of every document, a tenth of which gets a wrapped tail (by crc32 of the id)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = find(docs, wrap=F.when(h % 10 == 0, F.floor(h / 10)))
    # exact fractions: a / b > c / d as a * d > c * b
    best = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))),
        F.get("runs", F.lit(0)),
        lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a),
    )
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    listed = F.array_join(F.transform("runs", line), "")
    out = found.withColumn("best", best)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
