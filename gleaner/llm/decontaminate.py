"""Benchmark decontamination by spaced seeds.

Fixed masks select some of a window's words and ignore the others, so a seed survives substitutions at ignored places.
Seeds of all benchmark items are joined with the seeds of all documents by hash; around every hit the document and the item
are compared word by word along the hit's diagonal, and the best-scoring run decides (substitutions count against it, but
do not end it).  Words are runs of letters and digits, lower-cased.

The benchmark's words are sent to every task only in blocks of at most ``BLOCK_WORDS`` words; a larger benchmark takes more blocks,
each a further step over the documents, so any size gives all results.  Of several blocks each one's result is written before the next
one is read, so the driver holds one block at a time.

The last mask has no gaps: it finds items that are too short for a window of the others.

Defined results: null and empty texts have no overlap; items under ``LEAST_ITEM`` words never match; empty documents or an empty
benchmark give no rows (and keep every document); repeated items and documents each get their own rows; rows with null item_id
count as items; of overlaps with as many matching words the first one is reported.  ``find`` takes the id and the text of the documents only,
``clean`` keeps all columns, whatever their names.  A text is kept whole by its task, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm import textops as X
from gleaner.operators.storage import written

#: Positions of the words that each mask selects.
MASKS = [(0, 1, 2, 4, 7, 8), (0, 1, 3, 6, 7, 9), (0, 2, 3, 5, 6, 8), (0, 1, 4, 5, 8, 9), (0, 1, 2, 3, 4, 5)]
LEAST_ITEM = 6
#: An overlap counts from so many matching words on, or from this share of a shorter item.
LEAST_MATCHES, LEAST_SHARE = 12, 0.8
MISMATCH = -2
BLOCK_WORDS = 1_000_000
FILTER_BITS = 20


def seeds(h: np.ndarray, at: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Seed hashes of a mask and the word at which each starts; windows do not cross documents."""
    span = mask[-1] + 1
    n = len(h) - span + 1
    if n <= 0:
        return np.zeros(0, X.U64), np.zeros(0, np.int64)
    out = np.zeros(n, X.U64)
    for k, m in enumerate(mask):
        out += h[m : m + n] * X.U64(0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64)
    own = X.doc_of(at)
    ok = own[:n] == own[span - 1 :]
    return X.mix(out + X.U64(sum(m << (4 * k) for k, m in enumerate(mask))))[ok], np.flatnonzero(ok)


class Items:
    """Words and seeds of a block of benchmark items."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids = ids
        data, off = X.string_bytes(X.string_array([t or "" for t in texts]))
        self.words, _, _, self.at = X.plain_words(data, off)
        own = X.doc_of(self.at)
        found = [(s, p, k) for k, mask in enumerate(MASKS) for s, p in [seeds(self.words, self.at, mask)]]
        keys = np.concatenate([s for s, _, _ in found])
        where = np.concatenate([p for _, p, _ in found])
        fits = np.diff(self.at)[own[where]] >= LEAST_ITEM if len(where) else np.zeros(0, bool)
        keys, where = keys[fits], where[fits]
        order = np.argsort(keys, kind="stable")
        self.keys, self.where, self.item = keys[order], where[order], own[where[order]] if len(where) else where
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.keys >> X.U64(64 - FILTER_BITS)).astype(np.int64)] = True

    def hits(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distinct (item, word of the documents at which the item would start), as rows."""
        out = []
        for mask in MASKS:
            key, pos = seeds(h, at, mask)
            maybe = np.flatnonzero(self.filter[(key >> X.U64(64 - FILTER_BITS)).astype(np.int64)])
            key, pos = key[maybe], pos[maybe]
            a, b = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, side="right")
            n = b - a
            j = X.ragged(a, n)
            out.append(np.column_stack([self.item[j], np.repeat(pos, n) - (self.where[j] - self.at[self.item[j]])]))
        return np.unique(np.concatenate(out), axis=0)

    def overlaps(self, h: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, first word of the documents, words, matching words) of verified overlaps."""
        found = []
        for item, begin in self.hits(h, at).tolist():
            size = int(self.at[item + 1] - self.at[item])
            inside = min(max(begin, 0), len(h) - 1)
            # the hit's own document: the one that holds most of the diagonal, found from every document it touches
            first = int(np.searchsorted(at, inside, side="right")) - 1
            last = int(np.searchsorted(at, min(begin + size, len(h)) - 1, side="right")) - 1
            for doc in range(first, last + 1):
                a, b = max(begin, int(at[doc])), min(begin + size, int(at[doc + 1]))
                if b - a < 5:
                    continue
                same = h[a:b] == self.words[self.at[item] + a - begin : self.at[item] + b - begin]
                total = np.append(0, np.cumsum(np.where(same, 1, MISMATCH)))
                gain = total - np.minimum.accumulate(total)
                stop = int(gain.argmax())
                # ties in the minimum: the last one gives the shortest run
                start = stop - int(total[: stop + 1][::-1].argmin())
                matches = int(same[start:stop].sum())
                if matches >= min(LEAST_MATCHES, int(np.ceil(LEAST_SHARE * size))):
                    found.append((doc, item, a + start, stop - start, matches))
        return found


def count_blocks(benchmark: DataFrame, most: int) -> int:
    """Into how many blocks the items have to be cut; a word has two bytes at least, with the space behind it."""
    total = benchmark.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    return int(total // most) + 1


def read_block(benchmark: DataFrame, k: int, n: int) -> Items:
    """The k-th of n blocks."""
    own = benchmark.select("item_id", "text")
    rows = (own if n == 1 else own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)).collect()
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    return Items([r[0] for r in rows], [r[1] for r in rows])


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document and item that overlap: the best overlap's place and size, and how many there are."""
    id_type, item_type = docs.schema[key].dataType, benchmark.schema["item_id"].dataType
    names = ["item_id", "n_overlaps", "first_word", "n_words", "matches", "coverage", "start", "end"]
    schema = T.StructType([T.StructField(key, id_type), T.StructField("item_id", item_type), *(T.StructField(n, T.LongType()) for n in names[1:5]), T.StructField("coverage", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])

    def run_with(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in X.slices(batches, text):
                data, off = X.string_bytes(batch.column(text))
                h, s, e, at = X.plain_words(data, off)
                best: dict[tuple[int, int], tuple] = {}
                count: dict[tuple[int, int], int] = {}
                for doc, item, first, size, matches in items.overlaps(h, at):
                    k = doc, item
                    count[k] = count.get(k, 0) + 1
                    if k not in best or (matches, -first) > (best[k][2], -best[k][0]):
                        best[k] = first, size, matches
                keys = sorted(best)
                if not keys:
                    continue
                rows = [[items.ids[i] for _, i in keys], [count[k] for k in keys], [best[k][0] - int(at[k[0]]) for k in keys], [best[k][1] for k in keys], [best[k][2] for k in keys], [best[k][2] / int(items.at[k[1] + 1] - items.at[k[1]]) for k in keys], [int(s[best[k][0]] - off[k[0]]) for k in keys], [int(e[best[k][0] + best[k][1] - 1] - off[k[0]]) for k in keys]]
                kinds = [pa.int64()] * 4 + [pa.float64()] + [pa.int64()] * 2
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array([d for d, _ in keys])), pa.array(rows[0], pa.int64() if item_type == T.LongType() else None), *(pa.array(x, t) for x, t in zip(rows[1:], kinds))], [f.name for f in schema.fields])

        return run

    n = count_blocks(benchmark, BLOCK_WORDS)
    out = None
    for k in range(n):
        found = docs.select(key, text).transform(X.arrow, run_with(read_block(benchmark, k, n)), schema)
        found = found if n == 1 else written(found, "overlaps")[0]
        out = found if out is None else out.unionAll(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents without any overlap, unchanged."""

    def run_with(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in X.slices(batches, text):
                h, _, _, at = X.plain_words(*X.string_bytes(batch.column(text)))
                keep = np.ones(batch.num_rows, bool)
                keep[[doc for doc, *_ in items.overlaps(h, at)]] = False
                yield batch.filter(pa.array(keep))

        return run

    n = count_blocks(benchmark, BLOCK_WORDS)
    for k in range(n):
        docs = docs.transform(X.arrow, run_with(read_block(benchmark, k, n)), docs.schema)
        docs = docs if n == 1 else written(docs, "clean")[0]
    return docs
