"""Byte-level BPE encoding and decoding without regular expressions.

Pre-tokenisation: every byte gets the class (letter, number, space, other) of its code point.  Each byte acts on the scan
state as a transition function that either replaces the state or leaves it alone; such functions compose associatively,
so run starts and run ends come from accumulate scans over whole buffers and the pattern's boundaries from a few masks.
Distinct slices are encoded once: the pair merging of all new slices runs in lock step, one lowest-ranked leftmost merge a
slice and round, and its results stay in a bounded cache.  Token end offsets are kept so that any range can be decoded.

Defined results: null or empty text has no tokens and empty bytes; repeated rows and ties give the same ids; the columns
of the input stay as they are, but columns named ``n_tokens``, ``ids`` or ``ends`` are replaced; an empty table gives no rows.  Slices
with equal 64-bit hashes count as equal.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm import textops as X

OTHER, LETTER, NUMBER, BLANK = 0, 1, 2, 3
#: Code points with the Unicode property White_Space.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: First and last code points that Unicode 16.0, which the tiktoken library follows, adds to 15.1.
NEWER_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NEWER_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: Slices longer than this are merged with a heap instead of in lock step.
LONG_SLICE = 48
#: Slices kept by a worker's cache; it starts anew beyond that.
CACHE_SLICES = 600_000
NONE = np.int64(1 << 40)


@lru_cache(1)
def code_classes() -> np.ndarray:
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for cp in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = LETTER
        elif kind == "N":
            out[cp] = NUMBER
    for kind, spans in ((LETTER, NEWER_LETTERS), (NUMBER, NEWER_NUMBERS)):
        for a, b in spans:
            out[a : b + 1] = kind
    out[WHITE] = BLANK
    return out


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of the code point that each byte belongs to."""
    table = code_classes()
    cls = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b0 = data[lead].astype(np.int64)
        size = 2 + (b0 >= 0xE0) + (b0 >= 0xF0)
        cp = np.where(size == 2, b0 & 31, np.where(size == 3, b0 & 15, b0 & 7))
        for k in (1, 2, 3):
            on = size > k
            cp[on] = (cp[on] << 6) | (data[lead[on] + k] & 63)
        c = table[cp]
        cls[lead] = c
        for k in (1, 2, 3):
            on = size > k
            cls[lead[on] + k] = c[on]
    return cls


def slice_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which the slices of the GPT-2 style pattern start, all documents together."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    cls = byte_classes(data)
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(cls[1:], cls[:-1], out=first[1:])
    first[offsets[:-1][offsets[:-1] < n]] = True
    begins = np.flatnonzero(first)
    ends = np.append(begins[1:], n)
    doc_end = np.zeros(n + 1, bool)
    doc_end[offsets[1:]] = True
    # the last blank of a run stands alone, or joins the next slice if it is a space
    gap = (cls[begins] == BLANK) & ~doc_end[ends]
    run, stop = begins[gap], ends[gap]
    last = stop - 1
    for _ in range(3):
        last -= (data[last] & 0xC0) == 0x80
    first[last] = True
    joins = data[last] == 32
    first[stop[joins]] = False
    # contractions: an apostrophe at which a slice starts, right before one of the fixed endings
    q = np.flatnonzero((data == 39) & first)
    q = q[(q + 1 < n) & ~doc_end[np.minimum(q + 1, n)]]
    a = data[q + 1]
    has2 = (q + 2 < n) & ~doc_end[np.minimum(q + 2, n)]
    b = np.where(has2, data[np.minimum(q + 2, n - 1)], 0)
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    one = (a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))
    for hit, size in ((one, 2), (two & ~one, 3)):
        p = q[hit]
        first[p + 1] = False
        p = p + size
        first[p[p < n]] = True
    return np.flatnonzero(first)


class Vocabulary:
    """Ranks of a .tiktoken file with the tables for merging and decoding, and the cache of slices."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        top = max(ranks.values())
        by_id = [b""] * (top + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
        self.lengths = np.array([len(t) for t in by_id], np.int64)
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        h = X.span_hashes(self.bytes, self.begins, self.begins + self.lengths)
        order = np.argsort(h)
        self.whole, self.whole_id = h[order], order
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int64, len(pairs))
        bits = max(4, int(np.ceil(np.log2(max(2, len(keys)) * 2))))
        self.shift, size = np.uint64(64 - bits), 1 << bits
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        self.pair_keys, self.pair_values = keys[order], values[order]
        self.bucket = np.searchsorted(slot[order], np.arange(size + 1))
        self.deepest = int(np.diff(self.bucket).max()) if len(keys) else 0
        self.pairs = pairs
        self.clear()

    def clear(self) -> None:
        self.keys, self.offs, self.ids = np.zeros(0, X.U64), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(X.U64) * X.U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        slot = self._slot(key)
        at, stop = self.bucket[slot], self.bucket[slot + 1]
        out = np.full(len(key), NONE)
        todo = np.flatnonzero(at < stop)
        for _ in range(self.deepest):
            if not len(todo):
                break
            hit = self.pair_keys[at[todo]] == key[todo]
            out[todo[hit]] = self.pair_values[at[todo[hit]]]
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[at[todo] < stop[todo]]
        return out

    def merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each slice, one after the other, and how many each has."""
        n = len(starts)
        found: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        lengths = ends - starts
        for i in np.flatnonzero(lengths > LONG_SLICE):
            ids = self._merge_long(data[starts[i] : ends[i]])
            found.append(ids)
            owner.append(np.full(len(ids), i))
        live = np.flatnonzero((lengths <= LONG_SLICE) & (lengths > 0))
        sym = self.single[data[X.ragged(starts[live], lengths[live])]]
        seg = np.repeat(live, lengths[live])
        rank = np.full(len(sym), NONE)
        if len(sym) > 1:
            same = np.flatnonzero(seg[1:] == seg[:-1])
            rank[same] = self.pair_ranks(sym[same], sym[same + 1])
        while len(sym):
            head = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            count = np.diff(np.append(head, len(seg)))
            least = np.minimum.reduceat(rank, head)
            done = least == NONE
            if done.any():
                out = np.repeat(done, count)
                found.append(sym[out])
                owner.append(seg[out])
                sym, seg, rank = sym[~out], seg[~out], rank[~out]
                count, least = count[~done], least[~done]
                if not len(sym):
                    break
            which = np.repeat(np.arange(len(count)), count)
            hit = np.flatnonzero(rank == least[which])
            hit = hit[np.append(True, which[hit][1:] != which[hit][:-1])]
            sym[hit] = rank[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))
            sym, seg, rank = sym[keep], seg[keep], rank[keep]
            rank[at] = NONE
            right = at[at + 1 < len(sym)]
            right = right[seg[right] == seg[right + 1]]
            rank[right] = self.pair_ranks(sym[right], sym[right + 1])
            left = at[at > 0] - 1
            left = left[seg[left] == seg[left + 1]]
            rank[left] = self.pair_ranks(sym[left], sym[left + 1])
        if not found:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        ids, own = np.concatenate(found), np.concatenate(owner)
        order = np.argsort(own, kind="stable")
        return ids[order].astype(np.int32), np.bincount(own, minlength=n)

    def _merge_long(self, piece: np.ndarray) -> np.ndarray:
        sym = self.single[piece].tolist()
        n, pairs = len(sym), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := pairs.get(sym[i] << 20 | sym[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := pairs.get(rank << 20 | sym[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, rank, sym[after[i]]))
            if (h := before[i]) >= 0 and (r := pairs.get(sym[h] << 20 | rank)) is not None:
                heapq.heappush(heap, (r, h, sym[h], rank))
        return np.array([s for s in sym if s >= 0], np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the documents, and the offsets of each document's ids."""
        starts = slice_starts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        h = X.span_hashes(data, starts, ends)
        distinct, one, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)
            new = np.flatnonzero(self.keys[at] != distinct)
        else:
            new = np.arange(len(distinct))
        if len(new):
            s, e = starts[one[new]], ends[one[new]]
            at = np.minimum(np.searchsorted(self.whole, distinct[new]), len(self.whole) - 1)
            whole = self.whole[at] == distinct[new]
            ids, count = self.merge(data, s[~whole], e[~whole])
            counts = np.ones(len(new), np.int64)
            counts[~whole] = count
            offs = np.append(0, np.cumsum(counts))
            fresh = np.empty(offs[-1], np.int32)
            fresh[offs[:-1][whole]] = self.whole_id[at[whole]]
            fresh[X.ragged(offs[:-1][~whole], count)] = ids
            keys = np.concatenate([self.keys, distinct[new]])
            lens = np.concatenate([np.diff(self.offs), counts])
            begin = np.concatenate([self.offs[:-1], self.offs[-1] + offs[:-1]])
            pool = np.concatenate([self.ids, fresh])
            order = np.argsort(keys, kind="stable")
            self.keys, lens = keys[order], lens[order]
            self.ids = pool[X.ragged(begin[order], lens)]
            self.offs = np.append(0, np.cumsum(lens))
        at = np.searchsorted(self.keys, distinct)[back]
        count = self.offs[at + 1] - self.offs[at]
        ids = self.ids[X.ragged(self.offs[at], count)]
        of_slice = np.append(0, np.cumsum(count))
        if len(self.keys) > CACHE_SLICES:
            self.clear()
        return ids, of_slice[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[X.ragged(self.begins[ids], self.lengths[ids])]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _binary(values: np.ndarray, offsets: np.ndarray, width: int) -> pa.Array:
    """Rows of a flat array as binary values."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def encode(docs: DataFrame, vocabulary_path: str, text: str = "text", offsets: bool = True) -> DataFrame:
    """Adds ``n_tokens``, ``ids`` (little-endian unsigned 32-bit ids) and, if asked for, ``ends`` (their end offsets in bytes).

    ``vocabulary_path`` must be readable on every executor (it belongs to the Python installation).
    """
    added = ["n_tokens", "ids", *(["ends"] if offsets else [])]
    docs = docs.drop(*added)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), *([T.StructField("ends", T.BinaryType())] if offsets else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocabulary_path)
        for batch in X.slices(batches, text):
            data, off = X.string_bytes(batch.column(text))
            ids, at = vocab.encode(data, off)
            columns = [*batch.columns, pa.array(np.diff(at)), _binary(ids.astype("<u4"), at, 4)]
            if offsets:
                ends = np.cumsum(vocab.lengths[ids])
                ends = ends - np.repeat(off[:-1], np.diff(at))
                columns.append(_binary(ends.astype("<u4"), at, 4))
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *added])

    return docs.transform(X.arrow, run, schema)


def decode(tokens: DataFrame, vocabulary_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for."""
    tokens = tokens.drop(into)
    schema = T.StructType([*tokens.schema.fields, T.StructField(into, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocabulary_path)
        for batch in X.slices(batches, ids):
            raw, off = X.string_bytes(batch.column(ids))
            flat = np.ascontiguousarray(raw).view("<u4").astype(np.int64)
            size = np.append(0, np.cumsum(vocab.lengths[flat]))
            yield pa.RecordBatch.from_arrays([*batch.columns, _binary(vocab.decode(flat), size[off // 4], 1)], [*batch.schema.names, into])

    return tokens.transform(X.arrow, run, schema)


def digests(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    tokens = encode(docs.select("doc_id", "text"), vocabulary_path).drop("text")
    return decode(tokens, vocabulary_path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
