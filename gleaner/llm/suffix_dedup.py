"""Exact removal of repeated byte strings, and of passages that documents share: difference-cover suffix sorting of the places that can repeat.

1. Anchors: the least hash of all 32-byte grams in a ``LENGTH``-byte window is the window's anchor.  Equal windows have equal
   anchors at equal places, so windows fall into spans, one for each anchor.
2. Spans are shuffled by anchor, as hashes.  A span whose whole content occurs twice repeats with all its windows; a span
   with an anchor of its own has no repeats.  What is left shares an anchor but not the content.
3. The bytes of those spans are dealt into buckets by anchor.  In a bucket the suffixes that start windows are sorted block by
   block: by their first ``COVER`` bytes, and ties by the ranks of a difference-cover sample, which are computed once by
   doubling.  Neighbours in that order that agree in ``LENGTH`` bytes are repeats.  Memory is bounded by the bucket.
4. An anchor with over ``HOT`` contents (a passage inside thousands of different documents) would make one huge bucket: its
   windows are dealt out by the hash of their own content instead, which is exact as well.
5. Passages: runs of ``PASSAGE`` words or more that also stand in a document with another text, whatever their bytes and the white
   space between words.  They take the same way with words for bytes; what shares an anchor but not the content goes as in 4.

Documents with equal texts are equal strings anywhere: they repeat as a whole, and one of them stands for all in steps 2 to 4.

Defined results: null text counts as empty; texts under ``LENGTH`` bytes repeat nothing; matches don't cross documents; repeated
rows are copies of each other; nulls in doc_id are kept; an empty table gives no rows.  Other columns stay, but those named like the
added ones (and ``d``, ``marks``, ``whole``) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm import exchange
from gleaner.llm import textops as X
from gleaner.llm.jaccard import bloom, in_bloom
from gleaner.operators.storage import use_checkpoints

LENGTH, GRAM = 400, 32
#: Words of the shortest passage, and of the grams that anchor its windows.
PASSAGE, WORD_GRAM = 51, 5
BYTES, WORDS = 0, 1
_WINDOW, _GRAM = (LENGTH, PASSAGE), (GRAM, WORD_GRAM)
COVER, STEP = 64, 8
#: Every difference modulo COVER is one of two members of this set: a run of STEP and the multiples of STEP.
SAMPLE = np.array([*range(STEP), *range(STEP, COVER, STEP)])
HOT = 48
FLUSH = 400_000
#: Suffixes that are sorted at once.
SORT_BLOCK = 250_000

_slot = np.full(COVER, -1)
_slot[SAMPLE] = np.arange(len(SAMPLE))
_inside = _slot >= 0
DELTA = np.array([[next(d for d in range(COVER) if _inside[(i + d) % COVER] and _inside[(j + d) % COVER]) for j in range(COVER)] for i in range(COVER)])


def spans(values: np.ndarray, offsets: np.ndarray, sums: np.ndarray, unit: int) -> dict[str, np.ndarray] | None:
    """All spans of bytes or words: document, anchor hash (its last bit is the unit) and place, first window, number of windows, content."""
    n, window, gram = len(values), _WINDOW[unit], _GRAM[unit]
    grams = window - gram + 1
    if n < window:
        return None
    at = np.arange(n - gram + 1)
    g = X.span_hashes(values, at, at + gram, sums)
    key = (g & X.U64(0xFFFFFFFF00000000)) | at.astype(X.U64)
    m = n - window + 1
    pad = -len(key) % grams
    block = np.append(key, np.full(pad, 2**64 - 1, X.U64)).reshape(-1, grams)
    ahead = np.minimum.accumulate(block, axis=1).reshape(-1)
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(back[:m], ahead[grams - 1 : grams - 1 + m])
    del key, block, ahead, back
    anchor = (least & X.U64(0xFFFFFFFF)).astype(np.int64)
    # windows that stay inside one document
    size = np.diff(offsets)
    doc = np.flatnonzero(size >= window)
    if not len(doc):
        return None
    windows = size[doc] - window + 1
    starts = X.ragged(offsets[doc], windows)
    own = np.repeat(doc, windows)
    a = anchor[starts]
    head = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (own[1:] != own[:-1])))
    first, count = starts[head], np.diff(np.append(head, len(starts)))
    h = (g[a[head]] & ~X.U64(1)) | X.U64(unit)
    return {"doc": own[head], "h": h, "pos": 2 * a[head] + unit, "first": first, "count": count, "content": X.span_hashes(values, first, first + count - 1 + window, sums)}


def _words(data: np.ndarray, offsets: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, each document's first, and sums of the hashes as ``X.prefix_sums`` has them of bytes."""
    s, e, at = X.words(data, offsets)
    h = X.span_hashes(data, s, e, sums)
    p, _ = X.powers(len(h) + 1)
    return h, at, np.append(X.U64(0), np.cumsum(h * p[: len(h)], dtype=X.U64))


def _of_units(batch: pa.RecordBatch, units: tuple[int, ...]):
    """Of each unit: its number, values, offsets, sums and spans; the spans' places are relative to their document."""
    data, off = X.string_bytes(batch.column("text"))
    if len(data) < PASSAGE:
        return
    byte_sums = X.prefix_sums(data)
    for unit in units:
        values, at, sums = (data, off, byte_sums) if unit == BYTES else _words(data, off, byte_sums)
        got = spans(values, at, sums, unit)
        if got is not None:
            got["first"] -= at[got["doc"]]
            got["pos"] -= 2 * at[got["doc"]]
            yield unit, values, at, sums, got


_FIELDS = {"h": X.U64, "content": X.U64, "d": np.int64, "doc": np.int64, "first": np.int64, "pos": np.int64, "count": np.int32, "many": np.uint8}


def _doc_ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _anchors(bits: int):
    """Packed span entries by anchor (part >= 0), and marks of spans that repeat within the task (part < 0)."""

    def close(held: list[dict]) -> Iterator[pa.RecordBatch]:
        all_ = {n: np.concatenate([x[n] for x in held]) for n in held[0]}
        order = np.lexsort((all_["first"], all_["d"], all_["content"], all_["h"]))
        all_ = {n: v[order] for n, v in all_.items()}
        same = lambda *names: np.append(False, np.logical_and.reduce([all_[n][1:] == all_[n][:-1] for n in names]))
        fresh = ~same("h", "content", "d", "first")  # copies of a document meet here
        all_ = {n: v[fresh] for n, v in all_.items()}
        head = ~same("h", "content")
        many = _several(head, ~same("h", "content", "d"), all_["h"])
        marks = {n: all_[n][many] for n in ("d", "first", "count", "h")}
        # one of a content that is decided, and all of one that only its own document repeats
        sent = head | ~many
        one = {n: v[sent] for n, v in all_.items()} | {"many": many[sent].astype(np.uint8)}
        for batch in exchange.cut(X.mix(one["h"]), {n: one[n].astype(t) for n, t in _FIELDS.items()}, bits):
            yield batch
        if len(marks["d"]):
            columns = {n: pa.array([exchange.planes(marks[n].astype(_FIELDS[n]))], pa.binary()) if n in marks else pa.nulls(1, pa.binary()) for n in _FIELDS}
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *columns.values()], ["part", *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in X.slices(batches, "text"):
            ids = _doc_ids(batch)
            for *_, got in _of_units(batch, (BYTES, WORDS)):
                doc = got.pop("doc")
                held.append(got | {"d": batch.column("d").to_numpy()[doc], "doc": ids[doc]})
                n += len(doc)
            if n > FLUSH:
                yield from close(held)
                held, n = [], 0
        if held:
            yield from close(held)

    return run


def _several(head: np.ndarray, new_text: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Of sorted entries, which belong to a content that occurs twice: anywhere for bytes, in two texts for words."""
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, len(head)))
    texts = np.add.reduceat(new_text.astype(np.int64), at) if len(at) else size
    words = (h[at] & X.U64(1)).astype(bool)
    return np.repeat(np.where(words, texts, size) > 1, size)


def _judge(hot: int):
    """Decides spans by hash: kind 0 are marks (repeat as a whole), 1 spans to be sorted, 2 those of hot anchors, 3 those of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = exchange.gather(batches, _FIELDS)
        if not len(e["h"]):
            return
        order = np.lexsort((e["first"], e["d"], e["content"], e["h"]))
        e = {n: v[order] for n, v in e.items()}

        def same(*names: str) -> np.ndarray:
            return np.append(False, np.logical_and.reduce([e[n][1:] == e[n][:-1] for n in names]))

        copy = same("h", "content", "d", "first")
        many = np.maximum.reduceat(e["many"], np.flatnonzero(~copy))
        # a document that was met in two tasks: the least id stands for it
        doc = np.minimum.reduceat(e["doc"], np.flatnonzero(~copy))
        e = {n: v[~copy] for n, v in e.items()} | {"many": many, "doc": doc}
        head = ~same("h", "content")
        at = np.flatnonzero(head)
        size = np.diff(np.append(at, len(head)))
        repeated = _several(head, ~same("h", "content", "d"), e["h"]) | np.repeat(np.add.reduceat(e["many"].astype(np.int64), at) > 0, size)
        # of anchors with several contents: one entry of each that is decided, all of the others
        group = np.cumsum(np.append(True, e["h"][1:] != e["h"][:-1])) - 1
        contents = np.bincount(group, head)[group]
        chosen = (contents > 1) & (head | ~repeated)
        kinds = np.where(e["h"] & X.U64(1) > 0, 3, np.where(contents > hot, 2, 1))
        out = {n: np.concatenate([e[n][repeated], e[n][chosen]]) for n in ("d", "doc", "first", "pos", "count")}
        unit = np.concatenate([e["h"][repeated], e["h"][chosen]]) & X.U64(1)
        kind = np.concatenate([np.zeros(int(repeated.sum()), np.int32), kinds[chosen].astype(np.int32)])
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(out["d"]), pa.array(out["doc"]), pa.array(out["first"]), pa.array(out["pos"]), pa.array(out["count"].astype(np.int64)), pa.array(unit.astype(np.int32))], ["kind", "d", "doc", "first", "pos", "count", "unit"])

    return run


def _span_keys(doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return X.mix(doc.view(X.U64) * X.U64(0x9E3779B97F4A7C15) + pos.view(X.U64))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_span_keys(batch.column("doc").to_numpy(), batch.column("pos").to_numpy()).view(np.int64))], ["k"])


def _selected(batch: pa.RecordBatch, filters: dict[int, np.ndarray]):
    """As ``_of_units``, of the spans in a unit's filter only."""
    ids = _doc_ids(batch)
    for unit, values, at, sums, got in _of_units(batch, tuple(filters)):
        on = in_bloom(filters[unit], _span_keys(ids[got["doc"]], got["pos"]))
        if on.any():
            got = {n: v[on] for n, v in got.items()}
            yield unit, values, at, sums, got, batch.column("d").to_numpy()[got["doc"]]


def _bytes_of(bits_filter: np.ndarray, bits: int):
    """Bytes of the chosen spans, dealt out by anchor."""

    def close(held: list) -> Iterator[pa.RecordBatch]:
        h, d, first, count = (np.concatenate([x[i] for x in held]) for i in range(4))
        raw = np.concatenate([x[4] for x in held])
        size = count + LENGTH - 1
        begin = np.cumsum(size) - size
        key = X.mix(h)
        order = np.lexsort((first, d, key))
        part = (key[order] >> X.U64(64 - bits)).astype(np.int64)
        head = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        stop = np.append(head[1:], len(part))
        rows = []
        for a, b in zip(head, stop):
            i = order[a:b]
            rows.append([exchange.planes(h[i]), exchange.planes(d[i]), exchange.planes(first[i]), exchange.planes(count[i]), raw[X.ragged(begin[i], size[i])].tobytes()])
        yield pa.RecordBatch.from_arrays([pa.array(part[head].astype(np.int32)), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(5))], ["part", "h", "d", "first", "count", "raw"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in X.slices(batches, "text"):
            for _, data, off, _, got, d in _selected(batch, {BYTES: bits_filter}):
                size = got["count"] + LENGTH - 1
                held.append((got["h"], d, got["first"], got["count"], data[X.ragged(got["first"] + off[got["doc"]], size)]))
                n += int(size.sum())
            if n > 8 << 20:
                yield from close(held)
                held, n = [], 0
        if held:
            yield from close(held)

    return run


def _window_hashes(filters: dict[int, np.ndarray], bits: int):
    """Every window of the chosen spans as a hash (its last bit is the unit), dealt out by that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def close() -> Iterator[pa.RecordBatch]:
            h, d, start = (np.concatenate([x[i] for x in held]) for i in range(3))
            yield from exchange.cut(h, {"h": h, "d": d, "start": start}, bits)

        for batch in X.slices(batches, "text"):
            for unit, values, at, sums, got, d in _selected(batch, filters):
                first = X.ragged(got["first"], got["count"])
                start = first + np.repeat(at[got["doc"]], got["count"])
                h = X.span_hashes(values, start, start + _WINDOW[unit], sums)
                held.append(((h & ~X.U64(1)) | X.U64(unit), np.repeat(d, got["count"]), first))
                n += len(start)
            if n > 1_000_000:
                yield from close()
                held, n = [], 0
        if held:
            yield from close()

    return run


def _ranges(d: np.ndarray, start: np.ndarray, unit: int = BYTES) -> pa.RecordBatch:
    """Marks of windows, runs of neighbouring ones put together."""
    order = np.lexsort((start, d))
    d, start = d[order], start[order]
    head = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (start[1:] - start[:-1] > 1))[: len(d)])
    count = np.append(head[1:], len(d))[: len(head)] - 1
    return pa.RecordBatch.from_arrays([pa.array(d[head]), pa.array(start[head]), pa.array(start[count] + _WINDOW[unit]), pa.array(np.full(len(head), unit, np.int32))], ["d", "a", "b", "unit"])


def _equal_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    e = exchange.gather(batches, {"h": X.U64, "d": np.int64, "start": np.int64})
    order = np.lexsort((e["start"], e["d"], e["h"]))
    h, d, start = e["h"][order], e["d"][order], e["start"][order]
    fresh = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]) | (start[1:] != start[:-1]))[: len(h)]
    h, d, start = h[fresh], d[fresh], start[fresh]
    if not len(h):
        return
    head = np.append(True, h[1:] != h[:-1])
    twice = _several(head, head | np.append(True, d[1:] != d[:-1]), h)
    for unit in (BYTES, WORDS):
        on = twice & (h & X.U64(1) == X.U64(unit))
        if on.any():
            yield _ranges(d[on], start[on], unit)


class CoverSample:
    """Ranks of the suffixes at sample places: by their first 64, 128, 256, ... bytes, until all differ."""

    def __init__(self, text: np.ndarray):
        self.text = np.append(text, np.zeros(2 * LENGTH + 1024, np.uint8))
        blocks = len(self.text) // COVER - 10
        self.places = (np.arange(blocks)[:, None] * COVER + SAMPLE[None]).reshape(-1)
        words = [self.word(self.places + 8 * k) for k in range(COVER // 8)]
        # places in the last block of the padding have nothing behind them that could tell them apart
        words.append(np.maximum(np.arange(len(self.places)) - (len(self.places) - len(SAMPLE)), 0).astype(X.U64))
        order = np.lexsort(words[::-1])
        new = np.logical_or.reduce([w[order][1:] != w[order][:-1] for w in words])
        rank = self._ranks(order, new)
        self.names = {COVER: rank}
        size = COVER
        while size < 256 or (rank.max(initial=0) + 1 < len(rank) and size < len(self.text)):
            # the place ``size`` bytes on is a sample place too, so many slots on
            on = min(size // COVER * len(SAMPLE), len(rank))
            then = np.append(rank[on:], np.full(on, -1))
            order = np.lexsort((then, rank))
            new = (rank[order][1:] != rank[order][:-1]) | (then[order][1:] != then[order][:-1])
            rank = self._ranks(order, new)
            size *= 2
            if size <= 256:
                self.names[size] = rank
        self.rank = rank

    @staticmethod
    def _ranks(order: np.ndarray, new: np.ndarray) -> np.ndarray:
        rank = np.empty(len(order), np.int64)
        rank[order] = np.append(0, np.cumsum(new))
        return rank

    def word(self, at: np.ndarray) -> np.ndarray:
        """Eight bytes from each place, as a number that sorts like them."""
        out = np.zeros(len(at), X.U64)
        for k in range(8):
            out = (out << X.U64(8)) | self.text[at + k]
        return out

    def slot(self, at: np.ndarray) -> np.ndarray:
        return at // COVER * len(SAMPLE) + _slot[at % COVER]

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before suffix j, given that their first COVER bytes agree."""
        delta = DELTA[i % COVER, j % COVER]
        return self.rank[self.slot(i + delta)] < self.rank[self.slot(j + delta)]

    def equal(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether LENGTH bytes agree, given that the first COVER bytes do."""
        delta = DELTA[i % COVER, j % COVER]
        a, b = self.slot(i + delta), self.slot(j + delta)
        ok = self.names[256][a] == self.names[256][b]
        on = 256 // COVER * len(SAMPLE)
        ok &= self.names[COVER][a + on] == self.names[COVER][b + on]
        near = delta + 320 + COVER <= LENGTH
        on += len(SAMPLE)
        ok &= ~near | (self.names[COVER][a + on] == self.names[COVER][b + on])
        for k in range(LENGTH - COVER, LENGTH, 8):
            left = np.flatnonzero(ok)
            ok[left] = self.word(i[left] + k) == self.word(j[left] + k)
        return ok


def _merge_ties(sample: CoverSample, suffix: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Sorts the suffixes inside every group of ties: a merge sort of all groups in lock step."""
    n = len(suffix)
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(begin, n))
    base, length = np.repeat(begin, size), np.repeat(size, size)
    width = 1
    while width < size.max(initial=1):
        place = np.arange(n) - base
        run = place // width
        other = (run ^ 1) * width
        lo, hi = base + np.minimum(other, length), base + np.minimum(other + width, length)
        right = (run & 1) == 1
        a, b = lo.copy(), hi.copy()
        active = np.flatnonzero(a < b)
        while len(active):
            mid = (a[active] + b[active]) // 2
            me, it = suffix[active], suffix[mid]
            # elements of the other run that go first: smaller ones, and for the right run equal ones too
            first = np.where(right[active], ~sample.less(me, it), sample.less(it, me))
            a[active] = np.where(first, mid + 1, a[active])
            b[active] = np.where(first, b[active], mid)
            active = active[a[active] < b[active]]
        target = base + run // 2 * 2 * width + place % width + (a - lo)
        out = np.empty_like(suffix)
        out[target] = suffix
        suffix, width = out, 2 * width
    return suffix


def repeated_windows(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which of the windows text[s : s + LENGTH] equal another one of them."""
    sample = CoverSample(text)
    found = np.zeros(len(starts), bool)
    head = sample.word(starts)
    order = np.argsort(head, kind="stable")
    sorted_head = head[order]
    a = 0
    while a < len(order):  # one block of suffixes with neighbouring prefixes at a time
        b = min(len(order), a + SORT_BLOCK)
        if b < len(order):
            b = int(np.searchsorted(sorted_head, sorted_head[b - 1], side="right"))
        own = order[a:b]
        words = [sample.word(starts[own] + 8 * k) for k in range(COVER // 8)]
        by = np.lexsort(words[::-1])
        tie = np.append(False, np.logical_and.reduce([w[by][1:] == w[by][:-1] for w in words]))
        in_tie = np.flatnonzero(tie | np.append(tie[1:], False))
        if len(in_tie):
            group = np.cumsum(~tie)[in_tie]
            where = own[by[in_tie]]
            ranked = _merge_ties(sample, starts[where], group)
            same = (group[1:] == group[:-1]) & sample.equal(ranked[:-1], ranked[1:])
            twice = ranked[np.append(False, same) | np.append(same, False)]
            back = np.argsort(starts[where])
            found[where[back[np.searchsorted(starts[where][back], twice)]]] = True
        a = b
    return found


def _sort_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts the window suffixes of each bucket in turn; the rows of a bucket follow each other."""

    def close(rows: list) -> Iterator[pa.RecordBatch]:
        h, d, first, count = (np.concatenate([exchange.unplane(r[k], t) for r in rows]) for k, t in enumerate((X.U64, np.int64, np.int64, np.int64)))
        raw = np.concatenate([np.frombuffer(r[4], np.uint8) for r in rows])
        size = count + LENGTH - 1
        begin = np.cumsum(size) - size
        # a document that came from two tasks takes part once
        order = np.lexsort((first, d))
        twin = np.append(False, (d[order][1:] == d[order][:-1]) & (first[order][1:] == first[order][:-1]))
        keep = np.sort(order[~twin])
        windows = X.ragged(begin[keep], count[keep])
        on = repeated_windows(raw, windows) if len(windows) else np.zeros(0, bool)
        if on.any():
            yield _ranges(np.repeat(d[keep], count[keep])[on], X.ragged(first[keep], count[keep])[on])

    rows, bucket = [], None
    for batch in batches:
        for i, part in enumerate(batch.column("part").to_pylist()):
            if rows and part != bucket:
                yield from close(rows)
                rows = []
            bucket = part
            rows.append([batch.column(n)[i].as_buffer() for n in ("h", "d", "first", "count", "raw")])
    if rows:
        yield from close(rows)


def _passed(row_first, row_count, unit):
    """End of a span's last window."""
    return row_first + row_count - 1 + F.when(unit == WORDS, PASSAGE).otherwise(LENGTH)


def repeats(docs: DataFrame) -> DataFrame:
    """(d, a, b, unit): ranges of bytes that repeat, or of words that stand in another text, by the hash ``d`` of the text.

    ``docs`` has doc_id, text, d.
    """
    spark = docs.sparkSession
    use_checkpoints(spark)
    bits = exchange.part_bits(spark)
    fields = ", ".join(f"{n} binary" for n in _FIELDS)
    entries = docs.transform(X.arrow, _anchors(bits), f"part int, {fields}").checkpoint()
    judged = exchange.deal(entries.where("part >= 0")).transform(X.arrow, _judge(HOT), "kind int, d long, doc long, first long, pos long, count long, unit int").checkpoint()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                d, first, count, h = (exchange.unplane(batch.column(n)[i].as_buffer(), _FIELDS[n]) for n in ("d", "first", "count", "h"))
                unit = (h & X.U64(1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(first), pa.array(first + count - 1 + np.array(_WINDOW)[unit]), pa.array(unit)], ["d", "a", "b", "unit"])

    schema = "d long, a long, b long, unit int"
    marks = entries.where("part < 0").transform(X.arrow, local, schema)
    marks = marks.unionAll(judged.where("kind = 0").select("d", F.col("first").alias("a"), _passed(F.col("first"), F.col("count"), F.col("unit")).alias("b"), "unit"))
    chosen = {k: bloom(judged.where(F.col("kind") == k).select("doc", "pos").transform(X.arrow, _keys, "k long"), F.col("k")) for k in (1, 2, 3)}
    raw = exchange.deal(docs.transform(X.arrow, _bytes_of(chosen[1], bits), "part int, h binary, d binary, first binary, count binary, raw binary"))
    marks = marks.unionAll(raw.sortWithinPartitions("part").transform(X.arrow, _sort_bucket, schema))
    hashed = {unit: chosen[kind] for unit, kind in ((BYTES, 2), (WORDS, 3)) if chosen[kind].any()}
    if hashed:
        hashes = exchange.deal(docs.transform(X.arrow, _window_hashes(hashed, bits), "part int, h binary, d binary, start binary"))
        marks = marks.unionAll(hashes.transform(X.arrow, _equal_hashes, schema))
    return marks


def _covered(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, a, 1)
    np.add.at(step, b, -1)
    return np.cumsum(step[:-1]) > 0


def _apply(passages: bool):
    """Takes the marked bytes out, with ``passages`` those of shared passages as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in X.slices(batches, "text"):
            data, off = X.string_bytes(batch.column("text"))
            n = np.diff(off)
            whole = batch.column("whole").to_numpy(zero_copy_only=False)
            lists = batch.column("marks")
            flat = lists.flatten()
            at = np.append(0, np.cumsum(np.diff(lists.offsets.to_numpy()) * ~np.asarray(lists.is_null())))
            doc = np.repeat(np.arange(len(n)), np.diff(at))
            a, b, unit = (flat.field(c).to_numpy() for c in ("a", "b", "unit"))
            byte = unit == BYTES
            gone = _covered(len(data), a[byte] + off[doc[byte]], b[byte] + off[doc[byte]])
            gone |= np.repeat(whole & (n >= LENGTH), n)
            # passages, from the first byte of their first word to the last one of their last word
            s, e, first = X.words(data, off)
            in_passage = _covered(len(s), a[~byte] + first[doc[~byte]], b[~byte] + first[doc[~byte]])
            in_passage |= np.repeat(whole & (np.diff(first) >= PASSAGE), np.diff(first))
            passage_at, passage_end, of_doc = X.runs(in_passage, first)
            if passages:
                gone |= _covered(len(data), s[passage_at], e[passage_end - 1])
            _, _, spans_at = X.runs(gone, off)
            cum = np.append(0, np.cumsum(~gone))
            kept = cum[off]
            rest = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(data[~gone])]).cast(pa.binary())
            own = [c for c in batch.schema.names if c not in ("marks", "whole", "d", "text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(n), pa.array(n - np.diff(kept)), pa.array(np.diff(spans_at)), pa.array(np.diff(of_doc)), rest], [*own, *_ADDED])

    return run


_ADDED = ("n_bytes", "n_removed", "n_spans", "n_passages", "kept")


def remove_repeats(docs: DataFrame, passages: bool = False) -> DataFrame:
    """The documents' columns without text, and n_bytes, n_removed, n_spans, n_passages, kept (the remaining bytes).

    With ``passages``, the passages that documents share are removed as well as the strings of ``LENGTH`` bytes.
    """
    docs = docs.drop(*_ADDED, "d", "marks", "whole")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumn("text", text).withColumn("d", F.xxhash64(text))
    light = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "d")
    marks = repeats(light).groupBy("d").agg(F.collect_list(F.struct("a", "b", "unit")).alias("marks"))
    copies = keyed.groupBy("d").count().where("count > 1").select("d", F.lit(True).alias("copied"))
    found = marks.join(copies, "d", "full").select("d", F.when(F.col("copied"), None).otherwise(F.col("marks")).alias("marks"), F.coalesce("copied", F.lit(False)).alias("copied"))
    joined = keyed.join(found, "d", "left").withColumn("whole", F.coalesce("copied", F.lit(False))).drop("copied")
    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, *(T.StructField(n, T.LongType()) for n in _ADDED[:-1]), T.StructField(_ADDED[-1], T.BinaryType())])
    return joined.select(*(f.name for f in kept), "text", "d", "marks", "whole").transform(X.arrow, _apply(passages), schema)


def report(docs: DataFrame) -> DataFrame:
    """The digest columns, and n_passages, repeats: passages of over 50 words that also stand in another document."""
    got = remove_repeats(docs.select("doc_id", "text"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", (F.col("n_passages") > 0).alias("repeats"))
