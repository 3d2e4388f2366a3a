"""N-gram Jaccard join: all documents whose word-shingle sets have a Jaccard similarity of 3/4 or more, and their components.

Exact, in steps that each cut what the next one has to move:

1. Equal sets collapse to one class (a 128-bit sum of mixed hashes identifies a set), so copies travel once.  The first 64 bits
   name a class from then on; the few classes that share them with another one are named by the other 64.
2. Prefixes: a fixed-size counting sketch orders shingles, frequent ones last.  The first entries of a set in that order are
   shuffled (packed, by shingle).  Two linked sets must share a known number of prefix entries; a class that
   shares too few with all others together is done.
3. Classes left over form candidate groups: pairs that share enough entries, and stars of shingles in a crowd of classes
   (for those classes that have enough such entries to link by them), contracted to components.
4. Signature trees verify inside a group: documents are ordered by size, every node holds the OR of its documents' token
   bitmaps and its size range, and a dual traversal drops node pairs whose largest possible overlap is too small.
   Pairs already in one component are skipped, others are compared in full.
5. A group over ``BLOCK`` documents is dealt out in blocks; the documents that resemble the group most stand in every
   block.  What then isn't in the group's main component is compared with the whole group, block by block.

Defined results: texts without words (null and empty ones too) have an empty set and link with nothing; repeated rows link as
copies; fewer words than a shingle make one shingle of the whole; nulls in doc_id are kept and never become a component's id; an
empty table gives no rows; other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm import exchange
from gleaner.llm import textops as X
from gleaner.operators.components import components
from gleaner.operators.storage import freed_shuffles, remove, use_checkpoints, written

WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Prefixes hold this percentage of a set beyond what any link must share one entry of; a link must share as many more.
EXTRA = 35
PEELS = 2
#: Shingles with more classes than this link candidates as a star, others pair by pair.
CROWD = 48
SKETCH_BITS = 20
#: Filters have 16 bits a key and sizes between these powers of 2; beyond, false positives cost work but change no result.
BLOOM_BITS = 20, 28
BLOCK, LEADERS = 128, 12
#: So many 64-bit names may be shared by different sets (some 3 are to be expected of 10**10 sets).
MOST_ODD = 10_000
FLUSH = 1_000_000
#: Entries of one row of those that several classes have.
ROW = 100_000
#: The lowest bits of a shingle, which don't travel; those of a packed entry number the classes of a task.
PLACE_BITS = 24


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and their offsets."""
    data = X.LOWER[data]
    s, e, at = X.words(data, offsets)
    h = X.span_hashes(data, s, e)
    count = np.diff(at)
    chains = [X.mix(h + X.U64(1))]
    for k in range(1, WORDS):
        prev = chains[-1]
        chains.append(X.mix(prev[:-1] * X.U64(3) + h[k:]) if len(prev) > 1 else prev[:0])
    out, sizes = [], np.zeros(len(count), np.int64)
    for i, (a, n) in enumerate(zip(at[:-1].tolist(), count.tolist())):
        if n:
            own = np.unique(chains[WORDS - 1][a : a + n - WORDS + 1]) if n >= WORDS else chains[n - 1][a : a + 1]
            out.append(own)
            sizes[i] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, X.U64)), np.append(0, np.cumsum(sizes))


def identities(sh: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that identify each set."""
    found = []
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        c = np.append(X.U64(0), np.cumsum(X.mix(sh ^ X.U64(salt)), dtype=X.U64))
        found.append(X.mix(c[at[1:]] - c[at[:-1]]))
    return found[0], found[1]


def named(c1: np.ndarray, c2: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Names of classes: ``c1``, or ``c2`` for those in ``odd``."""
    return np.where(np.isin(c1, odd), c2, c1) if len(odd) else c1


def _sets(batches: Iterator[pa.RecordBatch], text: str = "text"):
    for batch in X.slices(batches, text):
        sh, at = shingles(*X.string_bytes(batch.column(text)))
        yield batch, sh, at


def _identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, sh, at in _sets(batches):
        c1, c2 = identities(sh, at)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), pa.array(np.diff(at))], ["doc_id", "c1", "c2", "n"])


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cells = np.zeros(1 << SKETCH_BITS, np.int64)
    for _, sh, _ in _sets(batches):
        cells += np.bincount((sh & X.U64((1 << SKETCH_BITS) - 1)).astype(np.int64), minlength=len(cells))
    total = int(cells.sum())
    hot = np.flatnonzero(cells >= max(16, 4 * total >> SKETCH_BITS))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(hot, -1)), pa.array(np.append(cells[hot], total))], ["cell", "n"])


def frequency_levels(docs: DataFrame) -> np.ndarray:
    """For each cell of the sketch how many times (as a power of 2) it exceeds what is usual; a fixed-size table."""
    rows = docs.select("text").transform(X.arrow, _count_cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    got = rows.toArrow()  # at most one row for each cell
    cell, n = (got.column(c).to_numpy() for c in ("cell", "n"))
    usual = max(16, 4 * int(n[cell < 0].sum()) >> SKETCH_BITS)
    level = np.zeros(1 << SKETCH_BITS, np.uint8)
    on = (cell >= 0) & (n > usual)
    level[cell[on]] = np.log2(n[on] / usual).astype(np.uint8) + 1
    return level


def _prefixes(level: np.ndarray, odd: np.ndarray, bits: int, ids: int):
    """Entries (shingle, class) of the sets' prefixes."""

    def pick(own: np.ndarray) -> np.ndarray:
        n = len(own)
        most = n - -(-PERCENT * n // 100) + 1 + EXTRA * n // 100
        lv = level[(own & X.U64(len(level) - 1)).astype(np.int64)]
        return own[np.lexsort((own, lv))[:most]] if lv.any() else own[:most]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, names, held = [], {}, 0
        for _, sh, at in _sets(batches):
            c1 = named(*identities(sh, at), odd)
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                if b > a and int(c1[i]) not in names:
                    some = pick(sh[a:b])
                    entries.append(some)
                    names[int(c1[i])] = len(some)
                    held += len(some)
            if held > FLUSH:
                yield pack(entries, names, bits, ids)
                entries, names, held = [], {}, 0
        if entries:
            yield pack(entries, names, bits, ids)

    return run


def pack(entries: list[np.ndarray], names: dict[int, int], bits: int, ids: int) -> pa.RecordBatch:
    """Rows (part, n, k, packed) of a task's entries: for each partition n shingles and the k classes that have them.

    Of a shingle its upper bits travel, as differences, of a class its place among the row's classes.  A set's shingles that agree in
    these bits move on to the next free value, so two sets share as many values as they share shingles, or more.
    """
    name, size = np.array(list(names), X.U64), np.array(list(names.values()))
    place = np.empty(len(name), X.U64)
    place[np.argsort(name)] = np.arange(len(name), dtype=X.U64)
    name, low = np.sort(name), X.U64((1 << PLACE_BITS) - 1)
    key = np.sort((np.concatenate(entries) & ~low) | np.repeat(place, size))
    while len(twin := np.flatnonzero(key[1:] == key[:-1]) + 1):
        key[twin] += X.U64(1 << PLACE_BITS)
        key.sort()
    part = (key >> X.U64(64 - bits)).astype(np.int64) % ids
    order = np.argsort(part.astype(np.uint16) if ids < 1 << 16 else part, kind="stable")
    key, part = key[order], part[order]
    heads = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    ns, ks, packed = [], [], []
    for a, b in zip(heads, np.append(heads[1:], len(part))):
        h, owner = key[a:b] >> X.U64(PLACE_BITS), (key[a:b] & low).astype(np.int64)
        used = np.zeros(len(name), bool)
        used[owner] = True
        at = (np.cumsum(used) - 1)[owner].astype(_places(int(used.sum())))
        gaps = exchange.planes(np.diff(h, prepend=X.U64(0)))[: (8 - PLACE_BITS // 8) * len(h)]
        ns.append(len(h))
        ks.append(int(used.sum()))
        packed.append(pa.compress(gaps + exchange.planes(at) + exchange.planes(np.diff(name[used], prepend=X.U64(0))), "zstd", asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(part[heads].astype(np.int32)), pa.array(ns, pa.int32()), pa.array(ks, pa.int32()), pa.array(packed, pa.binary())], ["part", "n", "k", "packed"])


def _places(k: int):
    return np.uint16 if k <= 1 << 16 else np.uint32


def unpack(n: int, k: int, packed: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    """Shingles and classes of one row's entries."""
    width, of_h = np.dtype(_places(k)).itemsize, (8 - PLACE_BITS // 8) * n
    raw = pa.decompress(packed, of_h + width * n + 8 * k, "zstd", asbytes=True)
    h = exchange.unplane(raw[:of_h] + bytes(PLACE_BITS // 8 * n), X.U64)
    at, names = exchange.unplane(raw[of_h : of_h + width * n], _places(k)), exchange.unplane(raw[of_h + width * n :], X.U64)
    return np.cumsum(h, dtype=X.U64), np.cumsum(names, dtype=X.U64)[at]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes of each shingle that belongs to two or more, and packed bits that mark the first one of each shingle."""
    got = [unpack(n, k, p.as_buffer()) for batch in batches for n, k, p in zip(batch.column("n").to_pylist(), batch.column("k").to_pylist(), batch.column("packed"))]
    if not got:
        return
    h, c = (np.concatenate(x) for x in zip(*got))
    del got
    order = np.lexsort((c, h))
    h, c = h[order], c[order]
    fresh = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))
    h, c = h[fresh], c[fresh]
    heads = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    size = np.diff(np.append(heads, len(h)))
    keep = np.repeat(size, size) > 1
    h, c = h[keep], c[keep]
    # rows end at shingle bounds
    a = 0
    while a < len(h):
        b = min(len(h), a + ROW)
        if b < len(h):
            b = int(np.searchsorted(h, h[b - 1], side="right"))
        first = np.append(True, h[a + 1 : b] != h[a : b - 1])
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(first).tobytes()], pa.binary()), pa.array([exchange.planes(c[a:b])], pa.binary())], ["first", "c"])
        a = b


def _groups(batches: Iterator[pa.RecordBatch], bits: np.ndarray | None) -> Iterator[tuple[np.ndarray, ...]]:
    """Entries (number of the shingle, class, number of classes) of the classes in play (by the filter ``bits``), by row of ``shared``."""
    for batch in batches:
        for i in range(batch.num_rows):
            c = exchange.unplane(batch.column("c")[i].as_buffer(), X.U64)
            h = np.cumsum(np.unpackbits(np.frombuffer(batch.column("first")[i].as_buffer(), np.uint8), count=len(c)), dtype=np.int64)
            if bits is not None:
                on = in_bloom(bits, c)
                h, c = h[on], c[on]
            at = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
            size = np.diff(np.append(at, len(h)))
            df = np.repeat(size, size)
            yield h[df > 1], c[df > 1].view(np.int64), df[df > 1]


def _tally(bits: np.ndarray | None, parts: int, ids: int, over: int = 1):
    """By class, how many of its entries more than ``over`` classes that are still in play (by the filter ``bits``) have, packed by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(c[df > over].view(X.U64), df[df > over]) for _, c, df in _groups(batches, bits)]
        if found:
            c, back = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
            df = np.concatenate([x for _, x in found])
            fame = np.bincount(back, np.log2(df + 1.0), minlength=len(c)).astype(float)
            yield from exchange.cut(X.mix(c), {"c": c, "shared": np.bincount(back, minlength=len(c)).astype(np.int32), "fame": fame}, parts, ids)

    return run


def _add_tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = exchange.gather(batches, {"c": X.U64, "shared": np.int32, "fame": np.float64})
    c, back = np.unique(got["c"], return_inverse=True)
    shared = np.bincount(back, got["shared"], minlength=len(c))
    fame = np.bincount(back, got["fame"], minlength=len(c)) / np.maximum(shared, 1)
    yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)), pa.array(shared.astype(np.int64)), pa.array(fame)], ["c1", "shared", "fame"])


def bloom(rows: DataFrame, key) -> np.ndarray:
    """Packed bits of a Bloom filter with two positions a key, sized by the number of rows."""
    power = int(np.clip(np.ceil(np.log2(16 * max(1, rows.count()))), *BLOOM_BITS))
    size = 1 << power
    places = rows.select(F.explode(F.array(F.pmod(key, F.lit(size)), F.pmod(F.shiftright(key, power), F.lit(size)))).alias("p")).select((F.col("p") + 1).alias("p"))
    bits = np.zeros(size // 8, np.uint8)
    for bucket, some in places.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect():
        bits[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bytes(some), np.uint8)
    return bits


def in_bloom(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    signed, size = key.view(np.int64), 8 * len(bits)
    ok = np.ones(len(key), bool)
    for p in (signed & (size - 1), (signed >> (size.bit_length() - 1)) & (size - 1)):
        ok &= (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
    return ok


def _pairs(bits: np.ndarray, parts: int, ids: int):
    """How many entries two classes share of the shingles with at most ``CROWD`` classes, packed by pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, c, df in _groups(batches, bits):
            h, c = h[df <= CROWD], c[df <= CROWD]
            left, right = [], []
            for k in range(1, CROWD):
                at = np.flatnonzero(h[k:] == h[:-k])
                if not len(at):
                    break
                left.append(c[at])
                right.append(c[at + k])
            if left:
                a, b = np.concatenate(left), np.concatenate(right)
                pairs, n = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0, return_counts=True)
                a, b = pairs[:, 0].copy(), pairs[:, 1].copy()
                yield from exchange.cut(X.mix(a.view(X.U64) * X.U64(3) + b.view(X.U64)), {"a": a, "b": b, "n": n.astype(np.int32)}, parts, ids)

    return run


def _add_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = exchange.gather(batches, {"a": np.int64, "b": np.int64, "n": np.int32})
    pairs, back = np.unique(np.column_stack([got["a"], got["b"]]), axis=0, return_inverse=True)
    k = np.bincount(back.reshape(-1), got["n"], minlength=len(pairs)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(k)], ["a", "b", "k"])


def _stars(bits: np.ndarray, crowded: np.ndarray):
    """Links from the first class of each crowded shingle to its others, among classes with enough such entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, c, df in _groups(batches, bits):
            on = (df > CROWD) & in_bloom(crowded, c.view(X.U64))
            h, c = h[on], c[on]
            head = np.append(True, h[1:] != h[:-1])[: len(h)]
            at = np.flatnonzero(head)
            center = np.repeat(c[at], np.diff(np.append(at, len(h))))
            pairs = np.unique(np.column_stack([center, c])[~head], axis=0) if len(h) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _chosen_sets(bits: np.ndarray, odd: np.ndarray):
    """The sets of the documents that stand for candidate classes (and a few others, which a join drops)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sh, at in _sets(batches):
            c1 = named(*identities(sh, at), odd)
            doc = batch.column("doc_id").fill_null(-1).to_numpy().astype(np.int64)
            on = np.flatnonzero(in_bloom(bits, X.mix(c1 * X.U64(3) + doc.view(X.U64))) & (at[1:] > at[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(c1[on].view(np.int64)), pa.array(doc[on]), pa.array([sh[at[i] : at[i + 1]].tobytes() for i in on], pa.binary())], ["c1", "doc", "set"])

    return run


class Forest:
    """Disjoint sets of positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


class SignatureTree:
    """Documents by size; nodes of ``FAN`` children with OR-combined bitmaps, size ranges and the most bits lost to collisions."""

    FAN = 4

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        n = len(sets)
        bits = 1 << int(np.clip(np.ceil(np.log2(2 * max(len(s) for s in sets) + 2)), 8, 16))
        maps = np.zeros((n, bits), bool)
        for i, s in enumerate(sets):
            maps[i, (s & X.U64(bits - 1)).astype(np.int64)] = True
        sizes = np.array([len(s) for s in sets])
        level = {"or": np.packbits(maps, axis=1).view(np.uint64), "min": sizes, "max": sizes, "lost": sizes - maps.sum(1)}
        self.levels = [level]
        while len(level["min"]) > 1:
            at = np.arange(0, len(level["min"]), self.FAN)
            level = {"or": np.bitwise_or.reduceat(level["or"], at), "min": np.minimum.reduceat(level["min"], at), "max": np.maximum.reduceat(level["max"], at), "lost": np.maximum.reduceat(level["lost"], at)}
            self.levels.append(level)

    def may_link(self, depth: int, i: int, others: np.ndarray) -> np.ndarray:
        """Which of the other nodes at this depth can hold a document that links with one of node i."""
        lv = self.levels[depth]
        low, high = lv["min"][others], lv["max"][others]
        fits = (100 * lv["max"][i] >= PERCENT * low) & (100 * high >= PERCENT * lv["min"][i])
        most = np.bitwise_count(lv["or"][i] & lv["or"][others]).sum(1).astype(np.int64) + np.minimum(lv["lost"][i], lv["lost"][others])
        # 100 o >= P (a + b - o)  needs  (100 + P) o >= P (a + b)
        return fits & ((100 + PERCENT) * most >= PERCENT * (lv["min"][i] + low))

    def components(self) -> Forest:
        forest = Forest(len(self.sets))
        todo = [(len(self.levels) - 1, 0, np.zeros(1, np.int64))]
        while todo:
            depth, i, others = todo.pop()
            others = others[self.may_link(depth, i, others)]
            if not len(others):
                continue
            if depth == 0:
                for j in others.tolist():
                    if j != i and forest.find(i) != forest.find(j) and linked(self.sets[i], self.sets[j]):
                        forest.join(i, j)
                continue
            size = len(self.levels[depth - 1]["min"])
            children = X.ragged(others * self.FAN, np.minimum(others * self.FAN + self.FAN, size) - others * self.FAN)
            for c in range(i * self.FAN, min(i * self.FAN + self.FAN, size)):
                todo.append((depth - 1, c, children[children >= c]))
        return forest


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams groups (all rows of a group follow each other) and links every document to its component's first."""
    group, ids, sets = None, [], []

    def close() -> pa.RecordBatch | None:
        first: dict[int, np.ndarray] = {}
        for i, s in zip(ids, sets):
            first.setdefault(i, s)
        keys = sorted(first, key=lambda k: (len(first[k]), k))
        if len(keys) < 2:
            return None
        forest = SignatureTree([first[k] for k in keys]).components()
        roots = [keys[forest.find(i)] for i in range(len(keys))]
        pairs = [(k, r) for k, r in zip(keys, roots) if k != r]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["a", "b"])

    for batch in batches:
        keys = list(zip(batch.column("comp").to_pylist(), batch.column("x").to_pylist(), batch.column("y").to_pylist()))
        c1, data = batch.column("c1").to_pylist(), batch.column("set")
        for i, k in enumerate(keys):
            if k != group:
                if ids and (out := close()):
                    yield out
                group, ids, sets = k, [], []
            ids.append(c1[i])
            sets.append(np.frombuffer(data[i].as_buffer(), X.U64).copy())
    if ids and (out := close()):
        yield out


def _links(rows: DataFrame) -> DataFrame:
    """Verified links of rows (comp, x, y, c1, set), group by group."""
    parts = X.shuffle_parts(rows.sparkSession)
    dealt = rows.select("comp", "x", "y", "c1", "set").repartition(parts, "comp", "x", "y").sortWithinPartitions("comp", "x", "y")
    return dealt.transform(X.arrow, _verify, "a long, b long")


def classes_and_links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, c1, c2, n) of every document, (c1, c2, name, doc, n) of every class, and (name, label) of those that link with another one."""
    with freed_shuffles(docs.sparkSession):
        return _classes_and_links(docs)


def _classes_and_links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    spark: SparkSession = docs.sparkSession
    use_checkpoints(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = docs.transform(X.arrow, _identify, "doc_id long, c1 long, c2 long, n long").checkpoint()
    distinct = ids.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"))
    twice = distinct.groupBy("c1").count().where("count > 1").select("c1")
    odd = np.array([r[0] for r in twice.limit(MOST_ODD + 1).collect()], np.int64)
    if len(odd) > MOST_ODD:
        raise ValueError("64-bit names of sets collide too often")
    name = F.when(F.col("c1").isin(odd.tolist()), F.col("c2")).otherwise(F.col("c1")) if len(odd) else F.col("c1")
    classes, _ = written(distinct.withColumn("name", name), "classes")
    odd = odd.view(X.U64)
    classes_by_name = classes.select(F.col("name").alias("c1"), "doc", "n")
    level = frequency_levels(docs)
    bits, slots = exchange.part_bits(spark), X.shuffle_parts(spark)
    entries = exchange.send(docs.select("text").transform(X.arrow, _prefixes(level, odd, bits, slots), "part int, n int, k int, packed binary"), slots)
    shared, shared_path = written(entries.transform(X.arrow, _shared, "first binary, c binary"), "shared")
    # a link's smaller set has at least PERCENT of the size of its larger one, which bounds the extra entries that both share
    least = 1 + F.floor(F.floor(F.col("n") * PERCENT / 100) * EXTRA / 100)
    left = None
    for _ in range(PEELS):  # entries shared with classes that are done count no more
        partial = shared.transform(X.arrow, _tally(None if left is None else bloom(left, F.col("c1")), bits, slots), "part int, c binary, shared binary, fame binary")
        tally = exchange.send(partial, slots).transform(X.arrow, _add_tallies, "c1 long, shared long, fame double")
        left = tally.join(classes_by_name, "c1").where(F.col("shared") >= least).select("c1", F.coalesce("doc", F.lit(-1)).alias("doc"), "n", "fame").checkpoint()
    # of a link's shared entries at least half are crowded or at least half are not
    in_play = bloom(left, F.col("c1"))
    half = lambda n: F.ceil((1 + F.floor(n * EXTRA / 100)) / 2)
    pairs = exchange.send(shared.transform(X.arrow, _pairs(in_play, bits, slots), "part int, a binary, b binary, n binary"), slots).transform(X.arrow, _add_pairs, "a long, b long, k long")
    n_a, n_b = (left.select(F.col("c1").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    edges = pairs.join(n_a, "a").join(n_b, "b").where(F.col("k") >= half(F.least("n_a", "n_b"))).select("a", "b")
    partial = shared.transform(X.arrow, _tally(in_play, bits, slots, CROWD), "part int, c binary, shared binary, fame binary")
    crowds = exchange.send(partial, slots).transform(X.arrow, _add_tallies, "c1 long, shared long, fame double").join(left.select("c1", "n"), "c1")
    crowded = bloom(crowds.where(F.col("shared") >= half(F.floor(F.col("n") * PERCENT / 100))), F.col("c1"))
    if crowded.any():
        edges = edges.unionAll(shared.transform(X.arrow, _stars(in_play, crowded), "a long, b long"))
    groups = components(edges).select(F.col("id").alias("c1"), F.col("label").alias("comp"))
    remove(spark, shared_path)
    members = left.join(groups, "c1")
    sizes = members.groupBy("comp").agg(F.count("*").alias("size")).where("size > 1")
    big = members.join(sizes.where(F.col("size") > BLOCK), "comp", "left_semi")
    # the first of each of many shares of a group, then the first of those: no task ranks a whole group
    top = lambda rows, *by: rows.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("fame"), "c1"))).where(F.col("r") <= LEADERS)
    famous = top(top(big.withColumn("share", F.pmod(F.xxhash64("c1"), F.lit(64))), "comp", "share"), "comp").select("c1", F.lit(True).alias("leads"))
    members = members.join(sizes, "comp").join(famous, "c1", "left").checkpoint()
    chosen = docs.transform(X.arrow, _chosen_sets(bloom(members.withColumn("k", _mixed("c1", "doc")), F.col("k")), odd), "c1 long, doc long, set binary")
    sets, sets_path = written(chosen.join(members, ["c1", "doc"]), "sets")
    blocks = F.ceil(F.col("size") / BLOCK)
    own = F.pmod(F.xxhash64("c1"), blocks)
    dealt = sets.withColumn("x", F.explode(F.when(F.col("leads") & (F.col("size") > BLOCK), F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(F.when(F.col("size") > BLOCK, own).otherwise(F.lit(0).cast("long")))))).withColumn("y", F.lit(0))
    links = _links(dealt).distinct().checkpoint()
    labels = components(links)
    large = sets.where(F.col("size") > BLOCK)
    if not large.isEmpty():
        placed = large.select("comp", "c1").join(labels.withColumnRenamed("id", "c1"), "c1", "left").withColumn("label", F.coalesce("label", "c1"))
        tops = placed.groupBy("comp", "label").agg(F.count("*").alias("k")).groupBy("comp").agg(F.max(F.struct("k", "label"))["label"].alias("core"))
        rest = placed.join(tops, "comp").where("label <> core").select("comp", "c1").checkpoint()
        if not rest.isEmpty():
            counts = rest.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).alias("rest_blocks"))
            marked = large.join(counts, "comp").join(rest.select("c1", F.lit(True).alias("apart")), "c1", "left")
            everyone = marked.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rest_blocks") - 1))).withColumn("y", own)
            apart = marked.where("apart").withColumn("x", F.pmod(F.xxhash64("c1", F.lit(3)), F.col("rest_blocks"))).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
            more = _links(everyone.unionByName(apart))
            labels = components(links.unionAll(more))
    remove(spark, sets_path)
    return ids, classes, labels.select(F.col("id").alias("name"), "label")


@F.pandas_udf(T.LongType())
def _mixed(c1: pd.Series, doc: pd.Series) -> pd.Series:
    """Key of a class and the document that stands for it, as in ``_chosen_sets``."""
    return pd.Series(X.mix(c1.to_numpy(np.int64).view(X.U64) * X.U64(3) + doc.to_numpy(np.int64).view(X.U64)).view(np.int64))


def clusters(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    ids, classes, labels = classes_and_links(docs)
    placed = classes.join(labels, "name", "left").withColumn("label", F.coalesce("label", "name"))
    least = placed.groupBy("label").agg(F.min("doc").alias("component_id"))
    of_class = placed.join(least, "label").select("c1", "c2", "component_id")
    out = ids.join(of_class, ["c1", "c2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def with_identities(docs: DataFrame, text: str, names: tuple[str, str]) -> DataFrame:
    """Adds the two numbers that identify each text's set, null for texts without words."""
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sh, at in _sets(batches, text):
            none = at[1:] == at[:-1]
            found = [pa.array(c.view(np.int64), mask=none) for c in identities(sh, at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [f.name for f in schema.fields])

    return docs.transform(X.arrow, run, schema)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with one row of every component: the one of the smallest key, a row without a key only if none has one.

    Rows are told apart by their key and their set; of several rows with the same both, one stays.  Rows without words all stay.
    """
    ids, classes, labels = classes_and_links(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")))
    placed = classes.join(labels, "name", "left").select("c1", "c2", F.coalesce("label", "name").alias("label"))
    rows = ids.where("n > 0").groupBy("doc_id", "c1", "c2").agg(F.count("*").alias("copies")).join(placed, ["c1", "c2"])
    with freed_shuffles(docs.sparkSession):
        rows, _ = written(rows, "placed")
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "c1", "c2")).alias("first"))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("c1") == F.col("first.c1")) & (F.col("c2") == F.col("first.c2"))
    judged = rows.join(first, "label").select("doc_id", "c1", "c2", "copies", same.alias("stays")).where("NOT stays OR copies > 1")
    names = ("c1", "c2")
    while {c.lower() for c in docs.columns} & set(names):
        names = tuple(f"{n}_" for n in names)
    marked = with_identities(docs, text, names)

    def meets(left: DataFrame, right: DataFrame):
        return left[f"`{key}`"].cast("long").eqNullSafe(right["the_id"]) & (left[names[0]] == right["the_c1"]) & (left[names[1]] == right["the_c2"])

    gone, twice = (judged.where(w).select(*(F.col(c).alias(f"the_{c.removeprefix('doc_')}") for c in ("doc_id", "c1", "c2"))) for w in ("NOT stays", "stays"))
    kept = marked.join(gone, meets(marked, gone), "left_anti")
    own = [F.col(f"`{c}`") for c in docs.columns]
    if twice.isEmpty():
        return kept.select(*own)
    again = kept.join(twice, meets(kept, twice), "left_semi").groupBy(F.col(f"`{key}`").alias("the_id"), *names).agg(F.first(F.struct(*own)).alias("row"))
    return kept.join(twice, meets(kept, twice), "left_anti").select(*own).unionAll(again.select("row.*"))
