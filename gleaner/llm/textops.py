"""Vectorised byte-level text kernels shared by the operators.

A text is never cut: its task keeps it whole, in about 80 times its bytes, so the longest text bounds what a worker needs beyond
``SLICE_BYTES``.

All kernels work on one concatenated ``uint8`` buffer of many documents plus ``int64`` document offsets, taken from
an Arrow string column without a copy, so no Python code runs per character or per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# the system's allocator gives large blocks back at once, and small ones on demand
pa.set_memory_pool(pa.system_memory_pool())
try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):
    _trim = None

U64 = np.uint64
#: Text bytes handled at once; bounds the working memory of a Python worker (about 80 times this).
SLICE_BYTES = 1 << 19
#: Bytes of rows that Spark hands to a Python worker at once: both sides hold them, Spark's outside its heap.
BATCH_BYTES = 4 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(0x5EED)
BYTE_CODE = _rng.integers(1, 2**64 - 1, 256, dtype=U64) | U64(1)
BASE = 0x9E3779B97F4A7C55 | 1
_BASE_INV = pow(BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n (kept between calls)."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in ((0, BASE), (1, _BASE_INV)):
            grown = np.full(size, base, U64)
            grown[0] = 1
            _powers[k] = np.multiply.accumulate(grown)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser, so that all bits of a hash are usable."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def prefix_sums(data: np.ndarray) -> np.ndarray:
    p, _ = powers(len(data) + 1)
    c = np.empty(len(data) + 1, U64)
    c[0] = 0
    np.cumsum(BYTE_CODE[data] * p[: len(data)], out=c[1:])
    return c


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit content hash of each byte span; equal bytes give equal hashes wherever they stand."""
    c = prefix_sums(data) if sums is None else sums
    _, inv = powers(len(data) + 1)
    return mix((c[ends] - c[starts]) * inv[starts] + (ends - starts).astype(U64))


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the document offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each has about ``most`` bytes of text (a longer single text stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(lengths) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs ``[^\\x20\\x09-\\x0D]+``, and for each document the first word's index (n + 1 values)."""
    return runs(~SPACE[data], offsets)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that do not cross documents."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = inside[begins]
    stops = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[stops] = inside[stops]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, offsets)


ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def folded(data: np.ndarray) -> np.ndarray:
    """Lower-cases A-Z and the two-byte letters from U+00C0 to U+00DE."""
    out = LOWER[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
    at = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    out[at] += 32
    return out


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters and digits whatever their case and punctuation: hashes, starts, ends, each document's first."""
    s, e, at = runs(ALNUM[data], offsets)
    return span_hashes(folded(data), s, e), s, e, at


def string_array(texts: list[str]) -> pa.Array:
    return pa.array(texts, pa.large_string())


def doc_of(counts_offsets: np.ndarray) -> np.ndarray:
    """Index of the document that each item belongs to, from offsets of items."""
    return np.repeat(np.arange(len(counts_offsets) - 1), np.diff(counts_offsets))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every span, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``: the split into learning and held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def give_back() -> None:
    """Returns a worker's free memory to the system.

    Spark keeps Python workers for later tasks, several for each core; what an idle one holds on to is missing elsewhere.
    """
    if len(_powers[0]) > 1 << 21:
        _powers[:] = [np.ones(1, U64), np.ones(1, U64)]
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def arrow(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with batches of bounded bytes, whose workers give their memory back after each task."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return rows.mapInArrow(tidy, schema)
