"""Shuffles of packed arrays: many (hash, value) entries travel as a few binary rows.

Entries are sorted by a 64-bit hash and cut at its leading bits into ``2**bits`` parts; a row holds one part of one task's entries,
column by column.  Bytes are stored plane by plane, which lets the shuffle's compression take the leading bytes of sorted hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleaner.llm import textops as X


def part_bits(spark) -> int:
    """At least eight parts for each shuffle partition, so that parts spread evenly."""
    return max(6, int(np.ceil(np.log2(max(1, X.shuffle_parts(spark))))) + 3)


def planes(values: np.ndarray) -> bytes:
    width = values.dtype.itemsize
    return values.view(np.uint8).reshape(-1, width).T.tobytes()


def unplane(raw: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).reshape(-1).view(dtype)


def cut(keys: np.ndarray, columns: dict[str, np.ndarray], bits: int, ids: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (part, one binary for each column) of entries dealt out by ``keys``.

    With ``ids``, the parts are folded onto that many partitions for ``send``: a task makes one row for each of them at most.
    """
    if not len(keys):
        return
    order = np.argsort(keys)
    part = (keys[order] >> X.U64(64 - bits)).astype(np.int64)
    if ids:
        part %= ids
        again = np.argsort(part, kind="stable")
        order, part = order[again], part[again]
    heads = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    stops = np.append(heads[1:], len(part))
    sorted_columns = {n: c[order] for n, c in columns.items()}
    rows = {n: [planes(c[a:b]) for a, b in zip(heads, stops)] for n, c in sorted_columns.items()}
    yield pa.RecordBatch.from_arrays([pa.array(part[heads].astype(np.int32)), *(pa.array(r, pa.binary()) for r in rows.values())], ["part", *rows])


def gather(batches: Iterator[pa.RecordBatch], dtypes: dict[str, object]) -> dict[str, np.ndarray]:
    """All entries of a partition's rows."""
    found: dict[str, list[np.ndarray]] = {n: [] for n in dtypes}
    for batch in batches:
        for n, dtype in dtypes.items():
            found[n] += [unplane(x.as_buffer(), dtype) for x in batch.column(n)]
    return {n: np.concatenate(f) if f else np.zeros(0, dtypes[n]) for n, f in found.items()}


def deal(rows: DataFrame) -> DataFrame:
    return rows.repartition(X.shuffle_parts(rows.sparkSession), "part")


def send(rows: DataFrame, ids: int) -> DataFrame:
    """Rows of ``cut`` with ``ids``, each in the partition that its part names."""
    return rows.repartitionById(ids, "part")
