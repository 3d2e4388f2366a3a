"""Bounded, repeatable samples of rows for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPAN = 1 << 62


def rank(key: Column, seed: int) -> Column:
    """A number in [0, 2**62) that depends on the key alone."""
    return F.xxhash64(key, F.lit(seed)).bitwiseAND(F.lit(_SPAN - 1))


def bounded(rows: DataFrame, key: str, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` of the rows: all if there are no more, else those with the smallest hash of ``key``.

    A hash threshold computed from the row count first cuts the rows to about 1.1 times the bound, so that the exact cut
    moves little however large the input is.
    """
    n = rows.count()
    if n > most:
        share = min(1.0, 1.1 * most / n + 10 / n)
        rows = rows.where(rank(F.col(key), seed) < int(share * _SPAN))
    return rows.orderBy(rank(F.col(key), seed), key).limit(most)
