"""Suffix arrays of single texts by prefix doubling: n log n numbers of memory, no suffix is written out."""

from __future__ import annotations

import numpy as np


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


def sort_suffixes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all suffixes in code-point order, and each one's common prefix with the one before (0 for the first)."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, rank = np.unique(codes, return_inverse=True)
    levels, size = [rank.astype(np.int32)], 1
    order = np.argsort(rank, kind="stable")
    while rank.max() + 1 < n:
        then = np.append(rank[size:] + 1, np.zeros(min(size, n), np.int64))[:n]
        key = rank * (n + 1) + then
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.append(0, np.cumsum(key[order][1:] != key[order][:-1]))
        levels.append(rank.astype(np.int32))
        size *= 2
    # equal ranks of a level mean equal runs of its length, so common prefixes are found from the longest level down
    common = np.zeros(n, np.int64)
    left, right = order[:-1], order[1:]
    for k in range(len(levels) - 1, -1, -1):
        i, j = left + common[1:], right + common[1:]
        inside = np.flatnonzero((i < n) & (j < n))
        same = inside[levels[k][i[inside]] == levels[k][j[inside]]]
        common[same + 1] += 1 << k
    return order, common


def longest_repeat(text: str) -> str:
    """The longest substring that occurs twice (overlaps count); the first in code-point order on ties, empty without one."""
    order, common = sort_suffixes(code_points(text))
    if not len(common) or not common.max():
        return ""
    at = int(common.argmax())
    return text[order[at] : order[at] + common[at]]


def repeated_reach(text: str) -> np.ndarray:
    """For every position the length of its longest prefix that occurs elsewhere too."""
    order, common = sort_suffixes(code_points(text))
    reach = np.zeros(len(order), np.int32)
    reach[order] = np.maximum(common, np.append(common[1:], 0))[: len(order)]
    return reach


def common_runs(a: str, b: str, least: int) -> list[str]:
    """Common prefixes of suffixes of ``a#b$`` that are neighbours and start on different sides, in suffix order; repeats stay.

    Runs that hold one of the two separators don't count.
    """
    both = f"{a}#{b}$"
    order, common = sort_suffixes(code_points(both))
    side = order < len(a)
    found = [both[order[i] : order[i] + common[i]] for i in np.flatnonzero((common[1:] >= least) & (side[1:] != side[:-1])) + 1]
    return [s for s in found if "#" not in s and "$" not in s]
