"""Hash functions whose values are the same in SQL and in Python."""

from __future__ import annotations

import math
import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = (1 << 61) - 1


def bloom_size(items: int, rate: float = 0.01) -> tuple[int, int]:
    """Bits and hash functions of a Bloom filter; both are cut, not rounded."""
    if items <= 0:
        raise ValueError("the number of items must be positive")
    if not 0 < rate < 1:
        raise ValueError("the false-positive rate must lie between 0 and 1")
    m = int(-items * math.log(rate) / math.log(2) ** 2) + 1
    return m, max(1, int(m / items * math.log(2)))


def md5_mod(item: Column, seed: int | Column, m: int) -> Column:
    """md5("seed:item") as a 128-bit number modulo m, from four 32-bit chunks by Horner's rule."""
    h = F.md5(F.concat(F.lit(seed).cast("string") if isinstance(seed, int) else seed.cast("string"), F.lit(":"), item))
    value = F.lit(0).cast("long")
    for k in range(4):
        chunk = F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long")
        value = (value * (1 << 32) % m + chunk) % m if m < 1 << 31 else F.pmod((value.cast("decimal(38,0)") * (1 << 32) + chunk).cast("decimal(38,0)"), F.lit(m).cast("decimal(38,0)")).cast("long")
    return value


def bloom_positions(item: Column, m: int, k: int) -> Column:
    return F.array(*[md5_mod(item, seed, m) for seed in range(k)])


def sha1_words(items: Column) -> Column:
    """The first 64 bits of each item's SHA-1, as 16 hexadecimal digits, all in one string."""
    return F.array_join(F.transform(items, lambda s: F.substring(F.sha1(s), 1, 16)), "")


@lru_cache(8)
def permutations(num_perm: int = 128, seed: int = 42) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Coefficients of the hash family: all multipliers are drawn first, then all offsets."""
    rng = random.Random(seed)
    a = tuple(rng.randint(1, PRIME - 1) for _ in range(num_perm))
    return a, tuple(rng.randint(0, PRIME - 1) for _ in range(num_perm))


#: Words that are hashed at once by all permutations; the work arrays stay in a core's cache.
_BLOCK = 512


def _low_words(a: np.ndarray, b: np.ndarray, v: np.ndarray) -> np.ndarray:
    """(a * v + b) modulo 2**61 - 1, of that the lower 32 bits; exact in 64-bit arithmetic.  One row for each a."""
    u = np.uint64
    p, m32, m29 = u(PRIME), u(0xFFFFFFFF), u((1 << 29) - 1)
    a1, a0, v1, v0 = (a >> u(32))[:, None], (a & m32)[:, None], (v >> u(32))[None], (v & m32)[None]
    middle = a1 * v0
    middle += a0 * v1
    low = a0 * v0
    out = a1 * v1
    out <<= u(3)
    out += b[:, None]
    out += low & p
    low >>= u(61)
    out += low
    out += middle >> u(29)
    middle &= m29
    middle <<= u(32)
    out += middle
    # the sum is below 2**64; folded once it is below 2 * p
    low = out >> u(61)
    out &= p
    out += low
    out -= (out >= p) * p
    out &= m32
    return out


def minhash_sets(words: np.ndarray, offsets: np.ndarray, num_perm: int, seed: int) -> np.ndarray:
    """Signatures (sets x num_perm) of many sets of 64-bit words, one after the other; an empty set has all values 2**32 - 1."""
    a, b = (np.array(x, np.uint64) for x in permutations(num_perm, seed))
    v = words.astype(np.int64).view(np.uint64) % np.uint64(PRIME)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    best = np.full((num_perm, len(offsets) - 1), 0xFFFFFFFF, np.uint64)
    for at in range(0, len(v), _BLOCK):
        own = owner[at : at + _BLOCK]
        heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        least = np.minimum.reduceat(_low_words(a, b, v[at : at + _BLOCK]), heads, axis=1)
        sets = own[heads]
        best[:, sets] = np.minimum(best[:, sets], least)
    return best.T.astype(np.int64)


def minhash_kernel(words: np.ndarray, num_perm: int, seed: int) -> np.ndarray:
    """Signature of one set given by its SHA-1 words."""
    return minhash_sets(words, np.array([0, len(words)]), num_perm, seed)[0]


def similarity(a: Column, b: Column, num_perm: int = 128) -> Column:
    """Share of equal values; signatures of different lengths raise an error."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z)) / num_perm
    return F.when(F.size(a) == F.size(b), same).otherwise(F.raise_error(F.lit("signatures have different lengths")).cast("double"))


def band_threshold(num_perm: int = 128, bands: int = 16) -> float:
    if num_perm % bands:
        raise ValueError("the number of permutations must be a multiple of the number of bands")
    return (1 / bands) ** (bands / num_perm)
