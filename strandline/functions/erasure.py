"""Erasure coding over GF(2^8): any M shards of K + M may be lost.

Data shards hold the value and, in the last four bytes, its length.  Parity
comes from a Cauchy matrix, whose square parts all have inverses.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The field's polynomial and a generator.
POLYNOMIAL, GENERATOR = 0x11D, 2


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    exp, log = np.zeros(510, np.uint8), np.zeros(256, np.int64)
    x = 1
    for i in range(255):
        exp[i] = exp[i + 255] = x
        log[x] = i
        x <<= 1
        if x & 0x100:
            x ^= POLYNOMIAL
    return exp, log


def _times(a: int, x: np.ndarray) -> np.ndarray:
    exp, log = _tables()
    return np.where(x == 0, 0, exp[log[a] + log[x]]).astype(np.uint8) if a else np.zeros_like(x)


def _inverse(a: int) -> int:
    exp, log = _tables()
    return int(exp[255 - log[a]])


def _matrix(k: int, m: int) -> np.ndarray:
    """Rows of all K + M shards in terms of the data shards."""
    cauchy = [[_inverse((k + i) ^ j) for j in range(k)] for i in range(m)]
    return np.vstack([np.eye(k, dtype=np.uint8), np.array(cauchy, np.uint8).reshape(m, k)])


def _product(rows: np.ndarray, shards: list[np.ndarray]) -> list[np.ndarray]:
    return [functools.reduce(np.bitwise_xor, (_times(int(a), s) for a, s in zip(row, shards))) for row in rows]


def _inverted(a: np.ndarray) -> np.ndarray:
    n = len(a)
    work = np.hstack([a.copy(), np.eye(n, dtype=np.uint8)])
    for c in range(n):
        pivot = next(r for r in range(c, n) if work[r, c])
        work[[c, pivot]] = work[[pivot, c]]
        work[c] = _times(_inverse(int(work[c, c])), work[c])
        for r in range(n):
            if r != c and work[r, c]:
                work[r] ^= _times(int(work[r, c]), work[c])
    return work[:, n:]


def shard_bytes(length: int, k: int) -> int:
    return max((length + k + 3) // k, 4)


def encode(payload: bytes, k: int, m: int) -> list[bytes]:
    if k < 1 or m < 1:
        raise ValueError("data and parity shards are at least one each")
    per = shard_bytes(len(payload), k)
    whole = payload + bytes(per * k - 4 - len(payload)) + len(payload).to_bytes(4, "big")
    data = [np.frombuffer(whole[i * per : (i + 1) * per], np.uint8) for i in range(k)]
    return [s.tobytes() for s in [*data, *_product(_matrix(k, m)[k:], data)]]


def _data(shards: list[bytes | None], k: int, m: int) -> list[np.ndarray]:
    have = [i for i, s in enumerate(shards) if s is not None][:k]
    if len(have) < k:
        raise ValueError("more shards are lost than there is parity for")
    rows = [np.frombuffer(shards[i], np.uint8) for i in have]
    return rows if have == list(range(k)) else _product(_inverted(_matrix(k, m)[have]), rows)


def decode(shards: list[bytes | None], k: int, m: int) -> bytes:
    whole = b"".join(s.tobytes() for s in _data(shards, k, m))
    length = int.from_bytes(whole[-4:], "big")
    if length > len(whole) - 4:
        raise ValueError("the length in the last data shard is wrong")
    return whole[:length]


def reconstruct(shards: list[bytes | None], k: int, m: int, at: int) -> bytes:
    """One shard from any K others."""
    return _product(_matrix(k, m)[at : at + 1], _data(shards, k, m))[0].tobytes()


def encoded(value: Column, k: int, m: int) -> Column:
    """A binary column's shards, as an array."""

    @F.pandas_udf("array<binary>")
    def shards(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else encode(x, k, m))

    return shards(value)


def reconstructed(shards: Column, k: int, m: int, at: int) -> Column:
    """One shard of an array of shards, lost ones null."""

    @F.pandas_udf("binary")
    def shard(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else reconstruct(list(x), k, m, at))

    return shard(shards)


def decoded(shards: Column, k: int, m: int) -> Column:
    """The value of an array of shards, lost ones null."""

    @F.pandas_udf("binary")
    def value(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else decode(list(x), k, m))

    return value(shards)
