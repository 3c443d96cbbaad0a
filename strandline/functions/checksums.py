"""CRC32C and XXH3 of binary columns; Spark has another polynomial and hash.

A CRC is linear: blocks are run from a zero state, all of a batch at once, and
joined by the linear map that a block of zero bytes applies to a state.  Zero
bytes leave a zero state as it is, so a short block is filled up in front.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the polynomial (Castagnoli), bits reversed.
POLYNOMIAL = 0x82F63B78
BLOCK = 256
#: Bytes that a task holds in blocks at once, about.
HELD = 16 << 20


@functools.cache
def _table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = (x >> 1) ^ np.where(x & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    return x


def _step(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return _table()[(state ^ byte) & 0xFF] ^ (state >> np.uint32(8))


@functools.cache
def _zeros() -> tuple[list[int], list[list[int]]]:
    """The first state after 0 to BLOCK zero bytes, and what a block of zero
    bytes makes of each byte of a state."""
    first = [np.uint32(0xFFFFFFFF)]
    for _ in range(BLOCK):
        first.append(_step(first[-1], 0))
    moved = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
    for _ in range(BLOCK):
        moved = _step(moved, 0)
    return [int(x) for x in first], moved.tolist()


def crc32c(values: list[bytes]) -> list[int]:
    """The CRC32C of each value."""
    sizes = [-(-len(v) // BLOCK) for v in values]
    data = np.zeros((sum(sizes), BLOCK), np.uint8)
    flat, end = data.reshape(-1), 0
    for v, n in zip(values, sizes):
        end += n * BLOCK
        flat[end - len(v) : end] = np.frombuffer(v, np.uint8)
    state = np.zeros(len(data), np.uint32)
    for column in data.T:
        state = _step(state, column)
    blocks, out, at = state.tolist(), [], 0
    first, (a, b, c, d) = _zeros()
    for v, n in zip(values, sizes):
        crc = first[len(v) - (n - 1) * BLOCK] ^ blocks[at] if n else first[0]
        for x in blocks[at + 1 : at + n]:
            crc = a[crc & 255] ^ b[crc >> 8 & 255] ^ c[crc >> 16 & 255] ^ d[crc >> 24] ^ x
        out.append(crc ^ 0xFFFFFFFF)
        at += n
    return out


def crc32c_of(value: Column) -> Column:
    """The CRC32C of a binary column, unsigned; null of null."""

    @F.pandas_udf("long")
    def crc(v: pd.Series) -> pd.Series:
        known, out, held, size = v[v.notna()], [], [], 0
        for x in known:
            held.append(x)
            size += len(x)
            if size >= HELD:
                out += crc32c(held)
                held, size = [], 0
        return pd.Series(out + crc32c(held), known.index, "Int64").reindex(v.index)

    return crc(value.cast("binary"))


def xxh3_of(value: Column, seed: int = 0) -> Column:
    """The 64-bit XXH3 of a binary column, as a signed long; null of null."""

    @F.pandas_udf("long")
    def xxh3(v: pd.Series) -> pd.Series:
        known = v[v.notna()]
        hashes = np.array([xxhash.xxh3_64_intdigest(x, seed) for x in known], np.uint64).view(np.int64)
        return pd.Series(hashes, known.index, "Int64").reindex(v.index)

    return xxh3(value.cast("binary"))
