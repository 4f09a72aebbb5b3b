"""Helpers shared by the operators: tables, Arrow text as bytes, word and window hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
# Bytes of text handled at once inside a task; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the SplitMix64 finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: A random value for every byte, from the scramble above.
BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
LOWER = BYTE.copy()
LOWER[65:91] = BYTE[97:123]

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for later blocks."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        p = np.full(max(n, BLOCK_BYTES + 1), base, U)
        p[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(p)
    return have[:n]


INVERSE = U(pow(int(BASE), -1, 1 << 64))


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array; null is empty."""
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    bufs = arr.buffers()
    if len(arr) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0]:offsets[-1]]


def blocks(arr: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: first row, offsets, bytes."""
    offsets, data = text_bytes(arr)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, offsets[lo:hi + 1] - offsets[lo], data[offsets[lo]:offsets[hi]]
        lo = hi


def word_bounds(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for every text the number of words before it."""
    word = ~SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] = word[heads]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    ends[tails] = word[tails]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = LOWER) -> np.ndarray:
    """A 64-bit hash of every word; with the default values A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, U)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(values[data] * powers(BASE, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(INVERSE, len(data))[starts] + (ends - starts).astype(U))
