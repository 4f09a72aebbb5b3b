"""Set similarity, MinHash and LSH on array columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

NUM_HASHES = 128
BANDS, ROWS = 64, 2


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b| of duplicate-free arrays, 0 when both are empty."""
    return jaccard_of(F.size(F.array_intersect(a, b)), a, b)


def jaccard_of(common: Column, a: Column, b: Column) -> Column:
    """``jaccard`` where the number of common items is known."""
    total = F.size(a) + F.size(b) - common
    return F.when(total > 0, common / total).otherwise(0.0)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def minhash(tokens: Column, num_hashes: int = NUM_HASHES) -> Column:
    """Signature of a token set: least salted 64-bit hash per position; zeros if empty."""
    return F.transform(F.sequence(F.lit(0), F.lit(num_hashes - 1)), lambda p: F.coalesce(
        F.array_min(F.transform(tokens, lambda t: F.xxhash64(t, p))), F.lit(0).cast("bigint")))


def md5_minhash(tokens: Column, num_hashes: int) -> Column:
    """The same estimator on md5, for engines without xxhash64."""
    return F.transform(F.sequence(F.lit(0), F.lit(num_hashes - 1)), lambda p: F.array_min(
        F.transform(tokens, lambda t: F.md5(F.concat(p.cast("string"), F.lit("|"), t)))))


def md5_signatures(rows: DataFrame, num_hashes: int = NUM_HASHES, text: bool = False) -> DataFrame:
    """(incident_id, signature): ``md5_minhash`` of ``rows(incident_id, tokens)`` that have tokens.

    As ``text`` the hashes joined by commas, else the first 64 bits of each, which are as good to
    compare. Every distinct token of a batch is hashed once, not once per row.
    """
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not len(rows):
                continue
            lists = rows["tokens"]
            known = pc.list_flatten(lists).dictionary_encode()
            words, code = [w.encode() for w in known.dictionary.to_pylist()], known.indices.to_numpy()
            edge = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]
            numbers = np.empty((len(rows), num_hashes), np.int64)
            letters = np.full((len(rows), num_hashes, 33), ord(","), np.uint8) if text else None
            for p in range(num_hashes):
                made = b"".join(hashlib.md5(f"{p}|".encode() + w, usedforsecurity=False).digest() for w in words)
                high, low = np.frombuffer(made, ">u8").reshape(-1, 2).T
                order = np.lexsort((low, high))
                rank = np.empty(len(words), np.int64)
                rank[order] = np.arange(len(words))
                least = order[np.minimum.reduceat(rank[code], edge[:-1])]
                numbers[:, p] = high.astype(np.uint64).view(np.int64)[least]
                if text:
                    letters[:, p, :32] = np.frombuffer(made.hex().encode(), np.uint8).reshape(-1, 32)[least]
            if text:
                width = 33 * num_hashes - 1
                flat = np.ascontiguousarray(letters.reshape(len(rows), -1)[:, :width])
                offsets = (np.arange(len(rows) + 1) * width).astype(np.int32)
                signature = pa.StringArray.from_buffers(len(rows), pa.py_buffer(offsets), pa.py_buffer(flat))
            else:
                signature = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * num_hashes, numbers.reshape(-1))
            yield pa.RecordBatch.from_arrays([rows["incident_id"], signature], ["incident_id", "signature"])

    return rows.where(F.size("tokens") > 0).select("incident_id", "tokens").mapInArrow(
        sign, f"incident_id string, signature {'string' if text else 'array<bigint>'}")


def estimated_jaccard(a: Column, b: Column) -> Column:
    """Share of equal positions; 0 when lengths differ or there are none."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), same / F.size(a)).otherwise(0.0)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def band_hashes(signature: Column, bands: int = BANDS, rows: int = ROWS) -> Column:
    """One hash per band of consecutive signature positions."""
    return let(signature, lambda sig: F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(
        b, F.slice(sig, b * rows + 1, F.lit(rows)))))
