"""Importance resampling towards a target distribution.

Texts are bags of hashed runs of one to three words. How much more frequent a bucket is in
the target than in the documents is its gain; a document's weight adds up the gains of its
features, and Gumbel noise from a hash of its id turns the highest scores into a draw
without replacement. The draw takes ranks of a distributed radix sort.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from opsrecall.llm import radix
from opsrecall.llm.common import blocks
from opsrecall.session import cut

BUCKETS = 10_000
SCALE = 1000
# Of the documents with so many words, so many in a hundred are drawn.
LEAST_WORDS = 20
SHARE = 5
SEED = 42

# Bytes of words: digits, letters, and all of a code point beyond ASCII.
LETTER = np.zeros(256, bool)
LETTER[128:] = True
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Words up to this length are checksummed together, byte by byte; longer ones one by one.
LONG = 64


def _step() -> np.ndarray:
    """Checksum table of a byte, by the polynomial of CRC-32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of checksums, given by its values of each of the four bytes."""
    return table[0, crc & 255] ^ table[1, crc >> 8 & 255] ^ table[2, crc >> 16 & 255] ^ table[3, crc >> 24]


def _shifts(n: int) -> np.ndarray:
    """Maps that take a checksum past 0 .. n - 1 zero bytes."""
    one = np.arange(256, dtype=np.uint32)
    out = [np.stack([one << np.uint32(8 * k) for k in range(4)])]
    while len(out) < n:
        out.append(STEP[out[-1] & 255] ^ out[-1] >> 8)
    return np.stack(out)


STEP = _step()
SHIFT = _shifts(LONG + 2)
#: Maps past 1, 2, 4 .. zero bytes, for long words.
DOUBLED = [SHIFT[1]]
for _ in range(39):
    DOUBLED.append(_apply(DOUBLED[-1], DOUBLED[-1]))
FLAT = SHIFT.reshape(-1)


def shift(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Checksums past ``size`` further bytes: crc(a + b) is shift(crc(a), len(b)) ^ crc(b)."""
    at = np.minimum(size, LONG + 1) * 1024
    out = FLAT[at + (crc & 255)] ^ FLAT[at + 256 + (crc >> 8 & 255)] ^ FLAT[at + 512 + (crc >> 16 & 255)] ^ FLAT[at + 768 + (crc >> 24)]
    far = np.flatnonzero(size > LONG + 1)
    if len(far):
        value, left = crc[far], size[far]
        for k, table in enumerate(DOUBLED):
            odd = (left >> k & 1).astype(bool)
            value[odd] = _apply(table, value[odd])
        out[far] = value
    return out


def checksums(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of every word."""
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-np.minimum(size, LONG + 1), kind="stable")
    by_size = size[order]
    at, short = starts[order], np.searchsorted(-by_size, -LONG, "left")
    for k in range(int(by_size[short]) if short < len(by_size) else 0):
        active = slice(short, int(np.searchsorted(-by_size, -k, "left")))
        crc[active] = STEP[(crc[active] ^ data[at[active] + k]) & 255] ^ crc[active] >> 8
    out = np.empty(len(starts), np.uint32)
    out[order] = ~crc
    for i in order[:short].tolist():
        out[i] = zlib.crc32(data[starts[i]:starts[i] + size[i]])
    return out


def features(texts: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """In blocks of whole texts: the first text, for every text the words before it, and for
    runs of 1, 2 and 3 words the bucket of the run that begins at each word and whether there is one."""
    space = np.uint32(zlib.crc32(b" "))
    for first, offsets, data in blocks(texts):
        letter = LETTER[data]
        begins, ends = letter.copy(), letter.copy()
        begins[1:] &= ~letter[:-1]
        ends[:-1] &= ~letter[1:]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        begins[heads] = letter[heads]
        tails = offsets[1:][offsets[1:] > 0] - 1
        ends[tails] = letter[tails]
        starts = np.flatnonzero(begins)
        size = np.flatnonzero(ends) + 1 - starts
        edge = np.searchsorted(starts, offsets)
        one = checksums(LOWER[data], starts, size)
        spaced = shift(np.full(len(one), space), size) ^ one  # of a space and the word
        last = np.repeat(edge[1:], np.diff(edge))
        place = np.arange(len(one))
        runs, there = [one], [np.ones(len(one), bool)]
        for k in (1, 2):
            longer = np.zeros(len(one), np.uint32)
            longer[:max(0, len(one) - k)] = shift(runs[-1][:len(one) - k], size[k:] + 1) ^ spaced[k:] if len(one) > k else 0
            runs.append(longer)
            there.append(place + k < last)
        yield first, edge, [r % np.uint32(buckets) for r in runs], there


def bucket_counts(docs: DataFrame, text_column: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. A task sends one number for a bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, runs, there in features(b.column(0), buckets):
                for run, is_one in zip(runs, there, strict=True):
                    total += np.bincount(run[is_one], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select(F.col(text_column)).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for a bucket
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of every bucket."""
    s_all, t_all = float(int(source.sum()) + len(source)), float(int(target.sum()) + len(target))
    return np.array([math.floor(SCALE * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, n, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for first, edge, runs, there in features(b.column(1), len(gain)):
                mine = slice(first, first + len(edge) - 1)
                words[mine] = np.diff(edge)
                for run_, is_one in zip(runs, there, strict=True):
                    n[mine] += np.diff(np.r_[0, np.cumsum(is_one)][edge])
                    weight[mine] += np.diff(np.r_[0, np.cumsum(np.where(is_one, gain[run_], 0))][edge])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column)).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise times 1000 from a hash of the id; a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED,
             id_column: str = "doc_id", text_column: str = "text", target_column: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; rank is null unless drawn.

    Of the N rows with ``least_words`` words, floor(share * N / 100) with the highest
    scores are drawn, ties to the smaller id, null last, then to more features. Null and
    empty texts have no features and weight 0; repeated rows count, and are drawn, each by
    itself. An empty target gives every bucket the gain of one that never occurs in it; empty
    ``docs`` give an empty result. Other columns are not read.
    """
    gain = gains(bucket_counts(docs, text_column), bucket_counts(target, target_column))
    scored = cut(weights(docs, gain, id_column, text_column).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    slim = scored.where(F.col("n_words") >= least_words).select(
        F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().cast("long").alias("no_id"), "n_features", "weight", "score",
        (-F.col("score")).alias("by_score"), (-F.col("n_features")).alias("by_features"))
    placed, n = radix.places(slim, ["by_score", "no_id", "doc_id", "by_features"])
    drawn = F.when(F.col("pos") < share * n // 100, F.col("pos") + 1)
    rest = scored.where(F.col("n_words") < least_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return placed.select(F.when(F.col("no_id") == 0, F.col("doc_id")).alias("doc_id"), "n_features", "weight", "score", drawn.alias("rank")).unionByName(rest)
