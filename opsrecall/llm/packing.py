"""Best-fit packing of documents into sequences, certified by lower bounds.

Pieces are dealt to partitions of bounded size; each is packed best-fit decreasing and
its number of sequences compared with lower bounds from dual feasible functions. Where
there is a gap, and from the emptiest sequence of every partition, pieces go back into
a pool, meet others in new partitions and are packed again as long as that saves sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opsrecall.llm.bpe import Encoder, vocabulary
from opsrecall.llm.common import blocks
from opsrecall.session import cut

LENGTH = 2048
# Pieces of one partition, and the most exchanges.
DEALT = 20_000
ROUNDS = 4
# Bytes of text encoded at once; a worker needs about 18 times as much while it does.
ENCODE_BYTES = 4 << 20


def token_pieces(docs: DataFrame, ranks: bytes, length: int = LENGTH, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, ended by the id ``end``.

    Only documents longer than ``length`` are cut: all pieces have that length but the
    first, which has the rest.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary file, about 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(ranks.value)
        for b in batches:
            doc, piece, start, size, crc = [], [], [], [], []
            for first, offsets, _ in blocks(b.column(1), ENCODE_BYTES):
                place, ids = encode(b.column(1).slice(first, len(offsets) - 1))
                for i, (lo, hi) in enumerate(zip(place[:-1].tolist(), place[1:].tolist(), strict=True)):
                    own = np.append(ids[lo:hi], np.uint32(end)).astype("<u4", copy=False)
                    at, k = 0, 0
                    while at < len(own):
                        till = min(len(own), at + ((len(own) - 1) % length + 1 if at == 0 else length))
                        doc.append(first + i)
                        piece.append(k)
                        start.append(at)
                        size.append(till - at)
                        crc.append(zlib.crc32(own[at:till].data))
                        at, k = till, k + 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(run, f"doc_id {docs.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every item, and the number of bins; the fullest bin that fits takes an item."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n = 0, 0  # bit r of rooms: a bin with room for r more is open
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fit = rooms >> s
        if fit:
            room = s + (fit & -fit).bit_length() - 1
            b = open_[room].pop()
            if not open_[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, n
            n += 1
        bins[i], offsets[i] = b, capacity - room
        room -= s
        if room:
            open_[room].append(b)
            rooms |= 1 << room
    return bins, offsets, n


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """A lower bound on the number of bins, from two families of dual feasible functions."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    bound = -(-int((count * x).sum()) // capacity)
    items, filled = np.r_[0, np.cumsum(count)], np.r_[0, np.cumsum(count * x)]
    low = np.arange(1, capacity // 2 + 1)  # items above capacity - low count whole, below low nothing
    whole = items[-1] - items[capacity - low + 1]
    middle = filled[capacity - low + 1] - filled[low]
    bound = max(bound, int((whole + -(-middle // capacity)).max()))
    for k in range(1, 12):  # rounded to multiples of 1 / k, exact multiples of 1 / (k + 1) as they are
        scaled = (k + 1) * x
        parts = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)
        bound = max(bound, -(-int((count * parts).sum()) // (capacity * k)))
    return bound


def _packed(pieces: DataFrame, partitions: int, round_: int, capacity: int) -> DataFrame:
    """``pieces`` (row, length, ..) dealt anew and packed: round, part, bin, offset, gap, tail."""
    columns = [c for c in pieces.columns if c not in ("round", "part", "bin", "offset", "gap", "tail")]
    dealt = pieces.select(*columns, F.pmod(F.xxhash64(F.lit(round_), "row"), F.lit(partitions)).cast("int").alias("part"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)
        size = rows["length"].to_numpy(np.int64)
        bins, offset, n = best_fit_decreasing(size, capacity)
        fill = np.bincount(bins, size, n)
        return rows.assign(round=round_, bin=bins, offset=offset, gap=n - least_bins(size, capacity), tail=bins == int(fill.argmin()))

    return dealt.groupBy("part").applyInPandas(pack, schema + ", round int, bin long, offset long, gap long, tail boolean")


def pack(pieces: DataFrame, capacity: int = LENGTH) -> DataFrame:
    """``pieces`` with a sequence_id and the offset of every piece in its sequence.

    ``length`` is from 1 to ``capacity``. Partitions have about ``DEALT`` pieces, dealt
    by a row number, so ties and repeated rows spread like others. A partition whose
    count equals its bound is optimal by itself. Offsets have no gaps. An empty table
    gives an empty one.
    """
    rows = cut(pieces.withColumn("row", F.monotonically_increasing_id()))
    n = rows.count()
    done = cut(_packed(rows, max(1, -(-n // DEALT)), 0, capacity))
    for k in range(1, ROUNDS + 1):
        free = done.where("gap > 0 OR tail")
        before = free.groupBy("round", "part", "bin").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("bins"), F.sum("n").alias("n")).first()
        if not before.n or done.select("round", "part").distinct().limit(2).count() < 2:
            break
        again = cut(_packed(free, max(1, -(-before.n // DEALT)), k, capacity))
        after = again.select("part", "bin").distinct().count()
        if after >= before.bins:
            break
        done = cut(done.where("NOT (gap > 0 OR tail)").unionByName(again))
    sequence = (F.col("round").cast("long") * F.lit(1 << 58) + F.col("part").cast("long") * F.lit(1 << 24) + F.col("bin")).alias("sequence_id")
    return done.select(*pieces.columns, sequence, "offset")


def packed_documents(docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece.

    Null and empty texts are the end id alone; null ids and repeated rows are packed like
    any other; other columns are not read.
    """
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return pack(token_pieces(docs, vocabulary(vocabulary_path)))
