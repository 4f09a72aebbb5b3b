"""Passages of words that stand in several texts.

Of any ``REACH`` runs of ``RUN`` words in a row the one with the least hash is a mark, so two
texts that share ``RUN + REACH - 1`` words in a row share a mark, and texts that share a mark
share ``RUN`` words. A task finds out itself which marks two of its texts have and sends each
mark on once, so a passage in very many texts is sent once by each batch of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from opsrecall.llm.common import BASE, INVERSE, U, blocks, mix, powers, word_bounds, word_hashes

RUN, REACH = 40, 11
# Bytes of text that a task gathers before it sends on what it found.
GATHER_BYTES = 16 << 20
# Texts whose places in a batch fit two bytes, with room for those of one more block.
GATHER_TEXTS = 40_000
MOST = U(0xFFFFFFFFFFFFFFFF)
SEVERAL = 0xFFFF


def marks(offsets: np.ndarray, data: np.ndarray, run: int = RUN, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """(text, mark) of a block of texts, every mark of a text once."""
    starts, ends, first = word_bounds(offsets, data)
    words = word_hashes(data, starts, ends)
    n = max(0, len(words) - run + 1)
    total = np.zeros(len(words) + 1, U)
    np.cumsum(words * powers(BASE, len(words)), out=total[1:])
    runs = mix((total[run:] - total[:n]) * powers(INVERSE, max(n, 1))[:n]) if n else np.zeros(0, U)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))[:n]
    inside = np.arange(n) + run <= first[text + 1] if n else np.zeros(0, bool)
    runs = np.where(inside, runs, MOST)
    least, width = runs, 1
    while width < reach:  # the least of ``width`` runs from each
        step = min(width, reach - width)
        least = np.minimum(least[:len(least) - step], least[step:]) if len(least) > step else least[:0]
        width += step
    at = np.flatnonzero(inside[:len(least)])
    at = at[inside[at + reach - 1] & (text[at] == text[at + reach - 1])]
    found = [(text[at], least[at])]
    size = np.bincount(text[inside], minlength=len(offsets) - 1)
    few = np.flatnonzero((size > 0) & (size < reach))  # fewer runs than that have one mark
    if len(few):
        begin = first[few]
        found.append((few, np.minimum.reduceat(runs, np.stack([begin, np.minimum(begin + size[few], n - 1)], 1).ravel())[::2] if n > 1 else runs[begin]))
    text, mark = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((mark, text))
    text, mark = text[order], mark[order]
    new = np.r_[True, (text[1:] != text[:-1]) | (mark[1:] != mark[:-1])][:len(text)]
    return text[new], mark[new]


def shared_marks(docs: DataFrame, dests: int, run: int = RUN, reach: int = REACH) -> DataFrame:
    """(id, text_hash, n_shared) of the ``docs`` (doc_id, hash, text) that share marks with other rows,
    and how many. Rows with equal id and text are one row here, and share all they have."""
    schema = "dest int, batch long, low binary, mid binary, at binary, id binary, text_hash binary, known binary, n binary"
    shared = "batch long, id binary, text_hash binary, known binary, n binary"

    def arrays(rows: list, names: str, kinds: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in names.split(", ")])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        texts, marks_ = [], []
        size = number = 0

        def packed(dest, batch, mark, at, who, n):
            has = np.array([rows[i][0] is not None for i in who.tolist()], bool)
            ids = np.array([rows[i][0] or 0 for i in who.tolist()], np.int64)
            hashes = np.array([rows[i][1] for i in who.tolist()], np.int64)
            # The destination tells the rest of a mark, 48 bits of it are sent.
            low, mid = mark.astype(np.uint32), (mark >> U(32)).astype(np.uint16)
            return (dest, batch, low.tobytes(), mid.tobytes(), at.astype(np.uint16).tobytes(), ids.tobytes(), hashes.tobytes(), has.tobytes(), n.tobytes())

        def flush():
            nonlocal number
            batch = (TaskContext.get().partitionId() << 32) | number
            number += 1
            text, mark = np.concatenate(texts), np.concatenate(marks_)
            order = np.lexsort((text, mark))
            text, mark = text[order], mark[order]
            edge = np.flatnonzero(np.r_[True, mark[1:] != mark[:-1]][:len(mark)])
            count = np.diff(np.r_[edge, len(mark)])
            out = []
            here = np.bincount(text[np.repeat(count > 1, count)], minlength=len(rows))
            who = np.flatnonzero(here)
            if len(who):  # marks that two texts of this batch have
                out.append(packed(batch % dests, batch, np.zeros(0, U), np.zeros(0, np.uint16), who, here[who].astype(np.int64)))
            mark, text = mark[edge], np.where(count > 1, np.int64(SEVERAL), text[edge])
            dest = ((mark >> U(48)) % U(dests)).astype(np.int64)
            order = np.argsort(dest, kind="stable")
            cuts = np.searchsorted(dest[order], np.arange(dests + 1))
            for d in np.flatnonzero(np.diff(cuts)).tolist():
                own = order[cuts[d]:cuts[d + 1]]
                alone = text[own] != SEVERAL
                who, at = np.unique(text[own][alone], return_inverse=True)
                place = np.full(len(own), SEVERAL, np.int64)
                place[alone] = at
                out.append(packed(d, batch, mark[own], place, who, np.zeros(0, np.int64)))
            rows.clear(), texts.clear(), marks_.clear()
            return arrays(out, schema, (pa.int32(), pa.int64(), *[pa.binary()] * 7))

        for b in batches:
            ids, hashes = b.column(0).to_pylist(), b.column(1).to_pylist()
            for first, offsets, data in blocks(b.column(2)):
                text, mark = marks(offsets, data, run, reach)
                if len(mark):
                    have, text = np.unique(text, return_inverse=True)
                    texts.append(text + len(rows))
                    marks_.append(mark)
                    rows += [(ids[first + i], hashes[first + i]) for i in have.tolist()]
                size += len(data)
                if size >= GATHER_BYTES or len(rows) >= GATHER_TEXTS:
                    if rows:
                        yield flush()
                    size = 0
        if rows:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), *[pa.binary()] * 4)
        mark, dest, who, held = [], [], [], []
        count = 0
        for b in batches:
            for r in b.to_pylist():
                if not r["low"]:
                    yield arrays([[r[c] for c in ("batch", "id", "text_hash", "known", "n")]], shared, kinds)
                    continue
                at = np.frombuffer(r["at"], np.uint16).astype(np.int64)
                mark.append(np.frombuffer(r["low"], np.uint32).astype(U) | np.frombuffer(r["mid"], np.uint16).astype(U) << U(32))
                dest.append(np.full(len(at), r["dest"]))
                who.append(np.where(at == SEVERAL, -1, at + count))
                held.append((count, r))
                count += len(r["id"]) // 8
        if not mark:
            return
        mark, dest, who = np.concatenate(mark), np.concatenate(dest), np.concatenate(who)
        order = np.lexsort((mark, dest))
        mark, dest, who = mark[order], dest[order], who[order]
        edge = np.flatnonzero(np.r_[True, (mark[1:] != mark[:-1]) | (dest[1:] != dest[:-1])])
        size = np.diff(np.r_[edge, len(mark)])
        several = np.repeat(size > 1, size) & (who >= 0)  # every entry of a mark is of another batch
        n = np.bincount(who[several], minlength=count)
        for at, r in held:
            own = n[at:at + len(r["id"]) // 8]
            hit = own > 0
            if hit.any():  # one row for a batch and destination
                yield arrays([(r["batch"], *(np.frombuffer(r[c], t)[hit].tobytes() for c, t in (("id", np.int64), ("text_hash", np.int64), ("known", bool))), own[hit].tobytes())], shared, kinds)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[] for _ in range(5)]
        for b in batches:
            for r in b.to_pylist():
                k = len(r["id"]) // 8
                for to, v in zip(parts, (np.full(k, r["batch"]), np.frombuffer(r["known"], bool), np.frombuffer(r["id"], np.int64), np.frombuffer(r["text_hash"], np.int64), np.frombuffer(r["n"], np.int64)), strict=True):
                    to.append(v)
        if not parts[0]:
            return
        *keys, n = (np.concatenate(p) for p in parts)
        order = np.lexsort(keys)
        keys, n = [k[order] for k in keys], n[order]
        edge = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
        _, known, ids, hashes = (k[edge] for k in keys)
        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(hashes), pa.array(np.add.reduceat(n, edge))], ["id", "text_hash", "n"])

    found = docs.select("doc_id", "hash", "text").mapInArrow(send, schema).repartition(dests, "dest").mapInArrow(meet, shared)
    # A row of a batch has its number from all destinations added up; of repeated rows the largest counts.
    per = found.repartition(dests, "batch").mapInArrow(total, "id long, text_hash long, n long")
    return per.groupBy("id", "text_hash").agg(F.max("n").alias("n_shared"))
