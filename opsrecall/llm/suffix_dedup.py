"""Removes every long byte string that also starts somewhere else in the corpus.

A string of ``length`` bytes holds a sampled suffix: the place in it whose next ``HEAD``
bytes have the least hash. Equal strings hold the same one, so sampled suffixes are
compared first, by the hashes of their heads and of all that strings around them can
reach. What they leave open, near the ends of repeats, is settled on the strings
themselves: a task sorts its open suffixes, comparing two by a binary search for their
common extension over prefix polynomial hashes, in a mergesort; equal ones are checked
byte by byte, and one of each goes on to meet those of other tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from opsrecall.llm import passages
from opsrecall.llm.common import BASE, BYTE, INVERSE, U, mix, partitions, powers, text_bytes
from opsrecall.session import cut

LENGTH = 400
HEAD = 200
# Bytes of text that a task gathers before it sends on what it found.
GATHER_BYTES = 8 << 20

# What is known of a sampled suffix: its head is nowhere else; its head is elsewhere but
# not its surroundings; both are; the same, and it stands for its surroundings where
# others with this head are open.
UNIQUE, OPEN, REPEATED, SPEAKS = 0, 1, 2, 3


class Hashes:
    """Prefix polynomial hashes of a byte array."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.total = np.zeros(len(data) + 1, U)
        np.cumsum(BYTE[data] * powers(BASE, len(data)), out=self.total[1:])
        self.back = powers(INVERSE, max(1, len(data)))

    def of(self, start, size):
        """Hashes of the strings of ``size`` bytes from ``start``."""
        return (self.total[start + size] - self.total[start]) * self.back[start]

    def extension(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        """How many bytes the suffixes at a and b have in common, up to ``limit``, by binary search."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), limit, np.int64)
        low[self.of(a, limit) == self.of(b, limit)] = limit
        active = np.flatnonzero(low < high)
        while len(active):
            middle = (low[active] + high[active] + 1) // 2
            same = self.of(a[active], middle) == self.of(b[active], middle)
            low[active[same]] = middle[same]
            high[active[~same]] = middle[~same] - 1
            active = active[low[active] < high[active]]
        return low

    def compare(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        """-1, 0 or 1: the order of the suffixes at a and b by their first ``limit`` bytes."""
        common = self.extension(a, b, limit)
        order = np.zeros(len(a), np.int8)
        at = np.flatnonzero(common < limit)
        x, y = self.data[a[at] + common[at]], self.data[b[at] + common[at]]
        order[at] = np.where(x < y, -1, 1)
        return order


def suffix_sort(h: Hashes, starts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` in the order of the next ``limit`` bytes, and which equal the one before.

    The first 24 bytes are sorted as numbers. Where they tie, equal strings are taken
    together by hash, and the rest is a bottom-up mergesort of all ties at once: every
    element finds its rank in the neighbouring run by binary search.
    """
    step = np.lib.stride_tricks.sliding_window_view(h.data, 24)[starts]
    head = np.ascontiguousarray(step).view(">u8").astype(U)
    whole = h.of(starts, limit)
    order = np.lexsort((starts, whole, head[:, 2], head[:, 1], head[:, 0]))
    starts, head, whole = starts[order], head[order], whole[order]
    tie = np.zeros(len(starts), bool)
    tie[1:] = (head[1:] == head[:-1]).all(axis=1)
    twin = tie.copy()
    twin[1:] &= whole[1:] == whole[:-1]
    strings = np.lib.stride_tricks.sliding_window_view(h.data, limit)
    for some in np.array_split(np.flatnonzero(twin), max(1, int(twin.sum()) * limit >> 25)):  # hashes may collide
        twin[some[(strings[starts[some]] != strings[starts[some - 1]]).any(axis=1)]] = False
    lead = np.flatnonzero(~twin)  # one of each run of equal strings is merged, the others follow it
    group = np.cumsum(~tie)[lead]
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[begin, len(lead)])
    item = starts[lead].copy()
    run_of = np.arange(len(lead))
    width = 1
    while len(size) and width < size.max():
        where = np.concatenate([np.arange(b, b + s) for b, s in zip(begin[size > width].tolist(), size[size > width].tolist(), strict=True)])
        first, many = np.repeat(begin[size > width], size[size > width]), np.repeat(size[size > width], size[size > width])
        at = where - first
        run = at // width
        low = np.minimum((run ^ 1) * width, many)
        high = np.minimum(low + width, many)
        origin = low.copy()
        active = np.flatnonzero(low < high)
        while len(active):
            middle = (low[active] + high[active]) // 2
            order_ = h.compare(item[first[active] + middle], item[where[active]], limit)
            goes_on = (order_ < 0) | ((order_ == 0) & (run[active] & 1 == 1))
            low[active[goes_on]] = middle[goes_on] + 1
            high[active[~goes_on]] = middle[~goes_on]
            active = active[low[active] < high[active]]
        to = first + (run // 2) * 2 * width + (at - run * width) + (low - origin)
        moved, moved_run = item[where], run_of[where]
        item[to], run_of[to] = moved, moved_run
        width *= 2
    edges = np.r_[lead, len(starts)]
    lengths = np.diff(edges)[run_of]
    take = np.repeat(edges[run_of] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(len(starts))
    return starts[take], twin[take]


def _sliding(x: np.ndarray, width: int, op: np.ufunc, fill: int) -> np.ndarray:
    """The least or largest of every ``width`` neighbours, from running ones within blocks."""
    n = len(x)
    y = np.concatenate([x, np.full(-n % width, fill, x.dtype)]).reshape(-1, width)
    ahead = op.accumulate(y, axis=1).ravel()
    behind = op.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[:n - width + 1], ahead[width - 1:n])


def sampled_suffixes(data: np.ndarray, length: int = LENGTH, head: int = HEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, head hashes and surroundings hashes of the sampled suffixes of one text.

    A place is sampled if it has the least head hash of a window of ``length`` bytes, all
    that tie included, so equal windows sample equal places. The surroundings are what
    the windows over a place cover, cut at the ends of the text.
    """
    n, width = len(data), length - head + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U)
    h = Hashes(data)
    hashes = mix((h.total[head:] - h.total[:-head]) * h.back[:n - head + 1])
    least = _sliding(hashes, width, np.minimum, 0xFFFFFFFFFFFFFFFF)
    pad = np.zeros(width - 1, U)
    place = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), width, np.maximum, 0) == hashes)
    low, high = np.maximum(0, place - (length - head)), np.minimum(n, place + length)
    around = mix(h.of(low, high - low) + ((high - low).astype(U) << U(20)) + (place - low).astype(U))
    return place, hashes[place], around


def _sample(docs: DataFrame, dests: int, length: int) -> DataFrame:
    """Packed rows: ``dest`` -1 holds the texts and their places, others the distinct
    (head, surroundings) of a batch of texts by destination."""
    schema = "flush long, dest int, a binary, b binary, c binary, d binary, e binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, known, texts, place, head, around, count = [], [], [], [], [], [], []
        total = 0

        def flush():
            heads, surround = np.concatenate(head), np.concatenate(around)
            order = np.lexsort((surround, heads))
            x, y = heads[order], surround[order]
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            number_of = np.cumsum(new) - 1
            x, y = x[new], y[new]
            several = np.bincount(number_of, minlength=len(x)) > 1
            dest = (x >> U(24)) % U(dests)
            by = np.argsort(dest, kind="stable")
            rank = np.empty(len(x), np.int64)
            rank[by] = np.arange(len(x))
            ref = np.empty(len(heads), np.uint32)
            ref[order] = rank[number_of]
            x, y, several = x[by], y[by], several[by]
            edge = np.searchsorted(dest[by], np.arange(dests + 1, dtype=U))
            out = [(-1, np.array(ids, np.int64).tobytes(), np.array(known, bool).tobytes() + np.array(texts, np.int64).tobytes(),
                    np.concatenate(place).astype(np.uint32).tobytes(), ref.tobytes(), np.array(count, np.int32).tobytes())]
            out += [(d, x[edge[d]:edge[d + 1]].tobytes(), y[edge[d]:edge[d + 1]].tobytes(), several[edge[d]:edge[d + 1]].tobytes(), b"", b"")
                    for d in range(dests) if edge[d] < edge[d + 1]]
            cols = list(zip(*out, strict=True))
            for v in (ids, known, texts, place, head, around, count):
                v.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([number] * len(out), pa.int64()), pa.array(cols[0], pa.int32()), *(pa.array(v, pa.binary()) for v in cols[1:])],
                ["flush", "dest", "a", "b", "c", "d", "e"])

        for b in batches:
            offsets, data = text_bytes(b.column(2))
            for i, (doc, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                p, h, s = sampled_suffixes(data[offsets[i]:offsets[i + 1]], length)
                if len(p):
                    ids.append(doc or 0)
                    known.append(doc is not None)
                    texts.append(text)
                    place.append(p)
                    head.append(h)
                    around.append(s)
                    count.append(len(p))
                    total += int(offsets[i + 1] - offsets[i])
                    if total >= GATHER_BYTES:
                        yield flush()
                        total, number = 0, number + 1
        if ids:
            yield flush()

    return docs.mapInArrow(run, schema)


def _answers(asked: DataFrame, dests: int) -> DataFrame:
    """What is known of every (head, surroundings), in the order in which a flush sent them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush, dest, head, around, several = [], [], [], [], []
        for b in batches:
            for r in b.to_pylist():
                flush.append(r["flush"])
                dest.append(r["dest"])
                head.append(np.frombuffer(r["a"], U))
                around.append(np.frombuffer(r["b"], U))
                several.append(np.frombuffer(r["c"], bool))
        if not flush:
            return
        sizes = [len(x) for x in head]
        heads, surround, several = np.concatenate(head), np.concatenate(around), np.concatenate(several)
        order = np.lexsort((surround, heads))
        x, y, n = heads[order], surround[order], several[order].astype(np.int64) + 1
        new_head = np.r_[True, x[1:] != x[:-1]]
        new = new_head | np.r_[True, y[1:] != y[:-1]]
        class_, head_ = np.cumsum(new) - 1, np.cumsum(new_head) - 1
        in_class, in_head = np.bincount(class_, n), np.bincount(head_, n)
        state = np.where(in_head[head_] < 2, UNIQUE, np.where(in_class[class_] < 2, OPEN, REPEATED)).astype(np.uint8)
        mixed = np.bincount(head_, state == OPEN) > 0
        state[new & (state == REPEATED) & mixed[head_]] = SPEAKS
        back = np.empty(len(state), np.uint8)
        back[order] = state
        at = 0
        for f, d, size in zip(flush, dest, sizes, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int64()), pa.array([d], pa.int32()), pa.array([back[at:at + size].tobytes()], pa.binary())], ["flush", "dest", "a"])
            at += size

    return asked.repartition(dests, "dest").mapInArrow(run, "flush long, dest int, a binary")


def _by_text(sampled: DataFrame, answers: DataFrame, dests: int) -> DataFrame:
    """(id, text_hash, place, state) of every text with a place whose head is elsewhere too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, states = None, []

        def texts():
            state = np.frombuffer(b"".join(states), np.uint8)
            ids = np.frombuffer(own["a"], np.int64)
            known, hashes = np.frombuffer(own["b"][:len(ids)], bool), np.frombuffer(own["b"][len(ids):], np.int64)
            place, ref, count = np.frombuffer(own["c"], np.uint32), np.frombuffer(own["d"], np.uint32), np.frombuffer(own["e"], np.int32)
            mine = state[ref].copy()
            speaks = np.flatnonzero(mine == SPEAKS)  # of copies in one flush the first speaks for all
            later = np.ones(len(speaks), bool)
            later[np.unique(ref[speaks], return_index=True)[1]] = False
            mine[speaks[later]] = REPEATED
            edge = np.r_[0, np.cumsum(count)]
            some = [i for i in range(len(ids)) if mine[edge[i]:edge[i + 1]].any()]
            return pa.RecordBatch.from_arrays(
                [pa.array([int(ids[i]) if known[i] else None for i in some], pa.int64()), pa.array([int(hashes[i]) for i in some], pa.int64()),
                 pa.array([place[edge[i]:edge[i + 1]].tobytes() for i in some], pa.binary()), pa.array([mine[edge[i]:edge[i + 1]].tobytes() for i in some], pa.binary())],
                ["id", "text_hash", "place", "state"])

        for b in batches:
            for r in b.to_pylist():
                if r["dest"] == -1:
                    if own:
                        yield texts()
                    own, states = r, []
                else:
                    states.append(r["a"])
        if own:
            yield texts()

    empty = F.lit(None).cast("binary")
    told = answers.select("flush", "dest", "a", *(empty.alias(c) for c in "bcde"))
    rows = sampled.where("dest = -1").unionByName(told).repartition(dests, "flush").sortWithinPartitions("flush", "dest")
    return rows.mapInArrow(run, "id long, text_hash long, place binary, state binary")


def _one_each(info: DataFrame) -> DataFrame:
    """One row for each (id, text_hash): of equal rows, each may speak at other places, so
    every place has the largest of its states."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            state = [s[0] if len(s) == 1 else np.maximum.reduce([np.frombuffer(x, np.uint8) for x in s]).tobytes() for s in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(state, pa.binary())], ["id", "text_hash", "place", "state"])

    rows = info.groupBy("id", "text_hash").agg(F.max("place").alias("place"), F.collect_set("state").alias("states"))
    return rows.mapInArrow(run, "id long, text_hash long, place binary, state binary")


def _covered(places: np.ndarray, low: int, n: int) -> np.ndarray:
    """Which of the windows that start at 0 .. n - 1 hold one of ``places``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.minimum(np.maximum(0, places - low), n), 1)
    np.add.at(edge, np.minimum(places + 1, n), -1)
    return np.cumsum(edge[:n]) > 0


def _owned(place: np.ndarray, value: np.ndarray, low: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last start of the windows of which each place is the sampled
    suffix: the first with the least hash."""
    before, after = np.full(len(place), -1), np.full(len(place), n + low + 1)
    stack: list[int] = []
    at, values = place.tolist(), value.tolist()
    for i in range(len(at)):
        while stack and values[stack[-1]] > values[i]:
            after[stack.pop()] = at[i]
        if stack:
            before[i] = at[stack[-1]]
        stack.append(i)
    return np.maximum(np.maximum(place - low, before + 1), 0), np.minimum(np.minimum(place + 1, after - low), n)


def _open_strings(texts: DataFrame, dests: int, length: int) -> DataFrame:
    """Hashes of the strings that sampled suffixes leave open, and of those that can settle
    them, packed by destination; a task sends equal ones once. ``dest`` is drawn for
    strings that are settled within the task, which have no hash."""
    schema = "dest int, hash binary, at binary, start binary, id binary, text_hash binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, marks, ids, base = [], [], [], []

        def flush():
            h = Hashes(np.concatenate(data))
            starts, asks, low = [], [], length - HEAD
            for text, (place, state), at in zip(data, marks, base, strict=True):
                n = len(text) - length + 1
                first, past = _owned(place, mix(h.of(place + at, HEAD)), low, n)
                sure = _covered(place[state >= REPEATED], low, n)
                for k in np.flatnonzero(((state == OPEN) | (state == SPEAKS)) & (first < past)).tolist():
                    starts.append(np.arange(first[k], past[k]) + at)
                    asks.append(~sure[first[k]:past[k]] if state[k] == OPEN else np.zeros(past[k] - first[k], bool))
            begin = np.concatenate(starts) if starts else np.zeros(0, np.int64)
            if not len(begin):
                for v in (data, marks, ids, base):
                    v.clear()
                return
            asking = np.concatenate(asks)
            rows, twin = suffix_sort(h, begin, length)
            who = asking[np.searchsorted(begin, rows)]
            run_no = np.cumsum(~twin) - 1
            many = np.bincount(run_no) > 1
            speaks = np.bincount(run_no, ~who) > 0
            settled = who & (many | speaks)[run_no]
            first = ~twin
            doc = np.searchsorted(base, rows, "right") - 1
            start = rows - np.array(base)[doc]
            hashes = mix(h.of(rows, length))
            out = []
            sure = (many | speaks)[run_no]
            flags = start.astype(np.uint32) | (sure.astype(np.uint32) << np.uint32(31))
            dest = (hashes >> U(24)) % U(dests)
            known = np.array([i[0] is not None for i in ids])
            numbers, texts_ = np.array([i[0] or 0 for i in ids], np.int64), np.array([i[1] for i in ids], np.int64)

            def packed(d, pick, with_hash):
                here, at = np.unique(doc[pick], return_inverse=True)
                out.append((d, hashes[pick].tobytes() if with_hash else b"", at.astype(np.uint16).tobytes(), flags[pick].tobytes(),
                            known[here].tobytes() + numbers[here].tobytes(), texts_[here].tobytes()))

            by = np.argsort(dest[first], kind="stable")
            pick = np.flatnonzero(first)[by]
            edge = np.searchsorted(dest[pick], np.arange(dests + 1, dtype=U))
            for d in range(dests):
                if edge[d] < edge[d + 1]:
                    packed(d, pick[edge[d]:edge[d + 1]], True)
            if settled.any():
                packed(int(hashes[0] % U(dests)), np.flatnonzero(settled), False)
            cols = list(zip(*out, strict=True))
            for v in (data, marks, ids, base):
                v.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), *(pa.array(v, pa.binary()) for v in cols[1:])], ["dest", "hash", "at", "start", "id", "text_hash"])

        size = 0
        for b in batches:
            offsets, text = text_bytes(b.column(2))
            places, states = b.column(3).to_pylist(), b.column(4).to_pylist()
            for i, (doc, text_hash) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                own = text[offsets[i]:offsets[i + 1]]
                data.append(own)
                marks.append((np.frombuffer(places[i], np.uint32).astype(np.int64), np.frombuffer(states[i], np.uint8)))
                ids.append((doc, text_hash))
                base.append(size)
                size += len(own)
                if size >= GATHER_BYTES:
                    yield from flush()
                    size = 0
        if ids:
            yield from flush()

    return texts.mapInArrow(run, schema).repartition(dests, "dest")


def _settled(strings: DataFrame) -> DataFrame:
    """(id, text_hash, starts) of the open strings that are repeated."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, flags, ids, texts, known, settled = [], [], [], [], [], []

        def unpack(r):
            at, flag = np.frombuffer(r["at"], np.uint16), np.frombuffer(r["start"], np.uint32)
            n = len(r["text_hash"]) // 8
            return (flag, np.frombuffer(r["id"][n:], np.int64)[at], np.frombuffer(r["text_hash"], np.int64)[at], np.frombuffer(r["id"][:n], bool)[at])

        def rows(flag, doc, text, has):
            order = np.lexsort((flag, text, doc, has))
            flag, doc, text, has = flag[order], doc[order], text[order], has[order]
            edge = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (has[1:] != has[:-1])])
            pieces = np.split(flag & np.uint32(0x7FFFFFFF), edge[1:])
            return pa.RecordBatch.from_arrays(
                [pa.array([int(doc[e]) if has[e] else None for e in edge], pa.int64()), pa.array(text[edge]), pa.array([p.tobytes() for p in pieces], pa.binary())],
                ["id", "text_hash", "starts"])

        for b in batches:
            for r in b.to_pylist():
                u = unpack(r)
                if not r["hash"]:
                    yield rows(*u)
                    continue
                hashes.append(np.frombuffer(r["hash"], U))
                for to, v in zip((flags, ids, texts, known), u, strict=True):
                    to.append(v)
        if hashes:
            h = np.concatenate(hashes)
            order = np.argsort(h, kind="stable")
            flag, doc, text, has = (np.concatenate(v)[order] for v in (flags, ids, texts, known))
            h = h[order]
            run_no = np.cumsum(np.r_[True, h[1:] != h[:-1]]) - 1
            sure = flag >> np.uint32(31) == 1
            dup = (np.bincount(run_no) > 1) | (np.bincount(run_no, sure) > 0)
            pick = dup[run_no] & ~sure  # a sure one is settled where it was sent
            if pick.any():
                yield rows(flag[pick], doc[pick], text[pick], has[pick])

    return strings.mapInArrow(run, "id long, text_hash long, starts binary")


def _kept(rows: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = text_bytes(b.column(1))
            out, left = [], []
            for i, (place, state, starts) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
                own = data[offsets[i]:offsets[i + 1]]
                n = len(own)
                edge = np.zeros(n + 1, np.int64)
                if place:
                    p = np.frombuffer(place, np.uint32).astype(np.int64)[np.frombuffer(state, np.uint8) >= REPEATED]
                    np.add.at(edge, np.maximum(0, p - (length - HEAD)), 1)
                    np.add.at(edge, np.minimum(n, p + length), -1)
                for s in starts or ():
                    s = np.frombuffer(s, np.uint32).astype(np.int64)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + length, -1)
                gone = np.cumsum(edge[:n]) > 0
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(n > 0 and gone[0])
                kept = own[~gone].tobytes() if spans else own.tobytes()
                out.append((n, n - len(kept), spans, hashlib.sha256(kept).hexdigest()))
                left.append(kept)
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(left, pa.binary()), b.column(5)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "n_shared"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, n_shared long")


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, n_shared), one row for every row of ``docs``.

    Texts are UTF-8 bytes, null is empty. Every byte of a string of ``length`` bytes that
    starts at two places or more, in one text or two, is removed; strings are judged on
    the input. Matches never cross texts. Repeated rows remove each other, a null id is
    an id like others, shorter texts stay whole, an empty table gives no rows, and other
    columns are not read. ``length`` is above 200. What a task holds is bounded by a
    batch of texts, or by its share of the sampled suffixes; a head in very many texts
    is sent once by each batch. ``n_shared`` tells of passages too short to be removed: it
    counts sampled runs of words that stand in another row too (``passages.py``).
    """
    dests = partitions(docs.sparkSession)
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    sampled = cut(_sample(docs, dests, length))
    info = cut(_one_each(_by_text(sampled, _answers(sampled.where("dest >= 0"), dests), dests)))
    joined = docs.join(info, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("text_hash")), "left")
    unsure = joined.where(F.col("id").isNotNull() | F.col("place").isNotNull())
    unsure = unsure.where(F.expr("instr(hex(state), '01') > 0 OR instr(hex(state), '03') > 0"))
    settled = _settled(_open_strings(unsure.select("doc_id", "hash", "text", "place", "state"), dests, length))
    starts = settled.groupBy("id", "text_hash").agg(F.collect_list("starts").alias("starts"))
    starts = starts.select(F.col("id").alias("sid"), F.col("text_hash").alias("shash"), "starts")
    rows = joined.join(starts, F.col("doc_id").eqNullSafe(F.col("sid")) & (F.col("hash") == F.col("shash")), "left")
    shared = passages.shared_marks(docs, dests).select(F.col("id").alias("pid"), F.col("text_hash").alias("phash"), "n_shared")
    rows = rows.join(shared, F.col("doc_id").eqNullSafe(F.col("pid")) & (F.col("hash") == F.col("phash")), "left")
    return _kept(rows.select("doc_id", "text", "place", "state", "starts", F.coalesce("n_shared", F.lit(0)).alias("n_shared")), length)
