"""Near duplicates by Jaccard similarity of word shingles, through parity sketches.

Every shingle is a 64-bit hash. A parity sketch is the XOR of all hashes of a set, part
by part: two sets that differ in d shingles differ in at most d parts. At a similarity
of t the sets differ in at most (|A| + |B|) (1 - t) / (1 + t) shingles, so a band of
sizes whose sketches have more parts than that must agree on a part (pigeonhole). Sets
are joined on (band, part, value); empty parts are no keys, so a set with too few others
is joined on its shingles besides. A second sketch of single bits then bounds the
difference from below by its Hamming distance, one of more bits does so again, and what
remains is verified exactly, unless closer pairs have put both sets in one component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from opsrecall.llm.common import U, mix, partitions
from opsrecall.llm.shingles import shingle_sets
from opsrecall.operators.graphs import connected_components
from opsrecall.session import cut

# Width of a size band, largest over smallest size.
BAND = 1.6
# Groups of up to this size are compared pairwise, larger ones against one member first.
SMALL = 16
# Members of a large group that all others are compared with first.
LEADERS = 3
# After these, each outsider of a large group is compared with its closest others, so that
# most have joined a component before all that are in different ones are compared.
CLOSEST = (8,)
# Rows of one side of a comparison in a large group.
SIDE = 1024
# Bytes of sets that one task verifies, about.
VERIFY_BYTES = 48 << 20
# Bits of the filter on the ids of texts to verify: 2 MB.
SLOT_BITS = 24
# Bits for an element of the sketches that pairs must agree on before whole sets are sent. At a similarity of 0.75
# sketches of one bit let pairs from about 0.65 pass, of four bits from about 0.73.
FINE = 4
# Tells the keys of single shingles from those of parts.
SHINGLE = U(0x9FB21C651E98DF25)
# Sketch entries a task gathers before it sends them on.
FLUSH = 1 << 21


def _set_id(x: np.ndarray) -> int:
    return int((mix(x).sum(dtype=U) ^ U(len(x))).astype(np.int64))


def bit_sketch(x: np.ndarray, dense: int = 1) -> bytes:
    """Parity bits, at least ``dense`` for every element, at least 512: a power of two."""
    bits = max(512, dense << (max(len(x), 1) - 1).bit_length())
    odd = np.bincount((x & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch of the same set with fewer bits: halves laid over each other."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, U).reshape(-1, size // 8), axis=0)


def most_differing(n, m, percent: int):
    """The most elements in which two sets of these sizes may differ and still be similar."""
    return (n + m) * (100 - percent) // (100 + percent)


def part_keys(x: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the non-empty parts of the sketches of a set, for its own band of sizes and,
    where a partner may be in it, the next one.

    A set with more non-empty parts than it may differ in meets all that are similar. One
    with fewer has its shingles as keys too: two such sets that are similar share one.
    """
    n = len(x)
    band = int(math.log(n) / math.log(BAND) + 1e-9)
    keys, poor = [], False
    for b in (band, band + 1):
        if b > band and 100 * n < percent * BAND ** b:
            continue
        largest = math.ceil(BAND ** (b + 1))
        parts = int(1.1 * most_differing(largest, largest, percent)) + 6
        value = np.zeros(parts, U)
        np.bitwise_xor.at(value, (((x >> U(32)) * U(parts)) >> U(32)).astype(np.int64), x)
        full = np.flatnonzero(value)
        keys.append(mix(value[full] ^ mix(full.astype(U) + U(b << 40))))
        poor |= len(full) <= most_differing(n, min(largest, 100 * n // percent), percent)
    if poor:
        keys.append(mix(x ^ SHINGLE))
    return np.concatenate(keys)


def _join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by sorting, whatever the size. Turning the many joins of small tables into broadcasts
    costs the driver a job, a thread and buffers each, and nothing is gained where tables are large."""
    return left.join(right.hint("merge"), on, how)


def shingle_rows(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, c, sketch, fine): set size, a 64-bit id of the set, its bit sketch and one of ``FINE`` times the bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, c, sketch, fine = [], [], [], []
            for x in shingle_sets(b.column(1), size):
                n.append(len(x))
                c.append(_set_id(x))
                fine.append(bit_sketch(x, FINE) if len(x) else b"")
                sketch.append(bit_sketch(x) if len(x) else b"")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(sketch, pa.binary()), pa.array(fine, pa.binary())],
                ["doc_id", "n", "c", "sketch", "fine"])

    return docs.mapInArrow(run, f"doc_id {docs.schema[0].dataType.simpleString()}, n long, c long, sketch binary, fine binary")


def _entries(docs: DataFrame, size: int, percent: int, dests: int) -> DataFrame:
    """Sketch keys packed by destination; equal sets of one task are sent once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys: list[np.ndarray] = []
        ids: list[int] = []
        sizes: list[int] = []

        def flush():
            key = np.concatenate(keys)
            who = np.repeat(np.arange(len(ids)), [len(k) for k in keys])
            dest = (key >> U(32)) % U(dests)
            order = np.argsort(dest, kind="stable")
            edge = np.searchsorted(dest[order], np.arange(dests + 1, dtype=U))
            low, who = (key & U(0xFFFFFFFF)).astype(np.uint32)[order], who[order]
            c, n = np.array(ids, np.int64), np.array(sizes, np.int32)
            out = []
            for d in range(dests):
                if edge[d] < edge[d + 1]:
                    here, at = np.unique(who[edge[d]:edge[d + 1]], return_inverse=True)
                    out.append((d, low[edge[d]:edge[d + 1]].tobytes(), at.astype(np.uint16).tobytes(), c[here].tobytes(), n[here].tobytes()))
            keys.clear(), ids.clear(), sizes.clear()
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), *(pa.array(x, pa.binary()) for x in cols[1:])], ["dest", "low", "at", "c", "n"])

        total = 0
        for b in batches:
            for x in shingle_sets(b.column(0), size):
                if len(x) and (c := _set_id(x)) not in seen:
                    seen.add(c)
                    keys.append(part_keys(x, percent))
                    ids.append(c)
                    sizes.append(len(x))
                    total += len(keys[-1])
                    if total >= FLUSH or len(ids) == 1 << 16:
                        yield flush()
                        total = 0
        if ids:
            yield flush()

    return docs.mapInArrow(run, "dest int, low binary, at binary, c binary, n binary").repartition(dests, "dest")


def _groups(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of small groups that share a key, at size 0, and of large groups the
    size and every member (key, a), with the least hash of them all as b and a signature of
    the members as sig."""
    schema = "size long, key long, a long, b long, n long, sig long"
    columns = ["size", "key", "a", "b", "n", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, c, n = [], [], []
        for b in batches:
            for r in b.to_pylist():
                low, at = np.frombuffer(r["low"], np.uint32), np.frombuffer(r["at"], np.uint16)
                key.append(low.astype(U) | U(r["dest"] << 32))
                c.append(np.frombuffer(r["c"], np.int64)[at])
                n.append(np.frombuffer(r["n"], np.int32)[at])
        if not key:
            return
        key, c, n = np.concatenate(key), np.concatenate(c), np.concatenate(n)
        order = np.argsort(key, kind="stable")
        key = key[order]
        twin = np.zeros(len(key), bool)
        twin[1:] = key[1:] == key[:-1]
        twin[:-1] |= twin[1:]
        key, order = key[twin], order[twin]
        c, n = c[order], n[order]
        order = np.lexsort((c, key))
        key, c, n = key[order], c[order], n[order]
        if not len(key):
            return
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (c[1:] != c[:-1])
        key, c, n = key[fresh], c[fresh], n[fresh].astype(np.int64)
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[start, len(key)])
        group = np.repeat(count, count)
        hashed = mix(c.astype(U))
        lead = np.repeat(np.minimum.reduceat(hashed, start), count).astype(np.int64)
        sig = mix(np.add.reduceat(hashed, start)) ^ np.bitwise_xor.reduceat(mix(hashed ^ SHINGLE), start)
        sig = np.repeat(sig, count).astype(np.int64)
        large = group > SMALL
        first, second = [], []
        for k in range(1, SMALL):
            if k >= len(key):
                break
            i = np.flatnonzero((key[k:] == key[:-k]) & ~large[k:])
            i = i[100 * np.minimum(n[i], n[i + k]) >= percent * np.maximum(n[i], n[i + k])]
            first.append(c[i])
            second.append(c[i + k])
        pairs = np.unique(np.stack([np.concatenate(first), np.concatenate(second)], 1), axis=0) if first else np.zeros((0, 2), np.int64)
        step = 1 << 16
        for s in range(0, len(pairs), step):
            p = pairs[s:s + step]
            zero = np.zeros(len(p), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (zero, zero, p[:, 0].copy(), p[:, 1].copy(), zero, zero)], columns)
        members = [x[large] for x in (group, key.astype(np.int64), c, lead, n, sig)]
        for s in range(0, len(members[0]), step):
            yield pa.RecordBatch.from_arrays([pa.array(x[s:s + step]) for x in members], columns)

    return entries.mapInArrow(run, schema)


def _close(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose bit sketches don't rule out that they are similar."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = (b.column(i).to_numpy() for i in (2, 3))
            most = most_differing(n, m, percent)
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)):
                size = min(len(x), len(y))
                keep[i] = int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum()) <= most[i]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    one = sets.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = sets.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    sized = _join(_join(pairs, one, "a"), two, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return sized.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _slots(ids: DataFrame) -> np.ndarray:
    """A Bloom filter with one hash over the column ``slot``: bits, in bytes. Its size is fixed."""
    words = ids.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toPandas()
    full = np.zeros(1 << (SLOT_BITS - 6), np.int64)
    full[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return full.view(np.uint8)


def _met(pairs: DataFrame, sets: DataFrame, sent, compare, element_bytes: float) -> DataFrame:
    """Pairs (a, b, differ) with the difference that ``compare(x, y, n, m)`` finds in what is sent of both, if any.

    A pair is compared where the set of it that is in fewer pairs is at home, so what is sent of that
    set is sent once, and of a set that many are compared with once to each place instead of with
    every pair. ``sent(ids)`` gives (c, n, h) of at least the sets wanted, about ``element_bytes`` an element.
    """
    def run(place: tuple, pairs_: pa.Table, sets_: pa.Table) -> pa.Table:
        held = {c: (h.as_buffer(), n) for c, n, h in zip(sets_.column("c").to_pylist(), sets_.column("n").to_pylist(), sets_.column("h"), strict=True)}
        a, b = pairs_.column("a").to_pylist(), pairs_.column("b").to_pylist()
        differ = [compare(held[i][0], held[j][0], held[i][1], held[j][1]) for i, j in zip(a, b, strict=True)]
        out = pa.table({"a": pairs_.column("a"), "b": pairs_.column("b"), "differ": pa.array(differ, pa.int64())})
        return out.filter(pa.array([d is not None for d in differ], pa.bool_()))

    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("c"))
    often = cut(_join(ends.groupBy("c").agg(F.count(F.lit(1)).alias("degree")), sets.select("c", "n"), "c"))
    total = often.agg(F.sum(F.least("degree", F.lit(64)) * F.col("n")).alias("n")).first().n or 0
    places = max(partitions(pairs.sparkSession), -(-int(element_bytes * total) // VERIFY_BYTES))
    one, two = (often.select(F.col("c").alias(x), F.col("degree").alias(f"{x}_degree")) for x in ("a", "b"))
    first = (F.col("a_degree") < F.col("b_degree")) | ((F.col("a_degree") == F.col("b_degree")) & (F.col("a") < F.col("b")))
    home, other = F.when(first, F.col("a")).otherwise(F.col("b")), F.when(first, F.col("b")).otherwise(F.col("a"))

    def place(c) -> Column:
        return F.pmod(F.xxhash64(F.lit(7), c), F.lit(places)).cast("int")

    placed = cut(_join(_join(pairs, one, "a"), two, "b").select("a", "b", home.alias("home"), other.alias("other"), place(home).alias("place")))
    # Sets go to their own place; those that are compared elsewhere go there besides.
    abroad = cut(placed.where(place(F.col("other")) != F.col("place")).select(F.col("other").alias("c"), "place").distinct())
    at_home = placed.select(F.col("home").alias("c")).union(placed.where(place(F.col("other")) == F.col("place")).select("other")).distinct()
    both = sent(at_home).select(place(F.col("c")).alias("at"), "c", "n", "h").union(_join(sent(abroad.select("c").distinct()), abroad, "c").select("place", "c", "n", "h"))
    return placed.select("a", "b", "place").groupBy("place").cogroup(both.groupBy("at")).applyInArrow(run, "a long, b long, differ long").distinct()


def _finer(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, differ) that finer sketches don't rule out, and in how many bits these differ."""
    def sent(wanted: DataFrame) -> DataFrame:
        return _join(sets.select("c", "n", F.col("fine").alias("h")), wanted, "c", "left_semi")

    def compare(x, y, n: int, m: int) -> int | None:
        size = min(len(x), len(y))
        differ = int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum())
        return differ if differ <= most_differing(n, m, percent) else None

    return _met(pairs, sets, sent, compare, FINE / 5)


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) that are similar, by their whole sets.

    Only texts that may be wanted, by a Bloom filter of fixed size on ids, are hashed
    again and their sets sent on; a filter that is full lets all pass.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << SLOT_BITS))

    def sent(wanted: DataFrame) -> DataFrame:
        """The sets of at least the ids in ``wanted``, once from each task that has one."""
        bits = docs.sparkSession.sparkContext.broadcast(_slots(_join(sets.select("c", "doc_id"), wanted, "c", "left_semi").select(slot.alias("slot"))))

        def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for b in batches:
                at = b.column(0).to_numpy()
                b = b.filter(pa.array((bits.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
                c, n, h = [], [], []
                for x in shingle_sets(b.column(1), size):
                    if (k := _set_id(x)) not in seen:
                        seen.add(k)
                        c.append(k)
                        n.append(len(x))
                        h.append(x.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(n, pa.int64()), pa.array(h, pa.binary())], ["c", "n", "h"])

        return docs.select(slot.alias("slot"), "text").mapInArrow(hashes, "c long, n long, h binary")

    def compare(x, y, n: int, m: int) -> int | None:
        x, y = sorted((np.frombuffer(x, U), np.frombuffer(y, U)), key=len)
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        both = int((y[at] == x).sum())
        return 0 if 100 * both >= percent * (len(x) + len(y) - both) else None

    return _met(pairs, sets, sent, compare, 8).select("a", "b")


def _nearest(pairs: DataFrame) -> DataFrame:
    """Of every set in pairs (a, b, differ) the pair that differs least."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("c"), F.struct("differ", "a", "b").alias("pair"))
    return ends.groupBy("c").agg(F.min("pair").alias("pair")).select("pair.a", "pair.b").distinct()


def _open(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) that are not in one component yet."""
    one, two = (roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in ("a", "b"))
    known = _join(_join(pairs, one, "a", "left"), two, "b", "left")
    return known.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")


def _sides(size):
    return F.ceil(size / SIDE).cast("int")


def _laid(members: DataFrame) -> DataFrame:
    """(joint, key, c, n, sides): members of large groups and into how many sides a group is cut.

    Near copies share many keys, and the same member leads most of these. Groups with the
    same leader are laid together where that sends fewer rows, so that a pair meets once.
    """
    together = members.select("lead", "c", "n").distinct()
    apart = members.groupBy("lead").agg(F.sum(_sides(F.col("size"))).alias("sent"))
    joint = (
        _join(together.groupBy("lead").agg(F.count(F.lit(1)).alias("size")), apart, "lead").withColumn("sides", _sides(F.col("size")))
        .where("size * sides <= sent").select("lead", "sides")
    )
    return _join(together, joint, "lead").select(F.lit(True).alias("joint"), F.col("lead").alias("key"), "c", "n", "sides").union(
        _join(members, joint, "lead", "left_anti").select(F.lit(False), "key", "c", "n", _sides(F.col("size"))))


def _across(laid: DataFrame, roots: DataFrame, sets: DataFrame, percent: int, dests: int, closest: int = 0) -> DataFrame:
    """Pairs of large groups whose members are not yet in one component, in blocks of rows:
    all that their sketches allow or, of every member outside the group's largest
    component, those with the ``closest`` sketches.

    A group is cut into sides, and its outsiders into turns as well. Outsiders ask at every
    side, a turn at a time, and are compared there with the members whose side it is, so a
    block holds no more than a side and a turn."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()

        def pairs(rows: list[dict]) -> pa.RecordBatch:
            rows.sort(key=lambda r: (r["n"], r["c"]))
            size = min(len(r["sketch"]) for r in rows)
            sketch = np.stack([_folded(r["sketch"], size) for r in rows])
            n, c, root, own, asks = (np.array([r[k] for r in rows]) for k in ("n", "c", "root", "own", "asks"))
            a, b = [], []
            for x in np.flatnonzero(asks):
                first, last = np.searchsorted(n * 100, n[x] * percent), np.searchsorted(n, n[x] * 100 // percent, "right")
                y = np.arange(first, last)
                y = y[own[y] & (root[y] != root[x])]
                differ = np.bitwise_count(sketch[y] ^ sketch[x]).sum(axis=1, dtype=np.int64)
                if closest:
                    near = np.argsort(differ, kind="stable")[:closest]
                    y, differ = y[near], differ[near]
                y = y[differ <= most_differing(n[x], n[y], percent)]
                a.append(np.minimum(c[x], c[y]))
                b.append(np.maximum(c[x], c[y]))
            found = set(zip(np.concatenate(a).tolist(), np.concatenate(b).tolist(), strict=True)) - sent if a else set()
            if len(sent) > 1 << 20:  # only saves repeats
                sent.clear()
            sent.update(found)
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        rows: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if rows and any(r[k] != rows[0][k] for k in ("joint", "key", "i", "j")):
                    yield pairs(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield pairs(rows)

    known = _join(laid, roots, laid["c"] == roots["node"], "left").select(*laid.columns, F.coalesce("root", "c").alias("root"))
    counts = known.groupBy("joint", "key", "root").agg(F.count(F.lit(1)).alias("m"))
    open_ = counts.groupBy("joint", "key").agg(
        F.max_by("root", F.struct("m", "root")).alias("main"), F.count(F.lit(1)).alias("roots"), (F.sum("m") - F.max("m")).alias("outsiders"))
    open_ = open_.where("roots > 1").select("joint", "key", "main", _sides(F.col("outsiders")).alias("turns"))
    side, turn, outsider = F.pmod(F.hash("c"), F.col("sides")), F.pmod(F.hash(F.lit(1), "c"), F.col("turns")), F.col("root") != F.col("main")
    at_home = F.transform(F.sequence(F.lit(0), F.col("turns") - 1), lambda j: F.struct(F.col("side").alias("i"), j.alias("j"), (F.col("outsider") & (j == F.col("turn"))).alias("asks"), F.lit(True).alias("own")))
    away = F.transform(F.filter(F.sequence(F.lit(0), F.col("sides") - 1), lambda i: F.col("outsider") & (i != F.col("side"))),
                       lambda i: F.struct(i.alias("i"), F.col("turn").alias("j"), F.lit(True).alias("asks"), F.lit(False).alias("own")))
    rows = _join(
        _join(known, open_, ["joint", "key"]).select("*", side.alias("side"), turn.alias("turn"), outsider.alias("outsider"))
        .select("joint", "key", "c", "n", "root", F.inline(F.concat(at_home, away))),
        sets.select("c", "sketch"), "c")
    block = ["joint", "key", "i", "j"]
    return rows.repartition(dests, *block).sortWithinPartitions(*block).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for every row of ``docs``.

    Two documents link when 100 * |A and B| >= percent * |A or B| over their distinct
    shingles; component_id is the least id reachable by links. Null and wordless texts
    have no shingles and are their own component; repeated rows and equal texts share
    one; a null id takes part by its text and never becomes a component's id unless it
    is alone. Other columns of ``docs`` are not read; an empty table gives no rows.

    Groups of more than ``SMALL`` sets on a key are compared with ``LEADERS`` members, then
    outsiders with their closest others, and last every pair of members that are in
    different components by then, in blocks
    of ``SIDE`` rows, so that a large group costs little and no link is lost. Groups that
    the same member leads take these steps as one, where that sends fewer rows. A pair is
    sure to meet: by a part if one of its sets has more non-empty parts than the sets may
    differ in, otherwise by a shingle, which both then have among their keys.
    """
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    dests = partitions(docs.sparkSession)
    rows = cut(shingle_rows(docs, size))
    sets = cut(rows.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("fine").alias("fine")))
    rows = rows.select("doc_id", "n", "c")
    found = cut(_groups(_entries(docs.select("text"), size, percent, dests), percent))
    # Near copies share many keys, and many of these have the same members: one such key does.
    large = found.where("size > 0")
    several = large.groupBy("size", "sig").agg(F.min("key").alias("key"))
    members = cut(_join(large, several, ["size", "sig", "key"], "left_semi").select("size", "key", F.col("a").alias("c"), F.col("b").alias("lead"), "n"))
    lead = members.groupBy("key").agg(*(F.min(F.struct(F.xxhash64(F.lit(i), "c").alias("h"), "c", "n")).alias(f"lead{i}") for i in range(LEADERS)))
    lead = lead.select("key", F.explode(F.array(*(f"lead{i}" for i in range(LEADERS)))).alias("lead")).select("key", F.col("lead.c").alias("l"), F.col("lead.n").alias("m"))
    star = _join(members.select("key", "c", "n"), lead, "key").where((F.col("c") != F.col("l")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m")))
    star = star.select(F.least("c", "l").alias("a"), F.greatest("c", "l").alias("b"))
    near = found.where("size = 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    close = cut(_close(near.union(star).distinct(), sets, percent))
    # First of every set the pair that differs least; most others are in one component then.
    finer = cut(_finer(close, sets, percent))
    nearest = cut(_nearest(finer))
    links = cut(_verified(nearest, sets, docs, size, percent))
    roots = cut(connected_components(links))
    rest = cut(_open(_join(finer, nearest, ["a", "b"], "left_anti"), roots))
    if not rest.isEmpty():
        links = cut(links.union(_verified(rest, sets, docs, size, percent)))
        roots = cut(connected_components(links))
    laid = cut(_laid(members))
    for closest in (*CLOSEST, 0):
        more = cut(_join(_across(laid, roots, sets, percent, dests, closest), close, ["a", "b"], "left_anti"))
        if more.isEmpty():
            continue
        close = close.union(more)
        finer = cut(_finer(more, sets, percent))
        if finer.isEmpty():
            continue
        links = cut(links.union(_verified(finer.select("a", "b"), sets, docs, size, percent)).distinct())
        roots = cut(connected_components(links))
    least = _join(sets.select("c", "doc_id"), roots, sets["c"] == roots["node"]).groupBy("root").agg(F.min("doc_id").alias("component_id"))
    joined = _join(roots, least, "root").select(F.col("node").alias("c"), "component_id")
    alone = _join(sets.select("c", F.col("doc_id").alias("own")), joined, "c", "left").select("c", F.coalesce("component_id", "own").alias("component_id"))
    return _join(rows.select("doc_id", "n", "c"), alone, "c", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
