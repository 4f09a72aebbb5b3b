"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opsrecall.llm.common import BASE, INVERSE, LOWER, U, blocks, mix, partitions, powers
from opsrecall.session import cut

# Labelled rows of each label to learn from, the first by hash; a bound, so the index is bounded too.
EXAMPLES = 3000
# Terms in more than one in so many examples, up to a number, are columns of a matrix; others have postings.
COMMON, COLUMNS = 16, 2048
# Texts that are compared with the examples at once.
TOGETHER = 256
# More than rounding adds to a similarity in single precision.
ROUNDING = 1e-4
NEAREST = 25
# First bits of a hash that tell most unknown terms: 4 MB.
FILTER_BITS = 22
BLOCK = 256
# Votes of the base rate, so that a far neighbour cannot decide alone.
PRIOR = 0.5
# Lengths in bytes of the beginnings of a word that are terms besides the word.
PREFIXES = (4,)
# Nearest examples shown as evidence.
SHOWN = 3

LETTER = np.zeros(256, bool)
LETTER[128:] = True
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def terms(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """In blocks: the first row, then the row (from it) and the hash of every term.

    Terms are runs of letters, digits and other than ASCII bytes, A-Z lower-cased, and
    the beginnings of longer runs.
    """
    for first, offsets, data in blocks(texts):
        letter = LETTER[data]
        begins, ends = letter.copy(), letter.copy()
        begins[1:] &= ~letter[:-1]
        ends[:-1] &= ~letter[1:]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        begins[heads] = letter[heads]
        tails = offsets[1:][offsets[1:] > 0] - 1
        ends[tails] = letter[tails]
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        total = np.zeros(len(data) + 1, U)
        np.cumsum(LOWER[data] * powers(BASE, len(data)), out=total[1:])
        back = powers(INVERSE, max(len(data), 1))
        row = np.searchsorted(offsets, starts, "right") - 1
        size = stops - starts
        rows, hashes = [row], [mix((total[stops] - total[starts]) * back[starts] + size.astype(U))]
        for k in PREFIXES:
            s = starts[size > k]
            rows.append(row[size > k])
            hashes.append(mix((total[s + k] - total[s]) * back[s] + U(1000 + k)))
        yield first, np.concatenate(rows), np.concatenate(hashes)


class Lookup:
    """Places of hashes in a sorted list of known ones, most of them absent."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[(known >> U(64 - FILTER_BITS)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are known, and their places."""
        at = np.flatnonzero(self.maybe[(hashes >> U(64 - FILTER_BITS)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.known, hashes[at]), len(self.known) - 1)
        hit = self.known[place] == hashes[at]
        return at[hit], place[hit]


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + sizes[0] - 1, then the same of the next."""
    ends = np.cumsum(sizes)
    out = np.repeat(starts - ends + sizes, sizes)
    out += np.arange(len(out))
    return out


class BlockMaxIndex:
    """Examples in blocks, and for every common term the largest weight in each block.

    Rare terms are added up from postings. A block's columns of common terms are opened
    only for texts whose bound, the common terms times these maxima and the rare ones,
    reaches the similarity of the k-th nearest found so far. Those that can be among the
    k nearest are then compared again in double precision, so the result is exact and
    the same for equal texts.
    """

    def __init__(self, vectors, toxic: np.ndarray, weight: np.ndarray, n_terms: int = 0, ids: np.ndarray | None = None):
        """``vectors`` is a matrix, or the (edge, places, values) of its rows with ``n_terms`` columns; ``ids`` name the rows."""
        if isinstance(vectors, np.ndarray):
            rows, places = np.nonzero(vectors)
            n_terms, vectors = vectors.shape[1], (np.r_[0, np.cumsum(np.bincount(rows, minlength=len(vectors)))], places, vectors[rows, places])
        edge, places, values = vectors
        size = np.diff(edge)
        self.n, self.n_terms = len(size), n_terms
        row = np.repeat(np.arange(self.n), size)
        first = np.full(self.n, -1)  # examples with the same heaviest term are neighbours
        by = np.lexsort((places, values, row))
        first[row[by]] = places[by]
        order = np.lexsort((np.arange(self.n), first))
        take = _spans(edge[:-1][order], size[order])
        self.edge = np.r_[0, np.cumsum(size[order])]
        self.places, self.values = places[take].astype(np.int32), values[take].astype(np.float32)
        self.toxic, self.weight = toxic[order], weight[order]
        self.ids = (np.arange(self.n) if ids is None else ids)[order]
        self.ready = False

    def __getstate__(self):
        keep = ("n", "n_terms", "edge", "places", "values", "toxic", "weight", "ids")
        return {k: self.__dict__[k] for k in keep} | {"ready": False}

    def _prepare(self) -> None:
        """Lays out columns and postings, once in a process."""
        row = np.repeat(np.arange(self.n), np.diff(self.edge))
        count = np.bincount(self.places, minlength=self.n_terms)
        often = np.argsort(-count, kind="stable")[:COLUMNS]
        often = often[count[often] * COMMON > self.n]
        self.column = np.full(self.n_terms, -1)
        self.column[often] = np.arange(len(often))
        column = self.column[self.places]
        dense = column >= 0
        self.matrix = np.zeros((self.n, len(often)), np.float32)
        self.matrix[row[dense], column[dense]] = self.values[dense]
        self.heads = np.arange(0, self.n, BLOCK)
        self.largest = np.maximum.reduceat(self.matrix, self.heads, axis=0)
        places, row, values = self.places[~dense], row[~dense], self.values[~dense]
        by = np.argsort(places, kind="stable")
        self.post_row, self.post_value = row[by].astype(np.intp), values[by]
        self.post_size = np.bincount(places, minlength=self.n_terms)
        self.post_edge = np.r_[0, np.cumsum(self.post_size)]
        self.ready = True

    def nearest(self, places: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and similarities of the k nearest; of equal ones the first in the index."""
        return self.nearest_of([(places, values)], k)[0]

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if not self.n:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        if not self.ready:
            self._prepare()
        sims, common = np.zeros((len(queries), self.n), np.float32), np.zeros((len(queries), self.matrix.shape[1]), np.float32)
        for i, (places, values) in enumerate(queries):
            column = self.column[places]
            common[i, column[column >= 0]] = values[column >= 0]
            places, values = places[column < 0], values[column < 0]
            size = self.post_size[places]
            at = _spans(self.post_edge[places], size) if len(places) else np.zeros(0, np.int64)
            sims[i] = np.bincount(self.post_row[at], self.post_value[at] * np.repeat(values, size), self.n)
        bound = common @ self.largest.T + np.maximum.reduceat(sims, self.heads, axis=1)
        opened = np.zeros(bound.shape, bool)
        best = np.zeros((len(queries), k), np.float32)  # similarities, none of which is negative
        for j in np.argsort(-bound.sum(axis=0), kind="stable").tolist():
            here = slice(self.heads[j], self.heads[j] + BLOCK)
            who = np.flatnonzero(bound[:, j] >= best.min(axis=1) - ROUNDING)
            if len(who):
                own = sims[who, here] + common[who] @ self.matrix[here].T
                sims[who, here] = own
                opened[who, j] = True
                better = np.flatnonzero(own.max(axis=1) > best[who].min(axis=1))
                best[who[better]] = np.partition(np.concatenate([best[who[better]], own[better]], axis=1), -k, axis=1)[:, -k:]
        found = []
        full = np.zeros(self.n_terms)
        for i, (places, values) in enumerate(queries):
            rows = np.flatnonzero((sims[i] >= best[i].min() - ROUNDING) & (sims[i] > 0) & np.repeat(opened[i], BLOCK)[:self.n])
            if len(rows):
                full[places] = values
                size = self.edge[rows + 1] - self.edge[rows]
                at = _spans(self.edge[rows], size)
                exact = np.add.reduceat(full[self.places[at]] * self.values[at], np.r_[0, np.cumsum(size)[:-1]])
                full[places] = 0
                near = np.lexsort((rows, -exact))[:k]
                rows, exact = rows[near], exact[near]
                found.append((rows[exact > 0], exact[exact > 0]))
            else:
                found.append((rows, np.zeros(0)))
        return found


def _training(labels: DataFrame, id_column: str, label_column: str, learn_from) -> DataFrame:
    return labels.select(F.col(id_column).alias("doc_id"), F.col(label_column).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").where(learn_from(F.col("doc_id")))


def _sample(labels: DataFrame) -> DataFrame:
    """The first rows of each label by a hash of the id."""
    parts = [labels.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(y), "doc_id"), "doc_id").limit(EXAMPLES) for y in (0, 1)]
    return parts[0].union(parts[1])


def _counted(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of every text its distinct terms, as sorted hashes, and how often each is in it."""
    done = 0
    for first, row, h in terms(texts):
        edge = np.zeros(int(row.max(initial=-1)) + 2, np.int64)
        np.cumsum(np.bincount(row, minlength=len(edge) - 1), out=edge[1:])
        by = np.argsort(row, kind="stable")  # few runs that are in order
        row, h = row[by], h[by]
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            h[lo:hi].sort()
        new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])][:len(h)])
        count = np.diff(np.r_[new, len(h)])
        row, h = row[new] + first, h[new]
        for _ in range(done, first):
            yield h[:0], count[:0]
        done = max(done, first)
        last = int(row[-1]) + 1 if len(row) else done
        edge = np.searchsorted(row, np.arange(done, last + 1))
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            yield h[lo:hi], count[lo:hi]
        done = last
    for _ in range(done, len(texts)):
        yield np.zeros(0, U), np.zeros(0, np.int64)


def _weights(places: np.ndarray, counts: np.ndarray, idf: np.ndarray, other: float = 0.0) -> np.ndarray:
    """Weights of a vector of length 1, of which ``other`` is the square that other terms add to the length before."""
    v = (1 + np.log(counts)) * idf[places]
    norm = np.sqrt((v * v).sum() + other)
    return (v / norm if norm else v).astype(np.float32)


def _learned(examples: DataFrame) -> list[tuple[int, np.ndarray, np.ndarray, int]]:
    """(y, hashes, counts, id) of every example, in an order of their own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(_counted(b.column(1)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([h.tobytes() for h, _ in found], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in found], pa.binary()), b.column(2)], ["y", "h", "n", "id"])

    y, h, n, ids = examples.select("y", "text", F.col("doc_id").cast("long").alias("id")).mapInArrow(run, "y int, h binary, n binary, id long").toArrow().columns
    rows = [(a.as_py(), np.frombuffer(b.as_buffer(), U), np.frombuffer(c.as_buffer(), np.int32), d.as_py()) for a, b, c, d in zip(y, h, n, ids, strict=True)]
    return sorted(rows, key=lambda r: (r[0], len(r[1]), int(r[1].sum(dtype=U)), int((mix(r[1]) * r[2].astype(U)).sum(dtype=U)), r[3]))


def _frequencies(docs: DataFrame, known, dests: int) -> tuple[np.ndarray, int]:
    """In how many of ``docs`` each known term is, and how many there are. Counts are packed by ranges of terms."""
    schema = "dest int, docs long, place binary, df binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, n = known.value, 0
        df = np.zeros(len(lookup.known), np.int64)
        for b in batches:
            n += b.num_rows
            for h, _ in _counted(b.column(0)):
                df[lookup(h)[1]] += 1
        at = np.flatnonzero(df)
        edge = np.searchsorted(at, np.arange(dests + 1) * len(df) // dests)
        cut_ = [slice(edge[d], edge[d + 1]) for d in range(dests)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dests), pa.int32()), pa.array([n] + [0] * (dests - 1), pa.int64()),
             pa.array([at[c].astype(np.int32).tobytes() for c in cut_], pa.binary()), pa.array([df[at[c]].tobytes() for c in cut_], pa.binary())], ["dest", "docs", "place", "df"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(known.value.known), np.int64), 0
        for b in batches:
            for r in b.to_pylist():
                n += r["docs"]
                df[np.frombuffer(r["place"], np.int32)] += np.frombuffer(r["df"], np.int64)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([n], pa.int64()), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([df[at].tobytes()], pa.binary())], ["dest", "docs", "place", "df"])

    df, n = np.zeros(len(known.value.known), np.int64), 0
    for r in docs.select("text").mapInArrow(count, schema).repartition(dests, "dest").mapInArrow(add, schema).collect():
        n += r.docs
        df[np.frombuffer(r.place, np.int32)] += np.frombuffer(r.df, np.int64)
    return df, n


def calibration(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the log odds of a share of votes, fitted to the labels of ``weight`` rows each."""
    x = np.log(np.clip(raw, 1e-4, 1 - 1e-4) / (1 - np.clip(raw, 1e-4, 1 - 1e-4)))
    at = np.array([1.0, 0.0])

    def loss(at: np.ndarray) -> float:
        z = at[0] * x + at[1]
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * ((at - [1, 0]) ** 2).sum())

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(at[0] * x + at[1], -30, 30)))
        w = weight * p * (1 - p)
        g = np.array([(weight * (p - y) * x).sum(), (weight * (p - y)).sum()]) + at - [1, 0]
        h = np.array([[(w * x * x).sum(), (w * x).sum()], [(w * x).sum(), w.sum()]]) + np.eye(2)
        step = np.linalg.solve(h, g)
        while np.abs(step).max() > 1e-9 and loss(at - step) > loss(at):
            step /= 2
        if np.abs(step).max() <= 1e-9:
            break
        at = at - step
    return float(max(at[0], 1e-3)), float(at[1])


def scores(docs: DataFrame, labels: DataFrame, learn_from, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> DataFrame:
    """(doc_id, score, nearest, text_hash, evidence) for every row of ``docs``.

    ``learn_from`` maps an id column to whether a label may be learned from. Up to
    ``EXAMPLES`` labelled rows of each label become the index, with all their terms; the
    inverse document frequency counts all of ``docs``. Every text that shares a term with
    an example is compared; terms that no example has only add to its length, as if no
    other text had them. The share of
    toxic votes among the ``NEAREST`` examples by cosine, a vote counting its similarity
    times the rows of its label that the example stands for and the base rate
    ``PRIOR`` votes, becomes a score by a logistic curve fitted to the votes that the
    examples get from the others. Texts that share no term with an example (null and empty
    ones too) get the toxic share of the examples without terms. ``nearest`` is the
    similarity of the nearest example, ``evidence`` the ids of the ``SHOWN`` nearest.
    Repeated rows get equal scores; of rows with one labelled id the text with the least
    hash is learned from; without labels all score 0; null ids and labels are not learned
    from; other columns are not read.
    """
    text = F.col(text_column)
    docs = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    known = _training(labels, id_column, label_column, learn_from)
    total = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = F.broadcast(cut(_sample(known)))  # at most 2 * EXAMPLES rows of two numbers
    examples = cut(docs.join(sample, "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("text_hash", "text")).alias("t")).select("doc_id", "y", "t.text"))
    learned = _learned(examples)
    base = total.get(1, 0) / max(1, sum(total.values()))
    vocabulary = np.unique(np.concatenate([np.zeros(0, U), *(r[1] for r in learned)]))
    if not len(vocabulary):
        return docs.select("doc_id", F.lit(float(base)).alias("score"), F.lit(0.0).alias("nearest"), "text_hash", F.array().cast("array<bigint>").alias("evidence"))
    spread = docs.sparkSession.sparkContext.broadcast
    lookup = spread(Lookup(vocabulary))
    df, n_docs = _frequencies(docs, lookup, partitions(docs.sparkSession))
    idf, rarest = np.log1p(n_docs / (1.0 + df)), float(np.log1p(n_docs / 2.0))
    share = {y: total.get(y, 0) / max(1, sum(r[0] == y for r in learned)) for y in (0, 1)}
    plain = {y: PRIOR * share[y] * (y == 0) + share[y] * sum(1 for r in learned if r[0] == y and not len(r[1])) for y in (0, 1)}
    without = plain[1] / max(plain[0] + plain[1], 1e-9)
    some = [(y, np.searchsorted(vocabulary, h).astype(np.int32), c, i) for y, h, c, i in learned if len(h)]
    rows = (np.r_[0, np.cumsum([len(r[1]) for r in some])], np.concatenate([r[1] for r in some]), np.concatenate([_weights(r[1], r[2], idf) for r in some]))
    toxic = np.array([r[0] for r in some], bool)
    ids = np.array([r[3] for r in some], np.int64)
    del some
    index = spread((BlockMaxIndex(rows, toxic, np.where(toxic, share[1], share[0]), len(vocabulary), ids), idf))
    prior = PRIOR * sum(total.values()) / max(1, len(learned))
    del learned, rows

    def voted(texts: pa.Array, but_one: bool) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """Share of toxic votes, similarity of the nearest, and nearest ids of every text; ``but_one``
        leaves out one example as good as equal to the text, the text itself."""
        find, (near_by, idf) = lookup.value, index.value
        raw, first, shown = np.full(len(texts), np.nan), np.zeros(len(texts)), [[] for _ in range(len(texts))]
        asked: list[tuple[int, np.ndarray, np.ndarray]] = []

        def answer() -> None:
            for (i, *_), (near, sim) in zip(asked, near_by.nearest_of([q[1:] for q in asked], NEAREST + but_one), strict=True):
                if but_one:
                    near, sim = (near[1:], sim[1:]) if len(sim) and sim[0] > 1 - ROUNDING else (near[:NEAREST], sim[:NEAREST])
                votes = sim * near_by.weight[near]
                raw[i] = (votes[near_by.toxic[near]].sum() + prior * base) / (votes.sum() + prior)
                first[i], shown[i] = sim[0] if len(sim) else 0.0, near_by.ids[near[:SHOWN]].tolist()
            asked.clear()

        for i, (h, count) in enumerate(_counted(texts)):
            at, places = find(h)
            if len(at):
                tf = 1 + np.log(np.delete(count, at))
                asked.append((i, places, _weights(places, count[at], idf, rarest * rarest * (tf * tf).sum())))
                if len(asked) == TOGETHER:
                    answer()
        if asked:
            answer()
        return raw, first, shown

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(voted(b.column(1), True)[0])], ["y", "raw"])

    tested = examples.select("y", "text").repartition(partitions(docs.sparkSession)).mapInArrow(test, "y int, raw double").collect()  # at most 2 * EXAMPLES rows
    y, raw = np.array([r.y for r in tested]), np.array([np.nan if r.raw is None else r.raw for r in tested])
    order = np.lexsort((raw, y))  # rows come in any order, sums must not
    y, raw = y[order][~np.isnan(raw[order])], raw[order][~np.isnan(raw[order])]
    slope, offset = calibration(raw, y, np.where(y > 0, share[1], share[0])) if len(set(y.tolist())) == 2 else (1.0, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).fill_null("").dictionary_encode()  # equal texts once
            raw, first, shown = voted(texts.dictionary, False)
            odds = np.clip(raw, 1e-4, 1 - 1e-4)
            score = np.where(np.isnan(raw), without, 1 / (1 + np.exp(-(slope * np.log(odds / (1 - odds)) + offset))))
            at = texts.indices.to_numpy()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(score[at]), pa.array(first[at]), b.column(1), pa.array([shown[i] for i in at.tolist()], pa.list_(pa.int64()))],
                ["doc_id", "score", "nearest", "text_hash", "evidence"])

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, f"doc_id {docs.schema[0].dataType.simpleString()}, score double, nearest double, text_hash long, evidence array<bigint>")
