"""Exact k best matches by a weighted sum of set similarities, without comparing all pairs.

Past rows and queries are dealt into blocks; a task takes one block of each. It indexes its
past rows by item: rows that look alike stand in shelves, and for every item a list says
which shelves hold it. What a query shares with a shelf's union, and the least and greatest
size of a set there, bound the score of any row on it. Shelves are opened in the order of
these bounds, and only for queries whose k-th best so far they can still reach. Rows of an
opened shelf are compared by products of 0/1 matrices, sets that many queries have in common
once for all of these. Each task returns k rows for a query, so pairs are never shuffled;
blocks are written once and read where they are needed, so they are not either.
Where only what closed before a query counts, blocks are stretches of time, and blocks that
are too late for each other do not meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, GroupedData, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from opsrecall.session import cut

# Past rows, and queries, of one task; rows of a shelf; numbers of a query matrix. Every block is sent to all
# blocks of the other side, so beyond ``SPREAD`` blocks they grow to ``LARGEST`` rows before their number does.
BLOCK, ASKED = 4096, 2048
SPREAD, LARGEST = 8, 16_384
# Tasks that a search is spread over at most.
TASKS = 200
# Stretches of time, of about equally many rows, that blocks are made of.
PARTS = 32
# Rows that a task finds before those of no use are dropped.
KEPT_ROWS = 500_000
SHELF = 64
CELLS = 1 << 24
# The topology term, among the sets of a query.
TOPOLOGY = "(topology)"
# More than the bounds lose to rounding.
SLACK = 1e-9


def jaccard(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.add(a, b, dtype=np.float64)
    total = total - common if total.shape != common.shape else np.subtract(total, common, out=total)
    return np.divide(common, np.maximum(total, 1.0, out=total), out=total)  # two empty sets have nothing in common


@dataclass
class Sets:
    """Rows of item sets: edges of the rows and the items of all of them."""

    edge: np.ndarray
    items: np.ndarray

    @classmethod
    def of(cls, lists) -> Sets:
        sizes = np.array([len(x) for x in lists], np.int64)
        flat = np.concatenate([np.asarray(x, np.int64) for x in lists]) if sizes.sum() else np.zeros(0, np.int64)
        return cls(np.r_[0, np.cumsum(sizes)], flat)

    @property
    def size(self) -> np.ndarray:
        return np.diff(self.edge)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.edge) - 1), self.size)

    def distinct(self) -> tuple[Sets, np.ndarray]:
        """Rows that are not written like one before them, and for every row its place among these."""
        edge, known = self.edge.tolist(), {}
        code = np.array([known.setdefault(self.items[a:b].tobytes(), len(known)) for a, b in zip(edge[:-1], edge[1:], strict=True)], np.int64)
        return Sets.of([np.frombuffer(x, np.int64) for x in known]), code


class Shelves:
    """One set of every past row, in shelves of rows that follow each other."""

    def __init__(self, sets: Sets, heads: np.ndarray):
        self.known, place = np.unique(sets.items, return_inverse=True)
        self.size, self.heads = sets.size, heads
        row = sets.rows()
        shelf = np.searchsorted(heads, row, "right") - 1
        self.holds = np.zeros((len(self.known), len(heads)), bool)
        self.holds[place, shelf] = True
        self.least, self.most = np.minimum.reduceat(self.size, heads), np.maximum.reduceat(self.size, heads)
        by = np.argsort(shelf, kind="stable")
        cuts = np.searchsorted(shelf[by], np.arange(len(heads) + 1))
        self.parts = [(row[by[a:b]], place[by[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def known_items(self, sets: Sets) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of the items that any past row has."""
        if not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.known, sets.items), len(self.known) - 1)
        hit = self.known[at] == sets.items
        return sets.rows()[hit], at[hit]

    def shared(self, dense: np.ndarray) -> np.ndarray:
        """How many items each query, a row of a 0/1 matrix by known items, shares with the union of each shelf."""
        return (dense @ self.holds.astype(np.float32)).astype(np.int64)

    def bound(self, shared: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The largest similarity a row of each shelf can have."""
        most = np.minimum(shared, self.most)
        return jaccard(most, size[:, None], np.maximum(self.least, most))

    def matrix(self, shelf: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """The shelf's items, and a 0/1 matrix of its rows by them."""
        columns = np.flatnonzero(self.holds[:, shelf])
        row, place = self.parts[shelf]
        out = np.zeros((rows, len(columns)), np.float32)
        out[row - self.heads[shelf], np.searchsorted(columns, place)] = 1
        return columns, out


@dataclass
class Scoring:
    """Weights of the sets by name, and of the topology term, in the order they are added up;
    ``topology`` names the sets of services, of neighbours and of clusters."""

    weights: dict[str, float]
    topology: tuple[str, str, str] | None = None
    topology_weight: float = 0.0
    bonus: float = 0.0
    needed: tuple[str, ...] = field(default=())

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys([*self.weights, *((self.topology[0], self.topology[2]) if self.topology else ())]))


class Asked:
    """One set of every query: what is distinct of it, and which of these each query has."""

    def __init__(self, sets: Sets, code: np.ndarray):
        self.sets, self.code, self.size = sets, code, sets.size.astype(np.float64)
        self.n = int(code.max()) + 1 if len(code) else 0
        #: A 0/1 matrix of the distinct sets by the items that past rows know.
        self.dense: np.ndarray | None = None

    def part(self, who: np.ndarray, of) -> np.ndarray:
        """``of(places)`` by query: for all distinct sets once, where they are far fewer than the queries ``who``."""
        if 4 * self.n <= len(who):
            return of(np.arange(self.n))[self.code[who]]
        return of(self.code[who])


class PastIndex:
    """Past rows of one block, ready to be searched by many queries."""

    def __init__(self, sets: dict[str, Sets], scoring: Scoring, group: np.ndarray):
        """``group`` numbers groups whose rows are ranked apart; they come sorted by it, and alike rows together."""
        self.scoring, self.group, self.n = scoring, group, len(group)
        new = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        ends = np.r_[new[1:], self.n]
        self.heads = np.concatenate([np.arange(a, b, SHELF) for a, b in zip(new, ends, strict=True)])
        self.tails = np.r_[self.heads[1:], self.n]
        self.sets = {c: Shelves(s, self.heads) for c, s in sets.items()}
        #: Pairs of a query and a past row that were compared.
        self.compared = 0

    def search(self, asked: dict[str, Sets], boost: np.ndarray, allowed, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the k best rows of every group for every query, ties all included.

        ``allowed(rows)`` is a matrix of queries by those rows.
        """
        n = len(boost)
        widest = max([1, *(len(s.known) for s in self.sets.values())])
        step = max(1, CELLS // widest)
        out = [self._some({c: _part(s, i, min(i + step, n)) for c, s in asked.items()}, boost[i:i + step], (i, min(i + step, n)), allowed, k) for i in range(0, n, step)]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def _some(self, asked: dict[str, Sets], boost: np.ndarray, span: tuple[int, int], allowed, k: int):
        s, n = self.scoring, len(boost)
        asked = {c: Asked(*x.distinct()) for c, x in asked.items()}
        bound = np.tile(boost[:, None] + s.topology_weight, (1, len(self.heads)))
        for c in s.columns:
            past, mine = self.sets[c], asked[c]
            mine.dense = np.zeros((len(mine.size), len(past.known)), np.float32)
            mine.dense[past.known_items(mine.sets)] = 1
            if c in s.weights:
                bound += (s.weights[c] * past.bound(past.shared(mine.dense), mine.size))[mine.code]
        bound = np.minimum(bound, 1.0) + s.bonus
        if s.topology:
            past, mine = self.sets[s.topology[0]], asked[s.topology[1]]
            near = np.zeros((len(mine.size), len(past.known)), np.float32)
            near[past.known_items(mine.sets)] = 1
            mine.dense = near
            # Queries whose three sets for the topology are alike.
            some, code = np.unique(np.stack([asked[c].code for c in s.topology]), axis=1, return_inverse=True)
            asked[TOPOLOGY] = Asked(Sets(np.zeros(1, np.int64), np.zeros(0, np.int64)), code.reshape(-1))
            self.triples = dict(zip(s.topology, some, strict=True))
        found = []
        for g in np.unique(self.group).tolist():
            best, mine = np.full((n, k), -np.inf), []
            shelves = np.flatnonzero(self.group[self.heads] == g)
            shelves = shelves[np.argsort(-bound[:, shelves].sum(axis=0), kind="stable")]
            promising = shelves[bound[:, shelves].argmax(axis=1)]
            # First the most promising shelf of every query, then what can still reach its k best.
            for shelf, again in [(j, r) for r in (False, True) for j in shelves.tolist()]:
                rows = np.arange(self.heads[shelf], self.tails[shelf])
                who = np.flatnonzero(((promising == shelf) != again) & (bound[:, shelf] >= best[:, 0] - SLACK))
                if not len(who):
                    continue
                may = allowed(rows)[who + span[0]]
                some = may.any(axis=1)
                if not some.all():
                    who, may = who[some], may[some]
                if not len(who):
                    continue
                score = self._scores(shelf, rows, who, asked, boost)
                np.copyto(score, -np.inf, where=~may)
                self.compared += int(may.sum())
                # The first of the k best is the least of them; the rest are in any order.
                better = score.max(axis=1) >= best[who, 0]
                who, score = who[better], score[better]
                best[who] = np.partition(np.concatenate([best[who], score], axis=1), -k, axis=1)[:, -k:]
                at, column = np.nonzero((score >= best[who, :1]) & (score > -np.inf))
                mine.append((who[at], rows[column], score[at, column]))
            if mine:
                q, row, score = (np.concatenate(x) for x in zip(*mine, strict=True))
                keep = score >= best[q, 0]  # what later shelves have pushed out goes
                found.append((q[keep] + span[0], row[keep], score[keep]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def _scores(self, shelf: int, rows: np.ndarray, who: np.ndarray, asked: dict[str, Asked], boost: np.ndarray) -> np.ndarray:
        s, matrices = self.scoring, {c: self.sets[c].matrix(shelf, len(rows)) for c in self.scoring.columns}

        def common(c: str, past: str, at: np.ndarray) -> np.ndarray:
            """How many items the distinct sets ``at`` of queries share with each row."""
            columns, matrix = matrices[past]
            dense = asked[c].dense
            if 2 * len(columns) > dense.shape[1]:  # rows at once are cheaper than single places
                wide = np.zeros((len(rows), dense.shape[1]), np.float32)
                wide[:, columns] = matrix
                return (dense[at] @ wide.T).astype(np.float64)
            return (dense[np.ix_(at, columns)] @ matrix.T).astype(np.float64)

        def alike(c: str, at: np.ndarray) -> np.ndarray:
            part = jaccard(common(c, c, at), asked[c].size[at][:, None], self.sets[c].size[rows].astype(np.float64)[None, :])
            return np.multiply(part, s.weights[c], out=part)

        def close(_: str, at: np.ndarray) -> np.ndarray:
            services, near, clusters = s.topology
            of = {c: x[at] for c, x in self.triples.items()}
            empty = (asked[services].size[of[services]] == 0)[:, None] | (self.sets[services].size[rows] == 0)[None, :]
            far = np.where(common(clusters, clusters, of[clusters]) > 0, 0.3, 0.0)
            nearer = np.where(common(services, services, of[services]) > 0, 1.0, np.where(common(near, services, of[near]) > 0, 0.5, far))
            return s.topology_weight * np.where(empty, 0.0, nearer)

        total = None
        for c, part_of in [*((c, alike) for c in s.weights), *([(TOPOLOGY, close)] if s.topology else [])]:
            part = asked[c].part(who, lambda at, c=c, f=part_of: f(c, at))
            total = part if total is None else np.add(total, part, out=total)
        total += boost[who][:, None]
        np.clip(total, 0.0, 1.0, out=total)
        total += s.bonus
        return total


def _numbered(a: pd.Series, b: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Both columns with a number for each distinct text."""
    codes = pd.factorize(pd.concat([a, b], ignore_index=True))[0]
    return codes[:len(a)], codes[len(a):]


def _part(s: Sets, a: int, b: int) -> Sets:
    return Sets(s.edge[a:b + 1] - s.edge[a], s.items[s.edge[a]:s.edge[b]])


def _blocked(past: DataFrame, asked: DataFrame, scope: list[str], past_id: str, asked_id: str,
             past_us: str | None, asked_us: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The grid of blocks per scope, and both sides with it and the number of their block, `_blocks_no` and `_askers_no`."""
    edges = [i / PARTS for i in range(1, PARTS)]

    def cuts(us: str | None):
        return F.percentile_approx(us, edges) if us else F.lit(None).cast("array<bigint>")

    n = past.groupBy(*scope).agg(F.count(F.lit(1)).alias("_rows"), cuts(past_us).alias("_blocks_cuts"))
    q = asked.groupBy(*[F.col(f"q_{c}").alias(c) for c in scope]).agg(F.count(F.lit(1)).alias("_asks"), cuts(asked_us).alias("_askers_cuts"))

    def blocks(of: str, least: int):
        return F.least(F.ceil(F.col(of) / least), F.greatest(F.lit(SPREAD), F.ceil(F.col(of) / LARGEST))).cast("int")

    grid = cut(n.join(q, scope).select(*scope, "_asks", blocks("_rows", BLOCK).alias("_blocks"), blocks("_asks", ASKED).alias("_askers"), "_blocks_cuts", "_askers_cuts"))

    def number(own: str, by: str, us: str | None):
        if us is None:
            return F.pmod(F.xxhash64(by), F.col(own)).cast("int")
        below, upto = F.size(F.filter(f"{own}_cuts", lambda x: x < F.col(us))), F.size(F.filter(f"{own}_cuts", lambda x: x <= F.col(us)))
        # Rows of one time, and of one stretch that is more than a block, are dealt by hash.
        place = below + F.pmod(F.xxhash64(by), F.lit(1024)) / 1024 * (upto - below + 1)
        return F.least(F.floor(place * F.col(own) / PARTS).cast("int"), F.col(own) - 1)

    on, q_on = grid.drop("_asks"), grid.drop("_asks").withColumnsRenamed({c: f"q_{c}" for c in scope})
    of_past = past.join(on, scope).withColumn("_blocks_no", number("_blocks", past_id, past_us))
    of_asked = asked.join(q_on, [f"q_{c}" for c in scope]).withColumn("_askers_no", number("_askers", asked_id, asked_us))
    return grid, of_past, of_asked


_GRID = ["_blocks", "_askers", "_blocks_cuts", "_askers_cuts"]


def dealt(past: DataFrame, asked: DataFrame, scope: list[str], past_id: str, asked_id: str,
          past_us: str | None = None, asked_us: str | None = None) -> tuple[GroupedData, GroupedData]:
    """Both sides dealt so that within a scope every block of one meets every block of the other once.

    With times, neither null, only pairs with ``past_us`` before ``asked_us`` have to meet: blocks are
    stretches of time, and rows are sent only to blocks that may hold such a partner.
    """
    grid, of_past, of_asked = _blocked(past, asked, scope, past_id, asked_id, past_us, asked_us)

    def partners(other: str, us: str | None, later: bool):
        every = F.sequence(F.lit(0), F.col(other) - 1)
        if us is None:
            return every
        if later:  # the last time of a block of queries
            last = lambda j: F.get(f"{other}_cuts", (F.ceil((j + 1) * PARTS / F.col(other)) - 1).cast("int"))
            return F.filter(every, lambda j: F.coalesce(last(j) > F.col(us), F.lit(True)))
        first = lambda i: F.get(f"{other}_cuts", (F.floor(i * PARTS / F.col(other)) - 1).cast("int"))
        return F.filter(every, lambda i: F.coalesce(first(i) < F.col(us), F.lit(True)))

    of_past = of_past.withColumn("_askers_no", F.explode(partners("_askers", past_us, True))).drop(*_GRID)
    of_asked = of_asked.withColumn("_blocks_no", F.explode(partners("_blocks", asked_us, False))).drop(*_GRID)
    of_asked = of_asked.withColumnsRenamed({"_blocks_no": "q_blocks_no", "_askers_no": "q_askers_no"})
    # As many tasks as pairs of blocks: work goes with pairs, so tasks must not be merged because they read little.
    pairs = grid.agg(F.sum(F.col("_blocks") * F.col("_askers"))).first()[0] or 0
    tasks = max(int(past.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2 * pairs, TASKS))
    on, q_on = [*scope, "_blocks_no", "_askers_no"], [*[f"q_{c}" for c in scope], "q_blocks_no", "q_askers_no"]
    return of_past.repartition(tasks, *on).groupBy(*on), of_asked.repartition(tasks, *q_on).groupBy(*q_on)


def _packed(rows: DataFrame, scope: str, number: str, us: str | None, edge: str, into: str, parts: int) -> DataFrame:
    """One row for every block: its scope, its earliest (``edge`` is min) or latest time, and its rows in Arrow's format."""
    def pack(block: pa.Table) -> pa.Table:
        held = block.drop_columns([scope, number])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(held)
        time = pc.min_max(block[us])[edge].as_py() if us else None
        return pa.table({f"{into}_scope": pa.array([block[scope][0].as_py()], pa.string()), f"{into}_us": pa.array([time], pa.int64()),
                         into: pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return cut(rows.groupBy(scope, number).applyInArrow(pack, f"{into}_scope string, {into}_us bigint, {into} binary").repartition(parts))


def met_blocks(past: DataFrame, asked: DataFrame, past_id: str, asked_id: str, past_us: str | None, asked_us: str | None,
               search, schema: str, combine=None) -> DataFrame:
    """``search(past rows, queries)``, two pandas frames to one, of all blocks of `scope` that meet those of `q_scope`.

    As in ``dealt``, but a block is written once, as one row, and read by every task that needs it: what is
    written grows with the rows, not with the rows times the blocks they meet. Past blocks lie in ``SPREAD``
    partitions at most, and ``combine`` drops what a task has found to be of no use, so that what is found
    for a query does not grow with the blocks either.
    """
    grid, of_past, of_asked = _blocked(past, asked, ["scope"], past_id, asked_id, past_us, asked_us)
    sums = grid.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("_blocks", "_askers", "_asks")]).first()

    left = _packed(of_past.drop(*_GRID), "scope", "_blocks_no", past_us, "min", "past", max(1, min(sums[0], SPREAD)))
    right = _packed(of_asked.drop(*_GRID), "q_scope", "_askers_no", asked_us, "max", "asked", max(1, min(sums[1], max(SPREAD, math.ceil(sums[2] / LARGEST)))))
    # Two comparisons and no equality, so that tasks are pairs of partitions and blocks are not shuffled.
    meet = (F.col("past_scope") >= F.col("asked_scope")) & (F.col("past_scope") <= F.col("asked_scope"))
    if past_us:
        meet = meet & (F.col("past_us") < F.col("asked_us"))
    fields = T.StructType.fromDDL(schema)

    def rows_of(block: pa.Buffer) -> pd.DataFrame:
        return pa.ipc.open_stream(block).read_all().to_pandas()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        last = queries = None
        for pairs in batches:
            for one, other in zip(pairs["past"], pairs["asked"], strict=True):
                if last is None or not last.equals(other.as_buffer()):
                    last = other.as_buffer()
                    queries = rows_of(last)
                yield search(rows_of(one.as_buffer()), queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, best = [], 0
        for rows in found(batches):
            held.append(rows)
            if combine is None or sum(map(len, held)) > max(KEPT_ROWS, 2 * best):
                held = [combine(pd.concat(held, ignore_index=True))] if combine else held
                best = len(held[0])
                if combine is None:
                    yield from sent(held)
                    held = []
        yield from sent([combine(pd.concat(held, ignore_index=True))] if combine and held else held)

    def sent(frames: list[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        for rows in frames:
            if len(rows):
                yield pa.RecordBatch.from_pandas(rows[fields.names], to_arrow_schema(fields), preserve_index=False)

    return left.join(right, meet).select("past", "asked").mapInArrow(run, fields)


def best_classes(queries: DataFrame, classes: DataFrame, scoring: Scoring, k: int, as_of: bool, own: bool, by_family: bool) -> DataFrame:
    """(query_id, class_id, score): at least the k best classes of every block for each query.

    ``queries(query_id, q_us, q_service, boost, q_<set>..)`` and ``classes(class_id, closed_us,
    head, members, service, family, <set>..)`` carry sets as arrays of longs. With ``own`` a
    query meets the classes of its service, else all others. With ``by_family`` the k best are
    those of every family. Ties at the k-th place are all returned; the caller ranks them.
    A class counts if its first member closed before the signal; without ``as_of``, if it has
    a member besides the query.
    """
    names = scoring.columns
    asked_names = [*names, *([scoring.topology[1]] if scoring.topology else [])]
    past = classes.select("class_id", "closed_us", "head", "members", "service", F.col("family").cast("string").alias("family"), *names)
    asked = queries.select("query_id", "q_us", "q_service", "boost", *[f"q_{c}" for c in asked_names])
    for c in scoring.needed:
        past, asked = past.where(F.size(c) > 0), asked.where(F.size(f"q_{c}") > 0)

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        family = left["family"].fillna("\0") if by_family else pd.Series("", index=left.index)
        alike = left[names[0]].map(lambda x: int(np.min(x)) if len(x) else 0)  # equal for sets that share their least item
        order = np.lexsort((left["class_id"].to_numpy(str), left[names[0]].map(len), alike, family.to_numpy(str)))
        left, family = left.iloc[order].reset_index(drop=True), family.iloc[order].to_numpy(str)
        index = PastIndex({c: Sets.of(left[c]) for c in names}, scoring, np.unique(family, return_inverse=True)[1])
        closed, members = left["closed_us"].to_numpy(np.int64), left["members"].to_numpy(np.int64)
        asked_us = right["q_us"].fillna(0).to_numpy(np.int64)
        # Numbers of equal texts, so that pairs compare numbers.
        heads, asked_ids = _numbered(left["head"], right["query_id"])
        service, asked_service = _numbered(left["service"].fillna(""), right["q_service"].fillna(""))
        nowhere = (right["q_service"].fillna("") == "").to_numpy()

        sets, boost = {c: Sets.of(right[f"q_{c}"]) for c in asked_names}, right["boost"].to_numpy(float)

        def some(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """What queries a to b find. So few at once stay in a core's cache."""
            def allowed(rows: np.ndarray) -> np.ndarray:
                if as_of:
                    may = closed[rows][None, :] < asked_us[a:b, None]
                else:
                    may = (heads[rows][None, :] != asked_ids[a:b, None]) | (members[rows] > 1)[None, :]
                return may if own or nowhere[a:b].all() else may & ((service[rows][None, :] != asked_service[a:b, None]) | nowhere[a:b, None])

            q, row, score = index.search({c: _part(s, a, b) for c, s in sets.items()}, boost[a:b], allowed, k)
            return q + a, row, score

        found = [some(a, min(a + ASKED, len(right))) for a in range(0, len(right), ASKED)]
        q, row, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return pd.DataFrame({"query_id": right["query_id"].to_numpy()[q], "class_id": left["class_id"].to_numpy()[row], "score": score, "family": family[row]})

    def combine(found: pd.DataFrame) -> pd.DataFrame:
        """The k best of every family for every query, ties all included."""
        if not len(found):
            return found
        group, score = found.groupby(["query_id", "family"], sort=False).ngroup().to_numpy(), found["score"].to_numpy()
        order = np.lexsort((-score, group))
        first = np.searchsorted(group[order], np.arange(group.max() + 1))
        held = np.bincount(group)
        return found[score >= score[order][first + np.minimum(held, k) - 1][group]]

    if own:
        past, asked = past.where("service IS NOT NULL"), asked.where("q_service IS NOT NULL")
    if as_of:
        asked = asked.where("q_us IS NOT NULL")
    # Without a service to share, all are in one scope.
    scope = F.col("service") if own else F.lit("")
    asked_scope = F.col("q_service") if own else F.lit("")
    return met_blocks(past.withColumn("scope", scope), asked.withColumn("q_scope", asked_scope), "class_id", "query_id",
                      *(("closed_us", "q_us") if as_of else (None, None)), search, "query_id string, class_id string, score double", combine)
