"""Secret scans: patterns find what is certain, a character network judges every other candidate.

A candidate is a run of characters that keys and tokens are made of. A convolutional
network over the characters of a candidate and of the text around it, written in numpy,
learns from findings: values that the patterns have found in any document, each with its
surroundings and again without them, against all candidates that no pattern touches. They
are dealt by hash into shards; in a round every shard learns from all of its windows, and
the shards' networks are averaged. Outputs are calibrated on the quarter of all windows that
is not learned from, and the threshold is the most precise one that keeps the required
recall there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from opsrecall.session import cut

# The base patterns.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
NAMES = ("passw", "secret", "token", "api")  # one of them is in whatever ASSIGN matches
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex")
#: Kind of the spans that the network adds.
ADDED = "candidate"

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
# Characters of a window: before a candidate, of it, and after it. A longer candidate is judged in several windows.
BEFORE, INSIDE, AFTER = 24, 40, 8
WIDTH = BEFORE + INSIDE + AFTER

# Other windows of a shard, about, and the findings it has at least: fewer are learned from in several shards.
SHARD, SHARD_FINDINGS = 32_768, 64
# One in so many windows is kept out of learning.
KEPT_OUT = 4
# Logits are rounded to such parts and held within these bounds, so that all windows kept out are counted in few bins.
LOGIT_PARTS, LOGIT_BOUND = 512, 32
# Averages add whole numbers of such parts, so that their order does not matter.
AVERAGE_PARTS = 1 << 24
# Share of the findings kept out of learning that the threshold must catch, and the least probability of an added span.
RECALL = 0.95
LEAST_PROBABILITY = 0.5
# Findings that a model needs, besides as many other candidates.
LEAST_FINDINGS = 20
SEED = 20260301

# The network: sizes of the character vectors, of a filter, numbers of filters and of hidden units.
EMBED, TAP, FILTERS, HIDDEN = 8, 5, 24, 16
# In a round a shard sees all its windows, and takes so many steps at least.
ROUNDS, BATCH, RATE = 2, 128, 0.004
# Rows of the rarer label in a batch, at least.
FEW = 16
LEAST_STEPS = 128
# Windows judged at once inside a task.
TOGETHER = 2048

Span = tuple[int, int, int, str]  # start, number of the kind, end, kind


def assigned(text: str) -> Iterator[re.Match]:
    """Matches of ``ASSIGN``; a text without any of its names is not searched."""
    low = text.lower()
    return ASSIGN.finditer(text) if any(name in low for name in NAMES) else iter(())


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns by start and kind, in code points, ends exclusive."""
    found = [(m.start(), 0, m.end(), "assign") for m in assigned(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    found += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found)


def windows(text: str, start: int, end: int) -> list[str]:
    """The candidate in pieces of ``INSIDE`` characters with the text around each, padded by NUL.
    All of a candidate is in some window."""
    out = []
    for at in range(start, end, INSIDE):
        at = max(start, min(at, end - INSIDE))
        stop = min(at + INSIDE, end)
        left = text[max(0, at - BEFORE):at]
        out.append(left.rjust(BEFORE, "\0") + text[at:stop].ljust(INSIDE, "\0") + text[stop:stop + AFTER].ljust(AFTER, "\0"))
    return out


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Runs of key characters that no span of ``taken`` touches."""
    out, covered = [], sorted((s, e) for s, _, e, _ in taken)
    k, reach = 0, 0
    for m in CANDIDATE.finditer(text):
        while k < len(covered) and covered[k][0] < m.end():
            reach = max(reach, covered[k][1])
            k += 1
        if reach <= m.start():
            out.append(m.span())
    return out


# Character classes: 0 padding, the ASCII characters each by itself, 128 anything else.
def encode(windows_: list[str]) -> np.ndarray:
    code = np.frombuffer("".join(windows_).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(code, 128).astype(np.int64).reshape(-1, WIDTH)


class Network:
    """Characters to vectors, filters over neighbours, the largest and the mean answer of each
    filter inside and around the candidate, a hidden layer, a logit."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)

        def drawn(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) * np.sqrt(2 / np.prod(shape[:-1]))).astype(np.float32)

        self.p = {"embed": drawn(129, EMBED) * 4, "filters": drawn(TAP * EMBED, FILTERS), "shift": np.zeros(FILTERS, np.float32),
                  "hidden": drawn(3 * FILTERS, HIDDEN), "bias": np.zeros(HIDDEN, np.float32), "out": drawn(HIDDEN, 1), "last": np.zeros(1, np.float32)}

    def _forward(self, codes: np.ndarray) -> tuple:
        p, n = self.p, len(codes)
        vectors = p["embed"][codes]
        steps = WIDTH - TAP + 1
        view = np.lib.stride_tricks.sliding_window_view(vectors, TAP, axis=1).transpose(0, 1, 3, 2).reshape(n * steps, TAP * EMBED)
        answers = np.maximum(view @ p["filters"] + p["shift"], 0).reshape(n, steps, FILTERS)
        # A filter belongs to the candidate if its middle does.
        middle = np.arange(steps) + TAP // 2
        own = (codes[:, middle] > 0) & (middle >= BEFORE) & (middle < BEFORE + INSIDE)
        held = np.where(own[..., None], answers, 0)
        around = np.where(own[..., None], 0, answers)
        size = np.maximum(own.sum(axis=1, keepdims=True), 1).astype(np.float32)
        pooled = np.concatenate([held.max(axis=1), held.sum(axis=1) / size, around.max(axis=1)], axis=1)
        hidden = np.maximum(pooled @ p["hidden"] + p["bias"], 0)
        return view, answers, own, size, held, around, pooled, hidden, (hidden @ p["out"] + p["last"])[:, 0]

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(codes[i:i + TOGETHER])[-1] for i in range(0, len(codes), TOGETHER)] or [np.zeros(0, np.float32)])

    def rounded(self, codes: np.ndarray) -> np.ndarray:
        """Logits as whole numbers of their parts."""
        return np.rint(np.clip(self.logits(codes).astype(float), -LOGIT_BOUND, LOGIT_BOUND) * LOGIT_PARTS).astype(np.int64)

    def _gradients(self, codes: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0) -> dict[str, np.ndarray]:
        p, n = self.p, len(codes)
        view, answers, own, size, held, around, pooled, hidden, logit = self._forward(codes)
        d = ((1 / (1 + np.exp(-logit)) - y) * weight / n)[:, None].astype(np.float32)
        g = {"out": hidden.T @ d, "last": d.sum(axis=0)}
        d = (d @ p["out"].T) * (hidden > 0)
        g["hidden"], g["bias"] = pooled.T @ d, d.sum(axis=0)
        d = d @ p["hidden"].T
        top, mean, rest = d[:, :FILTERS], d[:, FILTERS:2 * FILTERS], d[:, 2 * FILTERS:]
        back = np.where(own[..., None], (mean / size)[:, None, :], 0).astype(np.float32)
        row, each = np.arange(n)[:, None], np.arange(FILTERS)[None, :]
        back[row, held.argmax(axis=1), each] += top
        back[row, around.argmax(axis=1), each] += rest
        back = (back * (answers > 0)).reshape(-1, FILTERS)
        g["filters"], g["shift"] = view.T @ back, back.sum(axis=0)
        back = (back @ p["filters"].T).reshape(n, -1, TAP, EMBED)
        vectors = np.zeros((n, WIDTH, EMBED), np.float32)
        for t in range(TAP):
            vectors[:, t:t + back.shape[1]] += back[:, :, t]
        g["embed"] = np.stack([np.bincount(codes.ravel(), vectors[..., e].ravel(), 129) for e in range(EMBED)], axis=1).astype(np.float32)
        return g

    def learn(self, codes: np.ndarray, y: np.ndarray, seed: int = SEED, spent: float = 0.0, share: float = 1.0) -> None:
        """Adam over shuffled batches. All rows of the larger side are taken, those of the smaller in
        turns, ``FEW`` in a batch at least; both sides weigh the same in every batch. The rate falls
        from ``1 - spent`` of the first by ``share``."""
        rng = np.random.default_rng(seed)
        mean, square = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        sides = sorted((s for s in (np.flatnonzero(y == label) for label in (0, 1)) if len(s)), key=len)
        if not sides:
            return
        few = min(BATCH // 2, max(FEW, BATCH * len(sides[0]) // len(y))) if len(sides) > 1 else 0
        take = [few, BATCH - few] if few else [BATCH]
        once = -(-len(sides[-1]) // take[-1])
        steps = -(-LEAST_STEPS // once) * once
        turns = [np.concatenate([rng.permutation(s) for _ in range(-(-steps * n // len(s)))]) for s, n in zip(sides, take, strict=True)]
        weight = np.concatenate([np.full(n, BATCH / n / len(sides), np.float32) for n in take])
        for t in range(1, steps + 1):
            rows = np.concatenate([s[(t - 1) * n:t * n] for s, n in zip(turns, take, strict=True)])
            rate = RATE * (1 - spent - share * t / (steps + 1))
            for k, g in self._gradients(codes[rows], y[rows], weight).items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                self.p[k] -= (rate * (mean[k] / (1 - 0.9 ** t)) / (np.sqrt(square[k] / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def fill(self, flat: np.ndarray) -> None:
        edge = np.cumsum([0, *(v.size for v in self.p.values())])
        self.p = {k: flat[a:b].reshape(v.shape).astype(np.float32) for (k, v), a, b in zip(self.p.items(), edge[:-1], edge[1:], strict=True)}


def calibrated(logits: np.ndarray, y: np.ndarray, count: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset that turn logits into probabilities, by Newton steps of a logistic fit
    that are halved until they lower the loss. Each row stands for ``count`` windows."""
    count = np.ones(len(y)) if count is None else count
    at = np.array([1.0, 0.0])
    # Targets a little inside 0 and 1, so that separable labels keep a finite slope.
    findings, others = (count * y).sum(), (count * (1 - y)).sum()
    want = np.where(y > 0, (findings + 1) / (findings + 2), 1 / (others + 2))

    def loss(at: np.ndarray) -> float:
        z = at[0] * logits + at[1]
        return float((count * (np.logaddexp(0, z) - want * z)).sum())

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(at[0] * logits + at[1], -30, 30)))
        w = count * (p * (1 - p) + 1e-9)
        g = np.array([(count * (p - want) * logits).sum(), (count * (p - want)).sum()])
        h = np.array([[(w * logits * logits).sum(), (w * logits).sum()], [(w * logits).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        while np.abs(step).max() > 1e-9 and loss(at - step) > loss(at):
            step /= 2
        if np.abs(step).max() <= 1e-9:
            break
        at = at - step
    return float(max(at[0], 1e-3)), float(at[1])


def recall_threshold(probability: np.ndarray, y: np.ndarray, recall: float = RECALL, count: np.ndarray | None = None) -> float:
    """The most precise threshold that catches ``recall`` of the findings; of equally precise ones
    the middle of the gap below the findings it catches. Each row stands for ``count`` windows."""
    count = np.ones(len(y), np.int64) if count is None else count
    level, at = np.unique(-probability, return_inverse=True)  # from the largest
    caught = np.cumsum(np.bincount(at, count * (y > 0), len(level)))
    wrong = np.cumsum(np.bincount(at, count * (y == 0), len(level)))
    needed = max(1, int(np.ceil(recall * caught[-1])))
    may = np.flatnonzero((caught >= needed) & (np.diff(caught, prepend=0) > 0))
    if not len(may):
        return 0.0
    precision = caught[may] / (caught[may] + wrong[may])
    last = np.flatnonzero(precision == precision.max())[-1]
    least = -level[may[last]]
    if precision[last] < 1:
        return float(least)
    return float((least + probability[(y == 0) & (probability < least)].max(initial=0.0)) / 2)


@dataclass
class Model:
    network: Network
    slope: float
    offset: float
    threshold: float
    #: Findings and other windows kept out of learning: number, caught at the threshold.
    held_out: dict[str, int]

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return self.likely(self.network.rounded(codes) / LOGIT_PARTS)

    def likely(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.offset, -30, 30)))


def _values(text: str) -> list[tuple[int, int]]:
    """Values of the findings that name a secret; a bare hex number says nothing of what it is."""
    return [m.span(2) for m in assigned(text) if m.end(2) - m.start(2) >= LEAST_VALUE] + [
        m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]


def labelled_windows(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(y, w): windows of findings (1) and of candidates that no pattern touches (0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, w = [], []
            for text in b.column(0).fill_null("").to_pylist():
                for s, e in _values(text):
                    own = windows(text, s, e)
                    w += own
                    y += [1] * len(own)
                for s, e in candidates(text, base_spans(text)):
                    own = windows(text, s, e)
                    w += own
                    y += [0] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(w, pa.string())], ["y", "w"])

    return docs.select(F.col(text_column)).mapInArrow(run, "y int, w string")


def with_bare(codes: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows as they are, and each different one without its surroundings."""
    sides = [(np.unique(bare(codes[y == label]).astype(np.uint8), axis=0).astype(np.int64), label) for label in (0, 1)]
    return np.concatenate([codes, *(c for c, _ in sides)]), np.concatenate([y, *(np.full(len(c), label, y.dtype) for c, label in sides)])


def bare(codes: np.ndarray) -> np.ndarray:
    """Windows without what stands around the candidate."""
    out = codes.copy()
    out[:, :BEFORE] = 0
    out[:, BEFORE + INSIDE:] = 0
    return out


def _sharded(windows_: DataFrame, findings: int, others: int) -> DataFrame:
    """(shard, y, w) of the windows to learn from."""
    shards = max(1, -(-others // SHARD))
    copies = min(shards, max(1, -(-SHARD_FINDINGS * shards // max(1, findings))))
    first = F.pmod(F.xxhash64("w", F.lit(SEED + 1)), F.lit(shards))
    turns = F.when(F.col("y") == 1, F.lit(copies - 1)).otherwise(F.lit(0))
    each = windows_.select("y", "w", first.alias("first"), F.explode(F.sequence(F.lit(0), turns)).alias("turn"))
    return each.select(((F.col("first") + F.col("turn")) % shards).cast("int").alias("shard"), "y", "w")


def _round(dealt: DataFrame, network: Network, number: int) -> Network:
    """The average of what every shard makes of the network."""
    def learn(key: tuple, rows: pa.Table) -> pa.Table:
        order = sorted(zip(rows.column("y").to_pylist(), rows.column("w").to_pylist(), strict=True))
        y, codes = np.array([r[0] for r in order], np.float32), encode([r[1] for r in order])
        own = Network()
        own.fill(network.flat())
        own.learn(*with_bare(codes, y), SEED + 1000 * number + key[0].as_py() * 1_000_003, number / ROUNDS, 1 / ROUNDS)
        flat = np.rint(own.flat().astype(float) * AVERAGE_PARTS).astype(np.int64)
        return pa.table({"place": pa.array(np.arange(len(flat))), "value": pa.array(flat)})

    sums = dealt.groupBy("shard").applyInArrow(learn, "place long, value long").groupBy("place").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n")).toPandas()
    flat = network.flat().astype(float)
    flat[sums["place"].to_numpy()] = sums["value"].to_numpy() / sums["n"].to_numpy() / AVERAGE_PARTS
    out = Network()
    out.fill(flat)
    return out


def _tested(kept: DataFrame, network: Network) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logit, label, number) of all windows kept out; with and without their surroundings, so that the threshold fits both."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, codes = np.asarray(b.column(0).to_pylist(), np.int64), encode(b.column(1).to_pylist())
            logit, n = np.unique(np.stack([np.concatenate([network.rounded(codes), network.rounded(bare(codes))]), np.r_[y, y]]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(logit[0]), pa.array(logit[1]), pa.array(n)], ["logit", "y", "n"])

    # At most twice as many rows as there are bins of logits.
    found = kept.select("y", "w").mapInArrow(run, "logit long, y long, n long").groupBy("y", "logit").agg(F.sum("n").alias("n")).orderBy("y", "logit").toPandas()
    return found["logit"].to_numpy(float) / LOGIT_PARTS, found["y"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def trained(docs: DataFrame, text_column: str = "text") -> Model | None:
    """A model from all findings and all other candidates of ``docs``, each different window once, or
    None if there are fewer than ``LEAST_FINDINGS`` of either."""
    kept_out = F.pmod(F.xxhash64("w", F.lit(SEED)), F.lit(KEPT_OUT)) == 0
    found = cut(labelled_windows(docs, text_column).distinct().withColumn("kept", kept_out))
    n = {(r.y, r.kept): r.n for r in found.groupBy("y", "kept").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 4 or min(n[y, True] + n[y, False] for y in (0, 1)) < LEAST_FINDINGS:
        return None
    dealt = _sharded(found.where("NOT kept"), n[1, False], n[0, False])
    network = Network()
    for number in range(ROUNDS):
        network = _round(dealt, network, number)
    logits, truth, count = _tested(found.where("kept"), network)
    slope, offset = calibrated(logits, truth, count)
    model = Model(network, slope, offset, 0.0, {})
    p = model.likely(logits)
    model.threshold = max(LEAST_PROBABILITY, recall_threshold(p, truth, count=count))
    hit = p >= model.threshold
    model.held_out = {"findings": int(count[truth > 0].sum()), "caught": int(count[(truth > 0) & hit].sum()),
                      "others": int(count[truth == 0].sum()), "false": int(count[(truth == 0) & hit].sum())}
    return model


def spans(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<start, order, end, kind, probability>>) of every row of ``docs``.

    Spans of the patterns always count, with probability 1; a candidate that touches none of
    them counts if one of its windows reaches the model's threshold. Null and empty texts
    have no spans; repeated rows and null ids are rows like others; other columns are not read.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("order", pa.int32()), ("end", pa.int64()), ("kind", pa.string()), ("probability", pa.float64())]))
    if model is None:
        def judged(asked: list[tuple[int, int, int, list[str]]]) -> Iterator[tuple[int, int, int, float]]:
            yield from ()
    else:
        def judged(asked: list[tuple[int, int, int, list[str]]]) -> Iterator[tuple[int, int, int, float]]:
            p = model.probability(encode([w for *_, own in asked for w in own]))
            edge = np.cumsum([0, *(len(own) for *_, own in asked)])
            for (row, s, e, _), best in zip(asked, np.maximum.reduceat(p, edge[:-1]).tolist(), strict=True):
                if best >= model.threshold:
                    yield row, s, e, best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = []
            asked: list[tuple[int, int, int, list[str]]] = []
            size = 0

            def answer() -> None:
                for row, s, e, p in judged(asked):
                    out[row].append((s, len(KINDS), e, ADDED, p))
                asked.clear()

            for row, text in enumerate(b.column(1).to_pylist()):
                found = base_spans(text or "")
                out.append([(*s, 1.0) for s in found])
                if model is not None:
                    for s, e in candidates(text or "", found):
                        own = windows(text, s, e)
                        asked.append((row, s, e, own))
                        size += len(own)
                        if size >= TOGETHER:
                            answer()
                            size = 0
            if asked:
                answer()
                size = 0
            rows = [[dict(zip(("start", "order", "end", "kind", "probability"), s, strict=True)) for s in sorted(own)] for own in out]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(
        run, f"doc_id {docs.select(id_column).schema[0].dataType.simpleString()}, spans array<struct<start:bigint,order:int,end:bigint,kind:string,probability:double>>")


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, spans) by a model learned from ``docs`` itself; an empty table gives no rows."""
    return spans(docs, trained(docs, text_column), id_column, text_column)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of their spans, and all spans, of every row of ``scan``."""
    def listed(column: Column) -> Column:
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of_kind(order: int):
        return lambda s: s["order"] == order

    base = F.filter("spans", lambda s: s["order"] < len(KINDS))
    counts = [F.size(F.filter("spans", of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
