"""Chat formatting by columnar byte assembly, and reading it back.

Lengths of all segments give their places in one buffer; headers, escaped contents and
footers are scattered into it by index arrays, and the buffer becomes the column.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from opsrecall.llm.common import partitions, text_bytes

# The template: a header with the role, the content, a footer. Inside roles and contents
# the marked characters get a backslash, so no control string can appear there.
HEADER, COLON, FOOTER = b"### ", b": ", b" </turn>\n"
MARKED = np.zeros(256, bool)
MARKED[[ord(c) for c in "\\#<:"]] = True
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
UNDER_LOSS = "assistant"


def _lengths(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Escaped lengths of texts, and for every byte the marked ones up to and with it."""
    seen = np.cumsum(MARKED[data])
    before = np.r_[0, seen][offsets]
    return np.diff(offsets) + np.diff(before), seen


def _scatter(out: np.ndarray, to: np.ndarray, offsets: np.ndarray, data: np.ndarray, seen: np.ndarray) -> None:
    """Escaped texts into ``out``, each from its place in ``to``."""
    before = np.r_[0, seen][offsets[:-1]]
    size = np.diff(offsets)
    place = np.repeat(to - offsets[:-1] - before, size) + np.arange(len(data)) + seen
    out[place] = data
    marked = MARKED[data]
    out[place[marked] - 1] = ord("\\")


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted turns over one buffer, and the byte range of the content of each."""
    ro, rd = text_bytes(roles)
    to, td = text_bytes(texts)
    rl, rs = _lengths(ro, rd)
    tl, ts = _lengths(to, td)
    total = len(HEADER) + rl + len(COLON) + tl + len(FOOTER)
    edge = np.r_[0, np.cumsum(total)]
    out = np.empty(edge[-1], np.uint8)
    role_at = edge[:-1] + len(HEADER)
    content_at = role_at + rl + len(COLON)
    for fixed, at in ((HEADER, edge[:-1]), (COLON, role_at + rl), (FOOTER, content_at + tl)):
        out[at[:, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    _scatter(out, role_at, ro, rd, rs)
    _scatter(out, content_at, to, td, ts)
    turns = pa.Array.from_buffers(pa.large_string(), len(total), [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(out)])
    return turns, content_at - edge[:-1], content_at + tl - edge[:-1]


def format_turns(turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """(conv_id, turn, formatted, loss_from, loss_to) for every row.

    A conversation's text is its turns' ``formatted``, by turn and then by themselves,
    put together. ``loss_from`` and ``loss_to`` are the bytes of it under the loss, an
    assistant's content, and both 0 elsewhere. Null roles and texts are empty; other
    columns are not read; an empty table gives no rows. Turns are formatted where they
    are read, so a conversation of any length is no one task's work.
    """
    rows = turns.select(
        F.col(id_column).cast("long").alias("conv_id"), F.col(turn_column).cast("long").alias("turn"),
        F.coalesce(F.col(role_column), F.lit("")).alias("role"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            formatted, begin, end = assemble(b.column(2), b.column(3))
            loss = np.array([r == UNDER_LOSS for r in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), formatted.cast(pa.string()), pa.array(np.where(loss, begin, 0)), pa.array(np.where(loss, end, 0))],
                ["conv_id", "turn", "formatted", "loss_from", "loss_to"])

    return rows.mapInArrow(run, "conv_id long, turn long, formatted string, loss_from long, loss_to long")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    head, tail = HEADER.decode(), FOOTER.decode()
    if not formatted.startswith(head) or not formatted.endswith(tail):
        raise ValueError("not a formatted turn")
    body = formatted[len(head):len(formatted) - len(tail)]
    role, _, text = body.partition(COLON.decode())  # a colon of the role has a backslash before it, and no space can follow that pair unseen
    while role.endswith("\\") and (len(role) - len(role.rstrip("\\"))) % 2:
        more, _, text = text.partition(COLON.decode())
        role = role + COLON.decode() + more
    return unescape(role), unescape(text)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of every conversation, parsed from its formatted turns.

    Rows stream through a task sorted by conversation; only running digests are kept.
    """
    rows = formatted.repartition(partitions(formatted.sparkSession), "conv_id").sortWithinPartitions(F.col("conv_id"), F.col("turn"), F.col("formatted"))
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def row():
            return (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        def table(out):
            cols = list(zip(*out, strict=True))
            ints, texts = pa.int64(), pa.string()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (ints, ints, texts, ints, texts, ints), strict=True)], [f.split()[0] for f in schema.split(", ")])

        for b in batches:
            out = []
            for conv, _, text, begin, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        out.append(row())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, content = parse_turn(text)
                state[0] += 1
                state[1].update(f"{role}\n{content}\n".encode())
                if end:
                    loss = unescape(text.encode()[begin:end].decode())
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += len(text)
            if out:
                yield table(out)
        if state is not None:
            yield table([row()])

    return rows.mapInArrow(run, schema)
