"""Numbers of greedy longest-match word pieces, by an automaton that never builds a piece.

The vocabulary is a trie. A node's failure link leads to where matching goes on once the
pieces that its string begins with are taken off, and the number of those is stored with
it, so a word is counted in one pass over its bytes. All distinct words of a batch run
through the automaton side by side.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from opsrecall.llm.common import text_bytes


class Automaton:
    """Failure links and popped-piece counts over a vocabulary that has every single byte."""

    def __init__(self, pieces: list[bytes]):
        children: list[dict[int, int]] = [{}]
        whole = [False]
        order, parent, byte = [], [0], [0]
        for p in sorted(pieces, key=len):
            node = 0
            for c in p:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    whole.append(False)
                    parent.append(node)
                    byte.append(c)
                node = children[node][c]
            whole[node] = True
        if len(children[0]) != 256 or not all(whole[v] for v in children[0].values()):
            raise ValueError("every single byte must be a piece")
        depth = [0] * len(children)
        for v in range(1, len(children)):
            depth[v] = depth[parent[v]] + 1
        order = sorted(range(1, len(children)), key=depth.__getitem__)
        fail, popped = [0] * len(children), [0] * len(children)
        for v in order:
            if whole[v]:
                popped[v] = 1
                continue
            z, n = fail[parent[v]], popped[parent[v]]
            while byte[v] not in children[z]:
                n += popped[z]
                z = fail[z]
            fail[v], popped[v] = children[z][byte[v]], n
        edges = sorted((u << 8 | c, v) for u in range(len(children)) for c, v in children[u].items())
        self.keys, self.to = (np.array(x, np.int64) for x in zip(*edges, strict=True))
        self.fail, self.popped = np.array(fail), np.array(popped)

    def counts(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Pieces of each of many words."""
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        begin, size = offsets[:-1][order], size[order]
        state, n = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        active = len(size)
        for j in range(int(size[0]) if len(size) else 0):
            while active and size[active - 1] <= j:
                active = int(np.searchsorted(-size, -j, "left"))
            c = data[begin[:active] + j].astype(np.int64)
            todo = np.arange(active)
            while len(todo):
                key = state[todo] << 8 | c[todo]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found = self.keys[at] == key
                state[todo[found]] = self.to[at[found]]
                todo = todo[~found]
                n[todo] += self.popped[state[todo]]
                state[todo] = self.fail[state[todo]]
        todo = np.flatnonzero(state)
        while len(todo):
            n[todo] += self.popped[state[todo]]
            state[todo] = self.fail[state[todo]]
            todo = todo[state[todo] != 0]
        out = np.empty(len(n), np.int64)
        out[order] = n
        return out


def vocabulary(path: str) -> list[bytes]:
    """Pieces of a vocabulary file that lists them in base 64, one a line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


def token_counts(docs: DataFrame, pieces: list[bytes], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) for every row.

    Words are runs of anything but ASCII white space; each counts with one space before
    it, from which the longest piece is taken again and again. Null, empty and wordless
    texts have none; repeated rows count alike; other columns are not read.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton(pieces))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).fill_null("")
            split = pc.ascii_split_whitespace(texts)
            words = split.flatten()
            edges = np.r_[0, np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))].astype(np.int64)
            coded = words.dictionary_encode()
            o, d = text_bytes(coded.dictionary)
            real = np.diff(o) > 0
            spaced = np.full(len(d) + len(o) - 1, 32, np.uint8)
            spaced[np.arange(len(d)) + np.repeat(np.arange(1, len(o)), np.diff(o))] = d
            per = np.where(real, automaton.value.counts(o + np.arange(len(o)), spaced), 0)
            at = coded.indices.to_numpy()
            tokens, count = np.r_[0, np.cumsum(per[at])], np.r_[0, np.cumsum(real[at])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(count[edges])), pa.array(np.diff(tokens[edges]))], ["doc_id", "n_words", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, n_words long, n_tokens long")
