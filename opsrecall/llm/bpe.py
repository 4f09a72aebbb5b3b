"""Token ids of whole texts by a public byte-level vocabulary, one distinct chunk at a time."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import tiktoken

from opsrecall.llm.common import text_bytes

# Fixed value: the pattern that this vocabulary's texts are split by before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# First bytes that cannot begin white space, so that a single space before one starts a chunk.
SOLID = np.zeros(256, bool)
SOLID[0x21:0x7F] = True
SOLID[0x80:] = True
SOLID[[0xC2, 0xE1, 0xE2, 0xE3]] = False

_encodings: dict[int, tiktoken.Encoding] = {}


def vocabulary(path: str) -> bytes:
    """The vocabulary file next to ``byte_bpe_50k.json`` that lists the same tokens as ranks."""
    with open(path.removesuffix(".json").removesuffix(".tiktoken") + ".tiktoken", "rb") as f:
        return f.read()


class Encoder:
    """Encodes arrays of texts. Merges never cross a space that a solid byte follows, so the
    distinct chunks between such spaces are encoded once and their ids laid out again."""

    def __init__(self, ranks: bytes):
        key = hash(ranks)
        if key not in _encodings:
            pairs = [line.split() for line in ranks.splitlines() if line]
            _encodings[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        self.encoding = _encodings[key]
        self.size = np.zeros(self.encoding.n_vocab, np.int64)
        for token, rank in self.encoding._mergeable_ranks.items():
            self.size[rank] = len(token)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of the texts among all ids, and the ids."""
        offsets, data = text_bytes(texts)
        if not len(data):
            return offsets, np.zeros(0, np.uint32)
        cut = np.zeros(len(data), bool)
        cut[:-1] = (data[:-1] == 32) & SOLID[data[1:]]
        full = offsets[:-1][offsets[:-1] < offsets[1:]]
        tails = offsets[1:][offsets[1:] > 0] - 1
        cut[tails] = False  # the byte after it belongs to another text
        cut[full] = True
        starts = np.flatnonzero(cut)
        chunks = pa.Array.from_buffers(
            pa.binary(), len(starts), [None, pa.py_buffer(np.r_[starts, len(data)].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        at = chunks.indices.to_numpy()
        o, d = text_bytes(chunks.dictionary)
        spaced = (d[o[:-1]] == 32) & SOLID[d[np.minimum(o[:-1] + 1, len(d) - 1)]] & (np.diff(o) > 1)
        counts, ids = np.zeros(len(o) - 1, np.int64), [None] * (len(o) - 1)
        joined = np.flatnonzero(spaced)
        edges = np.cumsum(np.diff(o)[joined])
        flat = self.encoding.encode_to_numpy(b"".join(d[o[i]:o[i + 1]].tobytes() for i in joined).decode(), disallowed_special=()) if len(joined) else np.zeros(0, np.uint32)
        ends = np.searchsorted(np.cumsum(self.size[flat]), edges, "right")
        counts[joined] = np.diff(np.r_[0, ends])
        begin = np.zeros(len(o) - 1, np.int64)
        begin[joined] = ends - counts[joined]
        extra, have = [flat.astype(np.uint32)], len(flat)
        for i in np.flatnonzero(~spaced).tolist():
            own = np.array(self.encoding.encode_ordinary(d[o[i]:o[i + 1]].tobytes().decode()), np.uint32)
            begin[i], counts[i] = have, len(own)
            extra.append(own)
            have += len(own)
        pool = np.concatenate(extra)
        per = counts[at]
        place = np.r_[0, np.cumsum(per)]
        out = pool[np.repeat(begin[at] - place[:-1], per) + np.arange(place[-1])]
        return place[np.searchsorted(starts, offsets)], out
