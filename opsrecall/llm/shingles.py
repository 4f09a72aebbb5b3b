"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from opsrecall.llm.common import U, blocks, mix, word_bounds, word_hashes

SALT = U(0x2545F4914F6CDD1D)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For every text its distinct shingles of ``size`` words, as sorted hashes.

    Words are runs of anything but ASCII white space, with A-Z lower-cased. A text
    with fewer words has one shingle, its whole sequence; one without words has none.
    """
    step = U(0xD6E8FEB86659FD93)
    for _, offsets, data in blocks(texts):
        starts, ends, first = word_bounds(offsets, data)
        words = word_hashes(data, starts, ends)
        rolled = np.zeros(max(0, len(words) - size + 1), U)
        for j in range(size):
            rolled = rolled * step + words[j:j + len(rolled)]
        rolled = mix(rolled + SALT)
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if hi - lo >= size:
                yield np.unique(rolled[lo:hi - size + 1])
            elif hi > lo:
                h = U(hi - lo)
                for w in words[lo:hi]:
                    h = U((int(h) * int(step) + int(w)) & 0xFFFFFFFFFFFFFFFF)
                yield mix(np.array([h], U) ^ SALT)
            else:
                yield np.zeros(0, U)
