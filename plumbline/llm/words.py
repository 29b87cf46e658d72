"""Words of many texts at once, as numpy arrays.

Words are runs of bytes other than ASCII white space, with A-Z lower-cased.  A word's 64-bit hash is that of a
polynomial over its bytes, taken from prefix sums, so no word is handled on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

BATCH_BYTES = 500_000
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed))


_OF_BYTE = numbers(256, 11)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


@dataclass
class Words:
    data: bytes  # all texts, lower-cased, with a space between any two
    start: np.ndarray  # of each word in data
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each text's words, and at the end the number of words

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]]


def words(texts: list[str | None]) -> Words:
    encoded = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    data = b" ".join(encoded) + b" "
    a = np.frombuffer(data, np.uint8)
    space = _SPACE[a]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edge[::2], edge[1::2]
    size = 1 << max(16, len(a).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_OF_BYTE[a] * up[: len(a)], out=sums[1:])
    found = mix((sums[end] - sums[start]) * down[start])
    text_start = np.cumsum([0, *(len(e) + 1 for e in encoded)])
    return Words(data, start, end, found, np.searchsorted(start, text_start))


def batches(texts: list[str | None]) -> Iterator[tuple[int, Words]]:
    """The words of runs of texts, with the number of the run's first text; a run has BATCH_BYTES or one text."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > at and size + n > BATCH_BYTES:
            yield at, words(texts[at:i])
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, words(texts[at:])
