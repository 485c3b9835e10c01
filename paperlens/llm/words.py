"""Words and their hashes for many texts at once."""

from __future__ import annotations

import numpy as np

from paperlens.llm.common import mix64

#: the separators of ``[^\x20\x09-\x0D]+``
_SPACES = [0x20, *range(0x09, 0x0E)]


def _factors(n: int, salt: int) -> np.ndarray:
    return mix64(np.arange(n, dtype=np.uint64) + np.uint64(salt)) | np.uint64(1)


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each word in UTF-8 bytes."""
    table = np.zeros(256, bool)
    table[_SPACES] = True
    inside = np.empty(len(raw) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(table[raw], out=inside[1:-1].view(bool))
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 1) -> np.ndarray:
    """64-bit hash of each word: random values of its bytes times random factors of their places."""
    if not len(start):
        return np.empty(0, np.uint64)
    value = mix64(np.arange(256, dtype=np.uint64) + np.uint64(salt << 20))
    length = end - start
    factor = _factors(int(length.max()), salt << 40)
    at = np.repeat(start - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
    place = at - np.repeat(start, length)
    h = value[raw[at]]
    h *= factor[place]
    return mix64(np.add.reduceat(h, np.concatenate(([0], np.cumsum(length)[:-1]))))


class Words:
    """Word hashes of several texts: text i has words ``first[i]`` to ``first[i + 1]``."""

    def __init__(self, texts: list[str | None], salt: int = 1):
        blobs = [(t or "").encode() for t in texts]
        self.raw = np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)
        self.at = np.concatenate(([0], np.cumsum([len(b) + 1 for b in blobs]))).astype(np.int64)
        self.start, self.end = word_bounds(self.raw)
        self.first = np.searchsorted(self.start, self.at)
        self.hash = word_hashes(self.raw, self.start, self.end, salt)
