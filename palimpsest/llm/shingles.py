"""Words and word shingles as 64-bit hashes, in numpy, for operators that run in Python workers."""

from __future__ import annotations

import numpy as np
import xxhash

#: Distinct words a worker remembers the hashes of; about 0.05 GB.
WORDS = 300_000
WIDTH = 5
_rng = np.random.default_rng(20)
#: Odd multipliers: one for each place in a shingle.
PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def shingles(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words; of fewer words, one hash of them all; of none, none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n < width:
        return mixed(np.array([(words * PLACE[8 : 8 + n]).sum() + np.uint64(n)], np.uint64))
    h = words[: n - width + 1] * PLACE[0]
    for k in range(1, width):
        h = h + words[k : n - width + 1 + k] * PLACE[k]
    return np.unique(mixed(h))
