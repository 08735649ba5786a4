"""Word shingles as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


class WordHash(dict):
    """64-bit hash of each word, remembered; emptied by `trim` when large."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def trim(self, most: int = 400_000) -> None:
        if len(self) > most:
            self.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash; wraps around."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def words_of(text: str) -> list[bytes]:
    """Runs of characters other than space and the controls 9 to 13, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes], hashes: WordHash, width: int) -> np.ndarray:
    """Sorted distinct hashes of the width-word shingles; fewer words make one shingle, none make none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    if n < width:
        total = np.uint64(0)
        with np.errstate(over="ignore"):
            for i in range(n):
                total = total + w[i] * _K[i % 8] + np.uint64(i + 1)
            return mix(np.array([total ^ np.uint64(n)], np.uint64))
    total = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        total += w[i : n - width + 1 + i] * _K[i % 8] + np.uint64(i // 8)
    return np.unique(mix(total))
