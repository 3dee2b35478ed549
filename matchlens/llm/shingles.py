"""Sets of hashed word shingles of whole texts, as sorted 64-bit numbers."""

from __future__ import annotations

import numpy as np
import xxhash

MOST_WORDS = 200_000         # in a task's table, some 35 MB; then it starts anew
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()


def forget_words() -> None:
    _hashes.clear()


def mixed(values: np.ndarray) -> np.ndarray:
    """Each 64-bit number scattered over all 64-bit numbers, one to one."""
    x = values ^ (values >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> np.ndarray:
    """Hashes of the words, A-Z lower-cased. The separators are space and the controls 9 to 13."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles of `width` words, sorted; of a shorter text its whole word sequence; without words none."""
    words = words_of(text)
    if not len(words):
        return words
    width = min(width, len(words))
    joined = np.full(len(words) - width + 1, np.uint64(width))
    for k in range(width):
        joined = mixed(joined * np.uint64(0x9E3779B97F4A7C15) + words[k:len(words) - width + 1 + k])
    return np.unique(joined)
