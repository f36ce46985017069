"""Words and shingles as 64-bit arrays, for the tasks of the text operators.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]`` in UTF-8, which
is exactly what ``bytes.split()`` yields. Each word is hashed once per task
(XXH3, 64 bits) and remembered in a table of bounded size.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Words remembered per task before the table starts afresh; bounds memory, not results.
TABLE_WORDS = 400_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class WordTable(dict):
    """word -> 64-bit hash, filled on first use."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= TABLE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def ascii_lower(raw: bytes) -> bytes:
    """A-Z to a-z, every other byte unchanged."""
    return raw.translate(_LOWER)


def word_hashes(words: list[bytes], table: WordTable) -> np.ndarray:
    return np.fromiter(map(table.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers (xor-shift and odd multiplications)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer than k words
    the whole sequence counts as one shingle, without words there is none."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    acc = np.full(n - k + 1, np.uint64(k))
    for j in range(k):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + words[j:n - k + 1 + j])
    return np.unique(acc)


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def rolling(units: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k units from every position on (of those that have k), by
    prefix sums of a polynomial modulo 2^64; the value depends on content only.
    Callers spread what they keep of it with :func:`mix`."""
    n = len(units)
    if n < k:
        return np.empty(0, np.uint64)
    power = np.full(n, _BASE, np.uint64)
    power[0] = 1
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(units * np.cumprod(power, out=power), out=total[1:])
    out = total[k:] - total[:-k]
    power = power[:n - k + 1]
    power[:] = _INVERSE
    power[0] = 1
    out *= np.cumprod(power, out=power)
    return out
