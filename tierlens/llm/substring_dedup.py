"""Substring dedup by recompression: long repeats of words across documents.

Rounds rename the word sequence of every text. A round first names maximal
runs of one symbol (symbol, length), then splits the symbols into two classes
by a bit of their name and names each pair (first class, second class). Names
are 64-bit hashes of what they stand for, so all tasks give equal runs and
pairs equal names without exchanging a name table. Whether a symbol arises
depends on its neighbours only: with every symbol goes the extent of words
that decides it, and two equal word sequences hold equal symbols wherever the
extent lies inside.

After the rounds a window of 50 words can repeat elsewhere only if every
high-level symbol decided inside it occurs in another text. That reveals the
candidates; a hash of the whole window verifies them (:mod:`repeats`). Symbols
that long runs stretch beyond a window decide nothing, such windows are
verified directly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tierlens.llm.repeats import Method, covering, remove_repeats, shared_inside, text_of_unit, whole_windows
from tierlens.llm.words import WordTable, mix, rolling, word_hashes

#: Rounds of run and pair naming; a symbol then stands for about 2.4 words.
ROUNDS = 3

_OUTSIDE = np.int64(1) << 40


def _runs(sym, text, lo, hi, salt):
    """Name maximal runs; a run is decided by its symbols and both neighbours."""
    start = np.flatnonzero(np.concatenate(([True], (sym[1:] != sym[:-1]) | (text[1:] != text[:-1]))))
    length = np.diff(np.append(start, len(sym)))
    name = np.where(length > 1, mix(sym[start] * salt + length.astype(np.uint64)), sym[start])
    lo, hi = np.minimum.reduceat(lo, start), np.maximum.reduceat(hi, start)
    return (name, text[start], *_with_neighbours(text[start], lo, hi, True, True))


def _with_neighbours(text, lo, hi, left, right):
    """Extents widened to the neighbours where asked for; past the edge of a text nothing decides."""
    joined = text[1:] == text[:-1]
    left_lo = np.concatenate(([-_OUTSIDE], np.where(joined, lo[:-1], -_OUTSIDE)))
    left_hi = np.concatenate(([_OUTSIDE], np.where(joined, hi[:-1], _OUTSIDE)))
    right_lo = np.concatenate((np.where(joined, lo[1:], -_OUTSIDE), [-_OUTSIDE]))
    right_hi = np.concatenate((np.where(joined, hi[1:], _OUTSIDE), [_OUTSIDE]))
    new_lo = np.minimum(np.where(left, np.minimum(lo, left_lo), lo), np.where(right, right_lo, lo))
    new_hi = np.maximum(np.where(left, np.maximum(hi, left_hi), hi), np.where(right, right_hi, hi))
    return new_lo, new_hi


def _pairs(sym, text, lo, hi, salt):
    """Name pairs of a first-class and a second-class symbol; a symbol without
    partner is decided by the neighbour that could have been it."""
    first = (mix(sym ^ salt) >> np.uint64(63)).astype(bool)
    head = np.zeros(len(sym), bool)
    head[:-1] = first[:-1] & ~first[1:] & (text[1:] == text[:-1])
    tail = np.zeros(len(sym), bool)
    tail[1:] = head[:-1]
    single = ~head & ~tail
    wide_lo, wide_hi = _with_neighbours(text, lo, hi, single & ~first, single & first)
    at = np.flatnonzero(head)
    sym, wide_lo, wide_hi = sym.copy(), wide_lo, wide_hi
    sym[at] = mix(mix(sym[at] + salt) * np.uint64(0x9E3779B97F4A7C15) + sym[at + 1])
    wide_lo[at] = np.minimum(lo[at], lo[at + 1])
    wide_hi[at] = np.maximum(hi[at], hi[at + 1])
    return sym[~tail], text[~tail], wide_lo[~tail], wide_hi[~tail]


def recompress(words: np.ndarray, text: np.ndarray, rounds: int = ROUNDS):
    """(symbols, their texts, first and last word that decide each)."""
    sym, lo = words, np.arange(len(words), dtype=np.int64)
    hi = lo
    for r in range(rounds if len(words) else 0):
        salt = mix(np.array([2 * r + 1], np.uint64))[0] | np.uint64(1)
        sym, text, lo, hi = _runs(sym, text, lo, hi, salt)
        sym, text, lo, hi = _pairs(sym, text, lo, hi, salt)
    return sym, text, lo, hi


class Recompression(Method):
    names_per_byte = 0.07
    windows_per_byte = 0.04

    def parse(self, raw):
        return raw.split()

    def join(self, units, keep):
        return b" ".join(w for w, k in zip(units, keep.tolist()) if k)

    def prepare(self, raws):
        table = WordTable()
        each = [word_hashes(r.split(), table) for r in raws]
        starts = np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int64)
        b = {"raws": raws, "starts": starts, "words": np.concatenate([np.empty(0, np.uint64), *each])}
        sym, text, lo, hi = recompress(b["words"], text_of_unit(b))
        use = (lo >= 0) & (hi - lo < self.window)
        b["symbols"] = (sym[use] >> np.uint64(self.low)) << np.uint64(self.low), text[use], lo[use], hi[use]
        return b

    def local_names(self, block):
        sym, text, _, _ = block["symbols"]
        return shared_inside(sym, text, self.low)

    def candidates(self, block, shared):
        sym, _, lo, hi = block["symbols"]
        at = np.minimum(np.searchsorted(shared, sym), max(len(shared) - 1, 0))
        alone = shared[at] != sym if len(shared) else np.ones(len(sym), bool)
        out = covering(np.maximum(hi[alone] - self.window + 1, 0), lo[alone] + 1, block["starts"][-1])
        return np.flatnonzero(~out & whole_windows(block, self.window))

    def window_names(self, block, starts):
        return mix(rolling(block["words"], self.window)[starts])


def substring_dedup(docs: DataFrame) -> DataFrame:
    """Remove every word covered by a 50-word window that also starts in a
    document with a smaller id. Columns ``doc_id, n_units`` (words),
    ``n_removed, spans`` (removed runs of word positions), ``kept`` (UTF-8,
    words joined by one space). Nulls, empty tables and equal rows: see
    :func:`tierlens.llm.repeats.remove_repeats`."""
    return remove_repeats(docs, Recompression())
