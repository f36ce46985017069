"""Suffix dedup by a difference cover: long repeats of bytes across documents.

A set D is a difference cover modulo v if every difference modulo v is one of
two members of D. Positions with residue in D are sampled; for any positions
i, j there is then a shift d < v that puts both i+d and j+d on samples. So if
50 bytes from i equal 50 bytes from j, sampled suffixes at i+d and j+d agree in
their first 50-v+1 bytes.

1. Sampled tuples (the first 30 bytes of sampled suffixes, v=21) are sorted
   and named; tuples that sort alone have no equal neighbour and drop out.
2. The algorithm goes on with what is left: the remaining suffixes (sampled or
   not) that reach an equal sampled tuple within v positions.
3. These are merged into one order by their first 50 bytes, and adjacent equal
   prefixes are repeats; the smallest document of each run stays.

Only equality up to 50 bytes matters, so tuples and prefixes are ordered by
64-bit hashes of their bytes instead of the bytes, and the recursion that a
full suffix order needs ends after its first step. Sorting is per bucket of the
hash range (:mod:`repeats`, :mod:`names`).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tierlens.llm.repeats import Method, covering, remove_repeats, shared_inside, text_of_unit, whole_windows
from tierlens.llm.words import mix, rolling

#: A perfect difference set: each non-zero difference modulo 21 occurs once.
PERIOD = 21
COVER = (3, 6, 7, 12, 14)

_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


class DifferenceCover(Method):
    names_per_byte = 0.24
    windows_per_byte = 0.2

    def parse(self, raw):
        return raw

    def join(self, units, keep):
        return np.frombuffer(units, np.uint8)[keep].tobytes()

    def prepare(self, raws):
        starts = np.concatenate(([0], np.cumsum([len(r) for r in raws]))).astype(np.int64)
        return {"raws": raws, "starts": starts, "bytes": np.frombuffer(b"".join(raws), np.uint8)}

    def _samples(self, block):
        """Sampled positions with a whole tuple in their text, and the tuples' names."""
        width = self.window - PERIOD + 1
        n = block["starts"][-1]
        sampled = np.zeros(PERIOD, bool)
        sampled[list(COVER)] = True
        at = np.flatnonzero(np.resize(sampled, n) & whole_windows(block, width)) if n else np.empty(0, np.int64)
        names = mix(rolling(_BYTE[block["bytes"]], width)[at])
        return at, (names >> np.uint64(self.low)) << np.uint64(self.low)

    def local_names(self, block):
        at, names = self._samples(block)
        return shared_inside(names, text_of_unit(block)[at], self.low)

    def candidates(self, block, shared):
        at, names = self._samples(block)
        if not len(shared):
            return np.empty(0, np.int64)
        hit = at[shared[np.minimum(np.searchsorted(shared, names), len(shared) - 1)] == names]
        near = covering(np.maximum(hit - PERIOD + 1, 0), hit + 1, block["starts"][-1])
        return np.flatnonzero(near & whole_windows(block, self.window))

    def window_names(self, block, starts):
        return mix(rolling(_BYTE[block["bytes"]], self.window)[starts])


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """Remove every byte covered by a 50-byte string that also starts in a
    document with a smaller id. Columns ``doc_id, n_units`` (bytes),
    ``n_removed, spans`` (removed runs of byte positions), ``kept`` (remaining
    bytes). Nulls, empty tables and equal rows: see
    :func:`tierlens.llm.repeats.remove_repeats`."""
    return remove_repeats(docs, DifferenceCover())
