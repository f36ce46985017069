"""Which 64-bit names do several text blocks share? A packed exchange.

Names (hashes of substrings or symbols) are far too many to travel as rows. A
block of a few MB sorts its distinct names and sends them as zstd-packed
differences, cut into buckets of the name space; one task per bucket merges
what all blocks sent and answers each sender with one bit per name, in the
order sent. Equal names always meet in one bucket, every block sends a name
once however often it holds it, so a name that all documents share costs one
entry per block. Buckets are sized by the expected number of names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard

#: Names of one bucket, about; bounds the memory of a merging task.
BUCKET_NAMES = 2_000_000

SENT = "block long, bucket int, kind int, names binary, ranks binary, ids binary"
ANSWER = "block long, bucket int, kind int, bits binary"

#: kind of a row: names, a row only passed through, names whose blocks are in document order.
NAMES, CARRY, ORDERED = 0, 1, 3


def bucket_bits(expected: int) -> int:
    """log2 of the number of buckets for about so many names."""
    return max(0, math.ceil(math.log2(max(1, expected) / BUCKET_NAMES)))


def pack(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as zstd-packed byte planes of their differences."""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    return np.cumsum(np.ascontiguousarray(flat.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _pack16(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack16(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view(np.uint32).ravel()


def _cuts(names: np.ndarray, bits: int) -> np.ndarray:
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.empty(0, np.uint64)
    return np.concatenate(([0], np.searchsorted(names, edges), [len(names)]))


def send(block: int, names: np.ndarray, bits: int, ranks: np.ndarray | None = None,
         ids: np.ndarray | None = None, low: int = 0, kind: int = NAMES) -> Iterator[pd.DataFrame]:
    """Rows of :data:`SENT` for a block's sorted distinct names.

    ``ranks[i]`` is the index in ``ids`` of the smallest document of name i;
    the lowest ``low`` bits of all names are zero and do not travel.
    """
    at = _cuts(names, bits)
    for b in np.flatnonzero(np.diff(at)):
        s = slice(at[b], at[b + 1])
        yield pd.DataFrame({
            "block": [block], "bucket": [int(b)], "kind": [kind], "names": [pack(names[s] >> np.uint64(low))],
            "ranks": [None if ranks is None else _pack16(ranks[s])],
            "ids": [None if ids is None else ids.astype(np.int64).tobytes()]})


def carry(block: int, bits: int, payload: bytes) -> pd.DataFrame:
    """A row that the merging task hands back to the block as it is."""
    return pd.DataFrame({"block": [block], "bucket": [block % (1 << bits)], "kind": [CARRY], "names": [payload],
                         "ranks": [None], "ids": [None]})


def answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Merge one bucket. Bit i of an answer: another block sent the same name;
    for ordered names, a smaller block did; with ids, another block has a
    smaller document for it."""
    out = pdf[pdf.kind == CARRY].rename(columns={"names": "bits"})[["block", "bucket", "kind", "bits"]]
    rows = pdf[pdf.kind != CARRY]
    if not len(rows):
        return out
    lists = [unpack(x) for x in rows.names]
    lengths = np.array([len(x) for x in lists])
    names = np.concatenate(lists)
    del lists
    ordered, with_ids = rows.kind.iloc[0] == ORDERED, rows.ids.iloc[0] is not None
    order = np.argsort(names)
    sorted_names = names[order]
    first = np.concatenate(([True], sorted_names[1:] != sorted_names[:-1]))
    start = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    if with_ids:
        docs = np.concatenate([np.frombuffer(i, np.int64)[_unpack16(r)] for i, r in zip(rows.ids, rows.ranks)])[order]
        flag = docs > np.minimum.reduceat(docs, start)[group]
    elif ordered:
        block = np.repeat(rows.block.to_numpy(), lengths)[order]
        flag = block > np.minimum.reduceat(block, start)[group]
    else:
        flag = np.diff(np.append(start, len(names)))[group] > 1
    bits = np.empty(len(names), dtype=bool)
    bits[order] = flag
    parts = np.split(bits, np.cumsum(lengths)[:-1])
    told = pd.DataFrame({"block": rows.block.values, "bucket": rows.bucket.values, "kind": NAMES,
                         "bits": [np.packbits(p).tobytes() for p in parts]})
    return pd.concat([told, out]) if len(out) else told


def received(rows: pd.DataFrame, names: np.ndarray, bits: int) -> np.ndarray:
    """The answered bits of a block, aligned with the sorted names it sent."""
    at = _cuts(names, bits)
    out = np.zeros(len(names), dtype=bool)
    for b, raw in zip(rows.bucket, rows.bits):
        n = at[b + 1] - at[b]
        out[at[b]:at[b + 1]] = np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)
    return out
