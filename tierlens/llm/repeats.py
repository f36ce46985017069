"""Long repeats across documents: the Spark side that two operators share.

Both operators remove every unit (word or byte) covered by a window whose
content also starts in a document with a smaller id. They differ in how names
for shared substrings are formed; what runs on Spark is the same:

1. every whole text gets a SHA-256 digest; equal texts collapse to the row
   with the smallest id (a copy of 50 units or more is covered entirely);
2. texts travel once, grouped into blocks of neighbouring ids;
3. each block sends local names (:mod:`tierlens.llm.names`) and learns which
   other blocks hold them too: windows without shared names are done;
4. windows still open are named by their whole content (64-bit hash) and sent;
   as blocks are in the order of ids, the answer says which ones start in a
   smaller block, and inside a block the documents themselves tell;
5. the block cuts the covered units out of its texts.

Texts and blocks are processed whole; nothing is capped. The same exchange of
texts serves steps 3 to 5. Copies of a text travel with their own blocks, so
millions of them are spread over all blocks; one block keeps the text.
"""

from __future__ import annotations

import copy
import hashlib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlens.llm import names as nm
from tierlens.llm.tables import MOST_RANGES, id_bounds, keyed, pieces, range_of, save
from tierlens.llm.words import utf8

#: Bytes of text in a block, about.
BLOCK_BYTES = 6_000_000

_SIDE = "block long, kind int, bucket int, digest binary, rep long, copies long, bits binary"
_REP, _ANSWER, _CARRY = 2, 0, 1
RESULT = "doc_id long, copies long, n_units long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


_NOTHING = pd.DataFrame(columns=["block", "bucket", "kind", "names", "ranks", "ids"])


def free_bits(names: float) -> int:
    """Low bits that about so many local names can do without: names keep 12 bits
    more than it takes to number them (40 at least), so one in 4096 at most meets
    another by chance whatever the input. Such a name leaves windows open, which
    their whole names then settle; it is no error."""
    return max(0, 64 - max(40, math.ceil(math.log2(max(1.0, names))) + 12))


class Method:
    """What an operator supplies; an instance travels to the tasks."""

    window = 50
    #: low bits of a local name that do not travel (:func:`free_bits` of the input, set on a copy)
    low = 0
    #: local names and windows per byte of text, about (for the number of buckets)
    names_per_byte = 0.25
    windows_per_byte = 0.25

    def parse(self, raw: bytes):
        """The units of a text."""
        raise NotImplementedError

    def count(self, units) -> int:
        return len(units)

    def join(self, units, keep: np.ndarray) -> bytes:
        """The text of the units whose ``keep`` is set."""
        raise NotImplementedError

    def prepare(self, raws: list[bytes]) -> dict:
        """A block's flat arrays: at least ``raws`` and ``starts`` (first unit of each text, and the total)."""
        raise NotImplementedError

    def local_names(self, block: dict) -> tuple[np.ndarray, np.ndarray]:
        """(sorted distinct names, those which two texts of the block share)."""
        raise NotImplementedError

    def candidates(self, block: dict, shared: np.ndarray) -> np.ndarray:
        """Starts of the windows that a set of shared names leaves open."""
        raise NotImplementedError

    def window_names(self, block: dict, starts: np.ndarray) -> np.ndarray:
        """64-bit names of whole windows."""
        raise NotImplementedError


def _digests(window: int, method: Method):
    def run(parts):
        for pdf in parts:
            raws = [utf8(t) for t in pdf.text]
            units = [method.parse(r) for r in raws]
            n = [method.count(u) for u in units]
            yield pd.DataFrame({
                "doc_id": pdf.doc_id, "digest": [hashlib.sha256(r).digest() for r in raws], "n_units": n,
                "short": [method.join(u, np.ones(k, bool)) if k < window else None for u, k in zip(units, n)]})
    return run


def _texts(parts):
    """Each text of a partition once for every block it goes to, packed."""
    seen: set[tuple[int, bytes]] = set()
    pack = zstandard.ZstdCompressor(level=3)
    for pdf in parts:
        block, digest, body = [], [], []
        for b, t in zip(pdf.block.tolist(), pdf.text):
            raw = utf8(t)
            d = hashlib.sha256(raw).digest()
            if (b, d[:16]) not in seen:
                seen.add((b, d[:16]))
                block.append(b)
                digest.append(d)
                body.append(pack.compress(raw))
        yield pd.DataFrame({"block": block, "digest": digest, "body": body})


def _load(method: Method, texts: pd.DataFrame, rows: pd.DataFrame) -> tuple[dict, np.ndarray, np.ndarray]:
    """The texts that have their smallest id in this block, by that id: (flat
    arrays, ids, rows that are shown for each). Copies of other blocks' texts go."""
    texts = texts.drop_duplicates("digest").merge(rows.loc[rows.kind == _REP, ["digest", "rep", "copies"]], on="digest").sort_values(["rep", "digest"])
    unpack = zstandard.ZstdDecompressor()
    return method.prepare([unpack.decompress(b) for b in texts.body]), texts.rep.to_numpy(np.int64), texts.copies.to_numpy(np.int64)


def shared_inside(names: np.ndarray, texts: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct names, and whether two texts of the block hold each. The
    names' lowest ``low`` bits are zero and take the text's number for one sort;
    where they are too few for the texts of the block, the two are sorted together."""
    if not len(names):
        return names, np.empty(0, bool)
    if int(texts.max()) >> low:
        order = np.lexsort((texts, names))
        names, texts = names[order], texts[order]
        first = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
        last = np.append(first[1:], len(names)) - 1
        return names[first], texts[first] != texts[last]
    both = np.sort(names | texts.astype(np.uint64))
    names = both >> np.uint64(low)
    first = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
    last = np.append(first[1:], len(names)) - 1
    return names[first] << np.uint64(low), both[first] != both[last]


def whole_windows(block: dict, window: int) -> np.ndarray:
    """For every unit: does a window that starts here end in the same text?"""
    ok = np.ones(block["starts"][-1], bool)
    for a, z in zip(block["starts"][:-1].tolist(), block["starts"][1:].tolist()):
        ok[max(a, z - window + 1):z] = False
    return ok


def covering(first: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """For n places: does one of the ranges [first, end) hold it?"""
    step = np.bincount(first, minlength=n + 1)[:n + 1] - np.bincount(end, minlength=n + 1)[:n + 1]
    return np.cumsum(step[:n]) > 0


def text_of_unit(block: dict) -> np.ndarray:
    return np.repeat(np.arange(len(block["starts"]) - 1), np.diff(block["starts"]))


def _second_names(method: Method, block: dict, open_: np.ndarray, reps: np.ndarray):
    """Window names of a block: every open window's name, the sorted distinct
    names, the smallest document (as rank in the sorted ids) of each."""
    all_names = method.window_names(block, open_)
    ids = np.unique(reps)
    if not len(open_):
        return all_names, np.empty(0, np.int64), all_names, np.empty(0, np.int64), ids
    rank = np.searchsorted(ids, reps)[text_of_unit(block)[open_]]
    order = np.argsort(all_names)
    s = all_names[order]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    return all_names, rank, s[first], np.minimum.reduceat(rank[order], first), ids


def remove_repeats(docs: DataFrame, method: Method) -> DataFrame:
    """Per document row: ``doc_id, n_units, n_removed, spans`` (removed runs of
    units, end exclusive) and ``kept`` (UTF-8 of what stays).

    A null text counts as empty. A null ``doc_id`` orders after all others.
    Rows with equal ids do not remove each other's text. Extra columns are
    ignored; an empty table gives an empty result.
    """
    base = keyed(docs)
    window = method.window
    small = save(base.mapInPandas(_digests(window, method), "doc_id long, digest binary, n_units long, short binary"),
                 "digests")
    reps = (small.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
            .groupBy("digest").agg(F.min(F.struct("doc_id", "copies")).alias("r"))
            .select("digest", F.col("r.doc_id").alias("rep"), F.col("r.copies").alias("copies")))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = pieces(total, BLOCK_BYTES)
    method = copy.copy(method)
    method.low = free_bits(total * method.names_per_byte)
    ranges = min(n_blocks, MOST_RANGES)
    bounds, n_sub = id_bounds(base, ranges), pieces(n_blocks, ranges)
    ordered = n_sub == 1

    def block_of(doc_id: str):
        """Ranges of ids, so that a smaller block has smaller ids; beyond the most
        ranges there are, a range's documents are dealt to several blocks."""
        at = range_of(F.col(doc_id), bounds)
        return (at if ordered else at * n_sub + F.pmod(F.xxhash64(doc_id), F.lit(n_sub))).cast("bigint").alias("block")

    bits1 = nm.bucket_bits(int(total * method.names_per_byte))
    bits2 = nm.bucket_bits(int(total * method.windows_per_byte))
    texts = base.select(block_of("doc_id"), "text").mapInPandas(_texts, "block long, digest binary, body binary")

    rep_rows = reps.select(
        block_of("rep"), F.lit(_REP).alias("kind"), F.lit(0).alias("bucket"), "digest", "rep", "copies",
        F.lit(None).cast("binary").alias("bits"))

    def side(answers: DataFrame) -> DataFrame:
        none = F.lit(0).cast("bigint")  # not null: pandas would turn the ids into floats
        return rep_rows.unionByName(answers.withColumns({"rep": none, "copies": none}), allowMissingColumns=True)

    def first_frame(texts_: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(texts_):
            return _NOTHING
        b, _, _ = _load(method, texts_, rows)
        found, _ = method.local_names(b)
        parts = list(nm.send(int(texts_.block.iloc[0]), found, bits1, low=method.low))
        return pd.concat(parts) if parts else _NOTHING

    def second_frame(texts_: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(texts_):
            return _NOTHING
        block = int(texts_.block.iloc[0])
        b, reps_, _ = _load(method, texts_, rows)
        found, inside = method.local_names(b)
        told = nm.received(rows[rows.kind == _ANSWER], found, bits1)
        open_ = method.candidates(b, found[told | inside])
        if not len(open_):
            return _NOTHING
        _, _, distinct, rank, ids = _second_names(method, b, open_, reps_)
        parts = list(nm.send(block, distinct, bits2, kind=nm.ORDERED) if ordered else
                     nm.send(block, distinct, bits2, ranks=rank, ids=ids))
        parts.append(nm.carry(block, bits2, zstandard.compress(nm.pack(open_))))
        return pd.concat(parts)

    def last_frame(texts_: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(texts_):
            b, ids, copies = _load(method, texts_, rows)
            starts, n = b["starts"], b["starts"][-1]
            hit = np.empty(0, np.int64)
            carried = rows[rows.kind == _CARRY]
            if len(carried):
                open_ = nm.unpack(zstandard.decompress(carried.bits.iloc[0])).astype(np.int64)
                all_names, rank, distinct, least, _ = _second_names(method, b, open_, ids)
                told = nm.received(rows[rows.kind == _ANSWER], distinct, bits2)
                at = np.searchsorted(distinct, all_names)
                hit = open_[told[at] | (rank > least[at])]
            covered = covering(hit, hit + window, n)
            for k, (i, c) in enumerate(zip(ids, copies)):
                cut = covered[starts[k]:starts[k + 1]]
                edge = np.diff(np.concatenate(([0], cut.view(np.int8), [0])))
                runs = [{"start": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
                out.append((int(i), int(c), len(cut), int(cut.sum()), runs, method.join(method.parse(b["raws"][k]), ~cut)))
        return pd.DataFrame(out, columns=["doc_id", "copies", "n_units", "n_removed", "spans", "kept"])

    answers1 = (texts.groupBy("block").cogroup(rep_rows.groupBy("block")).applyInPandas(first_frame, nm.SENT)
                .groupBy("bucket").applyInPandas(nm.answer, nm.ANSWER))
    answers2 = (texts.groupBy("block").cogroup(side(answers1).groupBy("block")).applyInPandas(second_frame, nm.SENT)
                .groupBy("bucket").applyInPandas(nm.answer, nm.ANSWER))
    own = texts.groupBy("block").cogroup(side(answers2).groupBy("block")).applyInPandas(last_frame, RESULT)
    own = own.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("i", "copies")
    covered = F.col("n_units") >= window
    copies = (small.join(reps, "digest").filter("doc_id != rep").select(
        "doc_id", "n_units", F.when(covered, F.col("n_units")).otherwise(0).alias("n_removed"),
        F.when(covered, F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_units").alias("end"))))
        .otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
        F.when(covered, F.lit(b"")).otherwise(F.col("short")).alias("kept")))
    return own.unionByName(copies)
