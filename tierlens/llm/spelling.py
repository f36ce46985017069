"""Spelling variants by k-d trees over letter-count vectors.

**Words.** Each task counts the words of its texts in a table of bounded size
and sends (word, count) pairs, so a frequent word travels once per table.

**Letter counts.** One edit changes at most one letter count by +1 and one by
-1: the vectors of two near words are at an L1 distance of at most two. Counts
are written in unary (bit "the letter occurs at least t times"), so a box of
vectors is the AND and the OR of its members' bits, and the distance from a
vector to a box is two popcounts: what it must gain (at most one) and what it
must lose (at most one; none if the other word is the longer one).

**Trees.** Words of each length have a k-d tree of their own; every node splits
at the letter and count that halves its words best. The top of a tree is fitted
on a bounded sample (:data:`SAMPLE_WORDS`, by hash) and only decides which cell
a word goes to; a cell with more than ``CELL_WORDS`` words is cut by hash, so no
task holds more however uneven the sample. Every word of the corpus is indexed.
A word searches the cells that its vector can reach, of its own length and of
the next one; in its cell a task grows the tree down to leaves and walks all
searching words through it together. What remains is verified letter by letter.

**Forms.** A word's form is its most frequent near word if that is at least
``TIMES`` times as frequent. Counts grow by that factor from step to step, so a
chain is short; roots come from pointer jumping, one small join a round.
"""

from __future__ import annotations

import math
import zlib
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlens.llm.tables import save

LEAST_LETTERS, LEAST_COUNT, TIMES = 6, 5, 5
#: Distinct words that a counting task holds before it sends them; bounds memory, not results.
TABLE_WORDS = 300_000
#: Words of all lengths that the tops of the trees are fitted on, and indexed words of a cell at most, about.
SAMPLE_WORDS, CELL_WORDS = 100_000, 16_384
#: Longer words are not in the sample; their lengths have one cell each, cut by hash.
SAMPLE_LETTERS = 256
LEAF_WORDS = 32
#: Queries that walk through a tree together, and pairs verified together.
BATCH = 8192

# every byte of Latin-1 to itself (A-Z lower-cased) if it is a letter of the runs, else to a blank
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 0xC0 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def runs_of(text: str | None) -> list[bytes]:
    """The lower-cased letter runs of a text in Latin-1, one byte a letter."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split() if text else []


def _crc(run: bytes, start: int) -> int:
    return zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)


def shortened(doc_id: int, runs: list[bytes], modulus: int = 199) -> dict[bytes, bytes]:
    """The runs of a document that lose a letter, with what is left of them."""
    start = zlib.crc32(b"%d:" % doc_id)
    out = {}
    for run, h in zip(runs, map(_crc, runs, repeat(start))):
        if h % modulus == 0:
            at = h % len(run)
            out[run] = run[:at] + run[at + 1:]
    return out


def _counted(parts):
    table: dict[bytes, int] = {}

    def sent():
        out = pd.DataFrame({"word": [w.decode("latin-1") for w in table], "n": np.fromiter(table.values(), np.int64, len(table))})
        table.clear()
        return out

    get = table.get
    for pdf in parts:
        for doc_id, text in zip(pdf.doc_id.tolist(), pdf.text):
            own: dict[bytes, int] = {}
            for w in runs_of(text):
                own[w] = own.get(w, 0) + 1
            for run, left in shortened(doc_id, list(own)).items():
                n = own.pop(run)
                if left:
                    table[left] = get(left, 0) + n
            for w, n in own.items():
                table[w] = get(w, 0) + n
            if len(table) >= TABLE_WORDS:
                yield sent()
    if table:
        yield sent()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words in all whole texts. Rows without an id have no
    checksum: their runs stay whole."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")).filter("text is not null")
    counted = rows.filter("doc_id is not null").mapInPandas(_counted, "word string, n long").unionByName(
        rows.filter("doc_id is null").mapInPandas(_counted_plain, "word string, n long"))
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _counted_plain(parts):
    """Words of rows without an id: nothing is deleted from them."""
    for pdf in parts:
        own: dict[bytes, int] = {}
        for text in pdf.text:
            for w in runs_of(text):
                own[w] = own.get(w, 0) + 1
        yield pd.DataFrame({"word": [w.decode("latin-1") for w in own], "n": np.fromiter(own.values(), np.int64, len(own))})


# ------------------------------------------------------------------ vectors and boxes
def padded(words: list[bytes], length: int) -> np.ndarray:
    """Words of one length as a matrix of letters."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length)


#: Unary counts: bits 0-25 and 26-51 of lane 0 say that a-z occur at least once and twice, the rest of both
#: lanes that letters from 0xC0 on occur (folded), bits 0-25 of lane 1 that a-z occur three times. Counts
#: beyond and folded letters only make boxes wider; the letters themselves decide.
def letter_counts(letters: np.ndarray) -> np.ndarray:
    """(n, 2) unary letter counts of a letter matrix."""
    n = len(letters)
    counts = np.zeros((n, 26), np.uint16)
    rows = np.arange(n)
    out = np.zeros((n, 2), np.uint64)
    one = np.uint64(1)
    for column in letters.T:
        plain = column < 0x80
        counts[rows[plain], column[plain] - 97] += 1  # a row occurs once in a column
        odd = (column[~plain] - 0xC0).astype(np.uint64)
        lane1 = odd >= np.uint64(12)
        where = rows[~plain]
        out[where[~lane1], 0] |= one << (np.uint64(52) + odd[~lane1])
        out[where[lane1], 1] |= one << (np.uint64(26) + odd[lane1] % np.uint64(38))
    place = one << np.arange(26, dtype=np.uint64)
    for least, lane, shift in ((1, 0, 0), (2, 0, 26), (3, 1, 0)):
        out[:, lane] |= ((counts >= least) @ place) << np.uint64(shift)
    return out


def reachable(codes: np.ndarray, low: np.ndarray, high: np.ndarray, longer: bool) -> np.ndarray:
    """Which vectors are one edit away from the box of ``low`` (AND) and ``high``
    (OR): one count up, one down (none down if the box holds longer words)."""
    up = np.bitwise_count(low & ~codes).sum(axis=-1)
    down = np.bitwise_count(codes & ~high).sum(axis=-1)
    return (up <= 1) & (down <= (0 if longer else 1))


def best_split(codes: np.ndarray) -> tuple[int, int] | None:
    """(lane, bit) that halves the vectors best; None if all are equal."""
    best, found = 0, None
    for lane in (0, 1):
        ones = np.unpackbits(np.ascontiguousarray(codes[:, lane]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
        even = np.minimum(ones, len(codes) - ones)
        bit = int(even.argmax())
        if even[bit] > best:
            best, found = int(even[bit]), (lane, bit)
    return found


def has(codes: np.ndarray, split: tuple[int, int]) -> np.ndarray:
    return (codes[:, split[0]] >> np.uint64(split[1])) & np.uint64(1) == 1


class Top:
    """The top of a k-d tree, down to cells: fitted on a sample, walked by all words."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.cells = 0
        self.root = self._grow(sample, max(0, math.ceil(math.log2(max(1, cells)))))

    def _grow(self, codes: np.ndarray, depth: int):
        split = best_split(codes) if depth and len(codes) > 1 else None
        if split is None:
            self.cells += 1
            return self.cells - 1
        side = has(codes, split)
        return split, self._grow(codes[~side], depth - 1), self._grow(codes[side], depth - 1)

    def place(self, codes: np.ndarray) -> np.ndarray:
        """The cell of every vector."""
        out = np.zeros(len(codes), np.int32)

        def walk(node, rows):
            if isinstance(node, int):
                out[rows] = node
                return
            side = has(codes[rows], node[0])
            walk(node[1], rows[~side])
            walk(node[2], rows[side])

        walk(self.root, np.arange(len(codes)))
        return out

    def reach(self, codes: np.ndarray, longer: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for every cell that a vector one edit away may lie in."""
        rows_out, cells_out = [], []

        def walk(node, rows, up, down):
            if not len(rows):
                return
            if isinstance(node, int):
                rows_out.append(rows)
                cells_out.append(np.full(len(rows), node, np.int32))
                return
            side = has(codes[rows], node[0])
            stay = down + side  # to the half without the bit: vectors that have it lose it
            ok = stay <= (0 if longer else 1)
            walk(node[1], rows[ok], up[ok], stay[ok])
            gain = up + ~side
            ok = gain <= 1
            walk(node[2], rows[ok], gain[ok], down[ok])

        zero = np.zeros(len(codes), np.int8)
        walk(self.root, np.arange(len(codes)), zero, zero)
        return (np.concatenate(rows_out), np.concatenate(cells_out)) if rows_out else (np.empty(0, np.int64), np.empty(0, np.int32))


class Tree:
    """The k-d tree of one cell: boxes down to leaves of a few words."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.root = self._grow(np.arange(len(codes)))

    def _grow(self, rows: np.ndarray):
        own = self.codes[rows]
        box = np.bitwise_and.reduce(own, axis=0), np.bitwise_or.reduce(own, axis=0)
        split = best_split(own) if len(rows) > LEAF_WORDS else None
        if split is None:
            return box, rows, None
        side = has(own, split)
        return box, None, (self._grow(rows[~side]), self._grow(rows[side]))

    def search(self, codes: np.ndarray, longer: bool):
        """Yield (query rows, indexed rows): every pair of a leaf whose vectors are one edit apart."""
        stack = [(self.root, np.arange(len(codes)))]
        while stack:
            (box, rows, parts), queries = stack.pop()
            queries = queries[reachable(codes[queries], *box, longer)]
            if not len(queries):
                continue
            if parts is not None:
                stack += [(p, queries) for p in parts]
                continue
            step = max(1, BATCH * LEAF_WORDS // len(rows))  # a leaf of equal vectors may be large
            for a in range(0, len(queries), step):
                some = queries[a:a + step]
                own = self.codes[rows]
                q, w = np.nonzero(reachable(codes[some][:, None, :], own[None], own[None], longer))
                if len(q):
                    yield some[q], rows[w]


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Does each row of ``b`` (one letter longer) become that of ``a`` by deleting one letter?"""
    if not a.shape[1]:
        return np.ones(len(a), bool)
    head = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= a.shape[1]


# ------------------------------------------------------------------ Spark side
def _tops(words: DataFrame) -> dict[int, Top]:
    """Tops of the trees, by word length, from a bounded sample and the number of words of each length."""
    sizes = {r["len"]: r["n"] for r in words.groupBy("len").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "len").limit(SAMPLE_WORDS).collect()}
    total = sum(sizes.values())
    mark = F.pmod(F.xxhash64("word", F.lit(3)), F.lit(1 << 40))
    part = words.filter((F.col("len") <= SAMPLE_LETTERS) & (mark < int((1 << 40) * min(1.0, SAMPLE_WORDS / max(1, total))))).select("len", "word").limit(2 * SAMPLE_WORDS)
    sample: dict[int, list[bytes]] = {}
    for r in part.collect():
        sample.setdefault(r["len"], []).append(r["word"].encode("latin-1"))
    return {n: Top(letter_counts(padded(own, n)), -(-sizes.get(n, 1) // CELL_WORDS)) for n, own in sample.items()}


_PLACED = "len int, cell int, longer boolean, query boolean, word string, n long"


def _placed(tops: dict[int, Top]):
    """Each word once as an indexed word of its cell, and once for every cell of
    its own and of the next length that it searches."""
    def run(parts):
        for pdf in parts:
            for n, own in pdf.groupby("len"):
                n = int(n)
                codes = letter_counts(padded([w.encode("latin-1") for w in own.word], n))
                top = tops.get(n)
                word, count = own.word.to_numpy(), own.n.to_numpy()
                cells = top.place(codes) if top else np.zeros(len(own), np.int32)
                yield pd.DataFrame({"len": n, "cell": cells, "longer": False, "query": False, "word": word, "n": count})
                for longer in (False, True):
                    top = tops.get(n + longer)
                    rows, cells = top.reach(codes, longer) if top else (np.arange(len(own)), np.zeros(len(own), np.int32))
                    yield pd.DataFrame({"len": n + longer, "cell": cells, "longer": longer, "query": True, "word": word[rows], "n": count[rows]})
    return run


def _near(indexed: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """(word, near, near_n) found in one cell; a longer near word gives both directions."""
    none = pd.DataFrame({"word": np.empty(0, object), "near": np.empty(0, object), "near_n": np.empty(0, np.int64)})
    if not len(indexed) or not len(queries):
        return none
    length = int(indexed.len.iloc[0])
    words, counts = indexed.word.to_numpy(), indexed.n.to_numpy()
    letters = padded([w.encode("latin-1") for w in words], length)
    tree = Tree(letter_counts(letters))
    out = []
    for longer, own in queries.groupby("longer"):
        own_words, own_counts = own.word.to_numpy(), own.n.to_numpy()
        own_letters = padded([w.encode("latin-1") for w in own_words], length - int(longer))
        codes = letter_counts(own_letters)
        for a in range(0, len(own), BATCH):
            for q, w in tree.search(codes[a:a + BATCH], bool(longer)):
                q = q + a
                ok = (one_inserted if longer else one_replaced)(own_letters[q], letters[w])
                q, w = q[ok], w[ok]
                out.append((own_words[q], words[w], counts[w]))
                if longer:
                    out.append((words[w], own_words[q], own_counts[q]))
    return pd.DataFrame(dict(zip(none.columns, (np.concatenate(c) for c in zip(*out))))) if out else none


def near_words(words: DataFrame) -> DataFrame:
    """Every pair (word, near, near_n) of ``words`` (word, n) that are exactly one
    inserted, deleted or replaced letter apart, in both directions."""
    words = words.select("word", "n", F.length("word").cast("int").alias("len"))
    tops = _tops(words)
    placed = save(words.mapInPandas(_placed(tops), _PLACED), "spelling-placed")
    # a cell that turned out larger is cut by hash; its searching words go to every part
    parts = (placed.filter("not query").groupBy("len", "cell").agg(F.count(F.lit(1)).alias("size"))
             .select("len", "cell", F.ceil(F.col("size") / CELL_WORDS).cast("int").alias("parts")))
    placed = placed.join(parts, ["len", "cell"])
    indexed = placed.filter("not query").withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    asking = placed.filter("query").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = ["len", "cell", "part"]

    def side(d: DataFrame):
        return d.select(*[F.col(c).alias(c) for c in (*key, "longer", "word", "n")]).groupBy(*key)

    return side(indexed).cogroup(side(asking)).applyInPandas(_near, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of ``forms`` (word, form): the end of its
    chain, by pointer jumping. Chains have no cycles, since counts grow."""
    at = save(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = at.alias("a").join(at.alias("b"), F.col("a.root") == F.col("b.word"), "left").select(
            F.col("a.word").alias("word"), F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved"))
        step = save(step, "spelling-roots")
        at = step.drop("moved")
        if not step.filter("moved").limit(1).count():
            return at


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Per frequent word of ``docs``: ``word, n, n_near, form, form_n, root``.

    Words are runs of letters as :func:`runs_of` finds them; a run that the
    checksum of ``<doc_id>:<run>`` selects loses a letter first. A null or empty
    text has no words; rows without an id lose no letters; equal rows count each
    time. Very long runs are words like others. Extra columns are ignored; an
    empty table gives an empty result. Ties between near words of equal count
    go to the smallest in code-point order.
    """
    words = save(word_counts(docs).filter(
        (F.length("word") >= LEAST_LETTERS) & (F.col("n") >= LEAST_COUNT)), "spelling-words")
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best"))
    found = words.join(best, "word", "left")
    good = -F.col("best.m") >= TIMES * F.col("n")
    found = save(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
                              F.when(good, F.col("best.w")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n")), "spelling-forms")
    ends = roots(found.filter("form is not null"))
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
