"""Hard negatives by inner product over an STR-packed R-tree.

**Tree.** Rows are sorted tile by tile: slabs of the first coordinate, runs of
the second inside each slab, the third inside each run, then a hash of the row,
so that equal vectors spread instead of filling one tile. Spark's range
partitioning deals that order to parts, each part cuts it into pages of
``PAGE_ROWS`` rows, and a page keeps the smallest box around its vectors.

**Bounds.** With a box [lo, hi] an anchor's inner product lies, coordinate by
coordinate, between min(q*lo, q*hi) and max(q*lo, q*hi); the sums bound every
score of the page.

**Search.** A part and a block of anchors meet in one task. Each anchor has a
queue of the part's pages, best upper bound first, and leaves out pages outside
its score windows or strictly below its k-th best score so far (equal scores
may still win by a smaller id). Parts are searched in two waves: about
sqrt(parts) of them first, the rest against the k-th scores that these gave, so
what tasks return per anchor grows with sqrt(parts). Nothing is left out for
size: every part meets every block of anchors, whole.

The first search finds each anchor's positives (its label), the second the
negatives in the window that each positive opens.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierlens.llm.tables import id_bounds, range_of, save

PAGE_ROWS = 256
#: Parts of the tree: about so many while they stay small, then parts of at most PART_ROWS rows.
PARTS, LEAST_PART_ROWS, PART_ROWS = 64, 2048, 131_072
#: Anchors that meet a part in one task, and of these the ones searched together.
BLOCK_ANCHORS, TOGETHER = 16_384, 1024
#: Slabs of a coordinate at most (beyond, the pages of a slab lie closer in the third coordinate).
MOST_SLABS = 64
#: Sums of products below this are exact in float64.
_EXACT = float(2**53)

_PAGE = "part int, n int, dim int, lo binary, hi binary, vectors binary, ids binary, labels binary, marks binary"
_FOUND = "anchor_id long, anchor_mark long, slot int, score long, vec_id long"
_ANCHOR = ["anchor_id", "anchor_mark"]


def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vector: array<bigint>, mark): the rows that take part.

    Rows with a null id, label or vector, or a null or non-finite component,
    take no part; components become floor(256 * x). Rows that agree in
    everything count once; ``mark`` tells the others apart."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
                       F.transform(x, lambda v: F.floor(v.cast("double") * 256)).alias("vector"))
    return rows.distinct().withColumn("mark", F.xxhash64("vec_id", "label", "vector"))


def relabelled(vectors: DataFrame) -> DataFrame:
    """Rows whose id is divisible by 7 get the next of ten labels."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


# ------------------------------------------------------------------ the tree
def _packed(vectors: list, dim: int) -> np.ndarray:
    """Vectors as rows of one matrix, shorter ones continued with zeros."""
    out = np.zeros((len(vectors), dim), np.int64)
    for row, v in zip(out, vectors):
        row[:len(v)] = v
    return out


def _pages(dim: int):
    def run(parts):
        part = TaskContext.get().partitionId()
        for pdf in parts:
            for a in range(0, len(pdf), PAGE_ROWS):
                own = pdf.iloc[a:a + PAGE_ROWS]
                x = _packed(own.vector.tolist(), dim)
                yield pd.DataFrame([(part, len(own), dim, x.min(axis=0).tobytes(), x.max(axis=0).tobytes(), x.tobytes(),
                                     own.vec_id.to_numpy(np.int64).tobytes(), own.label.to_numpy(np.int64).tobytes(),
                                     own.mark.to_numpy(np.int64).tobytes())], columns=[c.split()[0] for c in _PAGE.split(", ")])
    return run


def str_tree(rows: DataFrame, dim: int, total: int) -> DataFrame:
    """The pages of the tree over ``rows`` (vec_id, label, vector, mark)."""
    part_rows = min(PART_ROWS, max(LEAST_PART_ROWS, math.ceil(total / PARTS)))
    n_parts = max(1, math.ceil(total / part_rows))
    slabs = min(MOST_SLABS, max(1, round((total / PAGE_ROWS) ** (1 / 3))))

    def coordinate(i: int) -> Column:
        return F.coalesce(F.get("vector", F.lit(i)), F.lit(0).cast("bigint"))

    d = rows.withColumns({f"x{i}": coordinate(i) for i in range(3)})
    bounds = id_bounds(d.select(F.col("x0").alias("doc_id")), slabs)
    d = d.withColumn("slab", range_of(F.col("x0"), bounds))
    at = [i / slabs for i in range(1, slabs)]
    runs = d.groupBy("slab").agg((F.percentile_approx("x1", at, 100 * slabs) if at else F.array().cast("array<bigint>")).alias("bounds"))
    d = d.join(F.broadcast(runs), "slab")  # a row for each slab, MOST_SLABS at most
    d = d.withColumn("run", F.size(F.filter("bounds", lambda b: b <= F.col("x1"))))
    keys = ["slab", "run", "x2", "mark"]
    dealt = d.select(*keys, "vec_id", "label", "vector").repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys)
    return save(dealt.select("vec_id", "label", "vector", "mark").mapInPandas(_pages(dim), _PAGE), "rtree")


# ------------------------------------------------------------------ the search in one part
class Part:
    """The pages of one part: vectors, boxes, ids."""

    def __init__(self, pages: pd.DataFrame):
        self.dim = int(pages.dim.iloc[0])
        self.lo, self.hi = (np.stack([np.frombuffer(b, np.int64) for b in pages[c]]) for c in ("lo", "hi"))
        self.vectors = [np.frombuffer(b, np.int64).reshape(-1, self.dim) for b in pages.vectors]
        self.ids, self.labels, self.marks = ([np.frombuffer(b, np.int64) for b in pages[c]] for c in ("ids", "labels", "marks"))
        self.largest = float(max(np.abs(self.lo.astype(float)).max(initial=0), np.abs(self.hi.astype(float)).max(initial=0)))

    def number(self, anchors: np.ndarray):
        """Type in which inner products with these anchors are exact."""
        return np.float64 if self.dim * self.largest * np.abs(anchors.astype(float)).max(initial=0) < _EXACT else np.int64

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible score of each anchor (row) in each page;
        where float64 does not hold them exactly, a little wider."""
        plus, minus = np.maximum(anchors, 0).astype(float), np.minimum(anchors, 0).astype(float)
        lo, hi = self.lo.astype(float).T, self.hi.astype(float).T
        least, most = plus @ lo + minus @ hi, plus @ hi + minus @ lo
        if self.number(anchors) is np.int64:
            slack = 1e-12 * ((plus - minus) @ np.maximum(np.abs(lo), np.abs(hi)))
            least, most = least - slack, most + slack
        end = 2.0**63 - 1024  # the largest float64 that is an int64
        return np.clip(least, -end, end).astype(np.int64), np.clip(most, -end, end).astype(np.int64)


class Best:
    """The k best (score, smallest id) of every slot so far."""

    def __init__(self, kth: np.ndarray, k: int):
        self.k, self.kth = k, kth.copy()
        self.slot, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.concatenate(([True], slot[1:] != slot[:-1])) if len(slot) else np.empty(0, bool)
        starts = np.flatnonzero(first)
        place = np.arange(len(slot)) - np.repeat(starts, np.diff(np.append(starts, len(slot))))
        keep = place < self.k
        last = place == self.k - 1
        self.kth[slot[last]] = np.maximum(self.kth[slot[last]], score[last])
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]


def search(part: Part, anchors: np.ndarray, labels: np.ndarray, ids: np.ndarray, marks: np.ndarray, slots: pd.DataFrame, k: int, same: bool) -> Best:
    """Best rows of the part for every slot (anchor: row of ``anchors``, low,
    high: score window, kth: score that k rows elsewhere reach at least).
    ``same``: rows of the anchor's label other than itself, else rows of other labels."""
    who = slots.anchor.to_numpy()
    low, high = slots.low.to_numpy(np.int64), slots.high.to_numpy(np.int64)
    best = Best(slots.kth.to_numpy(np.int64), k)
    least, most = part.bounds(anchors)
    least, most = least[who], np.minimum(most[who], high[:, None])
    queue = np.argsort(-most, axis=1, kind="stable")
    kind = part.number(anchors)
    typed = anchors.astype(kind)
    rows = np.arange(len(who))
    alive = rows
    for turn in range(queue.shape[1]):
        page = queue[alive, turn]
        top = most[alive, page]
        open_ = top >= np.maximum(low[alive], best.kth[alive])  # later pages of the queue are no better
        alive, page = alive[open_], page[open_]
        if not len(alive):
            break
        inside = least[alive, page] <= high[alive]
        order = np.argsort(page[inside], kind="stable")
        todo, at = alive[inside][order], page[inside][order]
        edges = np.flatnonzero(np.diff(at, prepend=-1, append=-1))
        found = []
        for a, z in zip(edges[:-1], edges[1:]):
            p, mine = int(at[a]), todo[a:z]
            owners, where = np.unique(who[mine], return_inverse=True)
            scores = (typed[owners] @ part.vectors[p].T.astype(kind)).astype(np.int64)
            fits = part.labels[p] == labels[owners][:, None]
            fits = fits & ((part.ids[p] != ids[owners][:, None]) | (part.marks[p] != marks[owners][:, None])) if same else ~fits
            scores, fits = scores[where], fits[where]
            fits &= (scores >= np.maximum(low[mine], best.kth[mine])[:, None]) & (scores <= high[mine][:, None])
            if fits.shape[1] > k:  # of a page, only its own k best and their equals
                limit = np.partition(np.where(fits, scores, np.iinfo(np.int64).min), -k, axis=1)[:, -k]
                fits &= scores >= limit[:, None]
            s, i = np.nonzero(fits)
            found.append((mine[s], scores[s, i], part.ids[p][i]))
        if found:
            best.add(*(np.concatenate(x) for x in zip(*found)))
    return best


_WIDE = np.iinfo(np.int64)


def _search_part(k: int, same: bool, dim: int):
    def run(pages: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(pages) or not len(asked):
            return pd.DataFrame({c.split()[0]: [] for c in _FOUND.split(", ")})
        part, out = Part(pages), []
        for a in range(0, len(asked), TOGETHER):
            own = asked.iloc[a:a + TOGETHER]
            flat = [(i, x["slot"], x["low"], x["high"], x["kth"]) for i, mine in enumerate(own.slots) for x in mine]
            slots = pd.DataFrame(flat, columns=["anchor", "slot", "low", "high", "kth"])
            ids, marks = own.vec_id.to_numpy(), own["mark"].to_numpy()
            best = search(part, _packed(own.vector.tolist(), dim), own.label.to_numpy(), ids, marks, slots, k, same)
            who = slots.anchor.to_numpy()[best.slot]
            out.append(pd.DataFrame({"anchor_id": ids[who], "anchor_mark": marks[who], "slot": slots.slot.to_numpy()[best.slot],
                                     "score": best.score, "vec_id": best.id}))
        return pd.concat(out)
    return run


def best_of(tree: DataFrame, anchors: DataFrame, dim: int, n_anchors: int, n_parts: int, k: int, same: bool) -> DataFrame:
    """(anchor_id, anchor_mark, slot, score, vec_id, rank): the k best rows of every slot.
    ``anchors``: vec_id, label, vector, mark, slots (array of slot, low, high, kth)."""
    blocks = max(1, math.ceil(n_anchors / BLOCK_ANCHORS))
    step = max(1, math.isqrt(n_parts))
    order = Window.partitionBy(*_ANCHOR, "slot").orderBy(F.desc("score"), "vec_id")

    def wave(asked: DataFrame, first: bool) -> DataFrame:
        def mine(part: Column) -> Column:
            return (part % step == 0) if first else (part % step != 0)

        pages = tree.filter(mine(F.col("part"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        asked = (asked.withColumn("block", F.pmod("mark", F.lit(blocks)).cast("int"))
                 .withColumn("part", F.explode(F.filter(F.sequence(F.lit(0), F.lit(n_parts - 1)), mine))))
        return pages.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInPandas(_search_part(k, same, dim), _FOUND)

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    early = save(ranked(wave(anchors, True)), "negatives-early")
    if step > 1:
        kth = early.filter(F.col("rank") == k).groupBy(*_ANCHOR).agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("at"))
        told = anchors.join(kth, (F.col("vec_id") == F.col("anchor_id")) & (F.col("mark") == F.col("anchor_mark")), "left").withColumn("slots", F.transform("slots", lambda s: s.withField(
            "kth", F.greatest(s.kth, F.coalesce(F.try_element_at("at", s.slot), s.kth))))).drop("at", *_ANCHOR)
        early = save(ranked(early.drop("rank").unionByName(wave(told, False))), "negatives-best")
    return early


def hard_negatives(vectors: DataFrame, every: int = 100, k: int = 5, least_percent: int = 80, most_percent: int = 100) -> DataFrame:
    """Per anchor (id divisible by ``every``), positive and rank: ``anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score``.

    Positives are the anchor's first ``k`` other rows of its label; negatives of
    a positive the first ``k`` rows of other labels with ``least_percent`` *
    positive_score <= 100 * negative_score <= ``most_percent`` * positive_score.
    Higher scores come first, ties by smaller id. Which rows take part: see
    :func:`scaled`; vectors of different lengths are continued with zeros, an
    empty vector scores zero. Repeated rows count once; different rows that share
    an id are rows of their own. Scores must fit 63 bits. Extra columns are
    ignored; a table without anchors or positives gives an empty result.
    """
    rows = save(vectors.select("vec_id", "label", "vector", "mark"), "negatives-rows")
    total, dim, n_anchors = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0)),
                                     F.count_if(F.col("vec_id") % every == 0)).first()
    dim = max(1, dim)
    tree = str_tree(rows, dim, total)
    n_parts = (tree.agg(F.max("part")).first()[0] or 0) + 1
    anchors = rows.filter(F.col("vec_id") % every == 0)

    def slot(low: Column, high: Column, number: Column) -> Column:
        wide = F.lit(int(_WIDE.min)).cast("bigint")
        return F.struct(number.cast("int").alias("slot"), low.cast("bigint").alias("low"), high.cast("bigint").alias("high"), wide.alias("kth"))

    all_scores = F.array(slot(F.lit(int(_WIDE.min)), F.lit(int(_WIDE.max)), F.lit(0)))
    positives = best_of(tree, anchors.withColumn("slots", all_scores), dim, n_anchors, n_parts, k, same=True)
    positives = positives.select(*_ANCHOR, F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # whole-number windows: ceil(least * p / 100) to floor(most * p / 100), exact in decimals
    p = F.col("positive_score").cast("decimal(20,0)")
    low, high = F.ceil(p * least_percent / 100), F.floor(p * most_percent / 100)
    windows = positives.filter(low <= high).groupBy(*_ANCHOR).agg(F.collect_list(slot(low, high, F.col("slot"))).alias("slots"))  # k at most
    asked = anchors.join(windows, (F.col("vec_id") == F.col("anchor_id")) & (F.col("mark") == F.col("anchor_mark"))).drop(*_ANCHOR)
    found = best_of(tree, asked, dim, n_anchors, n_parts, k, same=False)
    return found.join(positives, [*_ANCHOR, "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
