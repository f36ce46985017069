"""MinHash near-dedup with circulant signatures and exact verification.

**Signature.** Shingle hashes pass a first permutation (a 64-bit bijection,
folded to 2^20 places). A second permutation, a fixed table of the 2^20
places, gives coordinate k of a set as the smallest table value over its
shingles with the table shifted circularly by k. One table and K shifts thus
replace K permutations, and the K values of a shingle are one contiguous slice
of the table.

**Banding.** ``BANDS`` bands of ``ROWS`` coordinates; sets that agree in a
whole band share a bucket. At a similarity of 0.85 a pair has no common bucket
with a probability below 3e-8 (at 0.8: 7e-6).

**Verification.** Equal sets are one set from here on. Every set of a bucket is
compared with the bucket's smallest one by exact Jaccard on full sets (a star,
no pairs within a bucket). Where the links found leave a group of buckets in
several components, the pairs that share a bucket and are still in different
components are compared too, in blocks of ``CHUNK`` by ``CHUNK`` sets. So every
pair with a common bucket is compared or already connected, whatever the size
of its bucket. Components come from alternating large-star and small-star
rounds, written to the shared folder after each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlens.llm.tables import NO_ID, keyed, save
from tierlens.llm.words import WordTable, ascii_lower, mix, shingle_set, utf8, word_hashes

BANDS, ROWS = 30, 5
PLACES_LOG2 = 20
#: Sets on one side of a block of leftover comparisons.
CHUNK = 256


def _table() -> np.ndarray:
    """The second permutation, continued circularly so that every slice is contiguous."""
    table = np.argsort(mix(np.arange(1 << PLACES_LOG2, dtype=np.uint64) + np.uint64(977)), kind="stable").astype(np.uint32)
    return np.concatenate([table, table[:BANDS * ROWS]])


def signature(shingles: np.ndarray, slices: np.ndarray) -> np.ndarray:
    """K circulant coordinates of a non-empty set."""
    at = (mix(shingles + np.uint64(77)) >> np.uint64(64 - PLACES_LOG2)).astype(np.int64)
    least = slices[at[:2048]].min(axis=0)
    for a in range(2048, len(at), 2048):
        np.minimum(least, slices[at[a:a + 2048]].min(axis=0), out=least)
    return least


def bands(shingles: np.ndarray, slices: np.ndarray) -> np.ndarray:
    """One 64-bit bucket name per band."""
    rows = signature(shingles, slices)[:BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS)
    name = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        name = mix(name * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return name


def _shingles(text, table: WordTable, k: int) -> np.ndarray:
    return shingle_set(word_hashes(ascii_lower(utf8(text)).split(), table), k)


def _key(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _signed(k: int):
    def run(parts):
        slices = np.lib.stride_tricks.sliding_window_view(_table(), BANDS * ROWS)
        table = WordTable()
        for pdf in parts:
            sets = [_shingles(t, table, k) for t in pdf.text]
            yield pd.DataFrame({
                "doc_id": pdf.doc_id, "n_shingles": [len(s) for s in sets],
                "set_key": [_key(s.tobytes()) for s in sets],
                "bands": [bands(s, slices).tobytes() if len(s) else None for s in sets]})
    return run


def _exploded(parts):
    for pdf in parts:
        yield pd.DataFrame({"bucket": np.frombuffer(b"".join(pdf.bands), np.int64),
                            "node": np.repeat(pdf.node.to_numpy(), BANDS)})


def _sets(k: int):
    def run(parts):
        table = WordTable()
        for pdf in parts:
            out = pd.DataFrame({"node": pdf.node, "bands": pdf.bands,
                                "shingles": [_shingles(t, table, k).tobytes() for t in pdf.text]})
            yield out[[_key(s) == n for s, n in zip(out.shingles, out.node)]]
    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    both = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(percent: int):
    def run(parts):
        for pdf in parts:
            ok = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                  for x, y in zip(pdf.left_set, pdf.right_set)]
            yield pdf.loc[ok, ["u", "v"]]
    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v): the smallest node
    reachable. Alternating large-star and small-star rounds; each round's
    edges go to the shared folder."""
    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()

    edges = save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "edges")
    before = None
    while (now := tuple(mark(edges))) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
        edges = save(small.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _block_links(percent: int):
    """Links between sets of one block of a group: a spanning forest of the
    pairs that share a band and are in different components so far."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = int(rows.i.iloc[0]), int(rows.j.iloc[0])
        rows = rows.drop_duplicates("node")
        left = rows[rows.chunk == i]
        right = rows[rows.chunk == j]
        sets = {r: np.frombuffer(s, np.uint64) for r, s in zip(rows.node, rows.shingles)}
        band = np.frombuffer(b"".join(right.bands), np.int64).reshape(-1, BANDS)
        parent = {c: c for c in rows.component}

        def root(c):
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        found = []
        right_nodes, right_comps = right.node.to_numpy(), right.component.to_numpy()
        for x, comp, own in zip(left.node, left.component, left.bands):
            meet = (band == np.frombuffer(own, np.int64)).any(axis=1) & (right_comps != comp)
            for k in np.flatnonzero(meet if i != j else meet & (right_nodes > x)):
                a, b = root(comp), root(right_comps[k])
                if a != b and _linked(sets[x], sets[right_nodes[k]], percent):
                    parent[a] = b
                    found.append((x, right_nodes[k]))
        return pd.DataFrame(found, columns=["u", "v"])
    return run


def near_dedup(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Sets are the distinct ``shingle``-word shingles of the lower-cased (A-Z)
    text, the whole sequence where it has fewer words. Documents link where
    100 * intersection >= ``percent`` * union; ``component_id`` is the smallest
    id reachable over links. Null or empty texts have no shingles and are
    their own component. A null ``doc_id`` orders after all others and is shown
    as null. Equal rows are in one component. Extra columns are ignored; an
    empty table gives an empty result.
    """
    base = keyed(docs)
    signed = save(base.mapInPandas(_signed(shingle), "doc_id long, n_shingles long, set_key binary, bands binary"), "signed")
    reps = (signed.filter("n_shingles > 0").groupBy(F.col("set_key").alias("node"))
            .agg(F.min("doc_id").alias("rep"), F.min("bands").alias("bands")))
    placed = reps.mapInPandas(_exploded, "bucket long, node binary")
    shared = placed.groupBy("bucket").agg(F.min("node").alias("center"), F.max("node").alias("other")).filter("center != other")
    stars = save(placed.join(shared.select("bucket", "center"), "bucket").filter("node != center")
                 .select(F.col("node").alias("u"), F.col("center").alias("v")).distinct(), "stars")

    met = stars.select(F.col("u").alias("node")).union(stars.select("v")).distinct()
    sets = save(base.join(reps.join(met, "node"), F.col("doc_id") == F.col("rep")).select("node", "bands", "text")
                .mapInPandas(_sets(shingle), "node binary, bands binary, shingles binary"), "sets")

    def one(name: str, col: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), F.col("shingles").alias(col))

    compared = stars.join(one("u", "left_set"), "u").join(one("v", "right_set"), "v")
    links = save(compared.mapInPandas(_confirm(percent), "u binary, v binary").distinct(), "links")

    groups = components(stars)
    found = components(links)
    state = (groups.withColumnRenamed("component", "grp").join(found, "node", "left")
             .select("node", "grp", F.coalesce("component", "node").alias("component")))
    state = save(state, "state")
    split = state.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")) \
        .filter("lo != hi and n > 2").withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    rows = (state.join(split.select("grp", "chunks"), "grp")
            .withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
            .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .select("grp", "node", "component", "chunk", F.least("chunk", "with").alias("i"), F.greatest("chunk", "with").alias("j"))
            .join(sets, "node"))
    late = rows.groupBy("grp", "i", "j").applyInPandas(_block_links(percent), "u binary, v binary")
    whole = components(links.unionByName(late))

    named = reps.select("node", "rep").join(whole, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").select(F.col("node").alias("set_key"), "component_id")
    out = signed.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left").withColumn(
        "component", F.coalesce("component_id", "doc_id"))
    shown = [F.when(F.col(c) != NO_ID, F.col(c)).alias(n) for c, n in (("doc_id", "doc_id"), ("component", "component_id"))]
    return out.select(shown[0], "n_shingles", shown[1], (F.col("doc_id") == F.col("component")).alias("kept"))
