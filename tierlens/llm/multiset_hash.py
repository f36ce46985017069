"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraph pieces (lines, cut further after
sentence ends). Each piece is hashed to a wide vector, and the fingerprint is
the sum of the vectors, each lane modulo 2^62, after the number of pieces. Sums
do not depend on the order of the pieces, and pieces can be inserted or deleted
by adding or subtracting their vectors (:func:`insert`, :func:`delete`).

``EQUAL_LANES`` lanes of 62 random bits tell different multisets apart. Each of
the other ``COUNT_LANES`` lanes holds ``FIELDS`` random bits, each the lowest of
a field of ``FIELD_BITS`` bits. The fields count, per bit, the pieces that have
it set; twice the count less the number of pieces is a random projection of the
multiset, and the cosine of two such projections estimates how alike the
multisets are. A field holds 2^31 - 1 pieces and a text, at most 2^31 bytes, has
at most 2^30 (every cut takes a character), so no field ever carries into the next.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierlens.llm.tables import MOST_RANGES, id_bounds, keyed, pieces, range_of, shown, text_bytes

EQUAL_LANES, COUNT_LANES = 8, 48
FIELDS, FIELD_BITS = 2, 31
#: Sums stay below this power of two, so two of them add without overflow.
_MODULUS = 1 << 62
_ONES = sum(1 << (FIELD_BITS * i) for i in range(FIELDS))

#: Text of one range of ids, about.
RANGE_BYTES = 8_000_000

PIECE_END = r"\n|(?<=[.!?])[ \t]+"


def vector(text: Column) -> Column:
    """[number of pieces, lane sums ...] of a text without null."""
    hashed = F.transform(F.filter(F.split(text, PIECE_END, -1), lambda p: p != ""), lambda p: F.xxhash64(p))

    def sums(hs: Column) -> Column:
        def lanes(first: int, last: int, mask: int) -> Column:
            return F.transform(F.sequence(F.lit(first), F.lit(last)), lambda j: F.aggregate(
                hs, F.lit(0).cast("bigint"),
                lambda acc, h: (acc + F.xxhash64(h, j).bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(_MODULUS - 1))))

        return F.concat(F.array(F.size(hs).cast("bigint")), lanes(1, EQUAL_LANES, _MODULUS - 1),
                        lanes(EQUAL_LANES + 1, EQUAL_LANES + COUNT_LANES, _ONES))

    return F.element_at(F.transform(F.array(hashed), sums), 1)  # a lambda variable, so the pieces are hashed once for all lanes


def insert(fingerprint: Column, more: Column) -> Column:
    """Vector of the two multisets together."""
    return F.zip_with(fingerprint, more, lambda a, b: (a + b).bitwiseAND(F.lit(_MODULUS - 1)))


def delete(fingerprint: Column, less: Column) -> Column:
    """Vector after the pieces of ``less`` are taken out."""
    return F.zip_with(fingerprint, less, lambda a, b: (a - b).bitwiseAND(F.lit(_MODULUS - 1)))


def shown_as_text(fingerprint: Column) -> Column:
    return F.concat_ws("", F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")))


def projection(fingerprint: Column) -> Column:
    n = F.element_at(fingerprint, 1)
    counts = F.flatten(F.transform(F.slice(fingerprint, 2 + EQUAL_LANES, COUNT_LANES), lambda x: F.array(
        *[F.shiftrightunsigned(x, FIELD_BITS * i).bitwiseAND(F.lit((1 << FIELD_BITS) - 1)) for i in range(FIELDS)])))
    return F.transform(counts, lambda c: (2 * c - n).cast("double"))


def likeness(a: Column, b: Column, proj_a: Column, proj_b: Column) -> Column:
    """1 for equal fingerprints, else the cosine of the projections, 0 at least."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    size = F.sqrt(dot(proj_a, proj_a) * dot(proj_b, proj_b))
    return F.when(a == b, 1.0).when(size > 0, F.least(F.greatest(dot(proj_a, proj_b) / size, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def with_next(docs: DataFrame, cols: list[str]) -> DataFrame:
    """``docs`` (doc_id, text without null, ...) with ``next_<col>`` of the next
    row by descending doc_id, cyclically; equal ids by a hash of the text.

    Rows are dealt to ranges of ids (bounds: approximate quantiles, a few
    thousand numbers); within a range a window looks one row ahead, and the
    first row of every range is also dealt to the range before it, as its
    last. No global window, and texts are shuffled once.
    """
    ranges = min(MOST_RANGES, pieces(text_bytes(docs), RANGE_BYTES))
    docs = docs.withColumn("__range", range_of(F.col("doc_id"), id_bounds(docs, ranges))).withColumn("__tie", F.xxhash64("text"))
    every = Window.partitionBy(F.lit(0))  # over one row per range: at most MOST_RANGES
    heads = docs.groupBy("__range").agg(F.max("doc_id").alias("doc_id")).withColumn(
        "__to", F.coalesce(F.lead("__range").over(every.orderBy("__range")), F.min("__range").over(every)))
    docs = docs.join(F.broadcast(heads), ["__range", "doc_id"], "left")
    head = F.col("__to")
    own = F.struct(F.col("__range").alias("r"), F.lit(False).alias("guest"))
    guest = F.struct(head.alias("r"), F.lit(True).alias("guest"))
    dealt = docs.withColumn("__place", F.explode(F.when(head.isNotNull(), F.array(own, guest)).otherwise(F.array(own))))
    order = Window.partitionBy("__place.r").orderBy("__place.guest", F.desc("doc_id"), F.desc("__tie"))
    ahead = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in cols}).filter("not __place.guest")
    return ahead.select("doc_id", *cols, *[f"next_{c}" for c in cols])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text, vector, n_chars``: the fingerprint of every whole text.
    A null text counts as empty (no pieces, all lanes 0)."""
    base = keyed(docs).withColumn("text", F.coalesce("text", F.lit("")))
    return base.withColumn("vector", vector(F.col("text"))).withColumn("n_chars", F.char_length("text").cast("bigint"))


def compare_with_edit(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts and of edited texts, whose last third is replaced
    by the start of the next document (descending id, cyclic): ``doc_id,
    n_chars, edited, vector, edited_vector, near_edited, near_next``.

    Nulls count as empty texts, a null id orders before all others; of repeated
    ids the text with the larger hash comes first; a single document is its own
    next. Extra columns are ignored; an empty table gives an empty result.
    """
    d = with_next(fingerprints(docs).select("doc_id", "text", "vector"), ["text", "vector"])
    d = d.withColumn("n_chars", F.char_length("text").cast("bigint")).withColumn("cut", F.floor(F.col("n_chars") / 3).cast("int"))
    d = d.withColumn("edited", F.concat(F.expr("left(text, int(n_chars) - cut)"), F.expr("left(next_text, cut)")))
    d = d.withColumn("edited_vector", vector(F.col("edited")))
    d = d.withColumns({f"p_{c}": projection(F.col(c)) for c in ("vector", "edited_vector", "next_vector")})
    near = {n: likeness(F.col("vector"), F.col(o), F.col("p_vector"), F.col(f"p_{o}"))
            for n, o in (("near_edited", "edited_vector"), ("near_next", "next_vector"))}
    return d.withColumns(near).select(shown(), "n_chars", "edited", "vector", "edited_vector", *near)
