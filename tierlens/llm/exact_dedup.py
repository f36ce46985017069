"""Exact dedup: a tree merge of sorted digest runs.

Every input partition sorts its normalised texts' digests into one run, equal
digests already merged. Partitions then exchange parts of their runs in
binomial rounds: in round r the runs whose numbers agree but for digit r (base
``FAN``) meet, and each of the ``FAN`` meeting places takes the part of the
runs whose next digest bits name it. A round thus multiplies the partitions
behind a run by ``FAN`` and divides the digest range of a run by as much, so a
merging task holds one partition's share in every round, and after the last
round each run is complete for its range. Every merge keeps, per digest, the
row that stays (most code points, then smallest id) and the group's size, so a
text with millions of copies is one row per run from the first level on.

Equality is verified at every level: rows merge only if the SHA-256 digest,
the length of the normalised text and a second, independent 64-bit hash agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlens.llm.tables import NO_ID, keyed, save
from tierlens.llm.words import utf8

#: Runs that meet in one merge; a power of two.
FAN_BITS = 3
FAN = 1 << FAN_BITS

_SPACES = b" \t\n\x0b\x0c\r"
_RUN = "run int, digest binary, n_norm long, verify long, n_chars long, keep_id long, members long"
_FACTS = ["digest", "n_norm", "verify"]


def _facts(parts):
    """One row per document: what identifies its normalised text."""
    for pdf in parts:
        norm = [utf8(t).translate(None, _SPACES) for t in pdf.text]
        yield pd.DataFrame({
            "doc_id": pdf.doc_id, "digest": [hashlib.sha256(n).digest() for n in norm],
            "n_norm": [len(n) for n in norm],
            "verify": np.array([xxhash.xxh3_64_intdigest(n) for n in norm], np.uint64).view(np.int64),
            "n_chars": [len(t) if t else 0 for t in pdf.text]})


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of several runs as one sorted run: per verified digest the row that stays."""
    rows = rows.assign(least=-rows.n_chars).sort_values([*_FACTS, "least", "keep_id"], kind="stable")
    out = rows.groupby(_FACTS, sort=False, as_index=False).agg(
        run=("run", "first"), n_chars=("n_chars", "first"), keep_id=("keep_id", "first"), members=("members", "sum"))
    return out[["run", *_FACTS, "n_chars", "keep_id", "members"]]


def _first_run(parts):
    """A partition's sorted run, batch by batch merged into what it has so far."""
    have = None
    for pdf in parts:
        rows = pdf.rename(columns={"doc_id": "keep_id"}).assign(members=1)
        have = _merge(rows if have is None else pd.concat([have, rows]))
    if have is not None and len(have):
        yield have


def merged_runs(facts: DataFrame) -> DataFrame:
    """One row per verified digest, merged through all levels of the tree."""
    facts = facts.withColumn("run", F.spark_partition_id())
    runs = facts.mapInPandas(_first_run, _RUN)
    last = facts.agg(F.max("run")).first()[0] or 0
    bits = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("bigint")
    level, behind = 0, 1
    while behind <= last and level * FAN_BITS < 30:
        level, behind = level + 1, behind * FAN
        place = F.shiftright(bits, 32 - level * FAN_BITS)
        runs = (runs.withColumn("run", F.shiftright("run", FAN_BITS)).withColumn("place", place)
                .groupBy("run", "place").applyInPandas(lambda rows: _merge(rows.drop(columns="place")), _RUN))
    return runs.drop("run")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, keep_id, group_size, kept, digest``
    (SHA-256 of the text without ASCII white space).

    Of equal normalised texts the row with the most code points stays, then
    the smallest ``doc_id``. A null text counts as empty; all empty texts are
    one group. A null ``doc_id`` orders after all others and is shown as null;
    of rows that tie in everything, id included, all are shown as kept. Extra
    columns are ignored; an empty table gives an empty result.
    """
    facts = save(keyed(docs).mapInPandas(_facts, "doc_id long, digest binary, n_norm long, verify long, n_chars long"),
                 "digests")
    groups = merged_runs(facts).select(*_FACTS, F.col("n_chars").alias("best"), "keep_id",
                                       F.col("members").alias("group_size"))
    joined = facts.join(groups, _FACTS)
    shown = [F.when(F.col(c) != NO_ID, F.col(c)).alias(c) for c in ("doc_id", "keep_id")]
    return joined.select(*shown, "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "digest")
