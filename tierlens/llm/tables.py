"""Input frames and shared-folder tables of the training-data operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlens.runtime import scratch_dir

#: Stands for a missing doc_id while documents are ordered: after every real id.
NO_ID = 2**63 - 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) only: a missing id becomes :data:`NO_ID`, a missing text
    stays null; every other column is left behind, so names cannot clash."""
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.col("text"))


def shown(col: str = "doc_id"):
    """The id as given: :data:`NO_ID` turns back into null."""
    c = F.col(col)
    return F.when(c != NO_ID, c).alias(col)


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to a fresh folder in the shared checkpoint folder and read again."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame) -> int:
    """Bytes of text in all rows."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def pieces(total: int, each: int) -> int:
    """How many blocks of about ``each`` hold ``total``."""
    return max(1, math.ceil(total / each))


def rows_with(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` (null included) is among ``ids``, all columns unchanged."""
    ids = ids.select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["__id"]), "left_semi")


#: Ranges of ids at most: their bounds travel inside an expression.
MOST_RANGES = 10_000


def id_bounds(docs: DataFrame, ranges: int) -> list[int]:
    """Bounds of about equally full ranges of ``doc_id`` (approximate quantiles), at most ``ranges`` - 1."""
    at = [i / ranges for i in range(1, ranges)]
    found = docs.agg(F.percentile_approx("doc_id", at, 100 * ranges)).first()[0] if at else []
    return sorted(set(found or []))


def range_of(value: Column, bounds: list[int]) -> Column:
    """How many bounds are at most ``value``, found in two steps of about sqrt(n) comparisons."""
    def at_most(array: Column) -> Column:
        return F.size(F.filter(array, lambda b: b <= value))

    def numbers(xs: list[int]) -> Column:
        return F.array(*[F.lit(x).cast("bigint") for x in xs])

    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) or 1
    groups = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    high = at_most(numbers([g[0] for g in groups]))
    low = at_most(F.element_at(F.array(*[numbers(g) for g in groups]), F.greatest(high, F.lit(1))))
    return F.when(high == 0, 0).otherwise((high - 1) * step + low)
