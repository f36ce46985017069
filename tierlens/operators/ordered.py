"""Skew-safe ordered scans per key (running sum, running last value, previous row).

A plain ``Window.partitionBy(key).orderBy(seq)`` puts every row of a key in
one task, so one huge session or document would serialise the job. These
helpers cut each key into chunks of at most ``chunk`` consecutive ``seq``
values, scan inside ``(key, chunk)`` groups in parallel, and fix the chunk
boundaries with a carry-in computed from one small aggregate row per chunk:

1. ``(key, chunk)`` aggregate of the key, order and value columns alone (partial
   aggregation, no skew),
2. a window over that chunk table per key (``rows / chunk`` rows per key),
3. an equi-join of the carry back on ``(key, chunk)`` -- a join key that can
   hold at most ``chunk`` seq values, so AQE sees no hot key.

Nothing is written and nothing runs while a query is built: the input is read
once for its values and once for its rows. Scans that would feed each other
(a running count of changes to the previous row) have one function, so no plan
chains scans and reads its input 2^k times.

With the default chunk every realistic key is one chunk and the result equals
the plain window; tests use tiny chunks to exercise the carry path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_CHUNK = 1 << 20


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _chunk_col(order: str, chunk: int) -> Column:
    return F.floor(F.col(order) / F.lit(chunk)).cast("bigint")


def scan(df: DataFrame, key, order: str, specs: list[tuple], chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Several ordered scans over the same (key, order) in one pass.

    ``specs`` items: ``("sum", value, out, include_current)``,
    ``("last", value, out, include_current)`` (latest non-null) or
    ``("prev", value, out)`` (previous row). One local window over
    ``(key, chunk)``, one aggregate row per chunk, one carry window over the
    chunk table and one join back -- whatever the number of scans.
    """
    ks = _keys(key)
    d = df.withColumn("__chunk", _chunk_col(order, chunk))
    for i, sp in enumerate(specs):
        d = d.withColumn(f"__v{i}", sp[1])
    w = Window.partitionBy(*ks, "__chunk").orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    aggs, carry_cols = [], []
    wc_before = Window.partitionBy(*ks).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    wc = Window.partitionBy(*ks).orderBy("__chunk")
    for i, sp in enumerate(specs):
        kind, v = sp[0], F.col(f"__v{i}")
        if kind == "sum":
            d = d.withColumn(f"__l{i}", F.coalesce(F.sum(v).over(upto if sp[3] else before), F.lit(0)))
            aggs.append(F.sum(v).alias(f"__a{i}"))
            carry_cols.append(F.coalesce(F.sum(f"__a{i}").over(wc_before), F.lit(0)).alias(f"__c{i}"))
        elif kind == "last":
            d = d.withColumn(f"__l{i}", F.last(v, ignorenulls=True).over(upto if sp[3] else before))
            aggs.append(F.max_by(v, F.when(v.isNotNull(), F.col(order))).alias(f"__a{i}"))
            carry_cols.append(F.last(f"__a{i}", ignorenulls=True).over(wc_before).alias(f"__c{i}"))
        elif kind == "prev":
            d = d.withColumn(f"__l{i}", F.lag(v).over(w))
            aggs.append(F.max_by(v, F.col(order)).alias(f"__a{i}"))
            carry_cols.append(F.lag(f"__a{i}").over(wc).alias(f"__c{i}"))
        else:
            raise ValueError(f"unknown scan kind {kind}")
    rows = d.select(*ks, "__chunk", order, *[f"__v{i}" for i in range(len(specs))])
    d = d.withColumn("__first", F.row_number().over(w) == 1)
    carry = rows.groupBy(*ks, "__chunk").agg(*aggs).select(*ks, "__chunk", *carry_cols)
    j = d.join(carry, [*ks, "__chunk"], "left")
    drop = ["__chunk", "__first"]
    for i, sp in enumerate(specs):
        kind, out = sp[0], sp[2]
        loc, car = F.col(f"__l{i}"), F.col(f"__c{i}")
        if kind == "sum":
            val = F.coalesce(car, F.lit(0)) + loc
        elif kind == "last":
            val = F.coalesce(loc, car)
        else:
            val = F.when(F.col("__first"), car).otherwise(loc)
        j = j.withColumn(out, val)
        drop += [f"__v{i}", f"__l{i}", f"__c{i}"]
    return j.drop(*drop)


def changes(df: DataFrame, key, order: str, value: Column, opens, prev_out: str, count_out: str,
            sums: tuple = (), chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """``prev_out``: the latest non-null ``value`` before each row; ``count_out``:
    how many rows up to each one open a run, that is have a value and
    ``opens(previous, value)``, previous being null for the first. ``sums``: further
    running sums (value, out), the current row included.

    One pass: inside a chunk only the first value's verdict depends on what came
    before, so a chunk is summed up by its first and last value and the runs it
    opens otherwise; the carry settles the first value and adds up the counts."""
    ks = _keys(key)
    names = [f"__s{i}" for i in range(len(sums))]
    d = df.withColumn("__chunk", _chunk_col(order, chunk)).withColumn("__v", value)
    d = d.withColumns({n: sp[0] for n, sp in zip(names, sums)})
    w = Window.partitionBy(*ks, "__chunk").orderBy(order)
    upto, v = w.rowsBetween(Window.unboundedPreceding, 0), F.col("__v")
    d = d.withColumn("__l", F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    known = v.isNotNull() & F.col("__l").isNotNull()
    d = d.withColumn("__k", F.when(known & opens(F.col("__l"), v), 1).otherwise(0))
    d = d.withColumn("__f", F.when(v.isNotNull() & F.col("__l").isNull(), 1).otherwise(0))
    where = F.when(v.isNotNull(), F.col(order))
    chunks = d.groupBy(*ks, "__chunk").agg(F.min_by("__v", where).alias("__a"), F.max_by("__v", where).alias("__z"), F.sum("__k").alias("__n"),
                                           *[F.sum(n).alias(n) for n in names])
    before = Window.partitionBy(*ks).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("__cl", F.last("__z", ignorenulls=True).over(before))
    chunks = chunks.withColumn("__cf", F.when(F.col("__a").isNotNull() & F.coalesce(opens(F.col("__cl"), F.col("__a")), F.lit(False)), 1).otherwise(0))
    carry = chunks.select(*ks, "__chunk", "__cl", "__cf", F.coalesce(F.sum(F.col("__n") + F.col("__cf")).over(before), F.lit(0)).alias("__cn"),
                          *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__c{n}") for n in names])
    d = d.withColumns({"__ku": F.sum("__k").over(upto), "__fu": F.sum("__f").over(upto)} | {n: F.sum(n).over(upto) for n in names})
    j = d.join(carry, [*ks, "__chunk"], "left")
    j = j.withColumn(prev_out, F.coalesce("__l", "__cl"))
    j = j.withColumn(count_out, F.col("__cn") + F.col("__ku") + F.col("__fu") * F.col("__cf"))
    for n, sp in zip(names, sums):
        j = j.withColumn(sp[1], F.col(f"__c{n}") + F.coalesce(F.col(n), F.lit(0)))
    return j.drop("__chunk", "__v", "__l", "__k", "__f", "__ku", "__fu", "__cl", "__cf", "__cn", *names, *[f"__c{n}" for n in names])


def running_sum(df: DataFrame, key, order: str, value: Column, out: str,
                chunk: int = DEFAULT_CHUNK, include_current: bool = True) -> DataFrame:
    """``out`` = sum of ``value`` over rows of the same key with smaller
    ``order`` (and the current row when ``include_current``)."""
    return scan(df, key, order, [("sum", value, out, include_current)], chunk)


def running_last(df: DataFrame, key, order: str, value: Column, out: str,
                 chunk: int = DEFAULT_CHUNK, include_current: bool = True) -> DataFrame:
    """``out`` = the latest non-null ``value`` at or before each row."""
    return scan(df, key, order, [("last", value, out, include_current)], chunk)


def previous(df: DataFrame, key, order: str, value: Column, out: str,
             chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """``out`` = ``value`` of the previous row of the same key (NULL for the first)."""
    return scan(df, key, order, [("prev", value, out)], chunk)


def top_k(df: DataFrame, group, order: list[Column], k: int | Column, tiebreak: Column, out: str = "rank",
          buckets: int = 256) -> DataFrame:
    """First ``k`` rows per group by ``order`` (ties by ``tiebreak``), numbered 1..k;
    ``k`` is a number or a column that is constant in a group.

    Two stages so a hot group is never sorted in one task: stage 1 keeps the
    top ``k`` of each (group, hash-bucket) split, stage 2 ranks the at most
    ``buckets * k`` survivors per group.
    """
    gs = _keys(group)
    salt = F.pmod(F.xxhash64(tiebreak), F.lit(buckets))
    w1 = Window.partitionBy(*gs, "__salt").orderBy(*order, tiebreak)
    s1 = (df.withColumn("__salt", salt).withColumn("__r1", F.row_number().over(w1))
            .filter(F.col("__r1") <= k).drop("__r1", "__salt"))
    w2 = Window.partitionBy(*gs).orderBy(*order, tiebreak)
    return s1.withColumn(out, F.row_number().over(w2)).filter(F.col(out) <= k)
