"""Training-set export: E11 seeded split, H16 chat rendering, A9/A10 writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlens import dims


def shuffle_key(seed: int, key_cols) -> Column:
    """Deterministic shuffle order: md5 of the seed and the row key (DuckDB's
    md5 gives the same order, so the split is reproducible across engines)."""
    parts = [F.lit(str(seed))] + [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols]
    return F.md5(F.concat_ws("|", *parts))


def global_rank(df: DataFrame, order: Column, tiebreak) -> DataFrame:
    """0-based global rank of every row by ``order`` without a single-partition window.

    Pass 1 range-partitions and sorts (one shuffle) and numbers rows inside
    each partition from ``monotonically_increasing_id`` (partition index in the
    upper bits, position in the lower bits); the result is checkpointed into
    the cluster's checkpoint folder so both passes see the same partitions.
    Pass 2 adds each partition's offset: the per-partition counts are one row
    per partition, so that side is bounded by the partition count and broadcast.
    """
    from tierlens.runtime import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    sorted_df = (df.withColumn("_k", order)
                   .repartitionByRange("_k", *tiebreak)
                   .sortWithinPartitions("_k", *tiebreak)
                   .withColumn("_pid", F.spark_partition_id())
                   .withColumn("_local", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("bigint"), 33)))
    staged = sorted_df.checkpoint(eager=True)
    counts = staged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.selectExpr(
        "_pid", "CAST(coalesce(sum(_n) OVER (ORDER BY _pid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS _off")
    return (staged.join(F.broadcast(offsets), "_pid")
                  .withColumn("rank", F.col("_off") + F.col("_local"))
                  .drop("_k", "_pid", "_local", "_off"))


def split_assign(df: DataFrame, key_cols, seed: int = 42, fractions=dims.SPLIT_FRACTIONS) -> DataFrame:
    """Seeded shuffle and exact cut: ``int(n*0.8)`` train, ``int(n*0.1)``
    val, the remainder test. Adds ``split`` and ``rank``."""
    n = df.count()
    train_end = int(n * fractions[0])
    val_end = train_end + int(n * fractions[1])
    ranked = global_rank(df, shuffle_key(seed, key_cols), [F.col(c) for c in key_cols])
    return ranked.withColumn(
        "split", F.when(F.col("rank") < train_end, "train").when(F.col("rank") < val_end, "val").otherwise("test"))


def render_chat(messages: Column, template: str = "[{role}]: {content}", sep: str = "\n") -> Column:
    """Render chat messages into one training/inference string; the
    per-message template is a parameter ({role} and {content} placeholders)."""
    pre, rest = template.split("{role}", 1)
    mid, post = rest.split("{content}", 1)
    return F.array_join(F.transform(messages, lambda m: F.concat(
        F.lit(pre), m["role"], F.lit(mid), F.coalesce(m["content"], F.lit("")), F.lit(post))), sep)


def instruct_prompt(query: Column) -> Column:
    """The classifier's instruction template around one query."""
    return F.concat(F.lit("<s>[INST] "), F.lit(dims.SYSTEM_PROMPT), F.lit("\n\nUser Query: "), query,
                    F.lit('\n\nRemember: Output ONLY the JSON object. Example: {"model_tier": 2, "confidence": 0.8} [/INST]'))


def write_splits(df: DataFrame, out_dir: str, fmt: str = "json") -> None:
    """One folder per split (``split=train`` ...) plus a combined copy."""
    df.write.mode("overwrite").partitionBy("split").format(fmt).save(f"{out_dir}/by_split")
    df.drop("split").write.mode("overwrite").format(fmt).save(f"{out_dir}/all")


def write_triples(df: DataFrame, out_dir: str) -> None:
    """A10: preference triples as JSON lines."""
    df.select("prompt", "chosen", "rejected").write.mode("overwrite").json(out_dir)
