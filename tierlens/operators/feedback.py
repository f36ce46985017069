"""Feedback operators: B7 acceptance, B8 status, C6 recovery, D4 stats, D5 readiness,
H14 SFT examples, H15 preference triples, G1 merge, A11 batch close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlens import dims

def _tiers() -> Column:
    return F.array(*[F.lit(t) for t in dims.TIER_NUMBERS])


def accept(df: DataFrame, pred_col: str = "predicted_tier", corr_col: str = "corrected_tier") -> tuple[DataFrame, DataFrame]:
    """Accept rows whose two tiers are both in 1..4 (derive ``is_correct``);
    the rest go to a quarantine frame with the reason instead of raising."""
    p, c = F.col(pred_col), F.col(corr_col)
    reason = (F.when(~F.coalesce(F.array_contains(_tiers(), p), F.lit(False)), "predicted_tier must be 1-4")
               .when(~F.coalesce(F.array_contains(_tiers(), c), F.lit(False)), "corrected_tier must be 1-4"))
    tagged = df.withColumn("_reject", reason)
    ok = tagged.filter(F.col("_reject").isNull()).drop("_reject").withColumn("is_correct", p == c)
    bad = tagged.filter(F.col("_reject").isNotNull()).withColumnRenamed("_reject", "reject_reason")
    return ok, bad


def interactive_status(response: Column, tier: Column, followup_tier: Column) -> Column:
    """B8 (interactive): 'n' or a tier digit records a correction (corrected if
    it differs, else confirmed); 'y' confirms; anything else is skipped.
    A digit answer is itself the corrected tier; 'n' uses the follow-up answer."""
    r = F.lower(F.trim(response))
    is_digit = r.isin("1", "2", "3", "4")
    corrected = F.when(is_digit, r.cast("int")).otherwise(F.coalesce(followup_tier, tier))
    return (F.when(is_digit | (r == "n"), F.when(corrected != tier, "corrected").otherwise("confirmed"))
             .when(r == "y", "confirmed").otherwise("skipped"))


def stored_status(is_correct: Column) -> Column:
    """B8 (from a stored entry): a missing ``is_correct`` counts as confirmed."""
    return F.when(F.coalesce(is_correct, F.lit(True)), "confirmed").otherwise("corrected")


def recover_turns(scratch: DataFrame, feedback: DataFrame, query_col: str = "query",
                  order_cols=("conv_id", "turn"), tier_col: str = "last_tier") -> DataFrame:
    """Scratch user turns whose text is in no feedback row are recovered
    once each (the first occurrence by ``order_cols``), with the scratch's last
    tier, confidence 1.0 and status ``recovered_from_scratchpad``.

    Deduplication is a grouped min over a struct (partial aggregation), then a
    left-anti hash join against the feedback texts."""
    first = (scratch.groupBy(query_col)
                    .agg(F.min(F.struct(*order_cols, tier_col)).alias("_f"))
                    .select(query_col, "_f.*"))
    fb = feedback.select(query_col).filter(F.col(query_col).isNotNull()).distinct()
    return (first.join(fb, query_col, "left_anti")
                 .withColumn("predicted_tier", F.col(tier_col))
                 .withColumn("corrected_tier", F.col(tier_col))
                 .withColumn("confidence", F.lit(1.0))
                 .withColumn("status", F.lit("recovered_from_scratchpad")))


def stats(df: DataFrame) -> DataFrame:
    """D4 totals: one row, full schema even when empty."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum(F.col("is_correct").cast("int")), F.lit(0)).cast("bigint").alias("correct"),
    ).select(
        "total", "correct", (F.col("total") - F.col("correct")).alias("incorrect"),
        F.when(F.col("total") > 0, F.round(F.col("correct") / F.col("total"), 9)).otherwise(0.0).alias("accuracy"),
        F.lit(dims.FEEDBACK_THRESHOLD).alias("threshold"),
        (F.col("total") >= dims.FEEDBACK_THRESHOLD).alias("ready_for_retrain"))


def stats_by_tier(df: DataFrame) -> DataFrame:
    """D4 per tier: for each corrected tier 1..4, the count of each predicted
    tier 1..4 -- all 16 cells, zero-filled via the tier x tier frame."""
    from tierlens.runtime import literal_dim

    cells = literal_dim(df.sparkSession, [(c, p) for c in range(1, 5) for p in range(1, 5)],
                        "corrected_tier int, predicted_tier int")
    counts = df.groupBy("corrected_tier", "predicted_tier").agg(F.count(F.lit(1)).alias("n"))
    return (cells.join(counts, ["corrected_tier", "predicted_tier"], "left")
            .select("corrected_tier", "predicted_tier", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def readiness(df: DataFrame, batch_cols, threshold: int = dims.FEEDBACK_THRESHOLD,
              force: Column | None = None) -> DataFrame:
    """Per batch, count, ready (count >= threshold or forced), shortfall."""
    out = df.groupBy(*batch_cols).agg(F.count(F.lit(1)).alias("n_feedback"))
    ready = F.col("n_feedback") >= threshold
    if force is not None:
        ready = ready | force
    return (out.withColumn("ready", ready)
               .withColumn("shortfall", F.greatest(F.lit(0), F.lit(threshold) - F.col("n_feedback")).cast("bigint")))


def _tier_json(tier: Column, conf: Column) -> Column:
    """``{"model_tier": t, "confidence": c}`` exactly as the training files
    write it (spaces after separators); a NULL confidence is written as null."""
    return F.concat(F.lit('{"model_tier": '), tier.cast("string"), F.lit(', "confidence": '),
                    F.coalesce(conf.cast("double").cast("string"), F.lit("null")), F.lit("}"))


def sft_examples(df: DataFrame, query_col: str = "query", tier_col: str = "corrected_tier",
                 confidence: Column | None = None) -> DataFrame:
    """Chat example ``messages`` = system prompt, user query, assistant JSON.
    Feedback examples use confidence 0.95 unless a confidence column is given."""
    conf = confidence if confidence is not None else F.lit(dims.SFT_FEEDBACK_CONFIDENCE)
    msg = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(dims.SYSTEM_PROMPT).alias("content")),
        F.struct(F.lit("user").alias("role"), F.col(query_col).alias("content")),
        F.struct(F.lit("assistant").alias("role"), _tier_json(F.col(tier_col), conf).alias("content")))
    return df.withColumn("messages", msg)


def hashed_confidence(seed: int, key: Column, lo: float, hi: float) -> Column:
    """Reproducible stand-in for a uniform draw rounded to 2 digits: a hash of
    (seed, key) mapped onto the 0.01 grid between lo and hi."""
    steps = int(round((hi - lo) * 100)) + 1
    h = F.conv(F.substring(F.md5(F.concat(F.lit(str(seed)), F.lit("|"), key.cast("string"))), 1, 8), 16, 10).cast("bigint")
    return (F.lit(int(round(lo * 100))) + h % steps).cast("double") / F.lit(100.0)


def dpo_triples(df: DataFrame, query_col: str = "query") -> DataFrame:
    """Preference triples from wrong predictions only; chosen = corrected
    tier at confidence 1.0, rejected = predicted tier at the stored confidence
    (a stored NULL stays null)."""
    wrong = df.filter(~F.col("is_correct"))
    return wrong.select(
        *[c for c in df.columns if c in ("conv_id", "turn")],
        F.concat(F.lit(dims.SYSTEM_PROMPT), F.lit("\n\nUser Query: "), F.col(query_col)).alias("prompt"),
        _tier_json(F.col("corrected_tier"), F.lit(dims.DPO_CHOSEN_CONFIDENCE)).alias("chosen"),
        _tier_json(F.col("predicted_tier"), F.col("confidence")).alias("rejected"))


def merge_into_training(existing: DataFrame, feedback_examples: DataFrame) -> DataFrame:
    """G1: UNION ALL of the training set and the feedback examples (duplicates
    kept); with no feedback the set is unchanged. ``source`` tells them apart."""
    cols = ["messages"]
    return (existing.select(*cols).withColumn("source", F.lit("existing"))
            .unionByName(feedback_examples.select(*cols).withColumn("source", F.lit("feedback"))))


def open_rows(entries: DataFrame, archived: DataFrame, key_cols) -> DataFrame:
    """Rows still open = entries not yet archived (left-anti on the entry key)."""
    return entries.join(archived.select(*key_cols).distinct(), list(key_cols), "left_anti")


def empty_feedback(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "query string, predicted_tier int, corrected_tier int, "
                                     "confidence double, notes string, timestamp string, is_correct boolean")

