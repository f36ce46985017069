"""Pricing, ROI and cost-log operators.

All money is BIGINT nano-USD so sums are exact; ratios are rounded to 9 digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlens import dims
from tierlens.functions.lookups import cost_nano, model_tier
from tierlens.operators import ordered


def _ratio_pct(num: Column, den: Column) -> Column:
    return F.round(num.cast("double") * 100.0 / den.cast("double"), 9)


def price_calls(df: DataFrame, book: str = "roi", tier_col: str = "tier",
                in_col: str = "input_tokens", out_col: str = "output_tokens",
                out: str = "cost_nano") -> DataFrame:
    """Price each call. Book ``roi`` prices an unknown tier at 0, book
    ``router_log`` leaves it NULL (the two books of the routing system differ)."""
    c = cost_nano(book, F.col(tier_col), F.col(in_col), F.col(out_col))
    if book == "roi":
        c = F.coalesce(c, F.lit(0).cast("bigint"))
    return df.withColumn(out, c)


def model_to_tier(df: DataFrame, model_col: str = "model", out: str = "actual_tier") -> DataFrame:
    """Model id -> tier; models outside the tier map give NULL."""
    return df.withColumn(out, model_tier(F.col(model_col)))


def turn_roi(df: DataFrame, tier_col: str = "tier", in_col: str = "input_tokens",
             out_col: str = "output_tokens", baseline_override: str | None = None) -> DataFrame:
    """Actual cost at the routed tier, baseline at tier 3 (or a measured
    override when present), savings = baseline - actual."""
    df = price_calls(df, "roi", tier_col, in_col, out_col, "actual_cost_nano")
    computed = F.coalesce(cost_nano("roi", F.lit(dims.BASELINE_TIER), F.col(in_col), F.col(out_col)), F.lit(0))
    base = F.coalesce(F.col(baseline_override), computed) if baseline_override else computed
    return (df.withColumn("baseline_cost_nano", base.cast("bigint"))
              .withColumn("savings_nano", F.col("baseline_cost_nano") - F.col("actual_cost_nano")))


def session_roi(calls: DataFrame, session_col: str = "conv_id",
                summary_col: str | None = "is_summarisation") -> DataFrame:
    """Per-session ROI from priced calls (output of ``turn_roi``).

    Turns exclude summarisation calls; the baseline includes them.
    One hash aggregate with map-side partial aggregation; the session key is
    the only shuffle key.
    """
    is_sum = F.coalesce(F.col(summary_col), F.lit(False)) if summary_col and summary_col in calls.columns else F.lit(False)
    agg = calls.groupBy(session_col).agg(
        F.sum(F.when(~is_sum, 1).otherwise(0)).cast("bigint").alias("total_turns"),
        F.sum("actual_cost_nano").cast("bigint").alias("actual_total_nano"),
        F.sum("baseline_cost_nano").cast("bigint").alias("baseline_total_nano"),
        F.sum(F.when(~is_sum, F.col("actual_cost_nano")).otherwise(0)).cast("bigint").alias("model_cost_nano"),
        F.sum(F.when(is_sum, F.col("actual_cost_nano")).otherwise(0)).cast("bigint").alias("summarisation_nano"),
    )
    savings = F.col("baseline_total_nano") - F.col("actual_total_nano")
    return (agg.withColumn("savings_nano", savings)
               .withColumn("roi_pct", F.when(F.col("baseline_total_nano") > 0,
                                             _ratio_pct(savings, F.col("baseline_total_nano")))
                           .otherwise(F.lit(0.0))))


def drop_empty_usage(df: DataFrame, cols=("prompt_tokens", "completion_tokens", "total_tokens")) -> DataFrame:
    """Usage rows with all counters zero or NULL are not logged."""
    cond = F.lit(False)
    for c in cols:
        cond = cond | (F.coalesce(F.col(c), F.lit(0)) != 0)
    return df.filter(cond)


def cost_records(df: DataFrame, model_col: str = "model") -> DataFrame:
    """D3 (record part): router cost-log record with the ``router_log`` book.

    Expects prompt/completion/total token columns and ``kind``; the actual
    tier comes from the model (summariser -> NULL tier, cost and savings)."""
    df = model_to_tier(df, model_col, "actual_tier")
    df = df.withColumn("baseline_tier", F.lit(dims.BASELINE_TIER))
    df = price_calls(df, "router_log", "actual_tier", "prompt_tokens", "completion_tokens", "actual_cost_nano")
    df = price_calls(df, "router_log", "baseline_tier", "prompt_tokens", "completion_tokens", "baseline_cost_nano")
    pct = F.when((F.col("actual_cost_nano").isNotNull()) & (F.col("baseline_cost_nano") > 0),
                 _ratio_pct(F.col("baseline_cost_nano") - F.col("actual_cost_nano"), F.col("baseline_cost_nano")))
    return df.withColumn("savings_pct", pct)


def cost_rollup(records: DataFrame) -> DataFrame:
    """D3 (roll-up): totals by kind, by model, by actual tier and overall, as
    GROUPING SETS in one aggregate (one shuffle)."""
    level = (F.when(F.grouping("kind") == 0, "kind").when(F.grouping("model") == 0, "model")
              .when(F.grouping("actual_tier") == 0, "tier").otherwise("all"))
    return (records.groupingSets([["kind"], ["model"], ["actual_tier"], []], "kind", "model", "actual_tier")
                   .agg(level.alias("grouping_level"),
                        F.count(F.lit(1)).alias("n_records"),
                        F.sum("prompt_tokens").cast("bigint").alias("prompt_tokens"),
                        F.sum("completion_tokens").cast("bigint").alias("completion_tokens"),
                        F.sum("actual_cost_nano").cast("bigint").alias("actual_cost_nano"),
                        F.sum("baseline_cost_nano").cast("bigint").alias("baseline_cost_nano")))


def measured_baseline(turns: DataFrame, measured: DataFrame, key=("conv_id", "turn")) -> DataFrame:
    """Baseline from a real tier-3 call for the same turn when there is
    one (``measured`` carries the baseline call's tokens), else computed."""
    m = (measured.withColumn("measured_baseline_nano",
                             cost_nano("roi", F.lit(dims.BASELINE_TIER), F.col("baseline_input_tokens"),
                                       F.col("baseline_output_tokens")))
                 .select(*key, "measured_baseline_nano"))
    joined = turns.join(m, list(key), "left")
    return turn_roi(joined, baseline_override="measured_baseline_nano").drop("measured_baseline_nano")


def running_cost(df: DataFrame, run_col: str = "conv_id", order_col: str = "turn",
                 cost_col: str = "actual_cost_nano") -> DataFrame:
    """Turn number and cumulative cost per run, as chunked ordered sums."""
    d = ordered.scan(df, run_col, order_col, [("sum", F.lit(1), "turn_no", True), ("sum", F.col(cost_col), "cumulative_cost_nano", True)])
    return d.withColumn("turn_no", F.col("turn_no").cast("bigint")) \
            .withColumn("cumulative_cost_nano", F.col("cumulative_cost_nano").cast("bigint"))
