"""Cost and ROI queries over routed turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierlens.fixtures import register
from tierlens.operators import cost
from tierlens.plans import query

# Oracle price tables (DuckDB side), nano-USD per token.
_ROI_PRICES = "(VALUES (1,100,100),(2,100,300),(3,400,2000),(4,500,1500)) AS p(tier, pin, pout)"
_LOG_PRICES = "(VALUES (1,100,100),(2,50,80),(3,400,2000),(4,500,1500)) AS p(tier, pin, pout)"


def routed_calls(spark, sf_dir):
    register(spark, sf_dir)
    return spark.table("v_routed").select(
        "conv_id", "turn", F.col("predicted_tier").alias("tier"), "input_tokens", "output_tokens")


@query("d2_session_roi", """
SELECT conv_id, CAST(count(*) AS BIGINT) AS total_turns,
       CAST(sum(a) AS BIGINT) AS actual_total_nano, CAST(sum(b) AS BIGINT) AS baseline_total_nano,
       CAST(sum(a) AS BIGINT) AS model_cost_nano, CAST(0 AS BIGINT) AS summarisation_nano,
       CAST(sum(b) - sum(a) AS BIGINT) AS savings_nano,
       CASE WHEN sum(b) > 0 THEN round(CAST(sum(b) - sum(a) AS DOUBLE) * 100.0 / CAST(sum(b) AS DOUBLE), 9) ELSE 0.0 END AS roi_pct
FROM (SELECT r.conv_id, coalesce(r.input_tokens*p.pin + r.output_tokens*p.pout, 0) AS a,
             r.input_tokens*400 + r.output_tokens*2000 AS b
      FROM v_routed r LEFT JOIN """ + _ROI_PRICES + """ ON r.predicted_tier = p.tier) t
GROUP BY conv_id""")
def d2_session_roi(spark, sf_dir):
    """Session ROI by conversation: price every routed turn (C2, book roi),
    per-turn ROI (D1), then one aggregate per session (D2)."""
    return cost.session_roi(cost.turn_roi(routed_calls(spark, sf_dir)))


@query("d1_turn_roi", """
SELECT r.conv_id, r.turn, r.predicted_tier AS tier,
       CAST(coalesce(r.input_tokens*p.pin + r.output_tokens*p.pout, 0) AS BIGINT) AS actual_cost_nano,
       CAST(r.input_tokens*400 + r.output_tokens*2000 AS BIGINT) AS baseline_cost_nano,
       CAST(r.input_tokens*400 + r.output_tokens*2000 - coalesce(r.input_tokens*p.pin + r.output_tokens*p.pout, 0) AS BIGINT) AS savings_nano
FROM v_routed r LEFT JOIN """ + _ROI_PRICES + """ ON r.predicted_tier = p.tier""")
def d1_turn_roi(spark, sf_dir):
    """Per-turn actual, baseline (tier 3) and savings in nano-USD."""
    return cost.turn_roi(routed_calls(spark, sf_dir)).select(
        "conv_id", "turn", "tier", "actual_cost_nano", "baseline_cost_nano", "savings_nano")


@query("c2_price_lookup", """
SELECT r.conv_id, r.turn, r.predicted_tier AS tier, b.book AS price_book,
       CAST(CASE WHEN b.book = 'roi' THEN coalesce(r.input_tokens*p1.pin + r.output_tokens*p1.pout, 0)
                 ELSE r.input_tokens*p2.pin + r.output_tokens*p2.pout END AS BIGINT) AS cost_nano
FROM (SELECT conv_id, turn, input_tokens, output_tokens,
             CASE WHEN (conv_id + turn) % 7 = 0 THEN 5 ELSE predicted_tier END AS predicted_tier FROM v_routed) r
CROSS JOIN (VALUES ('roi'), ('router_log')) AS b(book)
LEFT JOIN """ + _ROI_PRICES.replace(" AS p(", " AS p1(") + """ ON r.predicted_tier = p1.tier
LEFT JOIN """ + _LOG_PRICES.replace(" AS p(", " AS p2(") + """ ON r.predicted_tier = p2.tier""")
def c2_price_lookup(spark, sf_dir):
    """Price each routed call in both price books; every 7th call carries an
    unknown tier 5 (roi prices it at 0, router_log leaves NULL)."""
    calls = routed_calls(spark, sf_dir).withColumn(
        "tier", F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, F.lit(5)).otherwise(F.col("tier")))
    roi = cost.price_calls(calls, "roi").withColumn("price_book", F.lit("roi"))
    log = cost.price_calls(calls, "router_log").withColumn("price_book", F.lit("router_log"))
    return roi.unionByName(log).select("conv_id", "turn", "tier", "price_book", "cost_nano")


def _usage_log(spark, sf_dir):
    """Router calls as a usage log: route calls at the routed tier's model,
    every pivot adds a summariser call; some calls report no usage."""
    register(spark, sf_dir)
    return spark.sql("""
        SELECT conv_id, turn, 'route' AS kind, false AS is_summarisation,
               element_at(map(1,'ministral-3b-latest',2,'mistral-small-latest',3,'mistral-medium-latest',4,'mistral-large-latest'), predicted_tier) AS model,
               predicted_tier AS decision_tier,
               CASE WHEN turn % 9 = 8 THEN 0 ELSE input_tokens END AS prompt_tokens,
               CASE WHEN turn % 9 = 8 THEN 0 ELSE output_tokens END AS completion_tokens,
               CASE WHEN turn % 9 = 8 THEN 0 ELSE input_tokens + output_tokens END AS total_tokens
        FROM v_routed
        UNION ALL
        SELECT conv_id, turn, 'summary', true, 'magistral-small-2509', CAST(NULL AS INT),
               input_tokens * 2, 50, input_tokens * 2 + 50
        FROM v_routed WHERE turn % 4 = 2""")


_USAGE_LOG_SQL = """
usage_log AS (
  SELECT conv_id, turn, 'route' AS kind, false AS is_summarisation,
         CASE predicted_tier WHEN 1 THEN 'ministral-3b-latest' WHEN 2 THEN 'mistral-small-latest'
              WHEN 3 THEN 'mistral-medium-latest' WHEN 4 THEN 'mistral-large-latest' END AS model,
         predicted_tier AS decision_tier,
         CASE WHEN turn % 9 = 8 THEN 0 ELSE input_tokens END AS prompt_tokens,
         CASE WHEN turn % 9 = 8 THEN 0 ELSE output_tokens END AS completion_tokens,
         CASE WHEN turn % 9 = 8 THEN 0 ELSE input_tokens + output_tokens END AS total_tokens
  FROM v_routed
  UNION ALL
  SELECT conv_id, turn, 'summary', true, 'magistral-small-2509', CAST(NULL AS INT),
         input_tokens * 2, 50, input_tokens * 2 + 50
  FROM v_routed WHERE turn % 4 = 2),
records AS (
  SELECT u.*, m.tier AS actual_tier, 3 AS baseline_tier,
         CAST(u.prompt_tokens*p.pin + u.completion_tokens*p.pout AS BIGINT) AS actual_cost_nano,
         CAST(u.prompt_tokens*400 + u.completion_tokens*2000 AS BIGINT) AS baseline_cost_nano
  FROM usage_log u
  LEFT JOIN (VALUES ('ministral-3b-latest',1),('mistral-small-latest',2),('mistral-medium-latest',3),('mistral-large-latest',4)) AS m(model, tier) ON u.model = m.model
  LEFT JOIN """ + _LOG_PRICES + """ ON m.tier = p.tier
  WHERE coalesce(u.prompt_tokens,0) <> 0 OR coalesce(u.completion_tokens,0) <> 0 OR coalesce(u.total_tokens,0) <> 0)
"""


@query("b9_drop_empty_usage", """, """ + _USAGE_LOG_SQL.strip().rstrip(",") + """
SELECT conv_id, turn, kind, prompt_tokens, completion_tokens, total_tokens FROM records""")
def b9_drop_empty_usage(spark, sf_dir):
    """Usage records with all three counters zero are dropped before logging."""
    return cost.drop_empty_usage(_usage_log(spark, sf_dir)).select(
        "conv_id", "turn", "kind", "prompt_tokens", "completion_tokens", "total_tokens")


@query("d3_cost_log_rollup", """, """ + _USAGE_LOG_SQL.strip().rstrip(",") + """
SELECT CASE WHEN grouping(kind)=0 THEN 'kind' WHEN grouping(model)=0 THEN 'model'
            WHEN grouping(actual_tier)=0 THEN 'tier' ELSE 'all' END AS grouping_level,
       kind, model, actual_tier, count(*) AS n_records,
       CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
       CAST(sum(actual_cost_nano) AS BIGINT) AS actual_cost_nano, CAST(sum(baseline_cost_nano) AS BIGINT) AS baseline_cost_nano
FROM records GROUP BY GROUPING SETS ((kind), (model), (actual_tier), ())""")
def d3_cost_log_rollup(spark, sf_dir):
    """Cost-log records (router_log book, summariser unpriced) rolled up by
    kind, model, tier and overall."""
    recs = cost.cost_records(cost.drop_empty_usage(_usage_log(spark, sf_dir)))
    return cost.cost_rollup(recs)


@query("d3_cost_log_records", """, """ + _USAGE_LOG_SQL.strip().rstrip(",") + """
SELECT conv_id, turn, kind, model, actual_tier, baseline_tier, actual_cost_nano, baseline_cost_nano,
       CASE WHEN actual_cost_nano IS NOT NULL AND baseline_cost_nano > 0
            THEN round(CAST(baseline_cost_nano - actual_cost_nano AS DOUBLE) * 100.0 / CAST(baseline_cost_nano AS DOUBLE), 9) END AS savings_pct
FROM records""")
def d3_cost_log_records(spark, sf_dir):
    """Per-record savings % vs tier 3; the summariser model has NULL tier, cost and savings."""
    recs = cost.cost_records(cost.drop_empty_usage(_usage_log(spark, sf_dir)))
    return recs.select("conv_id", "turn", "kind", "model", "actual_tier", "baseline_tier",
                       "actual_cost_nano", "baseline_cost_nano", "savings_pct")


@query("c3_model_tier", """
SELECT r.conv_id, r.turn, r.model, m.tier AS actual_tier
FROM (SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN 'ministral-3b-latest' WHEN 1 THEN 'mistral-small-latest'
        WHEN 2 THEN 'mistral-medium-latest' WHEN 3 THEN 'mistral-large-latest' WHEN 4 THEN 'magistral-small-2509'
        ELSE 'codestral-latest' END AS model FROM v_routed) r
LEFT JOIN (VALUES ('ministral-3b-latest',1),('mistral-small-latest',2),('mistral-medium-latest',3),('mistral-large-latest',4)) AS m(model, tier)
ON r.model = m.model""")
def c3_model_tier(spark, sf_dir):
    """Model id -> tier inverse lookup; models outside the map give NULL."""
    register(spark, sf_dir)
    models = F.element_at(F.array(*[F.lit(m) for m in [
        "ministral-3b-latest", "mistral-small-latest", "mistral-medium-latest", "mistral-large-latest",
        "magistral-small-2509", "codestral-latest"]]), ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"))
    df = spark.table("v_routed").select("conv_id", "turn", models.alias("model"))
    return cost.model_to_tier(df, "model", "actual_tier")


@query("c13_measured_baseline", """
SELECT r.conv_id, r.turn, r.predicted_tier AS tier,
       CAST(coalesce(r.input_tokens*p.pin + r.output_tokens*p.pout, 0) AS BIGINT) AS actual_cost_nano,
       CAST(CASE WHEN r.turn % 4 = 0 THEN (r.input_tokens + 7)*400 + (r.output_tokens * 2)*2000
                 ELSE r.input_tokens*400 + r.output_tokens*2000 END AS BIGINT) AS baseline_cost_nano
FROM v_routed r LEFT JOIN """ + _ROI_PRICES + """ ON r.predicted_tier = p.tier""")
def c13_measured_baseline(spark, sf_dir):
    """Baseline from a measured tier-3 call where one exists (every turn % 4 = 0
    has a compare-mode call), else computed from the turn's own tokens."""
    calls = routed_calls(spark, sf_dir)
    measured = calls.filter(F.col("turn") % 4 == 0).select(
        "conv_id", "turn", (F.col("input_tokens") + 7).alias("baseline_input_tokens"),
        (F.col("output_tokens") * 2).alias("baseline_output_tokens"))
    return cost.measured_baseline(calls, measured).select(
        "conv_id", "turn", "tier", "actual_cost_nano", "baseline_cost_nano")


@query("e1_running_cost", """
SELECT conv_id, turn, CAST(row_number() OVER w AS BIGINT) AS turn_no,
       CAST(sum(coalesce(r.input_tokens*p.pin + r.output_tokens*p.pout, 0)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cumulative_cost_nano
FROM v_routed r LEFT JOIN """ + _ROI_PRICES + """ ON r.predicted_tier = p.tier
WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def e1_running_cost(spark, sf_dir):
    """Turn number and running cost per conversation."""
    priced = cost.price_calls(routed_calls(spark, sf_dir), "roi", out="actual_cost_nano")
    return cost.running_cost(priced).select("conv_id", "turn", "turn_no", "cumulative_cost_nano")
