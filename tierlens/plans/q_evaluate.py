"""Evaluation queries: C8, D6-D10 (truth = corrected tier, prediction = predicted tier)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierlens.fixtures import register
from tierlens.operators import evaluate as ev
from tierlens.operators import feedback as fb
from tierlens.plans import query


def _scored(spark, sf_dir):
    register(spark, sf_dir)
    return spark.table("v_feedback").select(
        "conv_id", "turn", F.col("corrected_tier").alias("true_tier"), "predicted_tier", "confidence")


_EV = """
, ev AS (SELECT corrected_tier AS t, predicted_tier AS p, confidence FROM v_feedback)
"""
_PER_LABEL = """,
pl AS (SELECT l.label,
          (SELECT count(*) FROM ev WHERE t = l.label AND p = l.label) AS tp,
          (SELECT count(*) FROM ev WHERE p = l.label) AS pred_n,
          (SELECT count(*) FROM ev WHERE t = l.label) AS support FROM labels l),
pm AS (SELECT *, CASE WHEN pred_n > 0 THEN tp / pred_n ELSE 0.0 END AS prec,
          CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rec,
          CASE WHEN pred_n + support > 0 THEN 2.0 * tp / (pred_n + support) ELSE 0.0 END AS f1 FROM pl)
"""
_ECE = """,
b AS (SELECT CASE WHEN coalesce(confidence, 0.5) > 0 AND coalesce(confidence, 0.5) <= 1
                  THEN CAST(ceil(coalesce(confidence, 0.5) * 10) AS INTEGER) - 1 END AS bin,
             coalesce(confidence, 0.5) AS c, CASE WHEN t = p THEN 1.0 ELSE 0.0 END AS ok FROM ev),
rel AS (SELECT bin, count(*) AS n, avg(c) AS avg_confidence, avg(ok) AS accuracy FROM b GROUP BY bin),
e AS (SELECT round(coalesce(sum(CASE WHEN bin IS NOT NULL THEN n * abs(accuracy - avg_confidence) END) / sum(n), 0.0), 9) AS ece FROM rel)
"""


@query("d6_metrics", _EV + ", labels AS (SELECT t AS label FROM ev UNION SELECT p FROM ev)" + _PER_LABEL + _ECE + """
SELECT (SELECT count(*) FROM ev) AS n,
       round((SELECT avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END) FROM ev), 9) AS accuracy,
       round(avg(f1), 9) AS f1_macro,
       round(sum(f1 * support) / sum(support), 9) AS f1_weighted,
       round(avg(prec), 9) AS precision_macro, round(avg(rec), 9) AS recall_macro,
       (SELECT ece FROM e) AS ece
FROM pm""")
def d6_metrics(spark, sf_dir):
    """Accuracy, macro / weighted F1, macro precision and recall, ECE."""
    return ev.metrics(_scored(spark, sf_dir))


@query("d7_confusion_matrix", _EV + """
SELECT l.t AS true_tier,
  CAST(count(*) FILTER (WHERE ev.p = 1) AS BIGINT) AS pred_1, CAST(count(*) FILTER (WHERE ev.p = 2) AS BIGINT) AS pred_2,
  CAST(count(*) FILTER (WHERE ev.p = 3) AS BIGINT) AS pred_3, CAST(count(*) FILTER (WHERE ev.p = 4) AS BIGINT) AS pred_4
FROM (VALUES (1),(2),(3),(4)) AS l(t) LEFT JOIN ev ON ev.t = l.t GROUP BY l.t""")
def d7_confusion_matrix(spark, sf_dir):
    """Confusion matrix on tiers 1..4, rows = truth."""
    return ev.confusion_matrix(_scored(spark, sf_dir))


@query("d8_classification_report", _EV + ", labels AS (SELECT * FROM (VALUES (1),(2),(3),(4)) AS x(label))" + _PER_LABEL + """
SELECT CASE label WHEN 1 THEN 'small' WHEN 2 THEN 'medium' WHEN 3 THEN 'large' ELSE 'xlarge' END AS row_name,
       round(prec, 9) AS precision, round(rec, 9) AS recall, round(f1, 9) AS f1, CAST(support AS BIGINT) AS support FROM pm
UNION ALL SELECT 'accuracy', NULL, NULL, round((SELECT avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END) FROM ev), 9), (SELECT count(*) FROM ev)
UNION ALL SELECT 'macro avg', round(avg(prec), 9), round(avg(rec), 9), round(avg(f1), 9), CAST(sum(support) AS BIGINT) FROM pm
UNION ALL SELECT 'weighted avg', round(sum(prec * support) / sum(support), 9), round(sum(rec * support) / sum(support), 9),
                 round(sum(f1 * support) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM pm""")
def d8_classification_report(spark, sf_dir):
    """Per-tier precision / recall / F1 / support plus accuracy, macro and weighted rows."""
    return ev.report(_scored(spark, sf_dir))


@query("d9_ece", _EV + _ECE + "SELECT ece FROM e")
def d9_ece(spark, sf_dir):
    """Expected calibration error, 10 equal bins (lo, hi]."""
    return ev.ece(_scored(spark, sf_dir))


@query("d9_reliability", _EV + _ECE + """
SELECT bin, n, round(avg_confidence, 9) AS avg_confidence, round(accuracy, 9) AS accuracy FROM rel""")
def d9_reliability(spark, sf_dir):
    """Reliability table: rows, mean confidence and accuracy per bin."""
    r = ev.reliability(_scored(spark, sf_dir))
    return r.select("bin", "n", F.round("avg_confidence", 9).alias("avg_confidence"), F.round("accuracy", 9).alias("accuracy"))


@query("d10_tier_distribution", """
SELECT l.t AS tier, CAST(count(f.conv_id) AS BIGINT) AS n,
       round(count(f.conv_id) * 100.0 / (SELECT count(*) FROM v_feedback), 9) AS pct
FROM (VALUES (1),(2),(3),(4)) AS l(t) LEFT JOIN v_feedback f ON f.corrected_tier = l.t GROUP BY l.t""")
def d10_tier_distribution(spark, sf_dir):
    """Distribution of the labelled tier with percentages."""
    return ev.tier_distribution(_scored(spark, sf_dir), "true_tier")


@query("c8_attach_predictions", """
, preds AS (SELECT query, predicted_tier, confidence,
                   row_number() OVER (PARTITION BY query ORDER BY predicted_tier, confidence NULLS FIRST) AS rn FROM v_routed)
SELECT f.conv_id, f.turn, f.corrected_tier AS true_tier, p.predicted_tier, p.confidence
FROM v_feedback f LEFT JOIN preds p ON p.query = f.query AND p.rn = 1""")
def c8_attach_predictions(spark, sf_dir):
    """Labelled chat examples (truth = corrected tier) joined to the routed
    predictions by their first user text."""
    register(spark, sf_dir)
    examples = fb.sft_examples(spark.table("v_feedback"))
    preds = spark.table("v_routed").select("query", "predicted_tier", "confidence")
    out = ev.attach_predictions(examples.select("conv_id", "turn", "messages"), preds)
    return out.select("conv_id", "turn", "true_tier", "predicted_tier", "confidence")
