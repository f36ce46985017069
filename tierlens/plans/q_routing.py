"""Routing queries: B1-B5 on routed turns and raw classifier text, B10 on events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierlens.fixtures import register
from tierlens.operators import routing
from tierlens.operators import webhook
from tierlens.plans import query

# DuckDB twins of the extraction patterns (RE2 accepts them unchanged).
_EMB = r"\{[^}]+\}"
_KW_T = r"""(?:model_tier|tier|Tier|category|level)["\s\-_:]+(\d)"""
_KW_C = r"""(?:confidence|Confidence|score|probability)["\s\-_:]+(0?\.\d+)"""

_TOLERANT_SQL = f"""
p0 AS (SELECT conv_id, turn, raw, regexp_extract(raw, '{_EMB}', 0) AS emb,
              regexp_extract(raw, '{_KW_T}', 1) AS kt, regexp_extract(raw, '{_KW_C}', 1) AS kc FROM src),
p1 AS (SELECT *, CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT' THEN raw END AS j1,
              CASE WHEN emb <> '' AND json_valid(emb) AND json_type(emb) = 'OBJECT' THEN emb END AS j2 FROM p0),
parsed AS (
  SELECT conv_id, turn, raw,
    CASE WHEN j1 IS NOT NULL THEN 'json' WHEN j2 IS NOT NULL THEN 'embedded_json'
         WHEN kt <> '' THEN 'keyword' ELSE 'fallback' END AS parse_path,
    CASE WHEN j1 IS NOT NULL THEN coalesce(TRY_CAST(json_extract_string(j1, '$.model_tier') AS DOUBLE), 2.0)
         WHEN j2 IS NOT NULL THEN coalesce(TRY_CAST(json_extract_string(j2, '$.model_tier') AS DOUBLE), 2.0)
         WHEN kt <> '' THEN CAST(kt AS DOUBLE) ELSE 2.0 END AS raw_tier,
    CASE WHEN j1 IS NOT NULL THEN coalesce(TRY_CAST(json_extract_string(j1, '$.confidence') AS DOUBLE), 0.5)
         WHEN j2 IS NOT NULL THEN coalesce(TRY_CAST(json_extract_string(j2, '$.confidence') AS DOUBLE), 0.5)
         WHEN kt <> '' THEN coalesce(TRY_CAST(nullif(kc, '') AS DOUBLE), 0.5) ELSE 0.3 END AS raw_confidence
  FROM p1),
clamped AS (
  SELECT *, CAST(greatest(1, least(4, trunc(raw_tier))) AS INTEGER) AS model_tier,
         greatest(0.0, least(1.0, raw_confidence)) AS confidence FROM parsed)
"""
_TIERS = "(VALUES (1,'small','ministral-3b-latest'),(2,'medium','mistral-small-latest'),(3,'large','mistral-medium-latest'),(4,'xlarge','mistral-large-latest')) AS d(tier, label, model)"


def _raw(spark, sf_dir):
    register(spark, sf_dir)
    return spark.table("v_raw")


@query("b1_tier_enrich", f"""
SELECT r.conv_id, r.turn, r.predicted_tier AS model_tier,
       coalesce(d.label, 'medium') AS tier_label, coalesce(d.model, 'mistral-small-latest') AS model_name
FROM v_routed r LEFT JOIN {_TIERS} ON r.predicted_tier = d.tier""")
def b1_tier_enrich(spark, sf_dir):
    """Tier -> label and model of every routed turn."""
    register(spark, sf_dir)
    df = spark.table("v_routed").select("conv_id", "turn", F.col("predicted_tier").alias("model_tier"))
    return routing.enrich(df)


@query("b3_tolerant_parse", ", src AS (SELECT * FROM v_raw)," + _TOLERANT_SQL + """
SELECT conv_id, turn, parse_path, raw_tier, raw_confidence FROM parsed""")
def b3_tolerant_parse(spark, sf_dir):
    """Tolerant extraction over six shapes of classifier output."""
    return routing.tolerant_parse(_raw(spark, sf_dir)).select(
        "conv_id", "turn", "parse_path", "raw_tier", "raw_confidence")


@query("b2_clamp", ", src AS (SELECT * FROM v_raw)," + _TOLERANT_SQL + """
SELECT conv_id, turn, model_tier, confidence FROM clamped""")
def b2_clamp(spark, sf_dir):
    """Parsed tier truncated and clamped to 1..4, confidence clamped to 0..1."""
    return routing.clamp(routing.tolerant_parse(_raw(spark, sf_dir))).select(
        "conv_id", "turn", "model_tier", "confidence")


@query("b3_route_decisions", ", src AS (SELECT * FROM v_raw)," + _TOLERANT_SQL + f"""
SELECT c.conv_id, c.turn, c.parse_path, c.model_tier, c.confidence,
       coalesce(d.label, 'medium') AS tier_label, coalesce(d.model, 'mistral-small-latest') AS model_name
FROM clamped c LEFT JOIN {_TIERS} ON c.model_tier = d.tier""")
def b3_route_decisions(spark, sf_dir):
    """Full decision per raw classifier output: parse, clamp, enrich."""
    return routing.route_decisions(_raw(spark, sf_dir)).select(
        "conv_id", "turn", "parse_path", "model_tier", "confidence", "tier_label", "model_name")


@query("b4_strict_parse", r"""
, s0 AS (SELECT conv_id, turn, raw, regexp_extract(raw, '(?s)\{.*\}', 0) AS span FROM v_raw),
s1 AS (SELECT *, CASE WHEN span <> '' THEN span ELSE raw END AS cand FROM s0),
s2 AS (SELECT *, CASE WHEN json_valid(cand) AND json_type(cand) = 'OBJECT' THEN cand END AS obj FROM s1)
SELECT s2.conv_id, s2.turn, CASE WHEN obj IS NULL THEN 'rejected' ELSE 'accepted' END AS status,
       CASE WHEN obj IS NOT NULL THEN coalesce(TRY_CAST(json_extract_string(obj, '$.model_tier') AS BIGINT), 1) END AS model_tier,
       TRY_CAST(json_extract_string(obj, '$.confidence') AS DOUBLE) AS confidence,
       CASE WHEN obj IS NOT NULL THEN coalesce(d.model, 'ministral-3b-latest') END AS model_name
FROM s2 LEFT JOIN (VALUES (1,'ministral-3b-latest'),(2,'mistral-small-latest'),(3,'mistral-medium-latest'),(4,'mistral-large-latest')) AS d(tier, model)
  ON TRY_CAST(json_extract_string(s2.obj, '$.model_tier') AS BIGINT) = d.tier""")
def b4_strict_parse(spark, sf_dir):
    """Strict extraction; texts without a JSON object are quarantined (status rejected)."""
    ok, bad = routing.strict_parse(_raw(spark, sf_dir))
    ok = ok.select("conv_id", "turn", F.lit("accepted").alias("status"), "model_tier", "confidence", "model_name")
    bad = bad.select("conv_id", "turn", F.lit("rejected").alias("status"), F.lit(None).cast("bigint").alias("model_tier"),
                     F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("model_name"))
    return ok.unionByName(bad)


@query("b5_service_fallback", """
, src0 AS (SELECT conv_id, turn,
                 CASE WHEN (conv_id + turn) % 7 = 1 THEN NULL ELSE raw END AS raw,
                 CASE WHEN (conv_id + turn) % 7 = 0 THEN 'timeout' END AS call_error FROM v_raw),
src AS (SELECT conv_id, turn, trim(raw) AS raw, call_error FROM src0),""" + _TOLERANT_SQL + """
SELECT c.conv_id, c.turn,
       CASE WHEN s.call_error IS NOT NULL THEN 'service_error' WHEN s.raw IS NULL THEN 'malformed_body' ELSE c.parse_path END AS parse_path,
       CASE WHEN s.call_error IS NOT NULL OR s.raw IS NULL THEN 2 ELSE c.model_tier END AS model_tier,
       CASE WHEN s.call_error IS NOT NULL THEN 0.0 WHEN s.raw IS NULL THEN 0.3 ELSE c.confidence END AS confidence
FROM clamped c JOIN src s ON c.conv_id = s.conv_id AND c.turn = s.turn""")
def b5_service_fallback(spark, sf_dir):
    """Classifier-call failures: every 7th call errors (2, 0.0), the next one
    returns a malformed body (2, 0.3); the rest go through tolerant parsing."""
    raw = _raw(spark, sf_dir)
    k = (F.col("conv_id") + F.col("turn")) % 7
    df = raw.select("conv_id", "turn",
                    F.when(k == 1, F.lit(None).cast("string")).otherwise(F.col("raw")).alias("raw"),
                    F.when(k == 0, F.lit("timeout")).alias("call_error"))
    return routing.service_fallback(df).select("conv_id", "turn", "parse_path", "model_tier", "confidence")


_WEBHOOK_SRC = """
, hooks AS (SELECT event_id,
       CASE WHEN user_id % 3 = 0 THEN 'model' ELSE 'dataset' END AS repo_type,
       CASE WHEN user_id % 5 = 0 THEN 'someone/other-data' ELSE 'your-username/router-training-data' END AS repo_name,
       CASE event_type WHEN 'purchase' THEN 'update' WHEN 'signup' THEN 'create' ELSE event_type END AS action
  FROM events)
"""


@query("b10_webhook_filter", _WEBHOOK_SRC + """
SELECT event_id,
  CASE WHEN repo_type IS DISTINCT FROM 'dataset' THEN 'ignored'
       WHEN repo_name IS DISTINCT FROM 'your-username/router-training-data' THEN 'ignored'
       WHEN action IS DISTINCT FROM 'update' THEN 'ignored' ELSE 'retrain_triggered' END AS status,
  CASE WHEN repo_type IS DISTINCT FROM 'dataset' THEN 'not a dataset repo'
       WHEN repo_name IS DISTINCT FROM 'your-username/router-training-data' THEN 'not our dataset (your-username/router-training-data)'
       WHEN action IS DISTINCT FROM 'update' THEN 'not an update event' END AS reason
FROM hooks""")
def b10_webhook_filter(spark, sf_dir):
    """Repository events: only updates of our dataset repo trigger retraining;
    the rest are labelled with the ignore reason."""
    register(spark, sf_dir)
    ev = spark.table("events")
    hooks = ev.select(
        "event_id",
        F.when(F.col("user_id") % 3 == 0, "model").otherwise("dataset").alias("repo_type"),
        F.when(F.col("user_id") % 5 == 0, "someone/other-data")
         .otherwise("your-username/router-training-data").alias("repo_name"),
        F.when(F.col("event_type") == "purchase", "update").when(F.col("event_type") == "signup", "create")
         .otherwise(F.col("event_type")).alias("action"))
    return webhook.classify_events(hooks).select("event_id", "status", "reason")
