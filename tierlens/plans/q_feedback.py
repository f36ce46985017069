"""Feedback queries: B6-B8, C6, D4, D5, H14, H15, G1 over the feedback view."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierlens import dims
from tierlens.fixtures import register
from tierlens.operators import feedback as fb
from tierlens.operators import validate
from tierlens.plans import query

_SYS_MD5 = None  # md5 of the system prompt is computed by both engines from the literal


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SYS = _sql_str(dims.SYSTEM_PROMPT)


def _feedback(spark, sf_dir):
    register(spark, sf_dir)
    return spark.table("v_feedback").withColumn("is_correct", F.col("predicted_tier") == F.col("corrected_tier"))


_SUBMITTED = """
, submitted AS (SELECT conv_id, turn, query,
     CASE WHEN (conv_id*3 + turn) % 13 = 0 THEN 0 ELSE predicted_tier END AS predicted_tier,
     CASE WHEN (conv_id + turn*7) % 17 = 0 THEN 5 ELSE corrected_tier END AS corrected_tier,
     confidence FROM v_feedback)
"""


@query("b7_feedback_accept", _SUBMITTED + """
SELECT conv_id, turn,
  CASE WHEN predicted_tier NOT IN (1,2,3,4) OR predicted_tier IS NULL THEN 'predicted_tier must be 1-4'
       WHEN corrected_tier NOT IN (1,2,3,4) OR corrected_tier IS NULL THEN 'corrected_tier must be 1-4' END AS reject_reason,
  CASE WHEN predicted_tier IN (1,2,3,4) AND corrected_tier IN (1,2,3,4) THEN predicted_tier = corrected_tier END AS is_correct
FROM submitted""")
def b7_feedback_accept(spark, sf_dir):
    """Submitted corrections with some out-of-range tiers: accepted rows get
    ``is_correct``, the others are quarantined with the reason."""
    register(spark, sf_dir)
    sub = spark.table("v_feedback").select(
        "conv_id", "turn", "query",
        F.when((F.col("conv_id") * 3 + F.col("turn")) % 13 == 0, F.lit(0)).otherwise(F.col("predicted_tier")).alias("predicted_tier"),
        F.when((F.col("conv_id") + F.col("turn") * 7) % 17 == 0, F.lit(5)).otherwise(F.col("corrected_tier")).alias("corrected_tier"),
        "confidence")
    ok, bad = fb.accept(sub)
    return (ok.select("conv_id", "turn", F.lit(None).cast("string").alias("reject_reason"), "is_correct")
              .unionByName(bad.select("conv_id", "turn", "reject_reason", F.lit(None).cast("boolean").alias("is_correct"))))


@query("b8_feedback_status", """
, answers AS (SELECT conv_id, turn, predicted_tier, corrected_tier,
     CASE (conv_id + turn) % 5 WHEN 0 THEN CAST(corrected_tier AS VARCHAR) WHEN 1 THEN 'n' WHEN 2 THEN 'y'
          WHEN 3 THEN '' ELSE CAST(predicted_tier AS VARCHAR) END AS response FROM v_feedback)
SELECT conv_id, turn,
  CASE WHEN response IN ('1','2','3','4') THEN CASE WHEN CAST(response AS INT) <> predicted_tier THEN 'corrected' ELSE 'confirmed' END
       WHEN response = 'n' THEN CASE WHEN corrected_tier <> predicted_tier THEN 'corrected' ELSE 'confirmed' END
       WHEN response = 'y' THEN 'confirmed' ELSE 'skipped' END AS status,
  CASE WHEN (conv_id + turn) % 4 = 0 OR predicted_tier = corrected_tier THEN 'confirmed' ELSE 'corrected' END AS stored_status
FROM answers""")
def b8_feedback_status(spark, sf_dir):
    """Feedback status from the operator's answer (digit / n / y / blank) and,
    for stored entries, from ``is_correct`` (missing counts as confirmed)."""
    df = _feedback(spark, sf_dir)
    k = (F.col("conv_id") + F.col("turn")) % 5
    resp = (F.when(k == 0, F.col("corrected_tier").cast("string")).when(k == 1, "n").when(k == 2, "y")
             .when(k == 3, "").otherwise(F.col("predicted_tier").cast("string")))
    stored_flag = F.when((F.col("conv_id") + F.col("turn")) % 4 != 0, F.col("is_correct"))
    return df.select("conv_id", "turn",
                     fb.interactive_status(resp, F.col("predicted_tier"), F.col("corrected_tier")).alias("status"),
                     fb.stored_status(stored_flag).alias("stored_status"))


@query("c6_recover_turns", """
, last_tier AS (SELECT conv_id, arg_max(predicted_tier, turn) AS last_tier FROM v_routed GROUP BY conv_id),
scratch AS (SELECT t.conv_id, t.turn, t.query, l.last_tier FROM v_turn t JOIN last_tier l ON t.conv_id = l.conv_id),
fbk AS (SELECT DISTINCT query FROM v_feedback WHERE predicted_tier <> corrected_tier AND query IS NOT NULL),
firsts AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY conv_id, turn) AS rn FROM scratch)
SELECT conv_id, turn, md5(query) AS query_md5, length(query) AS query_len, last_tier AS predicted_tier,
       last_tier AS corrected_tier, CAST(1.0 AS DOUBLE) AS confidence, 'recovered_from_scratchpad' AS status
FROM firsts WHERE rn = 1 AND query NOT IN (SELECT query FROM fbk)""")
def c6_recover_turns(spark, sf_dir):
    """Scratch-pad user turns missing from the stored corrections are recovered
    once each with the conversation's last tier."""
    register(spark, sf_dir)
    last = spark.table("v_routed").groupBy("conv_id").agg(F.max_by("predicted_tier", "turn").alias("last_tier"))
    scratch = spark.table("v_turn").join(last, "conv_id").select("conv_id", "turn", "query", "last_tier")
    stored = _feedback(spark, sf_dir).filter(~F.col("is_correct"))
    rec = fb.recover_turns(scratch, stored)
    return rec.select("conv_id", "turn", F.md5("query").alias("query_md5"), F.length("query").cast("bigint").alias("query_len"),
                      "predicted_tier", "corrected_tier", "confidence", "status")


@query("d4_feedback_stats", """
SELECT count(*) AS total, CAST(sum(CASE WHEN predicted_tier = corrected_tier THEN 1 ELSE 0 END) AS BIGINT) AS correct,
       CAST(count(*) - sum(CASE WHEN predicted_tier = corrected_tier THEN 1 ELSE 0 END) AS BIGINT) AS incorrect,
       round(CAST(sum(CASE WHEN predicted_tier = corrected_tier THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 9) AS accuracy,
       20 AS threshold, count(*) >= 20 AS ready_for_retrain
FROM v_feedback""")
def d4_feedback_stats(spark, sf_dir):
    """Totals, correct / incorrect and accuracy of the corrections."""
    return fb.stats(_feedback(spark, sf_dir))


@query("d4_feedback_by_tier", """
SELECT c.ct AS corrected_tier, p.pt AS predicted_tier, CAST(count(f.conv_id) AS BIGINT) AS n
FROM (VALUES (1),(2),(3),(4)) AS c(ct) CROSS JOIN (VALUES (1),(2),(3),(4)) AS p(pt)
LEFT JOIN v_feedback f ON f.corrected_tier = c.ct AND f.predicted_tier = p.pt
GROUP BY c.ct, p.pt""")
def d4_feedback_by_tier(spark, sf_dir):
    """For each corrected tier, how often each tier was predicted (all 16 cells)."""
    return fb.stats_by_tier(_feedback(spark, sf_dir))


@query("d5_retrain_readiness", """
SELECT CAST(floor(event_s / 86400) AS BIGINT) AS batch_day, count(*) AS n_feedback,
       count(*) >= 20 OR CAST(floor(event_s / 86400) AS BIGINT) % 2 = 0 AS ready,
       CAST(greatest(0, 20 - count(*)) AS BIGINT) AS shortfall
FROM v_feedback GROUP BY CAST(floor(event_s / 86400) AS BIGINT)""")
def d5_retrain_readiness(spark, sf_dir):
    """Per daily batch: count, ready when >= 20 (or forced on even days), shortfall."""
    df = _feedback(spark, sf_dir).withColumn("batch_day", F.floor(F.col("event_s") / 86400).cast("bigint"))
    return fb.readiness(df, ["batch_day"], force=(F.col("batch_day") % 2 == 0))


@query("h14_sft_examples", f"""
SELECT conv_id, turn, 3 AS n_messages, md5({SYS}) AS system_md5, md5(query) AS user_md5,
       concat('{{"model_tier": ', CAST(corrected_tier AS VARCHAR), ', "confidence": 0.95}}') AS assistant_content
FROM v_feedback""")
def h14_sft_examples(spark, sf_dir):
    """Chat training examples from corrections (the corrected tier is the label)."""
    ex = fb.sft_examples(_feedback(spark, sf_dir))
    return ex.select("conv_id", "turn", F.size("messages").alias("n_messages"),
                     F.md5(F.col("messages")[0]["content"]).alias("system_md5"),
                     F.md5(F.col("messages")[1]["content"]).alias("user_md5"),
                     F.col("messages")[2]["content"].alias("assistant_content"))


@query("h14_sft_converted", f"""
SELECT conv_id, turn, md5(query) AS user_md5,
  concat('{{"model_tier": ', CAST(predicted_tier AS VARCHAR), ', "confidence": ',
         CAST(CAST(88 + CAST(('0x' || substr(md5(concat('42|', CAST(conv_id AS VARCHAR), ':', CAST(turn AS VARCHAR))), 1, 8)) AS BIGINT) % 12 AS DOUBLE) / 100.0 AS VARCHAR),
         '}}') AS assistant_content
FROM v_routed""")
def h14_sft_converted(spark, sf_dir):
    """Prompt/label pairs converted to chat examples with a reproducible
    confidence on the 0.88-0.99 grid (hash of seed and key)."""
    register(spark, sf_dir)
    df = spark.table("v_routed")
    key = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    ex = fb.sft_examples(df, "query", "predicted_tier", fb.hashed_confidence(42, key, 0.88, 0.99))
    return ex.select("conv_id", "turn", F.md5(F.col("messages")[1]["content"]).alias("user_md5"),
                     F.col("messages")[2]["content"].alias("assistant_content"))


@query("h15_dpo_triples", f"""
SELECT conv_id, turn, md5(concat({SYS}, chr(10), chr(10), 'User Query: ', query)) AS prompt_md5,
       concat('{{"model_tier": ', CAST(corrected_tier AS VARCHAR), ', "confidence": 1.0}}') AS chosen,
       concat('{{"model_tier": ', CAST(predicted_tier AS VARCHAR), ', "confidence": ', coalesce(CAST(confidence AS VARCHAR), 'null'), '}}') AS rejected
FROM v_feedback WHERE predicted_tier <> corrected_tier""")
def h15_dpo_triples(spark, sf_dir):
    """Preference triples from wrong predictions only."""
    t = fb.dpo_triples(_feedback(spark, sf_dir))
    return t.select("conv_id", "turn", F.md5("prompt").alias("prompt_md5"), "chosen", "rejected")


@query("g1_merge_feedback", f"""
SELECT 'existing' AS source, md5(query) AS user_md5,
       concat('{{"model_tier": ', CAST(predicted_tier AS VARCHAR), ', "confidence": 0.95}}') AS assistant_content FROM v_routed
UNION ALL
SELECT 'feedback', md5(query), concat('{{"model_tier": ', CAST(corrected_tier AS VARCHAR), ', "confidence": 0.95}}')
FROM v_feedback WHERE predicted_tier <> corrected_tier""")
def g1_merge_feedback(spark, sf_dir):
    """Existing training set (routed turns) plus feedback examples (the
    corrections), duplicates kept."""
    register(spark, sf_dir)
    existing = fb.sft_examples(spark.table("v_routed"), "query", "predicted_tier")
    new = fb.sft_examples(_feedback(spark, sf_dir).filter(~F.col("is_correct")))
    merged = fb.merge_into_training(existing, new)
    return merged.select("source", F.md5(F.col("messages")[1]["content"]).alias("user_md5"),
                         F.col("messages")[2]["content"].alias("assistant_content"))


# Line shapes by (conv_id + turn) % 9; {turn} and {tier} are filled per row.
_LINE_SHAPES = [
    '{"messages": [oops',
    '{"msgs": []}',
    '{"messages": [{"role": "user", "content": "hi"}]}',
    '{"messages": [{"role": "system", "content": "s"}, {"role": "assistant", "content": "x"}, {"role": "user", "content": "q{turn}"}]}',
    '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "tier two"}]}',
    r'{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "{\"model_tier\": 7, \"confidence\": 0.9}"}]}',
    r'{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "{\"model_tier\": 2, \"confidence\": 1.5}"}]}',
    r'{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "{\"model_tier\": 2, \"confidence\": null}"}]}',
    r'{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "{\"model_tier\": {tier}, \"confidence\": 0.95}"}]}',
]


def _shape_sql(t: str) -> str:
    parts = []
    rest = t
    while rest:
        i = min([x for x in (rest.find("{turn}"), rest.find("{tier}")) if x >= 0], default=-1)
        if i < 0:
            parts.append(_sql_str(rest))
            break
        if i:
            parts.append(_sql_str(rest[:i]))
        parts.append("CAST(turn AS VARCHAR)" if rest[i:i + 6] == "{turn}" else "CAST(corrected_tier AS VARCHAR)")
        rest = rest[i + 6:]
    return "concat(" + ", ".join(parts) + ")" if len(parts) > 1 else parts[0]


def _shape_col(t: str):
    parts, rest = [], t
    while rest:
        i = min([x for x in (rest.find("{turn}"), rest.find("{tier}")) if x >= 0], default=-1)
        if i < 0:
            parts.append(F.lit(rest))
            break
        if i:
            parts.append(F.lit(rest[:i]))
        parts.append(F.col("turn").cast("string") if rest[i:i + 6] == "{turn}" else F.col("corrected_tier").cast("string"))
        rest = rest[i + 6:]
    return F.concat(*parts)


_LINES = ("\n, lines AS (SELECT conv_id, turn, CASE (conv_id + turn) % 9\n"
          + "\n".join(f"    WHEN {i} THEN {_shape_sql(t)}" for i, t in enumerate(_LINE_SHAPES))
          + "\n  END AS line FROM v_feedback)\n")


def _lines(spark, sf_dir):
    register(spark, sf_dir)
    k = (F.col("conv_id") + F.col("turn")) % 9
    line = None
    for i, t in enumerate(_LINE_SHAPES):
        line = (F.when(k == i, _shape_col(t)) if line is None else line.when(k == i, _shape_col(t)))
    return spark.table("v_feedback").select("conv_id", "turn", line.alias("line"))


_VALIDATE_SQL = _LINES + """,
v0 AS (SELECT conv_id, turn, line,
         CASE WHEN json_valid(line) THEN json_extract(line, '$.messages') END AS msgs FROM lines),
v1 AS (SELECT *, CASE WHEN msgs IS NOT NULL THEN json_array_length(msgs) END AS n_msgs,
         json_extract_string(msgs, '$[#-1].role') AS last_role,
         json_extract_string(msgs, '$[#-1].content') AS content FROM v0),
v2 AS (SELECT *, CASE WHEN content IS NOT NULL AND json_valid(content) AND json_type(content) = 'OBJECT' THEN content END AS out FROM v1),
v3 AS (SELECT *, TRY_CAST(json_extract_string(out, '$.model_tier') AS DOUBLE) AS tier,
         TRY_CAST(json_extract_string(out, '$.confidence') AS DOUBLE) AS conf FROM v2),
checked AS (SELECT conv_id, turn,
  CASE WHEN NOT json_valid(line) THEN 'invalid_json'
       WHEN msgs IS NULL THEN 'missing_messages'
       WHEN n_msgs < 2 THEN 'too_few_messages'
       WHEN last_role IS DISTINCT FROM 'assistant' THEN 'last_not_assistant'
       WHEN out IS NULL THEN 'content_not_json'
       WHEN tier IS NULL OR tier NOT IN (1, 2, 3, 4) THEN 'invalid_tier'
       WHEN conf IS NULL THEN 'content_not_json'
       WHEN conf < 0 OR conf > 1 THEN 'invalid_confidence' END AS error_code,
  CAST(tier AS INTEGER) AS tier FROM v3)
"""


@query("b6_validate_examples", _VALIDATE_SQL + """
SELECT conv_id, turn, error_code, CASE WHEN error_code IS NULL THEN tier END AS tier FROM checked""")
def b6_validate_examples(spark, sf_dir):
    """Chat-example lines (valid ones built from corrections, plus eight kinds
    of broken line): the first failing rule per line."""
    out = validate.validate_examples(_lines(spark, sf_dir))
    return out.select("conv_id", "turn", "error_code", "tier")


@query("d10_validated_distribution", _VALIDATE_SQL + """
SELECT d.t AS tier, CAST(count(c.conv_id) AS BIGINT) AS n,
       round(count(c.conv_id) * 100.0 / (SELECT count(*) FROM checked), 9) AS pct
FROM (VALUES (1),(2),(3),(4)) AS d(t) LEFT JOIN checked c ON c.error_code IS NULL AND c.tier = d.t
GROUP BY d.t""")
def d10_validated_distribution(spark, sf_dir):
    """Tier distribution of the valid examples, as % of all lines (errors included)."""
    from tierlens.operators.evaluate import tier_distribution
    out = validate.validate_examples(_lines(spark, sf_dir))
    return tier_distribution(out, "tier", F.col("error_code").isNull())
