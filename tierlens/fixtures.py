"""Test-table loading and the derived input views.

The driver tables carry no routing, feedback or session logs, so these views
shape ``conversations`` rows into the schemas the operators expect (a user
turn with its reply, a routed turn, a feedback row, raw classifier text, a
tagged session log). They only build inputs; every operator's work runs in
``tierlens.operators``. The SQL below runs unchanged in Spark and DuckDB and
is also the ``WITH`` prefix of every oracle query.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

_REGISTERED_KEY = "tierlens.fixtures.dir"

# Derived views, in dependency order.
VIEWS: dict[str, str] = {
    # a user message with the assistant reply right after it
    "v_turn": """
SELECT conv_id, turn, text AS query, ntext AS response,
       CAST(floor(length(text)/4.0) AS BIGINT)  AS input_tokens,
       CAST(floor(length(ntext)/4.0) AS BIGINT) AS output_tokens
FROM (SELECT conv_id, turn, role, text,
        lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nrole,
        lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ntext FROM conversations) m
WHERE role='user' AND nrole='assistant'""",
    # deterministic tier and confidence
    "v_routed": """
SELECT *, CAST(1+(conv_id*7+turn*3+input_tokens)%4 AS INT) AS predicted_tier,
       CAST(50+(conv_id*13+turn*5)%50 AS DOUBLE)/CAST(100 AS DOUBLE) AS confidence
FROM v_turn""",
    # about 4 in 10 corrected, confidence NULL for conv_id % 11 = 0
    "v_feedback": """
SELECT conv_id, turn, query, predicted_tier,
       CAST(CASE WHEN (conv_id+turn)%5<2 THEN 1+predicted_tier%4 ELSE predicted_tier END AS INT) AS corrected_tier,
       CASE WHEN conv_id%11=0 THEN NULL ELSE confidence END AS confidence,
       1704067200+conv_id*3600+turn*60 AS event_s
FROM v_routed""",
    # six shapes of classifier output
    "v_raw": """
SELECT conv_id, turn, CASE (conv_id+turn)%6
  WHEN 0 THEN concat('{"model_tier": ',CAST(predicted_tier AS STRING),', "confidence": ',CAST(confidence AS STRING),'}')
  WHEN 1 THEN concat('Sure! {"model_tier": ',CAST(predicted_tier AS STRING),', "confidence": 0.8} done')
  WHEN 2 THEN concat('Tier: ',CAST(predicted_tier AS STRING),' confidence: 0.7')
  WHEN 3 THEN 'no idea'
  WHEN 4 THEN '{"model_tier": 9, "confidence": 1.7}'
  ELSE 'level - 4' END AS raw
FROM v_routed""",
    # tagged session log
    "v_entry": """
SELECT conv_id AS session_id, turn*4 AS seq, 'message' AS type, role, text,
       CASE WHEN role='assistant' THEN CAST(floor(length(text)/4.0) AS BIGINT) END AS output_tokens,
       CASE WHEN role='assistant' THEN CAST(turn*100+conv_id AS BIGINT) END AS input_tokens,
       CAST(NULL AS STRING) AS value FROM conversations
UNION ALL SELECT conv_id, turn*4+1, 'compaction', NULL, NULL, NULL, NULL, concat('summary@',CAST(turn AS STRING))
  FROM conversations WHERE role='assistant' AND (conv_id+turn)%4=3
UNION ALL SELECT conv_id, turn*4+2, 'model_change', NULL, NULL, NULL, NULL, concat('model-',CAST(1+CAST(floor((conv_id+turn)/6.0) AS BIGINT)%2 AS STRING))
  FROM conversations WHERE (conv_id+turn)%3=0
UNION ALL SELECT conv_id, turn*4+3, 'session_info', NULL, NULL, NULL, NULL, concat('name-',CAST(turn AS STRING))
  FROM conversations WHERE turn%5=4""",
    # the same log with cache counters, stop reasons, tool calls, list content (an image first) and thinking levels
    "v_log": """
SELECT session_id, seq, type, role,
       CASE WHEN role='assistant' AND (session_id+seq)%13=8 AND seq%8=0 THEN '' ELSE text END AS text,
       output_tokens, input_tokens, value,
       CASE WHEN role='assistant' THEN CAST((seq*7+session_id)%60 AS BIGINT) END AS cache_read,
       CASE WHEN role='assistant' THEN CAST((seq*3+session_id)%20 AS BIGINT) END AS cache_write,
       CASE WHEN role='assistant' THEN CASE (session_id+seq)%13 WHEN 4 THEN 'error' WHEN 8 THEN 'interrupted' WHEN 2 THEN 'tool_use' ELSE 'stop' END END AS stop_reason,
       CASE WHEN type='message' THEN CASE WHEN role='user' AND (session_id+seq)%5=0 THEN 'image' ELSE 'text' END END AS first_kind,
       CASE WHEN role='assistant' AND (session_id+seq)%13=2 THEN CAST(1+session_id%3 AS INT) WHEN type='message' THEN 0 END AS n_calls,
       CAST(NULL AS STRING) AS thinking_level FROM v_entry
UNION ALL SELECT session_id, seq+3, 'thinking_level_change', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
       CASE WHEN (session_id+seq)%2=0 THEN 'low' ELSE 'high' END
  FROM v_entry WHERE type='message' AND CAST(floor(seq/4.0) AS BIGINT)%5=2""",
}


# Spark's form of a view where one scan can do what the portable SQL needs several for.
SPARK_VIEWS: dict[str, str] = {
    "v_entry": """
SELECT conv_id AS session_id, e.seq, e.type, e.role, e.text, e.output_tokens, e.input_tokens, e.value
FROM conversations LATERAL VIEW explode(filter(array(
  named_struct('seq', turn*4, 'type', 'message', 'role', role, 'text', text,
    'output_tokens', CASE WHEN role='assistant' THEN CAST(floor(length(text)/4.0) AS BIGINT) END,
    'input_tokens', CASE WHEN role='assistant' THEN CAST(turn*100+conv_id AS BIGINT) END, 'value', CAST(NULL AS STRING)),
  CASE WHEN role='assistant' AND (conv_id+turn)%4=3 THEN named_struct('seq', turn*4+1, 'type', 'compaction', 'role', CAST(NULL AS STRING),
    'text', CAST(NULL AS STRING), 'output_tokens', CAST(NULL AS BIGINT), 'input_tokens', CAST(NULL AS BIGINT), 'value', concat('summary@',CAST(turn AS STRING))) END,
  CASE WHEN (conv_id+turn)%3=0 THEN named_struct('seq', turn*4+2, 'type', 'model_change', 'role', CAST(NULL AS STRING),
    'text', CAST(NULL AS STRING), 'output_tokens', CAST(NULL AS BIGINT), 'input_tokens', CAST(NULL AS BIGINT),
    'value', concat('model-',CAST(1+CAST(floor((conv_id+turn)/6.0) AS BIGINT)%2 AS STRING))) END,
  CASE WHEN turn%5=4 THEN named_struct('seq', turn*4+3, 'type', 'session_info', 'role', CAST(NULL AS STRING),
    'text', CAST(NULL AS STRING), 'output_tokens', CAST(NULL AS BIGINT), 'input_tokens', CAST(NULL AS BIGINT), 'value', concat('name-',CAST(turn AS STRING))) END),
  x -> x IS NOT NULL)) t AS e""",
}


def register(spark: SparkSession, sf_dir: str) -> None:
    """Register the driver tables and the derived views as temp views.

    Done once per session and folder; the folder is remembered in the session conf.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.conf.get(_REGISTERED_KEY, None) == sf_dir and spark.catalog.tableExists("v_entry"):
        return
    for name in TABLES:
        try:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
        except AnalysisException as e:  # a table that a query needs and does not find fails there
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    for name, sql in {**VIEWS, **SPARK_VIEWS}.items():
        spark.sql(sql).createOrReplaceTempView(name)
    spark.conf.set(_REGISTERED_KEY, sf_dir)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.table(name)


def with_views(body: str) -> str:
    """Prefix an oracle query with the derived views as CTEs."""
    ctes = ",\n".join(f"{name} AS ({sql}\n)" for name, sql in VIEWS.items())
    return f"WITH {ctes}\n{body}"
