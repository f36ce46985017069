"""Export queries: E11 seeded split, H16 chat rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierlens import dims
from tierlens.fixtures import register
from tierlens.operators import export
from tierlens.plans import query


@query("e11_seeded_split", """
, r AS (SELECT conv_id, turn, row_number() OVER (ORDER BY md5(concat_ws('|', '42', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR))), conv_id, turn) - 1 AS rk,
               count(*) OVER () AS n FROM v_turn)
SELECT conv_id, turn, CASE WHEN rk < CAST(floor(n * 0.8) AS BIGINT) THEN 'train'
                           WHEN rk < CAST(floor(n * 0.8) AS BIGINT) + CAST(floor(n * 0.1) AS BIGINT) THEN 'val' ELSE 'test' END AS split
FROM r""")
def e11_seeded_split(spark, sf_dir):
    """Seeded shuffle (md5 of seed and key) and exact 80/10/10 cut, ranked
    globally with per-partition counts and offsets."""
    register(spark, sf_dir)
    df = spark.table("v_turn").select("conv_id", "turn")
    return export.split_assign(df, ["conv_id", "turn"], seed=42).select("conv_id", "turn", "split")


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query("h16_render_chat", f"""
SELECT conv_id, turn,
       md5(concat('[user]: ', query, chr(10), '[assistant]: ', coalesce(response, ''))) AS rendered_md5,
       length(concat('[user]: ', query, chr(10), '[assistant]: ', coalesce(response, ''))) AS rendered_len,
       md5(concat('<s>[INST] ', {_sql_str(dims.SYSTEM_PROMPT)}, chr(10), chr(10), 'User Query: ', query, chr(10), chr(10),
                  'Remember: Output ONLY the JSON object. Example: {{"model_tier": 2, "confidence": 0.8}} [/INST]')) AS prompt_md5
FROM v_turn""")
def h16_render_chat(spark, sf_dir):
    """Each turn rendered as one training string, and the classifier prompt around the query."""
    register(spark, sf_dir)
    t = spark.table("v_turn")
    msgs = F.array(F.struct(F.lit("user").alias("role"), F.col("query").alias("content")),
                   F.struct(F.lit("assistant").alias("role"), F.col("response").alias("content")))
    rendered = export.render_chat(msgs)
    return t.select("conv_id", "turn", F.md5(rendered).alias("rendered_md5"),
                    F.length(rendered).cast("bigint").alias("rendered_len"),
                    F.md5(export.instruct_prompt(F.col("query"))).alias("prompt_md5"))
