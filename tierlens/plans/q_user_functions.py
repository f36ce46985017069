"""User-function slot queries (J1-J3) with the deterministic stubs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierlens import dims
from tierlens.fixtures import register
from tierlens.operators import catalog as G
from tierlens.operators import user_functions as U
from tierlens.plans import query
from tierlens.plans.q_catalog import _TARGETS, _targets
from tierlens.plans.q_routing import _TOLERANT_SQL, _TIERS


def _t(spark, sf_dir, name):
    register(spark, sf_dir)
    return spark.table(name)


@query("j1_classify_batch", """
, sq AS (SELECT conv_id, turn, length(query) AS n FROM v_turn),
src0 AS (SELECT conv_id, turn, CASE n % 7
    WHEN 0 THEN NULL
    WHEN 1 THEN concat('{"model_tier": ', CAST(1 + n % 4 AS VARCHAR), ', "confidence": 0.', CAST(n % 10 AS VARCHAR), '5}')
    WHEN 2 THEN concat('Tier: ', CAST(1 + n % 4 AS VARCHAR), ' confidence: 0.', CAST(n % 10 AS VARCHAR))
    WHEN 3 THEN 'no idea'
    WHEN 4 THEN concat('Sure! {"model_tier": ', CAST(n % 6 AS VARCHAR), '} ok')
    WHEN 5 THEN concat('{"model_tier": ', CAST(1 + n % 4 AS VARCHAR), ', "confidence": 0.95}')
    ELSE concat('level - ', CAST(1 + n % 4 AS VARCHAR)) END AS raw FROM sq),
src AS (SELECT conv_id, turn, trim(raw) AS raw FROM src0),""" + _TOLERANT_SQL + f"""
SELECT c.conv_id, c.turn,
       CASE WHEN s.raw IS NULL THEN 'malformed_body' ELSE c.parse_path END AS parse_path,
       CASE WHEN s.raw IS NULL THEN 2 ELSE c.model_tier END AS model_tier,
       CASE WHEN s.raw IS NULL THEN 0.3 ELSE c.confidence END AS confidence,
       d.label AS tier_label, d.model AS model_name
FROM clamped c JOIN src s ON c.conv_id = s.conv_id AND c.turn = s.turn
LEFT JOIN {_TIERS} ON (CASE WHEN s.raw IS NULL THEN 2 ELSE c.model_tier END) = d.tier""")
def j1_classify_batch(spark, sf_dir):
    """Every user query routed by a user scorer (stub) through mapInPandas,
    then fallback, tolerant parsing, clamping and enrichment."""
    t = _t(spark, sf_dir, "v_turn").select("conv_id", "turn", "query")
    out = U.classify(t, U.stub_scorer)
    return out.select("conv_id", "turn", "parse_path", "model_tier", "confidence", "tier_label", "model_name")


_WS = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query("j2_summarise", r"""
, ctx AS (SELECT conv_id, string_agg(concat('[', role, ']: ', text), concat(chr(10), chr(10)) ORDER BY turn) AS c
          FROM conversations GROUP BY conv_id),
s AS (SELECT conv_id, c, concat(CAST(len(list_filter(regexp_split_to_array(c, '""" + _WS + r"""'), lambda x: x <> '')) AS VARCHAR), ' words, ',
                              CAST(length(c) - length(replace(c, chr(10), '')) + 1 AS VARCHAR), ' lines, ',
                              CAST(length(c) AS VARCHAR), ' chars') AS summary FROM ctx)
SELECT conv_id, md5(summary) AS summary_md5, CAST(floor(length(summary) / 4) AS BIGINT) AS summary_tokens,
       CAST(floor(length(c) / 4) AS BIGINT) AS tokens_before FROM s""")
def j2_summarise(spark, sf_dir):
    """Every conversation's context summarised by a user summariser (stub) into a compaction entry."""
    c = _t(spark, sf_dir, "conversations")
    out = U.summarise(c, U.stub_summariser)
    return out.select("conv_id", F.md5("summary").alias("summary_md5"), "summary_tokens", "tokens_before")


@query("j3_generate_examples", _TARGETS + """
, cats AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, '{c}')" for i, c in enumerate(dims.QUERY_CATEGORIES)) + """) AS c(category_idx, category)),
cells AS (SELECT tg.tier_label, CASE tg.tier_label WHEN 'small' THEN 1 WHEN 'medium' THEN 2 WHEN 'large' THEN 3 ELSE 4 END AS tier,
                 cats.category, CAST(greatest(1, (per_tier - n_seeds) // 15) AS INTEGER) AS quota
          FROM tg CROSS JOIN cats WHERE per_tier - n_seeds > 0 AND cats.category <> 'legal_and_compliance'),
q AS (SELECT tier_label, tier, category, unnest(range(0, quota)) AS position FROM cells)
SELECT tier_label, category, position,
       md5(concat(category, ' question ', CAST(position AS VARCHAR), ' for tier ', CAST(tier AS VARCHAR))) AS query_md5,
       concat('{"model_tier": ', CAST(tier AS VARCHAR), ', "confidence": ',
              CAST(CAST(85 + CAST(('0x' || substr(md5(concat('7|', tier_label, '|', category, '|', CAST(position AS VARCHAR))), 1, 8)) AS BIGINT) % 15 AS DOUBLE) / 100.0 AS VARCHAR),
              '}') AS assistant_content
FROM q""")
def j3_generate_examples(spark, sf_dir):
    """Generation grid (targets from the labelled tier counts) sent to a user
    teacher (stub); responses parsed, cut to quota and turned into examples.
    The failing category is reported instead of stopping the job."""
    grid = G.generation_grid(_targets(spark, sf_dir))
    examples, _failed = U.generate(grid, U.stub_teacher)
    return examples.select("tier_label", "category", F.col("position").cast("bigint").alias("position"),
                           F.md5(F.col("messages")[1]["content"]).alias("query_md5"),
                           F.col("messages")[2]["content"].alias("assistant_content"))


@query("j3_failed_cells", _TARGETS + """
SELECT tier_label, 'legal_and_compliance' AS category FROM tg WHERE per_tier - n_seeds > 0""")
def j3_failed_cells(spark, sf_dir):
    """Grid cells whose teacher call failed, reported with the error."""
    grid = G.generation_grid(_targets(spark, sf_dir))
    _examples, failed = U.generate(grid, U.stub_teacher)
    return failed.select("tier_label", "category")
