"""Catalogue / generation / provider-stream queries: C1, C7, D15, D16, E2, E12, G2, H12, H13, H17, H18, H19."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tierlens import dims
from tierlens.fixtures import register
from tierlens.operators import catalog as G
from tierlens.operators import provider_messages, tool_calls
from tierlens.plans import query


def _t(spark, sf_dir, name):
    register(spark, sf_dir)
    return spark.table(name)


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_CAT_VALUES = ", ".join(
    f"({i}, {_sql_str(k)}, {_sql_str(mid)}, {_sql_str(p)}, {mx})" for i, (k, mid, p, _a, mx, *_r) in enumerate(dims.MODEL_CATALOGUE))
_MODEL_NAMES = ["glm-4.7", "claude-sonnet-4.5", "claude-opus-4.6-copilot", "gpt-5.3-codex", "ministral-3b-latest", "unknown-model"]
_PROVIDERS = ["github-copilot", "openai-codex", "zhipu", "model-router", None]


def _model_requests(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    names = F.element_at(F.array(*[F.lit(n) for n in _MODEL_NAMES]), (F.col("event_id") % len(_MODEL_NAMES) + 1).cast("int"))
    provs = F.element_at(F.array(*[F.lit(p) if p else F.lit(None).cast("string") for p in _PROVIDERS]),
                         (F.col("user_id") % len(_PROVIDERS) + 1).cast("int"))
    return ev.select("event_id", names.alias("model_id"), provs.alias("provider"))


_REQ_SQL = ("CASE event_id % 6 " + " ".join(f"WHEN {i} THEN {_sql_str(n)}" for i, n in enumerate(_MODEL_NAMES)) + " END",
            "CASE user_id % 5 " + " ".join(f"WHEN {i} THEN {_sql_str(p) if p else 'NULL'}" for i, p in enumerate(_PROVIDERS)) + " END")


@query("c1_model_lookup", f"""
, cat AS (SELECT * FROM (VALUES {_CAT_VALUES}) AS c(cat_order, model_key, model_id, provider, max_tokens)),
rq AS (SELECT event_id, {_REQ_SQL[0]} AS model_id, {_REQ_SQL[1]} AS provider FROM events),
c1 AS (SELECT r.event_id, min(c.cat_order) AS o FROM rq r JOIN cat c ON c.model_id = r.model_id AND c.provider = r.provider GROUP BY r.event_id),
c2 AS (SELECT r.event_id, c.model_key, c.max_tokens FROM rq r JOIN cat c ON c.model_key = r.model_id),
c3 AS (SELECT r.event_id, min(c.cat_order) AS o FROM rq r JOIN cat c ON c.model_id = r.model_id GROUP BY r.event_id)
SELECT r.event_id, r.model_id, r.provider,
       CASE WHEN r.provider IS NOT NULL AND c1.o IS NOT NULL THEN (SELECT model_key FROM cat WHERE cat_order = c1.o)
            WHEN c2.model_key IS NOT NULL THEN c2.model_key
            WHEN c3.o IS NOT NULL THEN (SELECT model_key FROM cat WHERE cat_order = c3.o) END AS resolved_key,
       coalesce(c2.max_tokens, 16384) AS max_tokens
FROM rq r LEFT JOIN c1 ON r.event_id = c1.event_id LEFT JOIN c2 ON r.event_id = c2.event_id LEFT JOIN c3 ON r.event_id = c3.event_id""")
def c1_model_lookup(spark, sf_dir):
    """Model lookup for every event's (model, provider) request, with max tokens."""
    r = G.resolve_models(_model_requests(spark, sf_dir))
    return r.select("event_id", "model_id", "provider", "resolved_key", F.col("max_tokens").cast("int").alias("max_tokens"))


_TARGETS = """
, tg AS (SELECT CASE corrected_tier WHEN 1 THEN 'small' WHEN 2 THEN 'medium' WHEN 3 THEN 'large' ELSE 'xlarge' END AS tier_label,
                count(*) AS per_tier, 15 AS n_seeds FROM v_feedback GROUP BY corrected_tier)
"""


def _targets(spark, sf_dir):
    fbk = _t(spark, sf_dir, "v_feedback")
    lab = F.create_map(*[x for t, lab, _ in dims.TIERS for x in (F.lit(t), F.lit(lab))])
    return fbk.groupBy("corrected_tier").agg(F.count(F.lit(1)).alias("per_tier")).select(
        lab[F.col("corrected_tier")].alias("tier_label"), "per_tier", F.lit(dims.SEEDS_PER_TIER).alias("n_seeds"))


@query("c7_generation_grid", _TARGETS + """
, cats AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, {_sql_str(c)})" for i, c in enumerate(dims.QUERY_CATEGORIES)) + """) AS c(category_idx, category))
SELECT tg.tier_label, cats.category, CAST(greatest(1, (per_tier - n_seeds) // 15) AS INTEGER) AS quota
FROM tg CROSS JOIN cats WHERE per_tier - n_seeds > 0""")
def c7_generation_grid(spark, sf_dir):
    """Tier x category generation cells with per-cell quotas (targets = labelled counts per tier)."""
    g = G.generation_grid(_targets(spark, sf_dir))
    return g.select("tier_label", "category", "quota")


def _prompt_sql() -> str:
    """The generation template as a SQL concat over (tier_label, tier_num, tier_description, category, quota)."""
    cols = {"{tier_description}": "td.tier_description", "{category}": "cats.category",
            "{count}": "CAST(greatest(1, (per_tier - n_seeds) // 15) AS VARCHAR)",
            "{tier_num}": "CAST(td.tier_num AS VARCHAR)", "{tier_label}": "tg.tier_label"}
    parts = [cols.get(x, _sql_str(x)) for x in re.split(r"(\{[a-z_]+\})", dims.GENERATION_PROMPT) if x]
    return "concat(" + ", ".join(parts) + ")"


@query("c7_generation_prompts", _TARGETS + """
, cats AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, {_sql_str(c)})" for i, c in enumerate(dims.QUERY_CATEGORIES)) + """) AS c(category_idx, category)),
td AS (SELECT * FROM (VALUES """ + ", ".join(f"({_sql_str(lab)}, {t}, {_sql_str(dims.tier_description(lab))})" for lab, t, _ in dims.RUBRIC) + """) AS d(tier_label, tier_num, tier_description))
SELECT tg.tier_label, cats.category, CAST(greatest(1, (per_tier - n_seeds) // 15) AS INTEGER) AS quota,
       md5(""" + _prompt_sql() + """) AS prompt_md5
FROM tg CROSS JOIN cats JOIN td ON td.tier_label = tg.tier_label WHERE per_tier - n_seeds > 0""")
def c7_generation_prompts(spark, sf_dir):
    """Rendered generation prompt of every grid cell."""
    g = G.generation_grid(_targets(spark, sf_dir))
    return g.select("tier_label", "category", "quota", F.md5("prompt").alias("prompt_md5"))


_GEN = """
, gen AS (SELECT CASE (conv_id % 4) WHEN 0 THEN 'small' WHEN 1 THEN 'medium' WHEN 2 THEN 'large' ELSE 'xlarge' END AS tier_label,
                 conv_id % 15 AS category_idx, conv_id, turn AS position, concat('  ', text, ' ') AS query FROM conversations WHERE role = 'user')
"""


def _generated(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    lab = F.element_at(F.array(*[F.lit(lab) for _, lab, _ in dims.TIERS]), (F.col("conv_id") % 4 + 1).cast("int"))
    return c.select(lab.alias("tier_label"), (F.col("conv_id") % 15).alias("category_idx"), "conv_id",
                    F.col("turn").alias("position"), F.concat(F.lit("  "), F.col("text"), F.lit(" ")).alias("query"))


@query("e12_quota_cut", _GEN + r"""
SELECT conv_id, position, md5(regexp_replace(query, '^\s+|\s+$', '', 'g')) AS query_md5 FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY position, query) AS rn FROM gen) WHERE rn <= 3""")
def e12_quota_cut(spark, sf_dir):
    """First quota (3) generated queries per teacher response, trimmed."""
    out = G.quota_cut(_generated(spark, sf_dir), ["conv_id"], "position", 3)
    return out.select("conv_id", "position", F.md5("query").alias("query_md5"))


@query("g2_seeds_plus_generated", _GEN + r"""
SELECT origin, tier_label, count(*) AS n FROM (
  SELECT 'seed' AS origin, CASE item_id % 4 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' WHEN 2 THEN 'large' ELSE 'xlarge' END AS tier_label FROM benchmark
  UNION ALL SELECT 'generated', tier_label FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY position, query) AS rn FROM gen) WHERE rn <= 3) GROUP BY origin, tier_label""")
def g2_seeds_plus_generated(spark, sf_dir):
    """Seed examples (benchmark items) plus the quota-cut generated queries, counted by origin and tier."""
    b = _t(spark, sf_dir, "benchmark")
    seeds = b.select(F.col("text").alias("query"), F.element_at(F.array(*[F.lit(lab) for _, lab, _ in dims.TIERS]),
                                                                 (F.col("item_id") % 4 + 1).cast("int")).alias("tier_label"))
    gen = G.quota_cut(_generated(spark, sf_dir), ["conv_id"], "position", 3)
    u = G.seeds_plus_generated(seeds, gen)
    return u.groupBy("origin", "tier_label").agg(F.count(F.lit(1)).alias("n"))


# a teacher response per message: its lines as quoted queries, in three shapes
_ITEMS = r"""concat('"', regexp_replace(regexp_replace(text, '["\\\\]', ' ', 'g'), '\n', '", "', 'g'), '"')"""
_SHAPE = """CASE (conv_id + turn) % 3 WHEN 0 THEN concat('Here you go: [', items, '] enjoy')
                                          WHEN 1 THEN concat('Queries: ', items)
                                          ELSE concat('[', items, ', oops') END"""
_RESP = f"""
, agg AS (SELECT conv_id, turn, {_ITEMS} AS items FROM conversations),
resp AS (SELECT conv_id, turn, {_SHAPE} AS response FROM agg)
"""


def _responses(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    items = F.concat(F.lit('"'), F.replace(F.regexp_replace("text", r'["\\]', " "), F.lit("\n"), F.lit('", "')), F.lit('"'))
    return c.select("conv_id", "turn", items.alias("items")).select("conv_id", "turn", F.expr(_SHAPE).alias("response"))


@query("h12_parse_query_list", _RESP + r"""
, parsed AS (SELECT conv_id, turn, CASE WHEN regexp_extract(response, '(?s)\[.*\]', 0) <> '' AND json_valid(regexp_extract(response, '(?s)\[.*\]', 0))
                                         AND json_type(regexp_extract(response, '(?s)\[.*\]', 0)) = 'ARRAY'
                                        THEN CAST(from_json(regexp_extract(response, '(?s)\[.*\]', 0), '["VARCHAR"]') AS VARCHAR[])
                                        ELSE regexp_extract_all(response, '"([^"]+)"', 1) END AS qs FROM resp)
SELECT conv_id, turn, CAST(len(qs) AS INTEGER) AS n_queries, md5(array_to_string(qs, chr(10))) AS queries_md5 FROM parsed""")
def h12_parse_query_list(spark, sf_dir):
    """Query lists parsed from free-form teacher responses (JSON array, else quoted strings), whole texts."""
    r = _responses(spark, sf_dir).withColumn("qs", G.parse_query_list(F.col("response")))
    return r.select("conv_id", "turn", F.size("qs").alias("n_queries"), F.md5(F.array_join("qs", "\n")).alias("queries_md5"))


_RAW_REASONS = ["stop", "length", "tool_calls", "end_turn", "max_tokens", "tool_use", "content_filter"]


@query("h18_stop_reason", """
, r AS (SELECT event_id, CASE user_id % 2 WHEN 0 THEN 'openai-completions' ELSE 'anthropic' END AS layout,
               CASE event_id % 7 """ + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_RAW_REASONS)) + """ END AS raw FROM events),
m AS (SELECT * FROM (VALUES """ + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in dims.STOP_REASONS) + """) AS m(layout, raw, stop_reason))
SELECT r.event_id, coalesce(m.stop_reason, 'stop') AS stop_reason FROM r LEFT JOIN m ON r.layout = m.layout AND r.raw = m.raw""")
def h18_stop_reason(spark, sf_dir):
    """Provider stop reasons normalised (unknown -> stop)."""
    ev = _t(spark, sf_dir, "events")
    layout = F.when(F.col("user_id") % 2 == 0, "openai-completions").otherwise("anthropic")
    raw = F.element_at(F.array(*[F.lit(x) for x in _RAW_REASONS]), (F.col("event_id") % 7 + 1).cast("int"))
    return ev.select("event_id", G.normalise_stop_reason(layout, raw).alias("stop_reason"))


_USAGE = """
, u AS (SELECT user_id AS stream_id, event_id AS seq,
               CASE user_id % 3 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai-completions' ELSE 'openai-responses' END AS layout,
               CASE WHEN event_type = 'signup' THEN 'start' ELSE 'delta' END AS kind,
               CAST(floor(value * 10) AS BIGINT) AS input, CAST(floor(value * 3) AS BIGINT) AS output,
               CASE WHEN event_type = 'view' THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS cache_read FROM events)
"""


def _usage_events(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"),
                     F.element_at(F.array(F.lit("anthropic"), F.lit("openai-completions"), F.lit("openai-responses")),
                                  (F.col("user_id") % 3 + 1).cast("int")).alias("layout"),
                     F.when(F.col("event_type") == "signup", "start").otherwise("delta").alias("kind"),
                     F.floor(F.col("value") * 10).cast("bigint").alias("input"),
                     F.floor(F.col("value") * 3).cast("bigint").alias("output"),
                     F.when(F.col("event_type") == "view", F.lit(0).cast("bigint")).otherwise(F.floor("value").cast("bigint")).alias("cache_read"))


@query("h19_usage_normalise", _USAGE + """
, st AS (SELECT stream_id, max(seq) AS s_seq, arg_max(input, seq) AS s_in, arg_max(cache_read, seq) AS s_cache
         FROM u WHERE layout = 'anthropic' AND kind = 'start' GROUP BY stream_id),
an AS (SELECT u.stream_id, 'anthropic' AS layout, st.s_in + coalesce(st.s_cache, 0) AS input_tokens,
              arg_max(u.output, u.seq) AS output_tokens,
              coalesce(arg_max(u.cache_read, CASE WHEN coalesce(u.cache_read, 0) <> 0 THEN u.seq END), st.s_cache, 0) AS cache_read_tokens
       FROM u JOIN st ON u.stream_id = st.stream_id WHERE u.layout = 'anthropic' AND u.seq >= st.s_seq
       GROUP BY u.stream_id, st.s_in, st.s_cache),
ot AS (SELECT stream_id, layout, coalesce(arg_max(input, seq), 0) AS input_tokens, coalesce(arg_max(output, seq), 0) AS output_tokens,
              coalesce(arg_max(cache_read, seq), 0) AS cache_read_tokens FROM u WHERE layout <> 'anthropic' GROUP BY stream_id, layout)
SELECT * FROM an UNION ALL SELECT * FROM ot""")
def h19_usage_normalise(spark, sf_dir):
    """Final usage per stream from provider usage events (three layouts)."""
    return G.normalise_usage(_usage_events(spark, sf_dir))


_PROVIDER_NAMES = ["zhipu", "github-copilot", "openai-codex", "model-router"]
_API_TYPES = ["openai-completions", "anthropic-copilot", "openai-responses"]


@query("d15_pass_rates", """
, res AS (SELECT CASE user_id % 4 """ + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PROVIDER_NAMES)) + """ END AS provider,
                 CASE user_id % 3 """ + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_API_TYPES)) + """ END AS api_type,
                 event_type <> 'error' AS success, value > 25 AS has_thinking FROM events)
SELECT CASE WHEN grouping(provider) = 0 THEN 'provider' WHEN grouping(api_type) = 0 THEN 'api_type' ELSE 'all' END AS level,
       provider, api_type, count(*) AS total, CAST(sum(CASE WHEN success THEN 1 ELSE 0 END) AS BIGINT) AS passed,
       CAST(sum(CASE WHEN has_thinking THEN 1 ELSE 0 END) AS BIGINT) AS with_thinking,
       CAST(sum(CASE WHEN success THEN 1 ELSE 0 END) * 100 // count(*) AS BIGINT) AS pct
FROM res GROUP BY GROUPING SETS ((), (provider), (api_type))""")
def d15_pass_rates(spark, sf_dir):
    """Model test results (one per event) rolled up overall, by provider, by API type."""
    ev = _t(spark, sf_dir, "events")
    res = ev.select(
        F.element_at(F.array(*[F.lit(p) for p in _PROVIDER_NAMES]), (F.col("user_id") % 4 + 1).cast("int")).alias("provider"),
        F.element_at(F.array(*[F.lit(p) for p in _API_TYPES]), (F.col("user_id") % 3 + 1).cast("int")).alias("api_type"),
        (F.col("event_type") != "error").alias("success"), (F.col("value") > 25).alias("has_thinking"))
    return G.pass_rates(res)


_PARTS = """
, parts AS (SELECT user_id AS stream_id, event_id AS seq,
                   CASE event_type WHEN 'view' THEN 'text' WHEN 'click' THEN 'think' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'metadata' END AS part_type,
                   props AS text, CASE WHEN event_type = 'click' AND value > 10 THEN concat('sig-', CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR)) END AS signature,
                   CASE WHEN value > 40 THEN 'length' ELSE 'stop' END AS stop_reason,
                   concat('err@', CAST(event_id AS VARCHAR)) AS error FROM events)
"""


@query("d16_probe_summary", _PARTS + """
SELECT stream_id, count(*) FILTER (WHERE part_type = 'text') AS text_chunks, count(*) FILTER (WHERE part_type = 'think') AS thinking_chunks,
       CAST(coalesce(sum(length(text)) FILTER (WHERE part_type = 'text'), 0) AS BIGINT) AS text_chars,
       CAST(coalesce(sum(length(text)) FILTER (WHERE part_type = 'think'), 0) AS BIGINT) AS thinking_chars,
       count(DISTINCT signature) FILTER (WHERE part_type = 'think' AND coalesce(signature, '') <> '') AS n_signatures,
       arg_max(stop_reason, CASE WHEN part_type = 'done' THEN seq END) AS stop_reason,
       arg_max(error, CASE WHEN part_type = 'error' THEN seq END) AS error,
       arg_max(error, CASE WHEN part_type = 'error' THEN seq END) IS NULL AND count(*) FILTER (WHERE part_type = 'text') > 0 AS ok
FROM parts GROUP BY stream_id""")
def d16_probe_summary(spark, sf_dir):
    """Stream probe summary per user stream of events."""
    ev = _t(spark, sf_dir, "events")
    kind = (F.when(F.col("event_type") == "view", "text").when(F.col("event_type") == "click", "think")
             .when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").otherwise("metadata"))
    parts = ev.select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), kind.alias("part_type"),
                      F.col("props").alias("text"),
                      F.when((F.col("event_type") == "click") & (F.col("value") > 10),
                             F.concat(F.lit("sig-"), F.floor(F.col("value") / 10).cast("bigint").cast("string"))).alias("signature"),
                      F.when(F.col("value") > 40, "length").otherwise("stop").alias("stop_reason"),
                      F.concat(F.lit("err@"), F.col("event_id").cast("string")).alias("error"))
    return G.probe_summary(parts)


@query("e2_last_telemetry", """
SELECT conv_id, turn, predicted_tier FROM v_routed ORDER BY conv_id DESC, turn DESC LIMIT 11""")
def e2_last_telemetry(spark, sf_dir):
    """The newest 11 telemetry rows (turn records ordered by conversation and turn)."""
    t = _t(spark, sf_dir, "v_routed").select("conv_id", "turn", "predicted_tier")
    return G.newest_rows(t, ["conv_id", "turn"])


# ---- H13: tool calls in assistant text
_TOOL_TEXTS = [
    '<tool_call name="bash">{"command": "ls -la", "timeout": 5}</tool_call>',
    '<tool_call name="write">{"write": {"path": "/tmp/a.txt", "content": "hi"}}</tool_call>',
    '<tool_call name="bash">echo hello</tool_call>',
    '<tool_call name="read">```json\n{"path": "/etc/hosts"}\n```</tool_call>',
    '<tool_call name="write">garbage</tool_call>',
    '<tool_call name="read">{"a": {"b": {"c": {"d": {"e": {"path": "/deep"}}}}}}</tool_call>',
    '<tool_call name="bash">{"cmd": "pwd"}</tool_call>',
    '<tool_call name="read">Sure: {"path": "/x", "offset": 3} ok</tool_call>',
    '<tool_call name="write">{"path": "/y", "content": "broken "quotes" here"}</tool_call>',
    '<tool_call name="write">/tmp/only.txt</tool_call>',
    '<tool_call name="bash">{}</tool_call>',
    '<tool_call name="find">[1, 2]</tool_call>',
    '<tool_call name="find">no json</tool_call>',
]
_TOOL_CASES = " ".join(f"WHEN {i} THEN {_sql_str(x)}" for i, x in enumerate(_TOOL_TEXTS))


@query("h13_tool_call_extraction", rf"""
WITH RECURSIVE msgs AS (SELECT conv_id, turn, concat(text, chr(10), CASE (conv_id + turn) % {len(_TOOL_TEXTS)} {_TOOL_CASES} END, chr(10), 'Done.') AS t
                        FROM conversations WHERE role = 'assistant'),
c AS (SELECT conv_id, turn, regexp_extract(t, '(?s)<tool_call name="([^"]+)">(.*?)</tool_call>', 1) AS name,
             regexp_extract(t, '(?s)<tool_call name="([^"]+)">(.*?)</tool_call>', 2) AS raw FROM msgs),
b0 AS (SELECT *, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS body0 FROM c),
b AS (SELECT conv_id, turn, name, raw, CASE WHEN starts_with(body0, '```')
        THEN regexp_replace(regexp_replace(regexp_replace(body0, '^```(?:json)?\s*', ''), '\s*```$', ''), '^\s+|\s+$', '', 'g') ELSE body0 END AS body FROM b0),
w(conv_id, turn, name, raw, body, doc, step) AS (
  SELECT conv_id, turn, name, raw, body, CAST(CASE WHEN body = '' THEN '{{}}' WHEN json_valid(body) THEN body
      WHEN json_valid(regexp_extract(body, '(?s)\{{.*\}}', 0)) THEN regexp_extract(body, '(?s)\{{.*\}}', 0) END AS VARCHAR), 0 FROM b
  UNION ALL
  SELECT conv_id, turn, name, raw, body, CAST(json_extract(doc, '$."' || json_keys(doc)[1] || '"') AS VARCHAR), step + 1 FROM w
  WHERE json_type(doc) = 'OBJECT' AND len(json_keys(doc)) = 1 AND json_type(json_extract(doc, '$."' || json_keys(doc)[1] || '"')) = 'OBJECT'
    AND ((step = 0 AND json_keys(doc)[1] = name) OR json_keys(doc)[1] NOT IN ('path', 'content', 'command'))),
f AS (SELECT conv_id, turn, name, raw, body, arg_max(doc, step) AS doc FROM w GROUP BY conv_id, turn, name, raw, body),
o AS (SELECT *, CASE WHEN json_type(doc) = 'OBJECT' THEN json_keys(doc) END AS keys,
        nullif(regexp_extract(raw, '"path":\s*"([^"]+)"', 1), '') AS qp,
        CASE WHEN regexp_matches(raw, '(?s)"content":\s*"(.*)"\s*\}}') THEN regexp_replace(regexp_extract(raw, '(?s)"content":\s*"(.*)"\s*\}}', 1), '^\s+|\s+$', '', 'g') END AS qc,
        nullif(regexp_extract(body, 'path["\s:]+([^"\n]+)', 1), '') AS lp,
        CASE WHEN regexp_matches(body, '(?s)content["\s:]+(.*)') THEN regexp_extract(body, '(?s)content["\s:]+(.*)', 1) END AS lc FROM f),
r AS (SELECT conv_id, turn, name,
  CASE WHEN name = 'write' AND doc IS NOT NULL THEN coalesce(doc ->> '$.path', qp)
       WHEN name = 'write' AND lp IS NOT NULL AND lc IS NOT NULL THEN trim(lp, ' "' || chr(39))
       WHEN name = 'write' AND body <> '' AND NOT contains(body, chr(10)) AND contains(body, '/') THEN body
       WHEN name <> 'write' AND keys IS NOT NULL THEN doc ->> '$.path' END AS path,
  CASE WHEN name = 'write' AND doc IS NOT NULL THEN coalesce(doc ->> '$.content', qc)
       WHEN name = 'write' AND lp IS NOT NULL AND lc IS NOT NULL THEN trim(lc, ' "}}' || chr(39) || chr(10))
       WHEN name = 'write' AND body <> '' AND NOT contains(body, chr(10)) AND contains(body, '/') THEN ''
       WHEN name <> 'write' AND keys IS NOT NULL THEN doc ->> '$.content' END AS content,
  CASE WHEN name = 'bash' AND doc IS NULL AND body <> '' THEN body
       WHEN name = 'bash' AND len(keys) = 0 THEN regexp_replace(raw, '^\s+|\s+$', '', 'g')
       WHEN name = 'bash' AND len(keys) = 1 AND NOT list_contains(keys, 'command') THEN json_extract_string(doc, '$."' || keys[1] || '"')
       WHEN keys IS NOT NULL THEN doc ->> '$.command' END AS command,
  CASE WHEN name = 'bash' AND doc IS NULL AND body <> '' THEN 1 WHEN name = 'bash' AND keys IS NOT NULL THEN greatest(len(keys), 1)
       WHEN name = 'write' AND doc IS NOT NULL THEN nullif(coalesce(len(keys), 0) + CASE WHEN qp IS NOT NULL AND NOT coalesce(list_contains(keys, 'path'), false) THEN 1 ELSE 0 END
            + CASE WHEN qc IS NOT NULL AND NOT coalesce(list_contains(keys, 'content'), false) THEN 1 ELSE 0 END, 0)
       WHEN name = 'write' AND ((lp IS NOT NULL AND lc IS NOT NULL) OR (body <> '' AND NOT contains(body, chr(10)) AND contains(body, '/'))) THEN 2
       WHEN name = 'write' THEN NULL ELSE len(keys) END AS n_args FROM o)
SELECT conv_id, turn, 0 AS call_index, name, path, content, command, CAST(n_args AS INTEGER) AS n_args,
       CASE WHEN n_args IS NULL THEN 'quarantined' ELSE 'ok' END AS status FROM r""", views=False)
def h13_tool_call_extraction(spark, sf_dir):
    """Tool calls extracted from assistant messages (each message carries one
    tagged call of thirteen shapes after its own text)."""
    c = _t(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    tag = F.element_at(F.array(*[F.lit(x) for x in _TOOL_TEXTS]), ((F.col("conv_id") + F.col("turn")) % len(_TOOL_TEXTS) + 1).cast("int"))
    msgs = c.select("conv_id", "turn", F.concat(F.col("text"), F.lit("\n"), tag, F.lit("\nDone.")).alias("text"))
    _texts, calls, bad = tool_calls.extract_tool_calls(msgs, ["conv_id", "turn"])
    values = [F.try_variant_get(F.col("arguments")[k], "$", "string").alias(k) for k in tool_calls.OWN_KEYS]
    good = calls.select("conv_id", "turn", "call_index", "name", *values, F.size("arguments").alias("n_args"), F.lit("ok").alias("status"))
    none = [F.lit(None).cast("string").alias(k) for k in tool_calls.OWN_KEYS]
    return good.unionByName(bad.select("conv_id", "turn", "call_index", "name", *none, F.lit(None).cast("int").alias("n_args"),
                                       F.lit("quarantined").alias("status")))


# ---- H17: provider layouts of conversations with thinking, tool calls, results and images
_PART_SQL = """
, msg AS (SELECT conv_id, turn AS seq, text, CASE WHEN role = 'user' AND (conv_id + turn) % 4 IN (1, 2) THEN 'tool_result' ELSE role END AS role,
                 conv_id + turn AS k FROM conversations),
call AS (SELECT conv_id, seq, concat('c', CAST(k AS VARCHAR), CASE WHEN k % 3 = 0 THEN '|i7' ELSE '' END) AS call_id FROM msg),
p AS (
  SELECT conv_id, seq, 0 AS idx, 'thinking' AS kind, concat('first ', CAST(k AS VARCHAR)) AS text,
         CASE k % 3 WHEN 0 THEN '{"id": "r1"}' WHEN 1 THEN 'notes' ELSE '' END AS signature FROM msg WHERE role = 'assistant' AND k % 2 = 0
  UNION ALL SELECT conv_id, seq, 1, 'text', text, NULL FROM msg WHERE role <> 'tool_result' OR k % 3 <> 0
  UNION ALL SELECT conv_id, seq, 2, 'thinking', concat('then ', CAST(k AS VARCHAR)), CASE WHEN k % 4 = 0 THEN 'notes' END FROM msg WHERE role = 'assistant' AND k % 2 = 0
  UNION ALL SELECT conv_id, seq, 3, 'tool_call', NULL, NULL FROM msg WHERE role = 'assistant' AND k % 3 <> 1
  UNION ALL SELECT conv_id, seq, 4, 'image', concat('data:image/png;base64,', CAST(k AS VARCHAR)), NULL FROM msg WHERE (role = 'user' AND k % 5 = 0) OR (role = 'tool_result' AND k % 2 = 1)),
j AS (SELECT m.conv_id, m.seq, m.role, m.k, c.call_id, p.idx, p.kind, p.text, p.signature FROM msg m JOIN call c USING (conv_id, seq) LEFT JOIN p USING (conv_id, seq))
"""


def _messages(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    k = F.col("k")
    m = c.select("conv_id", F.col("turn").alias("seq"), "text", "role", (F.col("conv_id") + F.col("turn")).alias("k"))
    m = m.withColumn("role", F.when((F.col("role") == "user") & (k % 4).isin(1, 2), "tool_result").otherwise(F.col("role")))
    call = F.concat(F.lit("c"), k.cast("string"), F.when(k % 3 == 0, "|i7").otherwise(""))
    names = ("kind", "text", "signature", "call_id", "name", "arguments", "mime", "data")

    def part(**values):
        return F.struct(*[(values[n] if n in values else F.lit(None)).cast("string").alias(n) for n in names])

    asst, tool = F.col("role") == "assistant", F.col("role") == "tool_result"
    sig = F.when(k % 3 == 0, '{"id": "r1"}').when(k % 3 == 1, "notes").otherwise("")
    parts = F.array(
        F.when(asst & (k % 2 == 0), part(kind=F.lit("thinking"), text=F.concat(F.lit("first "), k.cast("string")), signature=sig)),
        F.when(~tool | (k % 3 != 0), part(kind=F.lit("text"), text=F.col("text"))),
        F.when(asst & (k % 2 == 0), part(kind=F.lit("thinking"), text=F.concat(F.lit("then "), k.cast("string")), signature=F.when(k % 4 == 0, "notes"))),
        F.when(asst & (k % 3 != 1), part(kind=F.lit("tool_call"), call_id=call, name=F.lit("read"), arguments=F.lit('{"path": "x"}'))),
        F.when(((F.col("role") == "user") & (k % 5 == 0)) | (tool & (k % 2 == 1)), part(kind=F.lit("image"), mime=F.lit("image/png"), data=k.cast("string"))))
    return m.select("conv_id", "seq", "role", F.filter(parts, lambda x: x.isNotNull()).alias("parts"),
                    F.when(tool, call).alias("call_id"), F.lit(False).alias("is_error"))


def _layout(spark, sf_dir, layout):
    out = provider_messages.to_provider_messages(_messages(spark, sf_dir), layout)
    shown = F.array_join(F.transform("blocks", lambda b: F.concat_ws("~", *[F.coalesce(b[c], F.lit("")) for c in (
        "type", "text", "field", "call_id", "name", "arguments")])), "\n")
    return out.select("conv_id", "seq", "sub", "out_role", "item_type", "call_id", "cache_mark",
                      F.size("blocks").cast("bigint").alias("n_blocks"), F.md5(shown).alias("blocks_md5"))


_SHOWN = """SELECT conv_id, seq, sub, out_role, item_type, call_id, cache_mark, count(type) AS n_blocks,
  md5(coalesce(string_agg(CASE WHEN type IS NOT NULL THEN concat(type, '~', coalesce(text, ''), '~', coalesce(field, ''), '~', coalesce(bcall, ''), '~', coalesce(name, ''), '~', coalesce(args, '')) END, chr(10) ORDER BY ord), '')) AS blocks_md5
FROM bl GROUP BY conv_id, seq, sub, out_role, item_type, call_id, cache_mark"""


def _held_sql(text_type: str, image_type: str) -> str:
    """Rows of the messages that carry the images of a run of tool results."""
    return f"""runs AS (SELECT conv_id, seq, role, k, sum(CASE WHEN role <> 'tool_result' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY seq) AS run FROM msg),
ends AS (SELECT conv_id, run, max(seq) AS last_seq FROM runs WHERE role = 'tool_result' GROUP BY conv_id, run HAVING bool_or(k % 2 = 1)),
held AS (SELECT conv_id, last_seq AS seq, 1 AS sub, 'user' AS out_role, 'message' AS item_type, NULL AS call_id, false AS cache_mark, -1 AS ord, '{text_type}' AS type,
                'Attached image(s) from tool result:' AS text, NULL AS field, NULL AS bcall, NULL AS name, NULL AS args FROM ends
         UNION ALL SELECT e.conv_id, e.last_seq, 1, 'user', 'message', NULL, false, r.seq, '{image_type}', concat('data:image/png;base64,', CAST(r.k AS VARCHAR)), NULL, NULL, NULL, NULL
         FROM ends e JOIN runs r ON r.conv_id = e.conv_id AND r.run = e.run AND r.role = 'tool_result' AND r.k % 2 = 1)"""


@query("h17_completions_layout", _PART_SQL + ", " + _held_sql("text", "image_url") + f"""
, fld AS (SELECT conv_id, seq, coalesce(nullif(signature, ''), 'reasoning_content') AS field, min(idx) AS i, string_agg(text, chr(10) ORDER BY idx) AS text
          FROM p WHERE kind = 'thinking' GROUP BY conv_id, seq, coalesce(nullif(signature, ''), 'reasoning_content')),
bl AS (
  SELECT conv_id, seq, 0 AS sub, role AS out_role, 'message' AS item_type, NULL AS call_id, false AS cache_mark, idx AS ord,
         CASE kind WHEN 'text' THEN 'text' WHEN 'image' THEN 'image_url' END AS type, text, NULL AS field, NULL AS bcall, NULL AS name, NULL AS args FROM j WHERE role IN ('system', 'user')
  UNION ALL SELECT conv_id, seq, 0, role, 'message', NULL, false, 0, 'text', text, NULL, NULL, NULL, NULL FROM j WHERE role = 'assistant' AND kind = 'text' AND trim(text) <> ''
  UNION ALL SELECT conv_id, seq, 0, 'assistant', 'message', NULL, false, 1 + i, 'thinking', text, field, NULL, NULL, NULL FROM fld
  UNION ALL SELECT conv_id, seq, 0, role, 'message', NULL, false, 9, 'function', NULL, NULL, call_id, 'read', '{{"path": "x"}}' FROM j WHERE role = 'assistant' AND kind = 'tool_call'
  UNION ALL SELECT conv_id, seq, 0, 'tool', 'tool', any_value(call_id), false, 0, 'tool',
         coalesce(max(text) FILTER (WHERE kind = 'text'), CASE WHEN count(*) FILTER (WHERE kind = 'image') > 0 THEN '(see attached image)' ELSE '(no output)' END), NULL, NULL, NULL, NULL
         FROM j WHERE role = 'tool_result' GROUP BY conv_id, seq
  UNION ALL SELECT * FROM held)
{_SHOWN}""")
def h17_completions_layout(spark, sf_dir):
    """Chat-completions messages: thinking per field, functions, tool rows, held images."""
    return _layout(spark, sf_dir, "openai-completions")


@query("h17_anthropic_layout", _PART_SQL + f"""
, lst AS (SELECT conv_id, max(seq) AS last FROM msg WHERE role <> 'system' GROUP BY conv_id),
bl AS (
  SELECT j.conv_id, j.seq, 0 AS sub, CASE WHEN role = 'tool_result' THEN 'user' ELSE role END AS out_role,
         CASE role WHEN 'system' THEN 'system' WHEN 'tool_result' THEN 'tool_result' ELSE 'message' END AS item_type,
         CASE WHEN role = 'tool_result' THEN call_id END AS call_id, coalesce(j.seq = last AND role IN ('user', 'tool_result'), false) AS cache_mark, idx AS ord,
         CASE kind WHEN 'tool_call' THEN 'tool_use' ELSE kind END AS type, text, CASE WHEN kind = 'thinking' THEN nullif(signature, '') END AS field,
         CASE WHEN kind = 'tool_call' THEN call_id END AS bcall, CASE WHEN kind = 'tool_call' THEN 'read' END AS name, CASE WHEN kind = 'tool_call' THEN '{{"path": "x"}}' END AS args
  FROM j LEFT JOIN lst ON j.conv_id = lst.conv_id WHERE NOT (role = 'assistant' AND kind = 'image')
  UNION ALL SELECT m.conv_id, m.seq, 0, 'user', 'tool_result', c.call_id, m.seq = last, -1, 'tool_result', NULL, NULL, c.call_id, NULL, NULL
  FROM msg m JOIN call c USING (conv_id, seq) JOIN lst ON m.conv_id = lst.conv_id WHERE role = 'tool_result')
{_SHOWN}""")
def h17_anthropic_layout(spark, sf_dir):
    """Anthropic messages: thinking blocks with signature, tool use, results as user blocks, cache mark."""
    return _layout(spark, sf_dir, "anthropic")


@query("h17_responses_layout", _PART_SQL + ", " + _held_sql("input_text", "input_image") + f"""
, bl AS (
  SELECT conv_id, seq, 0 AS sub, CASE role WHEN 'system' THEN 'developer' ELSE role END AS out_role, 'message' AS item_type, NULL AS call_id, false AS cache_mark, idx AS ord,
         CASE kind WHEN 'text' THEN 'input_text' WHEN 'image' THEN 'input_image' END AS type, text, NULL AS field, NULL AS bcall, NULL AS name, NULL AS args FROM j WHERE role IN ('system', 'user')
  UNION ALL SELECT conv_id, seq, row_number() OVER (PARTITION BY conv_id, seq ORDER BY idx) - 1 AS sub, role,
         CASE kind WHEN 'thinking' THEN 'reasoning' WHEN 'text' THEN 'message' ELSE 'function_call' END,
         CASE WHEN kind = 'tool_call' THEN split_part(call_id, '|', 1) END, false, 0,
         CASE kind WHEN 'thinking' THEN 'reasoning' WHEN 'text' THEN 'output_text' ELSE 'function_call' END,
         CASE kind WHEN 'thinking' THEN signature ELSE text END, CASE WHEN kind = 'tool_call' AND contains(call_id, '|') THEN split_part(call_id, '|', 2) END,
         CASE WHEN kind = 'tool_call' THEN split_part(call_id, '|', 1) END, CASE WHEN kind = 'tool_call' THEN 'read' END, CASE WHEN kind = 'tool_call' THEN '{{"path": "x"}}' END
  FROM j WHERE role = 'assistant' QUALIFY (kind = 'thinking' AND signature = '{{"id": "r1"}}') OR kind IN ('text', 'tool_call')
  UNION ALL SELECT conv_id, seq, 0, NULL, 'function_call_output', any_value(split_part(call_id, '|', 1)), false, 0, 'output',
         coalesce(max(text) FILTER (WHERE kind = 'text'), '(see attached)'), NULL, NULL, NULL, NULL FROM j WHERE role = 'tool_result' GROUP BY conv_id, seq
  UNION ALL SELECT * FROM held)
{_SHOWN}""")
def h17_responses_layout(spark, sf_dir):
    """Responses items: reasoning, messages, function calls and outputs, held images."""
    return _layout(spark, sf_dir, "openai-responses")
