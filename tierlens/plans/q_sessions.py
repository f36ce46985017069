"""Session queries over the tagged entry view: C4, C5, C9, C12, D11-D14, E5-E9, E15, F2."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tierlens import dims
from tierlens.fixtures import register
from tierlens.functions.text import md5_len
from tierlens.operators import sessions as S
from tierlens.operators import tools
from tierlens.plans import query


def _entries(spark, sf_dir):
    register(spark, sf_dir)
    return spark.table("v_entry")


def _log(spark, sf_dir):
    """Entries with their content: list parts, tool calls, cache counters, stop reasons, thinking levels."""
    register(spark, sf_dir)
    e = spark.table("v_log")
    part = "struct<kind:string,text:string,signature:string,call_id:string,name:string,arguments:string,mime:string,data:string>"
    none = F.lit(None).cast("string")

    def made(kind, text, call=none, name=none, arguments=none, mime=none, data=none):
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"), none.alias("signature"), call.alias("call_id"), name.alias("name"),
                        arguments.alias("arguments"), mime.alias("mime"), data.alias("data"))

    seq = F.col("seq").cast("string")
    image = made("image", none, mime=F.lit("image/png"), data=F.concat(F.lit("img"), seq))
    calls = F.transform(F.filter(F.sequence(F.lit(1), F.greatest("n_calls", F.lit(1))), lambda i: i <= F.col("n_calls")), lambda i: made(
        "tool_call", none, F.concat(F.lit("c"), seq, F.lit("-"), i.cast("string")), F.lit("read"), F.concat(F.lit('{"path":"/'), seq, F.lit('"}'))))
    lead = F.when(F.col("first_kind") == "image", F.array(image)).otherwise(F.array().cast(f"array<{part}>"))
    parts = F.when(F.col("type") == "message", F.concat(lead, F.array(made("text", F.col("text"))), calls))
    e = e.withColumn("parts", parts.cast(f"array<{part}>"))
    return e.withColumn("tool_calls", F.filter("parts", lambda p: p["kind"] == "tool_call")).drop("first_kind", "n_calls")


_LC = """
, lc AS (SELECT session_id, max(seq) AS c_seq, arg_max(value, seq) AS summary FROM v_entry WHERE type = 'compaction' GROUP BY session_id),
view AS (
  SELECT session_id, 0 AS part, c_seq AS seq, 'user' AS role, 'What did we do so far?' AS text, CAST(NULL AS VARCHAR) AS stop_reason FROM lc
  UNION ALL SELECT session_id, 1, c_seq, 'assistant', summary, 'stop' FROM lc
  UNION ALL SELECT e.session_id, 2, e.seq, e.role, e.text, NULL FROM v_entry e LEFT JOIN lc ON e.session_id = lc.session_id
    WHERE e.type = 'message' AND (lc.c_seq IS NULL OR e.seq > lc.c_seq))
"""


@query("e7_compacted_view", _LC + """
SELECT session_id, part, seq, role, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS text_len FROM view""")
def e7_compacted_view(spark, sf_dir):
    """Model context per session: all messages, or question + newest summary +
    messages after the newest compaction entry."""
    v = S.compacted_view(_entries(spark, sf_dir))
    return v.select("session_id", "part", "seq", "role", *md5_len(F.col("text"), "text"))


@query("e8_last_assistant_text", _LC.replace("e.text, NULL FROM v_entry e", "e.text, e.stop_reason FROM v_log e").replace("FROM v_entry", "FROM v_log") + r"""
, ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY part DESC, seq DESC) AS rn
             FROM view WHERE role = 'assistant' AND NOT (stop_reason IS NOT DISTINCT FROM 'interrupted' AND coalesce(text, '') = ''))
SELECT session_id, md5(nullif(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '')) AS last_md5
FROM ranked WHERE rn = 1""")
def e8_last_assistant_text(spark, sf_dir):
    """Newest assistant text of the compacted view, trimmed; empty -> NULL."""
    out = S.last_assistant_text(S.compacted_view(_log(spark, sf_dir)))
    return out.select("session_id", F.md5("last_assistant_text").alias("last_md5"))


@query("e5_settings_in_effect", """
SELECT session_id, seq, type,
  coalesce(last_value(CASE WHEN type = 'model_change' THEN value END IGNORE NULLS) OVER w, 'model-1') AS model,
  last_value(CASE WHEN type = 'session_info' AND coalesce(value, '') <> '' THEN value END IGNORE NULLS) OVER w AS session_name,
  last_value(CASE WHEN type = 'thinking_level_change' THEN thinking_level END IGNORE NULLS) OVER w AS thinking_level
FROM v_log WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def e5_settings_in_effect(spark, sf_dir):
    """Model (initial model-1), session name and thinking level in effect at every entry."""
    d = S.settings_in_effect(_log(spark, sf_dir), initial_model="model-1")
    return d.select("session_id", "seq", "type", "model", "session_name", "thinking_level")


@query("e5_settings_at_end", """
SELECT session_id,
  coalesce(arg_max(CASE WHEN type = 'model_change' THEN value END, CASE WHEN type = 'model_change' AND value IS NOT NULL THEN seq END), 'model-1') AS model,
  arg_max(value, CASE WHEN type = 'session_info' AND coalesce(value, '') <> '' THEN seq END) AS session_name,
  arg_max(thinking_level, CASE WHEN type = 'thinking_level_change' THEN seq END) AS thinking_level
FROM v_log GROUP BY session_id""")
def e5_settings_at_end(spark, sf_dir):
    """Model, session name and thinking level in effect at the end of each session."""
    return S.settings_at_end(_log(spark, sf_dir), initial_model="model-1")


@query("e6_drop_noop_changes", """
, b AS (SELECT *, coalesce(last_value(CASE WHEN type = 'model_change' THEN value END IGNORE NULLS) OVER
          (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'model-1') AS before FROM v_entry)
SELECT session_id, seq, type, value FROM b WHERE NOT (type = 'model_change' AND before IS NOT DISTINCT FROM value)""")
def e6_drop_noop_changes(spark, sf_dir):
    """Setting changes equal to the setting already in effect are dropped."""
    d = S.drop_noop_changes(_entries(spark, sf_dir), initial_model="model-1")
    return d.select("session_id", "seq", "type", "value")


@query("e9_overflow", """
SELECT session_id, seq, CAST(coalesce(input_tokens, 0) + coalesce(output_tokens, 0) + coalesce(cache_read, 0) + coalesce(cache_write, 0) AS BIGINT) AS tokens_before,
       coalesce(input_tokens, 0) + coalesce(output_tokens, 0) + coalesce(cache_read, 0) + coalesce(cache_write, 0) >= 600 AS overflow
FROM v_log WHERE stop_reason IS DISTINCT FROM 'error' AND type = 'message' AND role = 'assistant' AND (input_tokens IS NOT NULL OR output_tokens IS NOT NULL)""")
def e9_overflow(spark, sf_dir):
    """Overflow per assistant turn with window 700, max output 100, buffer 100."""
    d = S.overflow_turns(_log(spark, sf_dir), context_window=700, max_output=100, buffer=100)
    return d.select("session_id", "seq", "tokens_before", "overflow")


_FILES = """
, files AS (SELECT session_id, concat('/work/p', CAST(session_id % 7 AS VARCHAR)) AS cwd,
                   1704067200 + session_id * 3600 AS created_s, 1704067200 + session_id * 3600 + max(seq) * 60 AS modified_s
            FROM v_entry GROUP BY session_id)
"""


def _files(spark, sf_dir):
    e = _entries(spark, sf_dir)
    return e.groupBy("session_id").agg(F.max("seq").alias("_m")).select(
        "session_id", F.concat(F.lit("/work/p"), (F.col("session_id") % 7).cast("string")).alias("cwd"),
        (F.lit(1704067200) + F.col("session_id") * 3600).alias("created_s"),
        (F.lit(1704067200) + F.col("session_id") * 3600 + F.col("_m") * 60).alias("modified_s"))


@query("d11_session_listing", _FILES + """
, firsts AS (SELECT session_id, arg_min(text, seq) AS first_text FROM v_log
             WHERE type = 'message' AND role = 'user' AND first_kind = 'text' AND coalesce(text, '') <> '' GROUP BY session_id),
counts AS (SELECT session_id, count(*) FILTER (WHERE type = 'message') AS message_count FROM v_log GROUP BY session_id)
SELECT f.session_id, f.cwd, f.created_s, f.modified_s, CAST(coalesce(c.message_count, 0) AS BIGINT) AS message_count,
       coalesce(substring(x.first_text, 1, 100), '(no messages)') AS first_message
FROM files f LEFT JOIN counts c ON f.session_id = c.session_id LEFT JOIN firsts x ON f.session_id = x.session_id""")
def d11_session_listing(spark, sf_dir):
    """Session list: cwd, times, message count, first user text; newest first."""
    return S.listing(_log(spark, sf_dir), _files(spark, sf_dir))


@query("d12_session_counts", """
SELECT session_id,
  CAST(count(*) FILTER (WHERE type = 'message' AND role = 'user') AS BIGINT) AS n_user,
  CAST(count(*) FILTER (WHERE type = 'message' AND role = 'assistant') AS BIGINT) AS n_assistant,
  CAST(coalesce(sum(n_calls) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS n_tool_calls,
  CAST(count(*) FILTER (WHERE type = 'message' AND role = 'tool_result') AS BIGINT) AS n_tool_results,
  CAST(coalesce(sum(input_tokens) FILTER (WHERE type = 'message' AND role = 'assistant'), 0) AS BIGINT) AS input_tokens,
  CAST(coalesce(sum(output_tokens) FILTER (WHERE type = 'message' AND role = 'assistant'), 0) AS BIGINT) AS output_tokens,
  CAST(count(*) FILTER (WHERE type = 'message' AND role IN ('user', 'assistant')) AS BIGINT) AS n_messages,
  CAST(coalesce(sum(input_tokens) FILTER (WHERE type = 'message' AND role = 'assistant'), 0)
     + coalesce(sum(output_tokens) FILTER (WHERE type = 'message' AND role = 'assistant'), 0) AS BIGINT) AS total_tokens,
  CAST(coalesce(sum(cache_read), 0) AS BIGINT) AS cached_tokens
FROM v_log GROUP BY session_id""")
def d12_session_counts(spark, sf_dir):
    """Per-session message, tool-call, tool-result and token counts."""
    return S.counts(_log(spark, sf_dir))


@query("d13_token_totals", """
SELECT session_id, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens,
       CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS output_tokens, CAST(sum(coalesce(cache_read, 0)) AS BIGINT) AS cached_tokens,
       CAST(arg_max(coalesce(input_tokens, 0) + coalesce(output_tokens, 0), seq) AS BIGINT) AS context_tokens
FROM v_log WHERE type = 'message' AND role = 'assistant' AND (input_tokens IS NOT NULL OR output_tokens IS NOT NULL)
GROUP BY session_id""")
def d13_token_totals(spark, sf_dir):
    """Token totals and current context size (newest usage's input + output)."""
    return S.token_totals(_log(spark, sf_dir))


@query("d14_run_usage", """
, r AS (SELECT *, sum(CASE WHEN type = 'message' AND role = 'user' AND coalesce(text, '') <> (SELECT min(text) FROM v_log WHERE role = 'user' AND text <> '') THEN 1 ELSE 0 END)
                 OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_no FROM v_log)
SELECT session_id, CAST(run_no AS BIGINT) AS run_no,
  CAST(sum(CASE WHEN type = 'message' AND role = 'assistant' THEN coalesce(input_tokens, 0) ELSE 0 END) AS BIGINT) AS input_tokens,
  CAST(sum(CASE WHEN type = 'message' AND role = 'assistant' THEN coalesce(output_tokens, 0) ELSE 0 END) AS BIGINT) AS output_tokens,
  CAST(coalesce(sum(cache_read), 0) AS BIGINT) AS cache_read, CAST(coalesce(sum(cache_write), 0) AS BIGINT) AS cache_write,
  CAST(count(*) FILTER (WHERE type = 'message' AND role = 'assistant') AS BIGINT) AS turns,
  arg_max(stop_reason, seq) FILTER (WHERE role = 'assistant') AS stop_reason
FROM r WHERE run_no > 0 GROUP BY session_id, run_no""")
def d14_run_usage(spark, sf_dir):
    """Usage per agent run (a user message up to the next one); the smallest user
    text stands for the message that continues a run after a compaction."""
    log = _log(spark, sf_dir)
    told = log.filter("role = 'user' and text != ''").agg(F.min("text")).scalar()
    return S.run_usage(log, continue_text=told)


_CHAIN = """
, ids AS (SELECT session_id, seq,
     CASE WHEN seq % 37 = 5 THEN concat('e', CAST(session_id AS VARCHAR), '-', CAST(seq - 1 AS VARCHAR))
          ELSE concat('e', CAST(session_id AS VARCHAR), '-', CAST(seq AS VARCHAR)) END AS id FROM v_entry),
chain AS (SELECT session_id, seq, id,
     CASE WHEN (session_id + seq) % 11 = 0 THEN 'e-missing'
          ELSE lag(id) OVER (PARTITION BY session_id ORDER BY seq) END AS parent_id FROM ids)
"""


def _chain(spark, sf_dir):
    e = _entries(spark, sf_dir)
    sid, seq = F.col("session_id").cast("string"), F.col("seq")
    ids = e.select("session_id", "seq", F.when(seq % 37 == 5, F.concat(F.lit("e"), sid, F.lit("-"), (seq - 1).cast("string")))
                   .otherwise(F.concat(F.lit("e"), sid, F.lit("-"), seq.cast("string"))).alias("id"))
    w = Window.partitionBy("session_id").orderBy("seq")
    return ids.withColumn("parent_id", F.when((F.col("session_id") + seq) % 11 == 0, F.lit("e-missing"))
                          .otherwise(F.lag("id").over(w)))


@query("c12_session_chain", _CHAIN + """
, n AS (SELECT session_id, id, count(*) AS cnt FROM chain GROUP BY session_id, id),
x AS (SELECT c.*, lag(c.id) OVER (PARTITION BY c.session_id ORDER BY c.seq) AS expected FROM chain c)
SELECT x.session_id, x.seq, x.id, x.parent_id,
       x.parent_id IS DISTINCT FROM x.expected AS broken_link,
       x.parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chain p WHERE p.session_id = x.session_id AND p.id = x.parent_id) AS missing_parent,
       n.cnt > 1 AS duplicate_id
FROM x JOIN n ON x.session_id = n.session_id AND x.id = n.id""")
def c12_session_chain(spark, sf_dir):
    """Entry chain check: broken parent links, missing parents, duplicate ids."""
    return S.chain_check(_chain(spark, sf_dir))


@query("e15_rewrite_last_user", """
, nu AS (SELECT session_id, max(seq) AS useq FROM v_entry WHERE type = 'message' AND role = 'user' GROUP BY session_id)
SELECT e.session_id, e.seq,
  md5(CASE WHEN e.seq = nu.useq THEN concat('original prompt #', CAST(e.session_id AS VARCHAR)) ELSE e.text END) AS text_md5,
  coalesce(e.seq = nu.useq, false) AS rewritten
FROM v_entry e LEFT JOIN nu ON e.session_id = nu.session_id""")
def e15_rewrite_last_user(spark, sf_dir):
    """After a model switch, the newest user entry is restored to the original prompt."""
    e = _entries(spark, sf_dir)
    prompts = e.select("session_id").distinct().select(
        "session_id", F.concat(F.lit("original prompt #"), F.col("session_id").cast("string")).alias("prompt"))
    out = S.rewrite_last_user(e, prompts)
    return out.select("session_id", "seq", F.md5("text").alias("text_md5"), "rewritten")


_REQ = """
, sk AS (SELECT DISTINCT md5(CAST(session_id AS VARCHAR)) AS sid, session_id FROM v_entry),
req AS (SELECT session_id AS request_id, CASE session_id % 9
          WHEN 0 THEN '  ' WHEN 1 THEN concat(' ', upper(substring(sid, 1, 6)), ' ') WHEN 2 THEN 'xyz'
          WHEN 3 THEN sid ELSE substring(sid, 1, CAST(1 + session_id % 4 AS INTEGER)) END AS request FROM sk)
"""


def _requests(spark, sf_dir):
    e = _entries(spark, sf_dir)
    sk = e.select("session_id").distinct().withColumn("sid", F.md5(F.col("session_id").cast("string")))
    k = F.col("session_id") % 9
    req = (F.when(k == 0, F.lit("  ")).when(k == 1, F.concat(F.lit(" "), F.upper(F.substring("sid", 1, 6)), F.lit(" ")))
            .when(k == 2, F.lit("xyz")).when(k == 3, F.col("sid"))
            .otherwise(F.expr("substring(sid, 1, CAST(1 + session_id % 4 AS INT))")))
    return sk.select(F.col("sid").alias("session_key")), sk.select(F.col("session_id").alias("request_id"), req.alias("request"))


@query("c9_resolve_session_ids", _REQ + """
, r AS (SELECT request_id, request, lower(trim(request)) AS p FROM req),
m AS (SELECT r.request_id, r.request, r.p, s.sid FROM r LEFT JOIN sk s ON r.p <> '' AND starts_with(lower(s.sid), r.p)),
g AS (SELECT request_id, request, p, count(sid) AS n_prefix, count(*) FILTER (WHERE lower(sid) = p) AS n_exact,
             max(sid) FILTER (WHERE lower(sid) = p) AS exact_sid, max(sid) AS any_sid FROM m GROUP BY request_id, request, p)
SELECT request_id, request,
  CASE WHEN p = '' THEN 'empty' WHEN n_exact = 1 THEN 'exact' WHEN n_prefix = 1 THEN 'prefix'
       WHEN n_prefix > 1 THEN 'ambiguous' ELSE 'not_found' END AS status,
  CASE WHEN p = '' THEN NULL WHEN n_exact = 1 THEN exact_sid WHEN n_prefix = 1 THEN any_sid END AS session_key
FROM g""")
def c9_resolve_session_ids(spark, sf_dir):
    """Partial session ids resolved: exact, unique prefix, ambiguous, not found, empty."""
    sessions, requests = _requests(spark, sf_dir)
    return S.resolve_ids(sessions, requests)


@query("f2_recent_per_dir", _FILES + """
SELECT cwd, arg_max(concat(cwd, '/', CAST(session_id AS VARCHAR), '.jsonl'), modified_s) AS path, max(modified_s) AS mtime
FROM files GROUP BY cwd""")
def f2_recent_per_dir(spark, sf_dir):
    """Most recent session file per working directory."""
    f = _files(spark, sf_dir).select(
        "cwd", F.concat(F.col("cwd"), F.lit("/"), F.col("session_id").cast("string"), F.lit(".jsonl")).alias("path"),
        F.col("modified_s").alias("mtime"))
    return S.most_recent_per_dir(f)


# ---- tool calls (C4, C5): calls on assistant entries, results on user entries ----
_TOOLS_SQL = """
, calls AS (SELECT session_id, seq, concat('call-', CAST(session_id AS VARCHAR), '-', CAST(seq AS VARCHAR)) AS call_id,
                   CASE (session_id + seq) % 8 WHEN 0 THEN 'read' WHEN 1 THEN 'edit' WHEN 2 THEN 'write' WHEN 3 THEN 'bash'
                        WHEN 4 THEN 'grep' WHEN 5 THEN 'find' WHEN 6 THEN 'search' ELSE 'python' END AS tool_name
            FROM v_entry WHERE type = 'message' AND role = 'assistant'),
results AS (SELECT session_id, seq + 1 AS seq, call_id FROM calls WHERE (session_id + seq) % 5 <> 0
            UNION ALL SELECT session_id, seq, concat('call-', CAST(session_id AS VARCHAR), '-x', CAST(seq AS VARCHAR))
            FROM v_entry WHERE type = 'message' AND role = 'user' AND turn_mod = 0)
"""


def _tool_frames(spark, sf_dir):
    e = _entries(spark, sf_dir)
    names = F.element_at(F.array(*[F.lit(n) for n in dims.TOOLS + ["search", "python"]]),
                         ((F.col("session_id") + F.col("seq")) % 8 + 1).cast("int"))
    calls = e.filter((F.col("type") == "message") & (F.col("role") == "assistant")).select(
        "session_id", "seq",
        F.concat(F.lit("call-"), F.col("session_id").cast("string"), F.lit("-"), F.col("seq").cast("string")).alias("call_id"),
        names.alias("tool_name"))
    answered = calls.filter((F.col("session_id") + F.col("seq")) % 5 != 0).select(
        "session_id", (F.col("seq") + 1).alias("seq"), "call_id")
    orphans = e.filter((F.col("type") == "message") & (F.col("role") == "user") & ((F.col("seq") / 4) % 3 == 0)).select(
        "session_id", "seq",
        F.concat(F.lit("call-"), F.col("session_id").cast("string"), F.lit("-x"), F.col("seq").cast("string")).alias("call_id"))
    return calls, answered.unionByName(orphans)


_TOOLS_SQL = _TOOLS_SQL.replace("turn_mod = 0", "(seq / 4) % 3 = 0")


@query("c4_match_tool_results", _TOOLS_SQL + """
SELECT coalesce(c.session_id, r.session_id) AS session_id, coalesce(c.call_id, r.call_id) AS call_id,
       c.tool_name, c.seq AS call_seq, r.seq AS result_seq,
       c.call_id IS NOT NULL AND r.call_id IS NULL AS call_without_result,
       c.call_id IS NULL AS result_without_call
FROM calls c FULL OUTER JOIN results r ON c.session_id = r.session_id AND c.call_id = r.call_id""")
def c4_match_tool_results(spark, sf_dir):
    """Tool calls matched to results by call id within a session; orphans on both sides kept."""
    calls, results = _tool_frames(spark, sf_dir)
    return tools.match_results(calls, results)


@query("c5_unregistered_tools", _TOOLS_SQL + """
SELECT session_id, seq, call_id, tool_name, concat('Unknown tool: ', tool_name) AS error, true AS is_error
FROM calls WHERE tool_name NOT IN ('read', 'edit', 'write', 'bash', 'grep', 'find')""")
def c5_unregistered_tools(spark, sf_dir):
    """Calls to tools that are not registered are marked as errors."""
    calls, _ = _tool_frames(spark, sf_dir)
    return tools.unregistered_calls(calls)
