"""Source / sink round trips (A1-A11, A13, A14): each query writes data derived
from the driver tables to a fresh folder under the shared checkpoint folder,
reads it back through the reader, and reports what came back."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from tierlens.fixtures import register
from tierlens import dims
from tierlens.operators import cost, export, feedback as fb
from tierlens.operators import ordered
from tierlens.runtime import scratch_dir
from tierlens.sources import readers as R
from tierlens.sources import writers as W
from tierlens.plans import query
from tierlens.plans.q_cost import _USAGE_LOG_SQL, _usage_log
from tierlens.plans.q_sessions import _log as session_log


def _t(spark, sf_dir, name):
    register(spark, sf_dir)
    return spark.table(name)


def _feedback(spark, sf_dir):
    return _t(spark, sf_dir, "v_feedback").withColumn("is_correct", F.col("predicted_tier") == F.col("corrected_tier"))


SYS = "'" + dims.SYSTEM_PROMPT.replace("'", "''") + "'"

# a split's rows with everything a chat example holds
_SPLIT_ROWS = """
, r AS (SELECT conv_id, turn, query, corrected_tier, row_number() OVER (ORDER BY md5(concat_ws('|', '42', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR))), conv_id, turn) - 1 AS rk,
               count(*) OVER () AS n FROM v_feedback)
SELECT CASE WHEN rk < CAST(floor(n * 0.8) AS BIGINT) THEN 'train'
            WHEN rk < CAST(floor(n * 0.8) AS BIGINT) + CAST(floor(n * 0.1) AS BIGINT) THEN 'val' ELSE 'test' END AS split,
       'system,user,assistant' AS roles, md5(SYSTEM_TEXT) AS system_md5, md5(query) AS user_md5,
       concat('{"model_tier": ', CAST(corrected_tier AS VARCHAR), ', "confidence": 0.95}') AS assistant_content
FROM r""".replace("SYSTEM_TEXT", SYS)


def _shown_examples(df):
    m = F.col("messages")
    return df.select("split", F.array_join(F.transform(m, lambda x: x["role"]), ",").alias("roles"), F.md5(m[0]["content"]).alias("system_md5"),
                     F.md5(m[1]["content"]).alias("user_md5"), m[2]["content"].alias("assistant_content"))



@query("a9_write_splits", _SPLIT_ROWS + "\nUNION ALL SELECT 'all', 'system,user,assistant', md5(" + SYS + """), md5(query),
  concat('{"model_tier": ', CAST(corrected_tier AS VARCHAR), ', "confidence": 0.95}') FROM v_feedback""")
def a9_write_splits(spark, sf_dir):
    """Feedback examples split 80/10/10, written one folder per split plus a
    combined copy; both read back, every message compared."""
    out = scratch_dir(spark, "splits")
    ex = fb.sft_examples(_feedback(spark, sf_dir))
    split = export.split_assign(ex, ["conv_id", "turn"], seed=42)
    export.write_splits(split.select("messages", "split"), out)
    kind = "messages array<struct<role:string,content:string>>"
    back = spark.read.schema(f"{kind}, split string").json(f"{out}/by_split")
    whole = spark.read.schema(kind).json(f"{out}/all").withColumn("split", F.lit("all"))
    return _shown_examples(back).unionByName(_shown_examples(whole))


@query("a1_read_chat_examples", _SPLIT_ROWS)
def a1_read_chat_examples(spark, sf_dir):
    """Chat-example JSONL files named train / val / test read back with the
    split taken from the file name."""
    out = scratch_dir(spark, "chat")
    ex = fb.sft_examples(_feedback(spark, sf_dir))
    split = export.split_assign(ex, ["conv_id", "turn"], seed=42)
    for name in ("train", "val", "test"):
        part = split.filter(F.col("split") == name).select(F.to_json(F.struct("messages")).alias("value"))
        part.write.mode("overwrite").text(f"{out}/{name}")
    files = [f"{out}/{name}" for name in ("train", "val", "test")]
    return _shown_examples(R.read_chat_examples(spark, files))


@query("a2_read_feedback", """
SELECT md5(query) AS query_md5, predicted_tier, corrected_tier, confidence, CAST(NULL AS VARCHAR) AS notes,
       strftime(make_timestamp(event_s * 1000000), '%Y-%m-%d %H:%M:%S') AS timestamp, predicted_tier = corrected_tier AS is_correct
FROM v_feedback""")
def a2_read_feedback(spark, sf_dir):
    """Feedback entries written as JSONL with blank lines between batches, read back."""
    out = scratch_dir(spark, "feedback")
    f = _feedback(spark, sf_dir).select("query", "predicted_tier", "corrected_tier", "confidence",
                                        F.lit(None).cast("string").alias("notes"),
                                        F.from_unixtime("event_s").alias("timestamp"), "is_correct")
    lines = f.select(F.concat(F.to_json(F.struct(*f.columns)), F.lit("\n")).alias("value"))
    lines.write.mode("overwrite").text(out)
    back = R.read_feedback(spark, out)
    return back.select(F.md5("query").alias("query_md5"), "predicted_tier", "corrected_tier", "confidence", "notes", "timestamp", "is_correct")


@query("a3_read_prompt_labels", """
SELECT md5(query) AS prompt_md5, predicted_tier AS label FROM v_routed""")
def a3_read_prompt_labels(spark, sf_dir):
    """Prompt/label pairs written as JSON-array files (one array per file, at
    most about 100 000 entries each) and read back with the multi-line reader."""
    out = scratch_dir(spark, "prompts")
    r = _t(spark, sf_dir, "v_routed")
    # consecutive rows of a partition, at most 100 000 to an array, one array
    # per file (partitionBy puts each group in its own file)
    g = F.floor(F.monotonically_increasing_id() / 100_000).cast("bigint")
    arrays = (r.withColumn("g", g).groupBy("g")
               .agg(F.to_json(F.collect_list(F.struct(F.col("query").alias("prompt"),
                                                      F.col("predicted_tier").cast("string").alias("label")))).alias("value")))
    arrays.write.mode("overwrite").partitionBy("g").text(out)
    back = R.read_prompt_labels(spark, out)
    return back.select(F.md5("prompt").alias("prompt_md5"), "label")


_TELEMETRY_HEADER = "turn,model_used,tokens_used,input_complexity,cumulative_cost"


@query("a4_read_telemetry_csv", """
SELECT row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn, 'model' AS model_used, input_tokens + output_tokens AS tokens_used,
       'medium' AS input_complexity, CASE WHEN turn % 2 = 0 THEN confidence END AS confidence, CASE WHEN turn % 2 = 0 THEN 'ok' END AS status FROM v_routed""")
def a4_read_telemetry_csv(spark, sf_dir):
    """Ragged telemetry CSV (5-column header, rows of 5 or 7 fields) read with a 7-column schema."""
    out = scratch_dir(spark, "telemetry")
    r = _t(spark, sf_dir, "v_routed")
    priced = cost.running_cost(cost.price_calls(r.withColumnRenamed("predicted_tier", "tier"), out="actual_cost_nano"))
    line = F.concat_ws(",", F.col("turn_no").cast("string"), F.lit("model"), (F.col("input_tokens") + F.col("output_tokens")).cast("string"),
                       F.lit("medium"), (F.col("cumulative_cost_nano") / 1e9).cast("string"))
    line = F.when(F.col("turn") % 2 == 0, F.concat(line, F.lit(","), F.col("confidence").cast("string"), F.lit(",ok"))).otherwise(line)
    # one CSV part file per task, each opening with the header line
    W.with_header_lines(priced.select(line.alias("value")), _TELEMETRY_HEADER).write.mode("overwrite").text(out)
    back = R.read_telemetry_csv(spark, out)
    return back.select("turn", "model_used", "tokens_used", "input_complexity", "confidence", "status")


_SESSIONS_WITH_ASSISTANT = """
, keep AS (SELECT DISTINCT session_id FROM v_entry WHERE type = 'message' AND role = 'assistant')
SELECT e.session_id, concat('work-proj', CAST(e.session_id % 5 AS VARCHAR)) AS cwd_key, row_number() OVER (PARTITION BY e.session_id ORDER BY e.seq) AS position,
       e.type, e.role, md5(e.text) AS text_md5, e.input_tokens, e.output_tokens, e.value, e.cache_read, e.cache_write, e.stop_reason, e.thinking_level,
       CASE WHEN e.type = 'message' THEN md5(concat(CASE WHEN first_kind = 'image' THEN concat('image img', CAST(e.seq AS VARCHAR), chr(10)) ELSE '' END, 'text ', e.text,
         coalesce((SELECT string_agg(concat(chr(10), 'tool_call c', CAST(e.seq AS VARCHAR), '-', CAST(i AS VARCHAR), ' {"path":"/', CAST(e.seq AS VARCHAR), '"}'), '' ORDER BY i)
                   FROM range(1, n_calls + 1) r(i)), ''))) END AS parts_md5
FROM v_log e JOIN keep k ON e.session_id = k.session_id"""


def _write_sessions(spark, sf_dir, out):
    e = session_log(spark, sf_dir)
    heads = e.select("session_id").distinct().select(
        "session_id", F.concat(F.lit("/work/proj"), (F.col("session_id") % 5).cast("string")).alias("cwd"),
        F.from_unixtime(F.lit(1704067200) + F.col("session_id") * 3600).alias("created"))
    W.write_session_logs(heads, e, out)
    # a stray file with junk lines and no header: rejected as a whole
    spark.createDataFrame([("not json",), ("",), ('{"type": "message", "id": "x"}',)], "value string") \
         .coalesce(1).write.mode("overwrite").text(f"{out}/cwd_key=stray")


@query("a14_write_session_logs", _SESSIONS_WITH_ASSISTANT)
def a14_write_session_logs(spark, sf_dir):
    """Session logs written one file per session under its working directory
    (header first), then read back with directory, line order and every field."""
    out = scratch_dir(spark, "sessions")
    _write_sessions(spark, sf_dir, out)
    _h, ents = R.read_session_logs(spark, out)
    cwd = ents.select("session_id", F.regexp_extract("file", "cwd_key=([^/]*)/", 1).alias("cwd_key")).distinct()
    w = R.entries_wide(ents).join(cwd, "session_id")
    shown = F.transform("parts", lambda p: F.concat_ws(" ", p["kind"], F.coalesce(p["text"], p["data"], p["call_id"]), p["arguments"]))
    return w.select(F.col("session_id").cast("bigint").alias("session_id"), "cwd_key", F.col("seq").alias("position"), "type", "role",
                    F.md5("text").alias("text_md5"), "input_tokens", "output_tokens", "value", "cache_read", "cache_write", "stop_reason", "thinking_level",
                    F.md5(F.array_join(shown, "\n")).alias("parts_md5"))


@query("a5_read_session_logs", """
, keep AS (SELECT DISTINCT session_id FROM v_entry WHERE type = 'message' AND role = 'assistant')
SELECT e.session_id, CAST(count(*) FILTER (WHERE e.type = 'message') AS BIGINT) AS n_messages,
       CAST(coalesce(sum(e.output_tokens), 0) AS BIGINT) AS output_tokens
FROM v_log e JOIN keep k ON e.session_id = k.session_id GROUP BY e.session_id""")
def a5_read_session_logs(spark, sf_dir):
    """Typed session logs read from a directory (bad lines skipped, files
    without a header rejected), mapped back to entries."""
    out = scratch_dir(spark, "sessions")
    _write_sessions(spark, sf_dir, out)
    _h, ents = R.read_session_logs(spark, out)
    w = R.entries_wide(ents)
    return w.groupBy(F.col("session_id").cast("bigint").alias("session_id")).agg(
        F.count(F.when(F.col("type") == "message", 1)).cast("bigint").alias("n_messages"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("bigint").alias("output_tokens"))


@query("a6_table_snapshot", """
SELECT strftime(make_timestamp(event_s * 1000000), '%Y-%m-%d %H:%M:%S') AS timestamp, md5(query) AS query_md5, CAST(predicted_tier AS VARCHAR) AS predicted_tier,
       CAST(corrected_tier AS VARCHAR) AS corrected_tier, confidence FROM v_feedback""")
def a6_table_snapshot(spark, sf_dir):
    """Feedback snapshots in the columnar table layout (one per day, split into
    documents of about 10 000 rows), read back to rows."""
    out = scratch_dir(spark, "snapshots")
    f = _feedback(spark, sf_dir).withColumn("batch_day", F.floor(F.col("event_s") / 86400).cast("bigint"))
    cols = ["timestamp", "query", "predicted_tier", "corrected_tier", "confidence", "status"]
    rows = f.select("batch_day", F.from_unixtime("event_s").alias("timestamp"), "query", "predicted_tier",
                    "corrected_tier", "confidence", fb.stored_status(F.col("is_correct")).alias("status"))
    W.write_table_snapshots(rows, cols, out, ["batch_day"])
    long_rows = R.read_table_snapshot(spark, out)
    wide = R.pivot_snapshot(long_rows, cols)
    return wide.select("timestamp", F.md5("query").alias("query_md5"), "predicted_tier", "corrected_tier", F.col("confidence").cast("double").alias("confidence"))


@query("a7_cost_records", f""", {_USAGE_LOG_SQL.strip().rstrip(",")}
SELECT kind, is_summarisation, model, decision_tier, actual_tier, 3 AS baseline_tier, prompt_tokens, completion_tokens, total_tokens,
       round(actual_cost_nano / 1e9, 12) AS actual_cost, round(baseline_cost_nano / 1e9, 12) AS baseline_cost,
       CASE WHEN actual_cost_nano IS NOT NULL AND baseline_cost_nano > 0
            THEN round(CAST(baseline_cost_nano - actual_cost_nano AS DOUBLE) * 100.0 / CAST(baseline_cost_nano AS DOUBLE), 9) END AS savings_pct
FROM records""")
def a7_cost_records(spark, sf_dir):
    """Cost records appended in two batches (route, summary) and read back, every field of them."""
    out = scratch_dir(spark, "costlog")
    recs = cost.cost_records(cost.drop_empty_usage(_usage_log(spark, sf_dir)))
    recs = recs.select(F.lit("2024-01-01T00:00:00").alias("timestamp"), "kind", "is_summarisation", "model", "decision_tier",
                       "actual_tier", "baseline_tier", "prompt_tokens", "completion_tokens", "total_tokens",
                       (F.col("actual_cost_nano") / 1e9).alias("actual_cost"), (F.col("baseline_cost_nano") / 1e9).alias("baseline_cost"),
                       "savings_pct")
    W.append_cost_records(recs.filter(F.col("kind") == "route"), out)
    W.append_cost_records(recs.filter(F.col("kind") == "summary"), out)
    back = R.read_cost_records(spark, out)
    return back.select("kind", "is_summarisation", "model", "decision_tier", "actual_tier", "baseline_tier", "prompt_tokens", "completion_tokens",
                       "total_tokens", F.round("actual_cost", 12).alias("actual_cost"), F.round("baseline_cost", 12).alias("baseline_cost"), "savings_pct")


@query("a8_router_history", """
SELECT CAST(conv_id AS VARCHAR) AS conversation_id, role, md5(text) AS content_md5, 'mistral-small-latest' AS model,
       row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations""")
def a8_router_history(spark, sf_dir):
    """Router history appended per conversation and read back in line order."""
    out = scratch_dir(spark, "history")
    c = _t(spark, sf_dir, "conversations").repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    h = c.select("role", F.col("text").alias("content"), F.lit("mistral-small-latest").alias("model"),
                 F.col("conv_id").cast("string").alias("conversation_id"), F.lit("2024-01-01T00:00:00").alias("timestamp"))
    W.append_history(h, out)
    back = R.read_router_history(spark, out)
    placed = ordered.running_sum(back, "conversation_id", "seq", F.lit(1), "position")
    return placed.select("conversation_id", "role", F.md5("content").alias("content_md5"), "model", F.col("position").cast("bigint").alias("position"))


@query("a10_write_triples", f"""
SELECT md5(concat({SYS}, chr(10), chr(10), 'User Query: ', query)) AS prompt_md5,
       concat('{{"model_tier": ', CAST(corrected_tier AS VARCHAR), ', "confidence": 1.0}}') AS chosen,
       concat('{{"model_tier": ', CAST(predicted_tier AS VARCHAR), ', "confidence": ', coalesce(CAST(confidence AS VARCHAR), 'null'), '}}') AS rejected
FROM v_feedback WHERE predicted_tier <> corrected_tier""")
def a10_write_triples(spark, sf_dir):
    """Preference triples written as JSON lines and read back."""
    out = scratch_dir(spark, "dpo")
    export.write_triples(fb.dpo_triples(_feedback(spark, sf_dir)), out)
    back = spark.read.schema("prompt string, chosen string, rejected string").json(out)
    return back.select(F.md5("prompt").alias("prompt_md5"), "chosen", "rejected")


@query("a11_close_batch", """
SELECT conv_id, turn, md5(query) AS query_md5, predicted_tier, corrected_tier, CASE WHEN (conv_id + turn) % 3 = 0 THEN '20240101_000000' END AS archive_ts
FROM v_feedback""")
def a11_close_batch(spark, sf_dir):
    """A batch close archives the consumed entries under a timestamp; the open
    set is what the archive does not hold."""
    out = scratch_dir(spark, "archive")
    f = _feedback(spark, sf_dir).select("conv_id", "turn", "query", "predicted_tier", "corrected_tier")
    consumed = f.filter((F.col("conv_id") + F.col("turn")) % 3 == 0)
    W.close_batch(consumed, out, "20240101_000000")
    kind = "conv_id bigint, turn bigint, query string, predicted_tier int, corrected_tier int, archive_ts string"
    archived = spark.read.schema(kind).json(out)
    open_rows = fb.open_rows(f, archived, ["conv_id", "turn"]).withColumn("archive_ts", F.lit(None).cast("string"))
    cols = ["conv_id", "turn", F.md5("query").alias("query_md5"), "predicted_tier", "corrected_tier", "archive_ts"]
    return archived.select(*cols).unionByName(open_rows.select(*cols))


@query("a13_list_files", """
SELECT conv_id, min(turn) AS first_turn, count(*) AS n_rows FROM v_routed GROUP BY conv_id ORDER BY conv_id LIMIT 100""")
def a13_list_files(spark, sf_dir):
    """The newest 100 JSON files of a folder tree, each opened to see what it
    holds. Every conversation has a file; those of the 100 smallest ids are
    written after all others, so SQL can say which files are the newest."""
    out = scratch_dir(spark, "listing")
    r = _t(spark, sf_dir, "v_routed").select("conv_id", "turn", "query")
    last = F.broadcast(r.select("conv_id").distinct().orderBy(F.col("conv_id").asc_nulls_last()).limit(100))
    for mode, how in (("overwrite", "left_anti"), ("append", "left_semi")):
        W.write_key_files(r.join(last, "conv_id", how), "conv_id", "turn", out, mode)
        time.sleep(1.1)  # some stores keep modification times in whole seconds
    paths = [f.path for f in R.list_files(spark, out, "*.json").collect()]
    rows = spark.read.schema("turn bigint, query string, conv_id bigint").json(paths or out)
    return rows.groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("n_rows"))
