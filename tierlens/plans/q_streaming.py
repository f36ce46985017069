"""Streaming queries (I1-I11). Each stream query replays its input (derived
from the driver tables) as event-time slices, runs the streaming job with
``availableNow`` once per slice (resuming from its checkpoint), and returns
what the sink holds; batch twins of the same operators are compared against
the same oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierlens.fixtures import register, with_views
from tierlens.operators import cost
from tierlens.operators import streams as ST
from tierlens.plans import query
from tierlens.plans.q_feedback import _SUBMITTED
from tierlens.streaming import harness as H
from tierlens.streaming import jobs as J


def _t(spark, sf_dir, name):
    register(spark, sf_dir)
    return spark.table(name)


# ---------------------------------------------------------------- I1
def _submissions(spark, sf_dir):
    f = _t(spark, sf_dir, "v_feedback")
    return f.select(
        "conv_id", "turn", "query", "event_s",
        F.when((F.col("conv_id") * 3 + F.col("turn")) % 13 == 0, F.lit(0)).otherwise(F.col("predicted_tier")).alias("predicted_tier"),
        F.when((F.col("conv_id") + F.col("turn") * 7) % 17 == 0, F.lit(5)).otherwise(F.col("corrected_tier")).alias("corrected_tier"),
        "confidence")


_SUB_SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                            T.StructField("query", T.StringType()), T.StructField("event_s", T.LongType()),
                            T.StructField("predicted_tier", T.IntegerType()), T.StructField("corrected_tier", T.IntegerType()),
                            T.StructField("confidence", T.DoubleType())])


@query("i1_feedback_ingest", _SUBMITTED + """
SELECT conv_id, turn,
  CASE WHEN predicted_tier NOT IN (1,2,3,4) OR predicted_tier IS NULL THEN 'predicted_tier must be 1-4'
       WHEN corrected_tier NOT IN (1,2,3,4) OR corrected_tier IS NULL THEN 'corrected_tier must be 1-4' END AS reject_reason,
  CASE WHEN predicted_tier IN (1,2,3,4) AND corrected_tier IN (1,2,3,4) THEN predicted_tier = corrected_tier END AS is_correct
FROM submitted""")
def i1_feedback_ingest(spark, sf_dir):
    """Corrections streamed in time order: each micro-batch validated, accepted
    rows and quarantined rows appended to their own sinks."""
    w = H.workdir(spark, "ingest")
    rp = H.stage_slices(_submissions(spark, sf_dir), w["input"], "event_s")
    acc, quar = f"{w['out']}/accepted", f"{w['out']}/quarantine"
    stream = H.file_stream(spark, w["input"], _SUB_SCHEMA)
    H.run_foreach_batch(stream, lambda df, bid: J.ingest_feedback(df, bid, acc, quar), w["ckpt"], rp)
    a = spark.read.schema(T.StructType(_SUB_SCHEMA.fields + [T.StructField("is_correct", T.BooleanType()),
                                                             T.StructField("batch", T.LongType())])).json(acc)
    q = spark.read.schema(T.StructType(_SUB_SCHEMA.fields + [T.StructField("reject_reason", T.StringType()),
                                                             T.StructField("batch", T.LongType())])).json(quar)
    return (a.select("conv_id", "turn", F.lit(None).cast("string").alias("reject_reason"), "is_correct")
             .unionByName(q.select("conv_id", "turn", "reject_reason", F.lit(None).cast("boolean").alias("is_correct"))))


# Batches are the non-empty event-time slices in order (8 equal ranges from the
# earliest event); open corrections accumulate until 20 or more trigger an archive.
_RETRAIN_SQL = with_views("""
, sub AS (SELECT conv_id, turn, event_s,
     CASE WHEN (conv_id*3 + turn) % 13 = 0 THEN 0 ELSE predicted_tier END AS pt,
     CASE WHEN (conv_id + turn*7) % 17 = 0 THEN 5 ELSE corrected_tier END AS ct FROM v_feedback),
bounds AS (SELECT min(event_s) AS lo, max(event_s) AS hi FROM sub),
sl AS (SELECT s.*, CAST(floor((event_s - lo) / ((hi - lo + 8) // 8)) AS BIGINT) AS slice FROM sub s, bounds),
bt AS (SELECT slice, n_acc, row_number() OVER (ORDER BY slice) - 1 AS batch_id
       FROM (SELECT slice, count(*) FILTER (WHERE pt IN (1, 2, 3, 4) AND ct IN (1, 2, 3, 4)) AS n_acc FROM sl GROUP BY slice) g),
walk AS (SELECT batch_id, n_acc AS n_open FROM bt WHERE batch_id = 0
         UNION ALL
         SELECT bt.batch_id, CASE WHEN w.n_open >= 20 THEN 0 ELSE w.n_open END + bt.n_acc
         FROM walk w JOIN bt ON bt.batch_id = w.batch_id + 1)
SELECT CAST(n_open AS BIGINT) AS n_archived, CAST(batch_id AS BIGINT) AS batch_id FROM walk WHERE n_open >= 20""").replace("WITH ", "WITH RECURSIVE ", 1)


@query("i2_retrain_trigger", _RETRAIN_SQL, views=False)
def i2_retrain_trigger(spark, sf_dir):
    """Corrections streamed in; whenever 20 or more are open the batch is
    archived and a retrain trigger recorded (keyed by batch id)."""
    w = H.workdir(spark, "retrain")
    rp = H.stage_slices(_submissions(spark, sf_dir), w["input"], "event_s", n_slices=8)
    acc, quar = f"{w['out']}/accepted", f"{w['out']}/quarantine"
    arch, trig = f"{w['out']}/archive", f"{w['out']}/triggers"

    def step(df, bid):
        J.ingest_feedback(df, bid, acc, quar)
        J.retrain_step(spark, bid, acc, arch, trig, ["conv_id", "turn"])

    H.run_foreach_batch(H.file_stream(spark, w["input"], _SUB_SCHEMA), step, w["ckpt"], rp)
    return spark.read.schema("n_archived long, batch_id long").json(trig)


@query("i10_snapshot_refresh", """
SELECT strftime(make_timestamp(CAST(event_s * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS timestamp, md5(query) AS query_md5,
       CAST(predicted_tier AS VARCHAR) AS predicted_tier, CAST(corrected_tier AS VARCHAR) AS corrected_tier, confidence,
       CASE WHEN predicted_tier = corrected_tier THEN 'confirmed' ELSE 'corrected' END AS status FROM v_feedback""")
def i10_snapshot_refresh(spark, sf_dir):
    """Every micro-batch of corrections adds its documents and a manifest row;
    the newest snapshot is read back to rows, every field of them."""
    w = H.workdir(spark, "snapshot")
    f = _t(spark, sf_dir, "v_feedback").select(
        "event_s", F.from_unixtime("event_s").alias("timestamp"), "query", "predicted_tier", "corrected_tier", "confidence",
        F.when(F.col("predicted_tier") == F.col("corrected_tier"), "confirmed").otherwise("corrected").alias("status"))
    rp = H.stage_slices(f, w["input"], "event_s", n_slices=10)
    schema = T.StructType([T.StructField("event_s", T.LongType()), T.StructField("timestamp", T.StringType()),
                           T.StructField("query", T.StringType()), T.StructField("predicted_tier", T.IntegerType()),
                           T.StructField("corrected_tier", T.IntegerType()), T.StructField("confidence", T.DoubleType()),
                           T.StructField("status", T.StringType())])
    H.run_foreach_batch(H.file_stream(spark, w["input"], schema), lambda df, bid: J.refresh_snapshot(df, bid, w["out"]), w["ckpt"], rp)
    rows = J.read_snapshot(spark, w["out"])
    return rows.select("timestamp", F.md5("query").alias("query_md5"), "predicted_tier", "corrected_tier",
                       F.col("confidence").cast("double").alias("confidence"), "status")


# ---------------------------------------------------------------- I3 / I11
_CALL_SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                             T.StructField("tier", T.IntegerType()), T.StructField("input_tokens", T.LongType()),
                             T.StructField("output_tokens", T.LongType()), T.StructField("ts_s", T.LongType())])


def _calls(spark, sf_dir):
    r = _t(spark, sf_dir, "v_routed")
    return r.select("conv_id", "turn", F.col("predicted_tier").alias("tier"), "input_tokens", "output_tokens",
                    (F.lit(1704067200) + F.col("turn") * 60).cast("bigint").alias("ts_s"))


_ROI_PRICES = "(VALUES (1,100,100),(2,100,300),(3,400,2000),(4,500,1500)) AS p(tier, pin, pout)"


# Session events: the routed calls; before a call of another tier than the one
# before, a summary of the conversation at tier 1; a reset after some turns.
_EVENTS_SQL = """
, c AS (SELECT conv_id, turn, predicted_tier AS tier, input_tokens, output_tokens,
               lag(predicted_tier) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM v_routed),
ev AS (SELECT conv_id, turn * 4 + 2 AS seq, 'call' AS kind, tier, input_tokens, output_tokens FROM c
       UNION ALL SELECT conv_id, turn * 4 + 1, 'summary', 1, 200 + turn * 3, 40 + conv_id % 7 FROM c WHERE prev <> tier
       UNION ALL SELECT conv_id, turn * 4 + 3, 'reset', NULL, NULL, NULL FROM c WHERE (conv_id + turn) % 7 = 5),
ep AS (SELECT *, count(*) FILTER (WHERE kind = 'reset') OVER (PARTITION BY conv_id ORDER BY seq) AS epoch FROM ev)"""


def _session_events(spark, sf_dir):
    c = _t(spark, sf_dir, "v_routed").select("conv_id", "turn", F.col("predicted_tier").alias("tier"), "input_tokens", "output_tokens")
    prev = F.lag("tier").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = c.withColumn("prev", prev)

    def event(rows, offset, kind, tier, tin, tout):
        return rows.select("conv_id", (F.col("turn") * 4 + offset).cast("bigint").alias("seq"), F.lit(kind).alias("kind"), tier.cast("int").alias("tier"),
                           tin.cast("bigint").alias("input_tokens"), tout.cast("bigint").alias("output_tokens"))

    none = F.lit(None)
    return (event(c, 2, "call", F.col("tier"), F.col("input_tokens"), F.col("output_tokens"))
            .unionByName(event(c.filter("prev != tier"), 1, "summary", F.lit(1), F.col("turn") * 3 + 200, F.col("conv_id") % 7 + 40))
            .unionByName(event(c.filter((F.col("conv_id") + F.col("turn")) % 7 == 5), 3, "reset", none, none, none)))


_EVENT_SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("kind", T.StringType()),
                              T.StructField("tier", T.IntegerType()), T.StructField("input_tokens", T.LongType()), T.StructField("output_tokens", T.LongType())])


@query("i3_live_session_roi", _EVENTS_SQL + """
, t AS (SELECT conv_id, epoch, kind = 'summary' AS is_sum, coalesce(input_tokens*p.pin + output_tokens*p.pout, 0) AS a,
               input_tokens*400 + output_tokens*2000 AS b FROM ep LEFT JOIN """ + _ROI_PRICES + """ ON ep.tier = p.tier WHERE kind <> 'reset')
SELECT conv_id, CAST(epoch AS BIGINT) AS epoch, CAST(count(*) FILTER (WHERE NOT is_sum) AS BIGINT) AS total_turns, CAST(sum(a) AS BIGINT) AS actual_total_nano,
       CAST(sum(b) AS BIGINT) AS baseline_total_nano, CAST(coalesce(sum(a) FILTER (WHERE NOT is_sum), 0) AS BIGINT) AS model_cost_nano,
       CAST(coalesce(sum(a) FILTER (WHERE is_sum), 0) AS BIGINT) AS summarisation_nano, CAST(sum(b) - sum(a) AS BIGINT) AS savings_nano,
       CASE WHEN sum(b) > 0 THEN round(CAST(sum(b) - sum(a) AS DOUBLE) * 100.0 / CAST(sum(b) AS DOUBLE), 9) ELSE 0.0 END AS roi_pct
FROM t GROUP BY conv_id, epoch""")
def i3_live_session_roi(spark, sf_dir):
    """Calls, summaries and resets streamed in order; the ROI of every session
    and epoch is updated each micro-batch (update log keyed by batch id, newest
    row per session and epoch)."""
    w = H.workdir(spark, "roi")
    rp = H.stage_slices(_session_events(spark, sf_dir), w["input"], "seq")
    agg = J.session_roi_updates(H.file_stream(spark, w["input"], _EVENT_SCHEMA))
    H.run_foreach_batch(agg, lambda df, bid: J.upsert_batch(df, bid, w["out"]), w["ckpt"], rp, mode="update")
    latest = J.latest_per_key(spark, w["out"], ["conv_id", "epoch"])
    return J.roi_columns(latest).select("conv_id", "epoch", "total_turns", "actual_total_nano", "baseline_total_nano", "model_cost_nano",
                                        "summarisation_nano", "savings_nano", "roi_pct")


@query("i11_running_telemetry", None)
def i11_running_telemetry(spark, sf_dir):
    """Telemetry records appended as turns arrive; turn number and running
    cost computed when the table is read."""
    w = H.workdir(spark, "telemetry")
    rp = H.stage_slices(_calls(spark, sf_dir), w["input"], "turn")
    H.run_to_parquet(J.telemetry_records(H.file_stream(spark, w["input"], _CALL_SCHEMA)), w["out"], w["ckpt"], replay=rp)
    recs = spark.read.parquet(w["out"])
    return cost.running_cost(recs).select("conv_id", "turn", "turn_no", "cumulative_cost_nano")


# ---------------------------------------------------------------- I4 / I9 / I8
@query("i4_pivot_stream", None)
def i4_pivot_stream(spark, sf_dir):
    """Tier pivots detected on a stream of routed turns with the last tier in keyed state."""
    w = H.workdir(spark, "pivot")
    rp = H.stage_slices(_calls(spark, sf_dir), w["input"], "turn")
    H.run_to_parquet(J.pivot_stream(H.file_stream(spark, w["input"], _CALL_SCHEMA)), w["out"], w["ckpt"], replay=rp)
    return spark.read.parquet(w["out"]).select("conv_id", "turn", "prev_tier", "is_pivot")


@query("i9_compaction_stream", None)
def i9_compaction_stream(spark, sf_dir):
    """Router-log compaction decided per conversation from keyed state while turns stream in."""
    w = H.workdir(spark, "compaction")
    t = _t(spark, sf_dir, "v_turn").select("conv_id", "turn", (F.lit(1704067200) + F.col("turn") * 60).cast("bigint").alias("ts_s"))
    rp = H.stage_slices(t, w["input"], "turn")
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("ts_s", T.LongType())])
    H.run_to_parquet(J.compaction_stream(H.file_stream(spark, w["input"], schema)), w["out"], w["ckpt"], replay=rp)
    return spark.read.parquet(w["out"]).select("conv_id", "turn", "call_no", "compact_before")


_ENTRY_SCHEMA = T.StructType([T.StructField("session_id", T.LongType()), T.StructField("seq", T.LongType()),
                              T.StructField("type", T.StringType()), T.StructField("role", T.StringType()),
                              T.StructField("text", T.StringType()), T.StructField("output_tokens", T.LongType()),
                              T.StructField("input_tokens", T.LongType()), T.StructField("value", T.StringType()),
                              T.StructField("cache_read", T.LongType()), T.StructField("cache_write", T.LongType()),
                              T.StructField("stop_reason", T.StringType())])


@query("i8_overflow_alerts", None)
def i8_overflow_alerts(spark, sf_dir):
    """Overflow alerts (window 700, max output 100, buffer 100) raised as session entries stream in."""
    w = H.workdir(spark, "overflow")
    rp = H.stage_slices(_t(spark, sf_dir, "v_log").select([f.name for f in _ENTRY_SCHEMA]), w["input"], "seq")
    alerts = J.overflow_alerts(H.file_stream(spark, w["input"], _ENTRY_SCHEMA), context_window=700, max_output=100, buffer=100)
    H.run_to_parquet(alerts.select("session_id", "seq", "tokens_before", "overflow"), w["out"], w["ckpt"], replay=rp)
    return spark.read.parquet(w["out"])


# ---------------------------------------------------------------- I5 / I6 parts
_CHUNK = 16


def _parts(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    c = c.withColumn("stream_id", F.col("conv_id") * 1000 + F.col("turn")).withColumn("k", F.col("conv_id") + F.col("turn"))
    words = c.select("stream_id", F.posexplode(F.split("text", " ", -1)).alias("seq", "w"))
    word_parts = words.select("stream_id", F.col("seq").cast("bigint").alias("seq"),
                              F.when(F.col("seq") % 11 >= 3, F.when(F.col("seq") % 11 <= 4, "think").otherwise("text"))
                               .otherwise("text").alias("part_type"),
                              F.concat("w", F.lit(" ")).alias("text"),
                              F.when(F.col("seq") % 11 == 4, F.concat(F.lit("sig-"), F.col("seq").cast("string"))).alias("signature"))
    n = c.select("stream_id", "k", F.size(F.split("text", " ", -1)).cast("bigint").alias("n"),
                 F.regexp_replace("text", "[^a-zA-Z ]", "").alias("clean"))
    args = F.when(F.col("k") % 4 == 2, F.concat(F.lit('{"path": '), "clean")) \
            .otherwise(F.concat(F.lit('{"path": "f.txt", "content": "'), "clean", F.lit('"}')))
    n = n.withColumn("args", F.when(F.col("k") % 2 == 0, args))
    n_chunks = F.floor((F.length("args") + _CHUNK - 1) / _CHUNK).cast("int")
    calls = n.filter(F.col("args").isNotNull())
    start = calls.select("stream_id", F.col("n").alias("seq"), F.lit("tool_call_start").alias("part_type"),
                         F.lit("write").alias("name"), F.concat(F.lit("call-"), F.col("stream_id").cast("string")).alias("call_id"))
    deltas = calls.select("stream_id", "n", "args", F.explode(F.sequence(F.lit(0), n_chunks - 1)).alias("j")).select(
        "stream_id", (F.col("n") + 1 + F.col("j")).alias("seq"), F.lit("tool_call_delta").alias("part_type"),
        F.expr(f"substring(args, {_CHUNK} * j + 1, {_CHUNK})").alias("args_delta"))
    tail = n.withColumn("extra", F.coalesce(n_chunks + 1, F.lit(0)).cast("bigint"))
    err = tail.filter(F.col("k") % 5 == 0).select("stream_id", (F.col("n") + F.col("extra")).alias("seq"),
                                                   F.lit("error").alias("part_type"))
    done = tail.select("stream_id", (F.col("n") + F.col("extra") + 1).alias("seq"), F.lit("done").alias("part_type"),
                       F.lit("stop").alias("stop_reason"))
    cols = {"text": "string", "signature": "string", "call_id": "string", "name": "string",
            "args_delta": "string", "stop_reason": "string"}

    def full(df):
        for c_, t in cols.items():
            if c_ not in df.columns:
                df = df.withColumn(c_, F.lit(None).cast(t))
        return df.select("stream_id", F.col("seq").cast("bigint").alias("seq"), "part_type", *cols)

    return full(word_parts).unionByName(full(start)).unionByName(full(deltas)).unionByName(full(err)).unionByName(full(done))


_PARTS_SQL = """
, am AS (SELECT conv_id * 1000 + turn AS stream_id, conv_id + turn AS k, text, len(string_split(text, ' ')) AS n,
                regexp_replace(text, '[^a-zA-Z ]', '', 'g') AS clean FROM conversations WHERE role = 'assistant'),
wd AS (SELECT stream_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS seq FROM am),
ca AS (SELECT stream_id, k, n, CASE WHEN k % 4 = 2 THEN concat('{"path": ', clean) ELSE concat('{"path": "f.txt", "content": "', clean, '"}') END AS args
       FROM am WHERE k % 2 = 0),
ch AS (SELECT stream_id, n, args, unnest(range(0, CAST(ceil(length(args) / 16.0) AS BIGINT))) AS j FROM ca),
tl AS (SELECT am.stream_id, am.k, am.n, coalesce(CAST(ceil(length(ca.args) / 16.0) AS BIGINT) + 1, 0) AS extra
       FROM am LEFT JOIN ca ON am.stream_id = ca.stream_id),
parts AS (
  SELECT stream_id, CAST(seq AS BIGINT) AS seq, CASE WHEN seq % 11 IN (3, 4) THEN 'think' ELSE 'text' END AS part_type,
         concat(w, ' ') AS text, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS VARCHAR) AS args_delta, CAST(NULL AS VARCHAR) AS stop_reason,
         CAST(NULL AS VARCHAR) AS call_id, CASE WHEN seq % 11 = 4 THEN concat('sig-', CAST(seq AS VARCHAR)) END AS signature FROM wd
  UNION ALL SELECT stream_id, n, 'tool_call_start', NULL, 'write', NULL, NULL, concat('call-', CAST(stream_id AS VARCHAR)), NULL FROM ca
  UNION ALL SELECT stream_id, n + 1 + j, 'tool_call_delta', NULL, NULL, substring(args, 16 * j + 1, 16), NULL, NULL, NULL FROM ch
  UNION ALL SELECT stream_id, n + extra, 'error', NULL, NULL, NULL, NULL, NULL, NULL FROM tl WHERE k % 5 = 0
  UNION ALL SELECT stream_id, n + extra + 1, 'done', NULL, NULL, NULL, 'stop', NULL, NULL FROM tl)
"""

_BLOCKS_SQL = _PARTS_SQL + """,
cp AS (SELECT *, CASE part_type WHEN 'text' THEN 'text' WHEN 'think' THEN 'thinking' ELSE 'tool_call' END AS kind
       FROM parts WHERE part_type IN ('text', 'think', 'tool_call_start', 'tool_call_delta')),
nb AS (SELECT *, CASE WHEN lag(kind) OVER w IS NULL OR lag(kind) OVER w <> kind OR part_type = 'tool_call_start' THEN 1 ELSE 0 END AS nb
       FROM cp WINDOW w AS (PARTITION BY stream_id ORDER BY seq)),
bi AS (SELECT *, sum(nb) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block_id FROM nb),
bl AS (SELECT stream_id, block_id, min(kind) AS kind, max(name) AS name, max(call_id) AS call_id, arg_max(signature, CASE WHEN signature <> '' THEN seq END) AS signature,
              string_agg(CASE WHEN kind = 'tool_call' THEN coalesce(args_delta, '') ELSE coalesce(text, '') END, '' ORDER BY seq) AS c
       FROM bi GROUP BY stream_id, block_id),
blocks AS (SELECT stream_id, CASE WHEN kind = 'tool_call' THEN 1099511627776 + block_id ELSE block_id END AS position, kind, name, call_id, signature,
                  CASE WHEN kind <> 'tool_call' THEN c WHEN json_valid(c) AND json_type(c) = 'OBJECT' THEN c ELSE '{}' END AS content FROM bl)
"""


@query("i5_assemble_batch", _BLOCKS_SQL + """
SELECT stream_id, CAST(position AS BIGINT) AS position, kind, name, call_id, signature, md5(content) AS content_md5 FROM blocks""")
def i5_assemble_batch(spark, sf_dir):
    """Streamed parts of every assistant message assembled into content blocks (batch twin)."""
    blocks, _msg = ST.assemble_messages(_parts(spark, sf_dir))
    return blocks.select("stream_id", F.col("position").cast("bigint").alias("position"), "kind", "name",
                         "call_id", "signature", F.md5("content").alias("content_md5"))


@query("i5_assemble_messages", _PARTS_SQL + """
, ends AS (SELECT stream_id, arg_max(stop_reason, CASE WHEN part_type = 'done' THEN seq END) AS done_reason,
                  max(CASE WHEN part_type = 'error' THEN seq END) AS err_seq, max(CASE WHEN part_type = 'done' THEN seq END) AS done_seq,
                  count(*) FILTER (WHERE part_type = 'tool_call_start') AS n_tool_calls FROM parts GROUP BY stream_id),
b AS (SELECT stream_id, n_tool_calls, CASE WHEN err_seq IS NOT NULL AND (done_seq IS NULL OR err_seq > done_seq) THEN 'error'
                                           ELSE coalesce(done_reason, 'stop') END AS base FROM ends)
SELECT stream_id, n_tool_calls, CASE WHEN base = 'stop' AND n_tool_calls > 0 THEN 'tool_use' ELSE base END AS stop_reason FROM b""")
def i5_assemble_messages(spark, sf_dir):
    """Per streamed message: tool-call count and final stop reason (batch twin)."""
    _blocks, msg = ST.assemble_messages(_parts(spark, sf_dir))
    return msg


_PART_SCHEMA = T.StructType([T.StructField("stream_id", T.LongType()), T.StructField("seq", T.LongType()),
                             T.StructField("part_type", T.StringType()), T.StructField("text", T.StringType()),
                             T.StructField("signature", T.StringType()), T.StructField("call_id", T.StringType()),
                             T.StructField("name", T.StringType()), T.StructField("args_delta", T.StringType()),
                             T.StructField("stop_reason", T.StringType()), T.StructField("ts_s", T.LongType())])


@query("i5_assemble_stream", None)
def i5_assemble_stream(spark, sf_dir):
    """The same parts streamed in seq slices, numbered with their blocks in keyed state."""
    w = H.workdir(spark, "assemble")
    timed = _parts(spark, sf_dir).withColumn("ts_s", F.lit(1704067200) + F.col("seq"))
    rp = H.stage_slices(timed, w["input"], "seq")
    H.run_to_parquet(J.assemble_stream(H.file_stream(spark, w["input"], _PART_SCHEMA)), w["out"], w["ckpt"], replay=rp)
    out = J.assembled_blocks(spark.read.parquet(w["out"]))
    return out.select("stream_id", "position", "kind", "name", "call_id", "signature", F.md5("content").alias("content_md5"))


@query("i6_progress_rows", _PARTS_SQL + """
, d AS (SELECT stream_id, seq, args_delta,
               sum(CASE WHEN part_type = 'tool_call_start' THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS call_no,
               part_type FROM parts WHERE part_type IN ('tool_call_start', 'tool_call_delta')),
c AS (SELECT stream_id, call_no, seq,
             row_number() OVER (PARTITION BY stream_id, call_no ORDER BY seq) AS chunk_no,
             sum(floor(length(coalesce(args_delta, '')) / 4)) OVER (PARTITION BY stream_id, call_no ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tokens
      FROM d WHERE part_type = 'tool_call_delta')
SELECT stream_id, CAST(call_no AS BIGINT) AS call_no, seq, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(tokens AS BIGINT) AS tokens
FROM c WHERE tokens > 20 AND chunk_no % 4 = 0""")
def i6_progress_rows(spark, sf_dir):
    """Argument-size progress rows of streamed tool calls."""
    return ST.progress_rows(_parts(spark, sf_dir)).select(
        "stream_id", F.col("call_no").cast("bigint").alias("call_no"), "seq",
        F.col("chunk_no").cast("bigint").alias("chunk_no"), F.col("tokens").cast("bigint").alias("tokens"))


# ---------------------------------------------------------------- I7
_STALL_S = 6 * 3600


def _event_parts(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    kind = (F.when(F.col("event_type") == "purchase", "tool_call_start").when(F.col("event_type") == "click", "tool_call_delta")
             .when(F.col("event_type") == "view", "text").when(F.col("event_type") == "error", "error").otherwise("done"))
    return ev.select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), kind.alias("part_type"),
                     F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint").alias("ts_s"))


@query("i7_stall_batch", f"""
, p AS (SELECT user_id AS stream_id, event_id AS seq,
               CASE event_type WHEN 'purchase' THEN 'tool_call_start' WHEN 'click' THEN 'tool_call_delta' WHEN 'view' THEN 'text'
                               WHEN 'error' THEN 'error' ELSE 'done' END AS part_type,
               CAST(floor(epoch(ts)) AS BIGINT) AS ts_s FROM events),
n AS (SELECT *, lead(ts_s) OVER (PARTITION BY stream_id ORDER BY seq) AS next_ts FROM p)
SELECT stream_id, seq, ts_s + {_STALL_S} AS closed_at_s FROM n
WHERE part_type IN ('tool_call_start', 'tool_call_delta') AND (next_ts IS NULL OR next_ts - ts_s > {_STALL_S})""")
def i7_stall_batch(spark, sf_dir):
    """Streams (one per user) with a call in progress silent for 6 hours are closed (batch twin)."""
    return ST.stalls(_event_parts(spark, sf_dir), _STALL_S)


@query("i7_stall_stream", f"""
, p AS (SELECT user_id AS stream_id, event_id AS seq,
               CASE event_type WHEN 'purchase' THEN 'tool_call_start' WHEN 'click' THEN 'tool_call_delta' WHEN 'view' THEN 'text'
                               WHEN 'error' THEN 'error' ELSE 'done' END AS part_type,
               CAST(floor(epoch(ts)) AS BIGINT) AS ts_s FROM events),
n AS (SELECT *, lead(ts_s) OVER (PARTITION BY stream_id ORDER BY seq) AS next_ts FROM p)
SELECT stream_id, seq, ts_s + {_STALL_S} AS closed_at_s FROM n
WHERE part_type IN ('tool_call_start', 'tool_call_delta')
  AND (next_ts - ts_s > {_STALL_S} OR (next_ts IS NULL AND (SELECT max(ts_s) FROM p) - ts_s > {_STALL_S}))""")
def i7_stall_stream(spark, sf_dir):
    """The same streams with an event-time timeout in keyed state; closures
    whose timeout lies beyond the last watermark (the latest event time)
    stay pending."""
    w = H.workdir(spark, "stall")
    parts = _event_parts(spark, sf_dir)
    rp = H.stage_slices(parts, w["input"], "ts_s")
    schema = T.StructType([T.StructField("stream_id", T.LongType()), T.StructField("seq", T.LongType()),
                           T.StructField("part_type", T.StringType()), T.StructField("ts_s", T.LongType())])
    H.run_to_parquet(J.stall_stream(H.file_stream(spark, w["input"], schema), _STALL_S), w["out"], w["ckpt"], replay=rp)
    return spark.read.parquet(w["out"])


def _install_twin_oracles():
    """Stream queries share the oracle of their batch twin."""
    from tierlens.plans import ORACLES

    twins = {"i4_pivot_stream": "e3_tier_pivots", "i9_compaction_stream": "e13_compaction_schedule",
             "i11_running_telemetry": "e1_running_cost", "i5_assemble_stream": "i5_assemble_batch"}
    for stream_key, batch_key in twins.items():
        if batch_key in ORACLES:
            ORACLES[stream_key] = ORACLES[batch_key]
    if "e9_overflow" in ORACLES:
        ORACLES["i8_overflow_alerts"] = f"SELECT * FROM ({ORACLES['e9_overflow']}) t WHERE overflow"

