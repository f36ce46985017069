"""Streaming operators.

Stateless steps reuse the batch operators on the stream (Catalyst plans them
incrementally). Keyed state (I4, I5, I7, I9) uses ``applyInPandasWithState``
over buckets of keys (:mod:`tierlens.streaming.buckets`): rows of one key in a
micro-batch are sorted by ``seq`` before they touch the key's state, and the
state is checkpointed with the query. ``foreachBatch`` sinks
(I1, I2, I3, I10) key every write by the batch id, so a replayed batch
overwrites its own output instead of duplicating it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from tierlens import dims
from tierlens.functions.parsing import json_object
from tierlens.operators import cost
from tierlens.operators import feedback as fb
from tierlens.operators import sessions as S
from tierlens.sources import readers as R
from tierlens.sources import writers as W
from tierlens.streaming.buckets import Keyed, per_key, stateful


# ---------------------------------------------------------------- I1 / I2 / I10
def ingest_feedback(batch: DataFrame, batch_id: int, accepted_path: str, quarantine_path: str) -> None:
    """Validate one micro-batch (B7) and write accepted / rejected rows
    under ``batch=<id>``."""
    ok, bad = fb.accept(batch)
    W.write_feedback_batch(ok, accepted_path, batch_id)
    W.write_feedback_batch(bad, quarantine_path, batch_id)


def last_closed(spark: SparkSession, batch_id: int, triggers_path: str) -> int:
    """The newest batch before ``batch_id`` whose trigger closed the open entries (-1: none)."""
    try:
        found = spark.read.schema("n_archived long, batch_id long").json(triggers_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # only a missing folder means that nothing is closed yet
            raise
        return -1
    last = found.filter(F.col("batch_id") < batch_id).agg(F.max("batch_id")).first()[0]
    return -1 if last is None else last


def retrain_step(spark: SparkSession, batch_id: int, accepted_path: str, archive_path: str, triggers_path: str,
                 key_cols, threshold: int = dims.FEEDBACK_THRESHOLD) -> None:
    """After a batch lands, if the open entries (those of the batches since
    the last trigger) reach the threshold, archive them under
    ``archive_ts=batch-<id>`` and record a trigger row, which starts the count
    from zero. Only those batches' folders are read, however long the history.
    Keyed by batch id, so a replay rewrites the same partitions."""
    schema = T.StructType(R.FEEDBACK.fields + [T.StructField(c, T.LongType()) for c in key_cols]
                          + [T.StructField("batch", T.LongType())])
    since = last_closed(spark, batch_id, triggers_path)
    open_rows = spark.read.schema(schema).json(accepted_path).filter(F.col("batch").between(since + 1, batch_id))
    n_open = open_rows.count()
    if n_open >= threshold:
        W.close_batch(open_rows.drop("batch"), archive_path, f"batch-{batch_id}")
        trig = spark.createDataFrame([(batch_id, n_open)], "batch_id long, n_archived long")
        (trig.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("batch_id").json(triggers_path))


SNAPSHOT_ROWS_PER_DOC = 10_000
#: Parts of a level that are merged into one of the next; a row is rewritten once a level.
SNAPSHOT_MERGE = 8
SNAPSHOT_COLUMNS = ["timestamp", "query", "predicted_tier", "corrected_tier", "confidence", "status"]
_PART = "snapshot long, first long, last long"


def snapshot_parts(spark: SparkSession, path: str, snapshot: int | None = None) -> list[tuple[int, int]]:
    """The (first, last batch) parts that make up a snapshot, the newest by
    default: per batch the part of most batches that was complete by then."""
    try:
        found = spark.read.schema(_PART).json(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    rows = [(r["first"], r["last"]) for r in found.distinct().collect() if snapshot is None or r["snapshot"] <= snapshot]  # a row a part
    out: list[tuple[int, int]] = []
    for first, last in sorted(rows, key=lambda r: (r[0], -r[1])):
        if not out or last > out[-1][1]:
            out.append((first, last))
    return out


def _add_part(rows: DataFrame, path: str, snapshot: int, first: int, last: int) -> None:
    """Write the documents of one part, then the manifest row that makes it visible."""
    W.write_table_snapshots(rows, SNAPSHOT_COLUMNS, f"{path}/documents/part={first:08d}-{last:08d}", rows_per_doc=SNAPSHOT_ROWS_PER_DOC)
    row = rows.sparkSession.createDataFrame([(snapshot, first, last)], _PART)
    row.write.mode("overwrite").json(f"{path}/manifest/part={first:08d}-{last:08d}")


def read_snapshot(spark: SparkSession, path: str, snapshot: int | None = None) -> DataFrame:
    """The rows of a snapshot (the newest by default), one column per field, as strings."""
    parts = snapshot_parts(spark, path, snapshot)
    if not parts:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in SNAPSHOT_COLUMNS))
    files = [f"{path}/documents/part={a:08d}-{b:08d}" for a, b in parts]
    return R.pivot_snapshot(R.read_table_snapshot(spark, files), SNAPSHOT_COLUMNS).select(*SNAPSHOT_COLUMNS)


def refresh_snapshot(batch: DataFrame, batch_id: int, path: str) -> None:
    """The rows of a batch become documents of their own, and a manifest row
    makes them part of snapshot ``batch_id``: what a batch writes does not grow
    with the history. Every :data:`SNAPSHOT_MERGE` parts of a level are merged
    into one, so a snapshot has a logarithmic number of parts. Rows are spread
    over documents of about 10 000 rows, one file each. A replayed batch
    overwrites its own part."""
    spark = batch.sparkSession
    _add_part(batch, path, batch_id, batch_id, batch_id)
    size = SNAPSHOT_MERGE
    while (batch_id + 1) % size == 0:
        first = batch_id + 1 - size
        step = size // SNAPSHOT_MERGE
        files = [f"{path}/documents/part={a:08d}-{a + step - 1:08d}" for a in range(first, batch_id + 1, step)]
        rows = R.pivot_snapshot(R.read_table_snapshot(spark, files), SNAPSHOT_COLUMNS)
        _add_part(rows, path, batch_id, first, batch_id)
        size *= SNAPSHOT_MERGE


# ---------------------------------------------------------------- I3
ROI_OUT = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("epoch", T.LongType())] + [
    T.StructField(c, T.LongType()) for c in ("total_turns", "actual_total_nano", "baseline_total_nano", "model_cost_nano", "summarisation_nano")])
ROI_STATE = T.StructType([f for f in ROI_OUT.fields[1:]])


def _roi_state(key, pdfs, state):
    """Totals of a session's current epoch; a reset ends it and starts the next at zero."""
    import numpy as np
    import pandas as pd

    epoch, *totals = state.get if state.exists else (0, 0, 0, 0, 0, 0)
    pdf = pd.concat(list(pdfs)).sort_values("seq")
    resets = (pdf["kind"] == "reset").to_numpy()
    after = np.cumsum(resets)
    out = []
    for k in range(int(after[-1]) + 1):
        own = pdf[(after == k) & ~resets]
        if k:
            epoch, totals = epoch + 1, [0] * 5
        if not len(own):
            continue
        summary = (own["kind"] == "summary").to_numpy()
        cost, base = own["actual_cost_nano"].to_numpy(), own["baseline_cost_nano"].to_numpy()
        step = ((~summary).sum(), cost.sum(), base.sum(), cost[~summary].sum(), cost[summary].sum())
        totals = [int(a + b) for a, b in zip(totals, step)]
        out.append((int(key[0]), int(epoch), *totals))
    state.update((int(epoch), *totals))
    yield pd.DataFrame(out, columns=[f.name for f in ROI_OUT.fields])


def session_roi_updates(stream: DataFrame) -> DataFrame:
    """Running ROI per session and epoch over a stream of session events
    (``conv_id, seq, kind, tier, input_tokens, output_tokens``): calls, calls that
    summarise (costed apart, no turns) and resets, which zero the totals and
    start a new epoch. Keyed state holds the epoch and its totals; every batch
    emits the totals of the epochs that it touched. An epoch without calls has no row."""
    priced = cost.turn_roi(stream).select("conv_id", "seq", "kind", "actual_cost_nano", "baseline_cost_nano")
    return priced.groupBy("conv_id").applyInPandasWithState(_roi_state, ROI_OUT, ROI_STATE, "update", GroupStateTimeout.NoTimeout)


def upsert_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Update-mode rows of one micro-batch written under ``batch_id=<id>``."""
    batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite") \
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def latest_per_key(spark: SparkSession, path: str, keys) -> DataFrame:
    """The newest update of every key from an update log."""
    log = spark.read.parquet(path)
    vals = [c for c in log.columns if c not in list(keys) + ["batch_id"]]
    g = log.groupBy(*keys).agg(F.max_by(F.struct(*vals), "batch_id").alias("_v"))
    return g.select(*keys, "_v.*")


def roi_columns(df: DataFrame) -> DataFrame:
    savings = F.col("baseline_total_nano") - F.col("actual_total_nano")
    return df.withColumn("savings_nano", savings).withColumn(
        "roi_pct", F.when(F.col("baseline_total_nano") > 0,
                          F.round(savings.cast("double") * 100.0 / F.col("baseline_total_nano").cast("double"), 9))
        .otherwise(F.lit(0.0)))


# ---------------------------------------------------------------- I4
PIVOT_OUT = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                          T.StructField("prev_tier", T.IntegerType()), T.StructField("is_pivot", T.BooleanType())])
PIVOT_STATE = T.StructType([T.StructField("last_tier", T.IntegerType()), T.StructField("ts_s", T.LongType())])
#: A conversation silent for so long is over: its state goes, and a later turn starts a new one.
IDLE_S = 7 * 24 * 3600


def _timed(stream: DataFrame, watermark: str) -> DataFrame:
    return stream.withColumn("event_time", F.timestamp_seconds("ts_s")).withWatermark("event_time", watermark)


def _keep(state, value: tuple, ts: int, idle_s: int) -> None:
    """Keep state until the watermark is ``idle_s`` past its last row."""
    state.update((*value, ts))
    state.setTimeoutTimestamp(max(ts * 1000, state.getCurrentWatermarkMs()) + idle_s * 1000)


def _pivots(idle_s: int) -> Keyed:
    def step(conv, rows, state):
        if state.hasTimedOut:
            state.remove()
            return []
        last, before = state.get if state.exists else (None, None)
        out = []
        for turn, tier, ts in rows:
            if before is not None and ts - before > idle_s:
                last = None
            out.append((conv, turn, last, last is not None and tier != last))
            last, before = tier, ts
        _keep(state, (last,), before, idle_s)
        return out
    return Keyed(step, "conv_id", "turn", ("turn", "tier", "ts_s"), PIVOT_OUT, PIVOT_STATE)


def _pivot_fn(idle_s: int):
    return per_key(_pivots(idle_s))


def pivot_stream(stream: DataFrame, idle_s: int = IDLE_S, watermark: str = "0 seconds") -> DataFrame:
    """I4: tier pivots with the last tier kept in keyed state (``conv_id, turn,
    tier, ts_s``). A turn more than ``idle_s`` seconds of event time after the
    one before has no previous tier, whatever batch it comes in; once the
    watermark is that far, the state is gone. Turns older than the watermark are
    dropped."""
    return stateful(_timed(stream, watermark), _pivots(idle_s))


# ---------------------------------------------------------------- I9
COMPACT_OUT = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                            T.StructField("call_no", T.LongType()), T.StructField("compact_before", T.BooleanType())])
COMPACT_STATE = T.StructType([T.StructField("entries", T.LongType()), T.StructField("calls", T.LongType()), T.StructField("ts_s", T.LongType())])


def _compactions(interval: int, idle_s: int) -> Keyed:
    def step(conv, rows, state):
        if state.hasTimedOut:
            state.remove()
            return []
        entries, calls, before = state.get if state.exists else (0, 0, None)
        out = []
        for turn, ts in rows:
            if before is not None and ts - before > idle_s:
                entries = calls = 0
            before = ts
            calls += 1
            fire = entries >= interval
            if fire:
                entries = 1
            entries += 2
            out.append((conv, turn, calls, fire))
        _keep(state, (entries, calls), before, idle_s)
        return out
    return Keyed(step, "conv_id", "turn", ("turn", "ts_s"), COMPACT_OUT, COMPACT_STATE)


def _compact_state_fn(interval: int, idle_s: int):
    return per_key(_compactions(interval, idle_s))


def compaction_stream(stream: DataFrame, interval: int = dims.SUMMARY_INTERVAL, idle_s: int = IDLE_S,
                      watermark: str = "0 seconds") -> DataFrame:
    """The router log's entry count per conversation in keyed state: before
    a call, a log of ``interval`` or more entries is compacted to one summary;
    every call adds two entries. A log silent for more than ``idle_s`` seconds is
    closed as in :func:`pivot_stream`: a later call starts one at zero."""
    return stateful(_timed(stream, watermark), _compactions(interval, idle_s))


# ---------------------------------------------------------------- I5
#: One row per part that belongs to a block, and one that closes the message.
PIECE_OUT = T.StructType([
    T.StructField("stream_id", T.LongType()), T.StructField("message", T.LongType()), T.StructField("seq", T.LongType()),
    T.StructField("position", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("piece", T.StringType()),
    T.StructField("name", T.StringType()), T.StructField("call_id", T.StringType()), T.StructField("signature", T.StringType()),
    T.StructField("stop_reason", T.StringType())])
#: A message whose last part is so much older than the watermark is closed as it is.
SILENT_S = 600
#: Calls stand after text: their positions start here.
CALLS_FROM = 1 << 40
BLOCK_STATE = T.StructType([T.StructField("message", T.LongType()), T.StructField("n", T.LongType()), T.StructField("kind", T.StringType()),
                            T.StructField("calls", T.LongType()), T.StructField("err", T.BooleanType())])


def _assemble(sid, rows, state):
    """State is the open block's number and kind: a few bytes however long the message."""
    message, n, kind, calls, err = state.get if state.exists else (None, 0, None, 0, False)
    out, last, done, stop = [], 0, False, None
    for seq, t, text, signature, call_id, name, args_delta, stop_reason, ts in rows:
        last = max(last, ts)
        new = {"text": "text", "think": "thinking", "tool_call_start": "tool_call"}.get(t)
        if new is not None:
            message = seq if message is None else message
            start = t == "tool_call_start"
            if start or kind != new:
                n, kind, calls = n + 1, new, calls + start
            place = n + (CALLS_FROM if kind == "tool_call" else 0)
            out.append((sid, message, seq, place, kind, "" if start else text or "", name if start else None,
                        call_id if start else None, None if start else signature, None))
        elif t == "tool_call_delta":
            if kind == "tool_call":
                out.append((sid, message, seq, n + CALLS_FROM, kind, args_delta or "", None, None, None, None))
        elif t == "done":
            stop, err, done = stop_reason, False, True
        elif t == "error":
            err = True
    if not done and not state.hasTimedOut:
        if message is not None:  # an error after the message was closed opens none
            state.update((message, n, kind, calls, err))
            state.setTimeoutTimestamp(max(last * 1000, state.getCurrentWatermarkMs()) + SILENT_S * 1000)
    else:
        if state.exists:
            state.remove()
        if message is not None:
            stop = "error" if err else (stop or "stop")
            stop = "tool_use" if stop == "stop" and calls else stop
            out.append((sid, message, None, None, None, None, None, None, None, stop))
    return out


_ASSEMBLE = Keyed(_assemble, "stream_id", "seq", ("seq", "part_type", "text", "signature", "call_id", "name", "args_delta", "stop_reason", "ts_s"),
                  PIECE_OUT, BLOCK_STATE)
_assemble_fn = per_key(_ASSEMBLE)


def assemble_stream(stream: DataFrame) -> DataFrame:
    """I5 (stream): every part is numbered with its block in keyed state and
    passed on once (:data:`PIECE_OUT`); a message is closed by a row with its
    stop reason when its ``done`` part arrives, or when the watermark is
    :data:`SILENT_S` past its last part (``ts_s``, seconds), so no state stays
    for ever. Parts after such a silence open a new message of the stream.
    :func:`assembled_blocks` joins the pieces of closed messages."""
    return stateful(_timed(stream, "0 seconds"), _ASSEMBLE)


def assembled_blocks(pieces: DataFrame) -> DataFrame:
    """Blocks of the closed messages in a log of :func:`assemble_stream`:
    ``stream_id, message, position, kind, content, name, call_id, signature,
    stop_reason``; call arguments that are no JSON object become ``{}``."""
    closed = pieces.filter("stop_reason is not null").select("stream_id", "message", "stop_reason")
    blocks = pieces.filter("stop_reason is null").groupBy("stream_id", "message", "position").agg(
        F.min("kind").alias("kind"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda x: x.piece), "").alias("content"),
        F.max("name").alias("name"), F.max("call_id").alias("call_id"),
        F.max_by("signature", F.when(F.col("signature") != "", F.col("seq"))).alias("signature"))
    content = F.when((F.col("kind") == "tool_call") & json_object(F.col("content")).isNull(), F.lit("{}")).otherwise(F.col("content"))
    return blocks.join(closed, ["stream_id", "message"]).withColumn("content", content)


# ---------------------------------------------------------------- I7
STALL_OUT = T.StructType([T.StructField("stream_id", T.LongType()), T.StructField("seq", T.LongType()),
                          T.StructField("closed_at_s", T.LongType())])
STALL_STATE = T.StructType([T.StructField("seq", T.LongType()), T.StructField("ts_s", T.LongType())])


def _stalls(timeout_s: int) -> Keyed:
    def step(sid, rows, state):
        pending = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            return [(sid, pending[0], pending[1] + timeout_s)]
        out = []
        for seq, part, ts in rows:
            if pending is not None and ts - pending[1] > timeout_s:
                out.append((sid, pending[0], pending[1] + timeout_s))
            pending = (seq, ts) if part in ("tool_call_start", "tool_call_delta") else None
        if pending is not None:
            state.update(pending)
            state.setTimeoutTimestamp((pending[1] + timeout_s) * 1000 + 1)
        elif state.exists:
            state.remove()
        return out
    return Keyed(step, "stream_id", "seq", ("seq", "part_type", "ts_s"), STALL_OUT, STALL_STATE)


def stall_stream(stream: DataFrame, timeout_s: int = 120, watermark: str = "0 seconds") -> DataFrame:
    """I7 (stream): a call in progress followed by silence longer than the
    timeout is closed; event-time timeouts fire once the watermark passes."""
    return stateful(_timed(stream, watermark), _stalls(timeout_s))


# ---------------------------------------------------------------- I8 / I11
def overflow_alerts(stream: DataFrame, **limits) -> DataFrame:
    """I8: the stateless overflow check (E9) applied to arriving turns; only alerts pass."""
    return S.overflow_turns(stream, **limits).filter("overflow")


def telemetry_records(stream: DataFrame) -> DataFrame:
    """Per-turn telemetry records appended as they arrive (costs priced
    on the way); the running total is computed when the table is read (E1)."""
    return cost.price_calls(stream, "roi", out="actual_cost_nano")
