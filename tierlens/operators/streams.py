"""Batch twins of the streamed-part operators: I5 message assembly, I6
argument-size progress rows, I7 stall detection. Their streaming versions
live in :mod:`tierlens.streaming.jobs` and must give the same rows.

Part schema: ``stream_id, seq, part_type (text / think / tool_call_start /
tool_call_delta / metadata / done / error), text, signature, call_id, name,
args_delta, stop_reason``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlens.functions.parsing import json_object
from tierlens.operators import ordered

# ---- FIXED VALUES ----------------------------------------------------------
ARGS_TOKEN_THRESHOLD = 20
ARGS_UPDATE_EVERY = 4
DEFAULT_STALL_SECONDS = 120
# ---- end of fixed values ---------------------------------------------------


def _content_parts(parts: DataFrame, chunk: int) -> DataFrame:
    """Parts that build content, in one ordered pass: orphan argument chunks
    (no open call) are dropped; ``new_block`` marks where a block starts and
    ``call_no`` counts tool-call starts so far.

    The last non-delta part before a row decides both: a delta belongs to an
    open call only when that part is a call start, and -- orphans being
    dropped -- the previous kept row has that part's kind."""
    kinds = parts.filter(F.col("part_type").isin("text", "think", "tool_call_start", "tool_call_delta"))
    non_delta = F.when(F.col("part_type") != "tool_call_delta", F.col("part_type"))

    def opens(prev, cur):
        return F.coalesce(prev != cur, F.lit(True)) | (cur == "tool_call_start")

    d = ordered.changes(kinds, "stream_id", "seq", non_delta, opens, "_lnd", "block_id",
                        sums=(((F.col("part_type") == "tool_call_start").cast("int"), "call_no"),), chunk=chunk)
    orphan = (F.col("part_type") == "tool_call_delta") & ~F.coalesce(F.col("_lnd") == "tool_call_start", F.lit(False))
    kind = F.when(F.col("part_type") == "text", "text").when(F.col("part_type") == "think", "thinking").otherwise("tool_call")
    return d.filter(~orphan).withColumn("kind", kind).drop("_lnd")


def assemble_messages(parts: DataFrame, chunk: int = ordered.DEFAULT_CHUNK) -> tuple[DataFrame, DataFrame]:
    """I5 (batch): streamed parts -> content blocks and one row per stream.

    A block is a run of parts of one kind; every tool-call start opens a new
    block and its argument chunks join the open call whatever their index.
    Blocks: text and thinking in stream order, then the tool calls; arguments
    that are not a JSON object become ``{}``. Stream stop reason: the last
    done part's (error parts make it ``error``); ``stop`` with tool calls
    becomes ``tool_use``."""
    d = _content_parts(parts, chunk)
    piece = F.when(F.col("kind") == "tool_call", F.coalesce(F.col("args_delta"), F.lit(""))).otherwise(F.coalesce("text", F.lit("")))
    blocks = d.groupBy("stream_id", "block_id").agg(
        F.first("kind").alias("kind"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", piece.alias("p")))), lambda x: x["p"]), "")
         .alias("_content"),
        F.max_by("call_id", F.when(F.col("part_type") == "tool_call_start", F.col("seq"))).alias("call_id"),
        F.max_by("name", F.when(F.col("part_type") == "tool_call_start", F.col("seq"))).alias("name"),
        F.max_by("signature", F.when(F.coalesce("signature", F.lit("")) != "", F.col("seq"))).alias("signature"))
    args = F.when(json_object(F.col("_content")).isNotNull(), F.col("_content")).otherwise(F.lit("{}"))
    blocks = (blocks.withColumn("content", F.when(F.col("kind") == "tool_call", args).otherwise(F.col("_content")))
                    .withColumn("position", F.when(F.col("kind") == "tool_call", F.lit(1 << 40) + F.col("block_id"))
                                .otherwise(F.col("block_id")))
                    .drop("_content"))
    ends = parts.groupBy("stream_id").agg(
        F.max_by("stop_reason", F.when(F.col("part_type") == "done", F.col("seq"))).alias("_done"),
        F.max(F.when(F.col("part_type") == "error", F.col("seq"))).alias("_err_seq"),
        F.max(F.when(F.col("part_type") == "done", F.col("seq"))).alias("_done_seq"))
    n_calls = blocks.groupBy("stream_id").agg(F.count(F.when(F.col("kind") == "tool_call", 1)).alias("n_tool_calls"))
    msg = ends.join(n_calls, "stream_id", "left").fillna(0, ["n_tool_calls"])
    base = (F.when(F.col("_err_seq").isNotNull() & (F.col("_done_seq").isNull() | (F.col("_err_seq") > F.col("_done_seq"))),
                   F.lit("error"))
             .otherwise(F.coalesce(F.col("_done"), F.lit("stop"))))
    msg = msg.withColumn("stop_reason", F.when((base == "stop") & (F.col("n_tool_calls") > 0), "tool_use").otherwise(base)) \
             .select("stream_id", "n_tool_calls", "stop_reason")
    return blocks, msg


def progress_rows(parts: DataFrame, chunk: int = ordered.DEFAULT_CHUNK) -> DataFrame:
    """For argument chunks of a tool call, the running chunk count and
    token estimate (characters // 4 per chunk), restarting at every call
    start; a progress row when the estimate exceeds 20 on every 4th chunk."""
    deltas = _content_parts(parts, chunk).filter(F.col("part_type") == "tool_call_delta")
    deltas = ordered.scan(deltas, ["stream_id", "call_no"], "seq", [
        ("sum", F.lit(1), "chunk_no", True),
        ("sum", F.floor(F.length(F.coalesce("args_delta", F.lit(""))) / 4).cast("bigint"), "tokens", True)], chunk)
    return deltas.filter((F.col("tokens") > ARGS_TOKEN_THRESHOLD) & (F.col("chunk_no") % ARGS_UPDATE_EVERY == 0)) \
                 .select("stream_id", "call_no", "seq", "chunk_no", "tokens")


def stalls(parts: DataFrame, timeout_s: int = DEFAULT_STALL_SECONDS, ts_col: str = "ts_s",
           chunk: int = ordered.DEFAULT_CHUNK) -> DataFrame:
    """I7 (batch): a stream with a tool call in progress that stays silent for
    more than ``timeout_s`` (0 or less disables) is closed at last part + timeout.
    The next part's time comes from a chunked look-back over negated ``seq``."""
    if timeout_s <= 0:
        return parts.limit(0).select("stream_id", "seq", F.lit(None).cast("bigint").alias("closed_at_s"))
    d = parts.withColumn("_neg", -F.col("seq"))
    d = ordered.previous(d, "stream_id", "_neg", F.col(ts_col), "_next_ts", chunk)
    in_call = F.col("part_type").isin("tool_call_start", "tool_call_delta")
    silent = F.col("_next_ts").isNull() | ((F.col("_next_ts") - F.col(ts_col)) > timeout_s)
    return d.filter(in_call & silent).select("stream_id", "seq", (F.col(ts_col) + timeout_s).cast("bigint").alias("closed_at_s"))
