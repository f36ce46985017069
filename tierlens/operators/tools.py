"""Tool-call operators: C4 call/result matching, C5 unregistered tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlens import dims

# ---- FIXED VALUES ----------------------------------------------------------
UNKNOWN_TOOL_PREFIX = "Unknown tool: "
# ---- end of fixed values ---------------------------------------------------


def match_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """C4: full outer equi-join of calls (session_id, seq, call_id, tool_name)
    and results (session_id, seq, call_id); calls without a result and results
    without a call are kept and flagged."""
    c = calls.select("session_id", "call_id", "tool_name", F.col("seq").alias("call_seq"), F.lit(True).alias("_c"))
    r = results.select("session_id", "call_id", F.col("seq").alias("result_seq"), F.lit(True).alias("_r"))
    j = c.join(r, ["session_id", "call_id"], "full_outer")
    return j.select("session_id", "call_id", "tool_name", "call_seq", "result_seq",
                    (F.col("_c").isNotNull() & F.col("_r").isNull()).alias("call_without_result"),
                    F.col("_c").isNull().alias("result_without_call"))


def unregistered_calls(calls: DataFrame, registered: list[str] | None = None) -> DataFrame:
    """Calls whose tool is not registered become error results. The
    registry is a fixed list, so the anti join is against a broadcast literal."""
    spark = calls.sparkSession
    names = registered or dims.TOOLS
    reg = F.broadcast(spark.createDataFrame([(n,) for n in names], "tool_name string"))
    bad = calls.join(reg, "tool_name", "left_anti")
    return bad.select("session_id", "seq", "call_id", "tool_name",
                      F.concat(F.lit(UNKNOWN_TOOL_PREFIX), F.col("tool_name")).alias("error"),
                      F.lit(True).alias("is_error"))
