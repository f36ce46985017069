from pyspark.sql import Window
from pyspark.sql import functions as F

from tierlens.operators import ordered
from tierlens.operators import sessions as S


def _entries(spark, rows):
    return spark.createDataFrame(rows, "session_id long, seq long, type string, role string, text string, "
                                       "input_tokens long, output_tokens long, value string")


def test_overflow_boundaries(spark):
    # window 200000, max output 16000, buffer 20000 -> limit 184000
    e = _entries(spark, [(1, 1, "message", "assistant", "a", 183_999, 0, None),
                         (1, 2, "message", "assistant", "b", 184_000, 0, None)])
    got = {r.seq: r.overflow for r in S.overflow_turns(e, 200_000, 16_000, 20_000).collect()}
    assert got == {1: False, 2: True}


def test_compacted_view_keeps_messages_after_last_compaction(spark):
    e = _entries(spark, [
        (1, 0, "message", "user", "q1", None, None, None), (1, 1, "message", "assistant", "a1", 1, 1, None),
        (1, 2, "compaction", None, None, None, None, "first"), (1, 3, "message", "user", "q2", None, None, None),
        (1, 4, "compaction", None, None, None, None, "second"), (1, 5, "message", "user", "q3", None, None, None),
        (2, 0, "message", "user", "only", None, None, None)])
    v = S.compacted_view(e).orderBy("session_id", "part", "seq").collect()
    s1 = [(r.role, r.text) for r in v if r.session_id == 1]
    assert s1 == [("user", "What did we do so far?"), ("assistant", "second"), ("user", "q3")]
    assert [(r.role, r.text) for r in v if r.session_id == 2] == [("user", "only")]
    last = {r.session_id: r.last_assistant_text for r in S.last_assistant_text(S.compacted_view(e)).collect()}
    assert last[1] == "second"


def test_resolve_ids(spark):
    sessions = spark.createDataFrame([("abc123",), ("abd456",), ("xyz789",)], "session_key string")
    reqs = spark.createDataFrame([(1, "ABC123"), (2, "ab"), (3, " xy "), (4, "zzz"), (5, "  ")],
                                 "request_id int, request string")
    got = {r.request_id: (r.status, r.session_key) for r in S.resolve_ids(sessions, reqs).collect()}
    assert got == {1: ("exact", "abc123"), 2: ("ambiguous", None), 3: ("prefix", "xyz789"),
                   4: ("not_found", None), 5: ("empty", None)}


def test_chunked_scans_match_plain_windows(spark):
    rows = [(k, s, (s * 7 + k) % 5 if s % 3 else None) for k in range(3) for s in range(40)]
    df = spark.createDataFrame(rows, "k long, s long, v long")
    w = Window.partitionBy("k").orderBy("s")
    ref = (df.withColumn("sum_ref", F.sum(F.coalesce("v", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("last_ref", F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("prev_ref", F.lag("v").over(w)))
    for chunk in (1, 3, 7, 1 << 20):
        got = ordered.running_sum(df, "k", "s", F.coalesce(F.col("v"), F.lit(0)), "sum_got", chunk)
        got = ordered.running_last(got, "k", "s", F.col("v"), "last_got", chunk)
        got = ordered.previous(got, "k", "s", F.col("v"), "prev_got", chunk)
        j = got.join(ref, ["k", "s"]).collect()
        assert len(j) == len(rows)
        for r in j:
            assert (r.sum_got, r.last_got, r.prev_got) == (r.sum_ref, r.last_ref, r.prev_ref), (chunk, r)


def test_top_k_two_stage(spark):
    rows = [(g, i, (i * 37) % 101) for g in range(2) for i in range(500)]
    df = spark.createDataFrame(rows, "g long, i long, score long")
    top = ordered.top_k(df, "g", [F.col("score").desc()], 10, F.col("i"), buckets=16)
    got = sorted((r.g, r.rank, r.i) for r in top.collect())
    exp = []
    for g in range(2):
        best = sorted(range(500), key=lambda i: (-((i * 37) % 101), i))[:10]
        exp += [(g, n + 1, i) for n, i in enumerate(best)]
    assert got == sorted(exp)


def test_drop_noop_model_changes(spark):
    e = _entries(spark, [(1, 0, "model_change", None, None, None, None, "m1"),
                         (1, 1, "model_change", None, None, None, None, "m2"),
                         (1, 2, "model_change", None, None, None, None, "m2"),
                         (1, 3, "message", "user", "x", None, None, None)])
    kept = [r.seq for r in S.drop_noop_changes(e, initial_model="m1").orderBy("seq").collect()]
    assert kept == [1, 3]


def test_message_content_model_through_reader_and_operators(spark):
    import json

    from tierlens.operators import context
    from tierlens.runtime import scratch_dir
    from tierlens.sources import readers as R

    lines = [
        {"type": "header", "version": 1, "id": "s1", "timestamp": "t", "cwd": "/w"},
        {"type": "message", "id": "1", "message": {"role": "user", "content": [{"type": "text", "text": "look"}, {"type": "image", "data": "QUJD", "mime_type": "image/png"}]}},
        {"type": "thinking_level_change", "id": "2", "thinking_level": "high"},
        {"type": "model_change", "id": "3", "provider": "p", "model_id": "m", "base_url": "u"},
        {"type": "model_change", "id": "4", "provider": "q", "model_id": "m", "base_url": "u"},
        {"type": "message", "id": "5", "message": {"role": "assistant", "content": [
            {"type": "thinking", "thinking": "hm", "signature": "sg"}, {"type": "text", "text": "a"}, {"type": "text", "text": "b "},
            {"type": "tool_call", "id": "c1", "name": "read", "arguments": {"path": "x", "n": 1}}],
            "usage": {"input_tokens": 5, "output_tokens": 3, "cache_read_tokens": 7, "cache_write_tokens": 2}, "stop_reason": "tool_use"}},
        {"type": "message", "id": "6", "message": {"role": "tool_result", "tool_call_id": "c1", "tool_name": "read",
                                                  "content": [{"type": "text", "text": "line"}, {"type": "image", "data": "WFla", "mime_type": "image/png"}]}},
        {"type": "message", "id": "7", "message": {"role": "user", "content": "plain [text]"}}]
    out = scratch_dir(spark, "content")
    spark.createDataFrame([(json.dumps(x),) for x in lines], "value string").coalesce(1).write.text(out)
    e = R.entries_wide(R.read_session_logs(spark, out)[1]).cache()
    rows = {r.id: r for r in e.collect()}
    assert rows["5"].text == "ab " and rows["7"].text == "plain [text]" and rows["1"].text == "look"
    assert [(p["kind"], p["text"], p["signature"]) for p in rows["5"].parts][0] == ("thinking", "hm", "sg")
    assert json.loads(rows["5"].tool_calls[0]["arguments"]) == {"path": "x", "n": 1}
    c = S.counts(e).first()
    assert (c.n_user, c.n_assistant, c.n_tool_calls, c.n_tool_results) == (2, 1, 1, 1)
    assert S.token_totals(e).first().cached_tokens == 7
    used = S.overflow_turns(e, 20, 1, 3).first()
    assert used.tokens_before == 17 and not used.overflow
    at_end = {r.id: r for r in S.settings_in_effect(e).collect()}["7"]
    assert (at_end.model, at_end.thinking_level) == ("m", "high")
    assert {r.id for r in S.drop_noop_changes(e).filter("type = 'model_change'").collect()} == {"3", "4"}
    upto = e.filter("seq < 7").withColumn("conv_id", F.lit(1))
    assert context.latest_input(upto, order="seq").first().latest_input == "Tool result for read:\nline\nImage: WFla"
    assert S.last_assistant_text(S.compacted_view(e)).first().last_assistant_text == "ab"
