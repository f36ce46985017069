import json

from pyspark.sql import functions as F

from tierlens.operators import catalog as G
from tierlens.operators import provider_messages, tool_calls


def test_tool_call_extraction(spark):
    text = ('Let me look.\n<tool_call name="bash">{"command": "ls", "timeout": 5}</tool_call> then '
            '<tool_call name="write">{"write": {"path": "a.txt", "content": "hi"}}</tool_call>'
            '<tool_call name="bash">echo hi</tool_call><tool_call name="write">garbage</tool_call> Done.')
    df = spark.createDataFrame([(1, text)], "k long, text string")
    texts, calls, bad = tool_calls.extract_tool_calls(df, ["k"])
    assert [r.text for r in texts.orderBy("part_idx").collect()] == ["Let me look.", "then", "Done."]
    got = {r.call_index: (r.name, json.loads(r.a)) for r in calls.withColumn("a", F.to_json("arguments")).collect()}
    assert got[0] == ("bash", {"command": "ls", "timeout": 5})
    assert got[1] == ("write", {"path": "a.txt", "content": "hi"})
    assert got[2] == ("bash", {"command": "echo hi"})
    assert [r.call_index for r in bad.collect()] == [3]


def test_tool_arguments(spark):
    cases = [("read", '```json\n{"path": "/x"}\n```', {"path": "/x"}), ("bash", '{"cmd": "ls"}', {"command": "ls"}),
             ("write", "/tmp/file.txt", {"path": "/tmp/file.txt", "content": ""}), ("write", "nothing here", None),
             ("read", '{"a": {"b": {"c": {"d": {"e": {"path": "x"}}}}}}', {"path": "x"}), ("read", '{"path": {"deep": 1}}', {"path": {"deep": 1}}),
             ("read", '{"n": 3, "list": [1, {"x": true}]}', {"n": 3, "list": [1, {"x": True}]}), ("find", "[1]", None), ("find", "words", None),
             ("bash", "{}", {"command": "{}"}), ("bash", "", {"command": ""}), ("read", "", {}), ("write", "{}", None),
             ("path", '{"path": {"path": 1}}', {"path": 1}), ("write", 'path: /a/b\ncontent: "hello"', {"path": "/a/b", "content": "hello"})]
    df = spark.createDataFrame([(i, n, r) for i, (n, r, _) in enumerate(cases)], "i int, n string, r string")
    got = {r.i: r.a and json.loads(r.a) for r in df.select("i", F.to_json(tool_calls.tool_arguments(F.col("n"), F.col("r"))).alias("a")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_images_wait_for_the_next_message_and_only_a_last_user_message_is_marked(spark):
    def part(kind, text=None, data=None):
        return (kind, text, None, None, None, None, "image/png" if data else None, data)

    rows = [(1, 0, "user", [part("text", "hi")], None, False), (1, 1, "tool_result", [part("image", None, "A")], "c1", False),
            (1, 2, "tool_result", [part("text", "out"), part("image", None, "B")], "c2", False), (1, 3, "assistant", [part("text", "ok")], None, False),
            (2, 0, "assistant", [part("text", "x")], None, False), (2, 1, "user", [part("text", "y")], None, False)]
    df = spark.createDataFrame(rows, f"conv_id long, seq long, role string, parts {provider_messages.PARTS}, call_id string, is_error boolean")
    out = provider_messages.to_provider_messages(df, "openai-completions").filter("conv_id = 1").orderBy("seq", "sub").collect()
    assert [(r.seq, r.sub, r.out_role) for r in out] == [(0, 0, "user"), (1, 0, "tool"), (2, 0, "tool"), (2, 1, "user"), (3, 0, "assistant")]
    assert [b["text"] for b in out[3].blocks] == [provider_messages.IMAGES_FROM_TOOL, "data:image/png;base64,A", "data:image/png;base64,B"]
    assert out[1].blocks[0]["text"] == provider_messages.SEE_IMAGE
    marks = provider_messages.to_provider_messages(df, "anthropic").filter("cache_mark").collect()
    assert [(r.conv_id, r.seq) for r in marks] == [(2, 1)]


def test_query_list_parsing(spark):
    df = spark.createDataFrame([('ok ["a", "b"] end',), ('"x" and "y"',), ('[broken "p"',)], "r string")
    got = [r.q for r in df.select(G.parse_query_list(F.col("r")).alias("q")).collect()]
    assert got == [["a", "b"], ["x", "y"], ["p"]]


def test_model_lookup_priority(spark):
    req = spark.createDataFrame([("gpt-5.3-codex", "openai-codex"), ("gpt-5.3-codex", None),
                                 ("claude-sonnet-4.5", None), ("nope", None)], "model_id string, provider string")
    got = [(r.resolved_key, r.max_tokens) for r in G.resolve_models(req).collect()]
    assert ("gpt-5.3-codex", 16384) in got                      # key match wins without provider
    assert ("claude-sonnet-4.5-copilot", 16384) in got          # first id match; max tokens default
    assert (None, 16384) in got


def test_stop_reasons(spark):
    df = spark.createDataFrame([("anthropic", "end_turn"), ("openai-completions", "tool_calls"), ("anthropic", "weird")],
                               "layout string, raw string")
    got = [r.s for r in df.select(G.normalise_stop_reason(F.col("layout"), F.col("raw")).alias("s")).collect()]
    assert got == ["stop", "tool_use", "stop"]
