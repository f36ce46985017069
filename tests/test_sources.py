import os

from pyspark.sql import functions as F

from tierlens.runtime import scratch_dir
from tierlens.sources import readers as R
from tierlens.sources import writers as W

HEADER = "turn,model_used,tokens_used,input_complexity,cumulative_cost"


def test_header_per_part_file_round_trip(spark):
    out = scratch_dir(spark, "hdr")
    line = F.concat_ws(",", F.col("id").cast("string"), F.lit("m"), F.lit("5"), F.lit("medium"), F.lit("0.1"))
    line = F.when(F.col("id") % 2 == 0, F.concat(line, F.lit(",0.9,ok"))).otherwise(line)
    df = spark.range(0, 1000, numPartitions=7).select(line.alias("value"))
    W.with_header_lines(df, HEADER).write.mode("overwrite").text(out)
    back = R.read_telemetry_csv(spark, out)
    r = back.agg(F.count(F.lit(1)).alias("n"), F.count("status").alias("s"), F.min("turn").alias("lo")).first()
    assert (r.n, r.s, r.lo) == (1000, 500, 0)
    assert len(spark.read.text(out).inputFiles()) == 7


def test_snapshot_documents_one_per_file_round_trip(spark):
    out = scratch_dir(spark, "snap")
    df = spark.range(0, 2000, numPartitions=4).select(
        (F.col("id") % 3).alias("day"), F.col("id").cast("string").alias("a"), (F.col("id") * 2).alias("b"))
    W.write_table_snapshots(df, ["a", "b"], out, ["day"], rows_per_doc=100)
    wide = R.pivot_snapshot(R.read_table_snapshot(spark, out), ["a", "b"])
    got = sorted((int(r.a), int(r.b)) for r in wide.collect())
    assert got == [(i, 2 * i) for i in range(2000)]
    assert len(spark.read.text(out).inputFiles()) > 3 * 4  # many documents, each in its own file


def test_line_numbers_survive_file_splits(spark):
    import os

    base = scratch_dir(spark, "lines")
    local = base.replace("file:", "")
    os.makedirs(local, exist_ok=True)
    with open(f"{local}/a.jsonl", "w") as fh:
        for i in range(3000):
            fh.write("" if i % 7 == 3 else f'{{"n": {i}, "pad": "{"x" * (i % 50)}"}}')
            fh.write("\n")
    with open(f"{local}/b.jsonl", "w") as fh:
        fh.write("first\nsecond\n\nfourth")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = R.numbered_file_lines(spark, local)
        assert df.rdd.getNumPartitions() > 10  # the big file is read in many splits
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    a = sorted((r.seq, r.line) for r in rows if r.file.endswith("a.jsonl"))
    assert [s for s, _ in a] == list(range(3000))
    assert all((line == "") == (s % 7 == 3) and (line == "" or f'"n": {s},' in line) for s, line in a)
    b = sorted((r.seq, r.line) for r in rows if r.file.endswith("b.jsonl"))
    assert b == [(0, "first"), (1, "second"), (2, ""), (3, "fourth")]


def test_newest_files_by_their_times(spark, tmp_path):
    for i in range(130):
        folder = tmp_path / f"d{i % 3}"
        folder.mkdir(exist_ok=True)
        for kind in ("json", "txt"):
            f = folder / f"{i}.{kind}"
            f.write_text("{}")
            os.utime(f, (1_000_000, 1_000_000 + i * 7919 % 130))
    order = sorted(range(130), key=lambda i: -(i * 7919 % 130))
    names = [r.path.rsplit("/", 1)[1] for r in R.list_files(spark, str(tmp_path), "*.json").collect()]
    assert names == [f"{i}.json" for i in order[:100]]
    assert len(R.list_files(spark, str(tmp_path), "*.json", 7).collect()) == 7


def test_listing_holds_every_conversation(spark, monkeypatch):
    from tierlens.plans.q_sources import a13_list_files

    sf, files, list_files = "/root/testdata/sf0.1", [], R.list_files

    def listed(spark, path, pattern):
        files.append(list_files(spark, path, pattern, 5000).count())
        return list_files(spark, path, pattern)

    monkeypatch.setattr(R, "list_files", listed)
    got = sorted(r.conv_id for r in a13_list_files(spark, sf).collect())
    ids = sorted(r.conv_id for r in spark.table("v_routed").select("conv_id").distinct().collect())
    assert files == [len(ids)] and len(ids) > 100 and got == ids[:100]


def test_session_lines_keep_every_field(spark):
    """Stored lines of every type, read, written and read again."""
    import json

    lines = [
        {"type": "header", "version": 1, "id": "s1", "timestamp": "2024-01-01T00:00:00", "cwd": "/work/a b"},
        {"type": "message", "id": "e1", "parent_id": None, "timestamp": "t1", "message": {"role": "user", "content": [
            {"type": "image", "mime_type": "image/png", "data": "QUJD"}, {"type": "text", "text": "what is \"this\"?\nsay"}]}},
        {"type": "message", "id": "e2", "parent_id": "e1", "timestamp": "t2", "message": {"role": "assistant", "content": [
            {"type": "thinking", "thinking": "hm", "signature": "sig"}, {"type": "text", "text": "a"},
            {"type": "tool_call", "id": "c1", "name": "read", "arguments": {"path": "/x", "n": 3}}],
            "stop_reason": "tool_use", "usage": {"input_tokens": 10, "output_tokens": 5, "cache_read_tokens": 7, "cache_write_tokens": 2}}},
        {"type": "message", "id": "e3", "parent_id": "e2", "timestamp": "t3", "message": {"role": "tool_result", "content": "[not json", "tool_call_id": "c1",
                                                                                          "tool_name": "read", "is_error": True}},
        {"type": "thinking_level_change", "id": "e4", "parent_id": "e3", "timestamp": "t4", "thinking_level": "high"},
        {"type": "model_change", "id": "e5", "parent_id": "e4", "timestamp": "t5", "provider": "p", "model_id": "m-2", "base_url": "http://b"},
        {"type": "compaction", "id": "e6", "parent_id": "e5", "timestamp": "t6", "summary": "so far", "first_kept_entry_id": "e3", "tokens_before": 900},
        {"type": "custom_message", "id": "e7", "parent_id": "e6", "timestamp": "t7", "custom_type": "note", "content": "hello", "display": False},
        {"type": "session_info", "id": "e8", "parent_id": "e7", "timestamp": "t8", "name": "my session"},
        {"type": "message", "id": "e9", "parent_id": "e8", "timestamp": "t9", "message": {"role": "user", "content": "plain"}}]
    first = scratch_dir(spark, "lines-in")
    spark.createDataFrame([(json.dumps(x),) for x in lines], "value string").coalesce(1).write.text(first)
    heads, entries = R.read_session_logs(spark, first)
    wide = R.entries_wide(entries)
    second = scratch_dir(spark, "lines-out")
    W.write_session_logs(heads.select("session_id", "cwd", "created"), wide, second)
    back = R.entries_wide(R.read_session_logs(spark, second)[1])

    def plain(x):  # arguments are JSON objects: the order of their keys is free
        if isinstance(x, (list, tuple)):
            return tuple(plain(y) for y in x)
        return json.dumps(json.loads(x), sort_keys=True) if isinstance(x, str) and x.startswith("{") else x

    a, b = (sorted((plain(r) for r in d.collect()), key=lambda r: r[1]) for d in (wide, back))
    assert a == b and len(a) == 9
    stored = [json.loads(r.value) for r in spark.read.text(second).collect()]
    message = next(x for x in stored if x.get("id") == "e2")["message"]
    assert message["content"][2] == {"type": "tool_call", "id": "c1", "name": "read", "arguments": {"path": "/x", "n": 3}}
    assert message["usage"]["cache_read_tokens"] == 7 and message["stop_reason"] == "tool_use"


def test_key_files_share_folders(spark):
    """One file a key whatever the number of keys, in a fixed number of folders; appended files stand beside them; a null key has a file."""
    out = scratch_dir(spark, "key-files")
    rows = spark.createDataFrame([(k, t, f"q{k}-{t}") for k in [*range(400), None] for t in (2, 0, 1)], "conv_id long, turn long, query string")
    W.write_key_files(rows.filter("conv_id is null or conv_id >= 10"), "conv_id", "turn", out, folders=16)
    W.write_key_files(rows.filter("conv_id < 10"), "conv_id", "turn", out, "append", folders=16)
    paths = [r.path for r in R.list_files(spark, out, "*.json", 1000).collect()]
    assert len(paths) == 401 and len({p.rsplit("/", 1)[0] for p in paths}) <= 16
    back = spark.read.schema("conv_id long, turn long, query string").json(paths)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    one = next(p for p in paths if p.endswith("session-7.json"))
    assert [r.value for r in spark.read.text(one).collect()] == [f'{{"conv_id":7,"turn":{t},"query":"q7-{t}"}}' for t in range(3)]
