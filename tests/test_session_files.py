"""Session log files: one per session and chunk, names, order, repeated writes."""

import json
import os
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from tierlens.runtime import scratch_dir
from tierlens.sources import readers as R
from tierlens.sources import session_files as SF
from tierlens.sources import writers as W

WIDE = "session_id string, seq bigint, type string, role string, text string, input_tokens bigint, output_tokens bigint, value string"


def _entries(spark, lengths, answered=True):
    rows = [(s, i, "message", "assistant" if i % 2 and answered else "user", f"{s} line {i}", None, None, None)
            for s, n in lengths.items() for i in range(n)]
    return spark.createDataFrame(rows, WIDE)


def _heads(spark, cwds):
    return spark.createDataFrame([(s, c, "t") for s, c in cwds.items()], "session_id string, cwd string, created string")


def _files(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if f.endswith(".jsonl"))


@pytest.mark.parametrize("chunk", [3, 7, 1000])
def test_chunks_of_a_session_are_joined_in_order(spark, chunk):
    lengths = {"hot": 40, "b": 2, "c": 9}
    out = scratch_dir(spark, "chunks")
    W.write_session_logs(_heads(spark, dict.fromkeys(lengths, "/w/x")), _entries(spark, lengths), out, chunk)
    want = [f"cwd_key=w-x/{SF.file_name(s, k)}" for s, n in lengths.items() for k in range((n - 1) // chunk + 1)]
    assert _files(out) == sorted(want) and os.path.exists(f"{out}/_SUCCESS")
    heads, entries = R.read_session_logs(spark, out)
    assert heads.count() == 3
    got = sorted((r.session_id, r.seq, r.text) for r in R.entries_wide(entries).collect())
    assert got == sorted((s, i + 1, f"{s} line {i}") for s, n in lengths.items() for i in range(n))


def test_odd_ids_and_directories(spark):
    cwds = {"../up": "/a b/c", "x~00000001": None, "_hid": "", "\u00e9/%": "C:\\dir\\", ".dot": "/"}
    out = scratch_dir(spark, "odd")
    W.write_session_logs(_heads(spark, cwds), _entries(spark, dict.fromkeys(cwds, 2)), out)
    folders = {unquote(f.split("/")[0][len("cwd_key="):]) for f in _files(out)}
    assert folders == {"a b-c", "__HIVE_DEFAULT_PARTITION__", "C:-dir"} and len(_files(out)) == 5
    heads, entries = R.read_session_logs(spark, out)
    assert {r.session_id: r.cwd for r in heads.collect()} == cwds
    assert {(r.session_id, r.seq) for r in entries.collect()} == {(s, i) for s in cwds for i in (1, 2)}


def test_unanswered_sessions_empty_input_and_rewrite(spark):
    out = scratch_dir(spark, "again")
    both = _entries(spark, {"a": 3}).unionByName(_entries(spark, {"mute": 3}, answered=False))
    for _ in range(2):  # the second write replaces the first
        W.write_session_logs(_heads(spark, {"a": "/w", "mute": "/w", "none": "/w"}), both, out)
    assert _files(out) == ["cwd_key=w/session-a.jsonl"]
    first = json.loads(open(f"{out}/cwd_key=w/session-a.jsonl").readline())
    assert (first["type"], first["id"], first["cwd"]) == ("header", "a", "/w")
    W.write_session_logs(_heads(spark, {"a": "/w"}), both.filter(F.lit(False)), out)
    assert _files(out) == [] and os.path.exists(f"{out}/_SUCCESS")


def test_a_task_that_runs_again_replaces_its_files(spark, tmp_path):
    import pyarrow as pa

    def batches(upto):
        yield pa.record_batch({"cwd_key": ["w"] * upto, "session_id": ["s"] * upto, "chunk": [0] * upto, "value": [str(i) for i in range(upto)]})

    writer = SF.SessionFilesWriter(str(tmp_path), overwrite=False)

    def failing():
        yield from batches(2)
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        writer.write(failing())
    assert _files(tmp_path) == [] and os.listdir(tmp_path / "cwd_key=w") == []
    writer.write(batches(2))
    writer.write(batches(3))
    assert (tmp_path / "cwd_key=w/session-s.jsonl").read_text() == "0\n1\n2\n"
