import pandas as pd

from tierlens.operators import streams as ST
from tierlens.streaming import buckets as B
from tierlens.streaming import harness as H
from tierlens.streaming import jobs as J


class _State:
    def __init__(self):
        self.value, self.exists, self.hasTimedOut, self.timeout_ms = None, False, False, None

    def setTimeoutTimestamp(self, ms):
        self.timeout_ms = ms

    def getCurrentWatermarkMs(self):
        return 0

    @property
    def get(self):
        return self.value

    def update(self, v):
        self.value, self.exists = v, True

    def remove(self):
        self.value, self.exists = None, False


COLS = ["stream_id", "seq", "part_type", "text", "signature", "call_id", "name", "args_delta", "stop_reason"]
PARTS = [
    (1, 0, "text", "Hel", None, None, None, None, None),
    (1, 1, "tool_call_delta", None, None, None, None, "orphan", None),   # no open call: dropped
    (1, 2, "text", "lo", None, None, None, None, None),
    (1, 3, "think", "hmm", "sig", None, None, None, None),
    (1, 4, "tool_call_start", None, None, "c1", "read", None, None),
    (1, 5, "tool_call_delta", None, None, None, None, '{"path": ', None),
    (1, 6, "tool_call_delta", None, None, None, None, '"/x"}', None),
    (1, 7, "tool_call_start", None, None, "c2", "bash", None, None),
    (1, 8, "tool_call_delta", None, None, None, None, "{bad", None),
    (1, 9, "text", "bye", None, None, None, None, None),
    (1, 10, "done", None, None, None, None, None, "stop"),
]


def _blocks(spark, frames):
    log = spark.createDataFrame(pd.concat(frames).astype(object).where(lambda x: x.notna(), None).to_dict("records"), J.PIECE_OUT)
    return J.assembled_blocks(log).collect()


def test_batch_assembly_matches_stream_state_machine(spark):
    df = spark.createDataFrame(PARTS, ", ".join(f"{c} {'long' if c in ('stream_id', 'seq') else 'string'}" for c in COLS))
    pdf = pd.DataFrame(PARTS, columns=COLS).assign(ts_s=100)
    for chunk in (2, 3, 1 << 20):
        blocks, msg = ST.assemble_messages(df, chunk)
        got = sorted((r.position, r.kind, r.content, r.name, r.call_id, r.signature) for r in blocks.collect())
        st, out = _State(), []
        for a in range(0, len(pdf), min(chunk, 11)):  # the same parts in micro-batches of any size
            out += J._assemble_fn((1,), iter([pdf.iloc[a:a + chunk]]), st)
        assert not st.exists and sum(len(o) for o in out) == 10  # nine parts of blocks, once each, and the closing row
        exp = sorted((r.position, r.kind, r.content, r.name, r.call_id, r.signature) for r in _blocks(spark, out))
        assert got == exp, chunk
        assert [(b[1], b[2]) for b in got] == [("text", "Hello"), ("thinking", "hmm"), ("text", "bye"),
                                               ("tool_call", '{"path": "/x"}'), ("tool_call", "{}")]
        m = msg.first()
        assert (m.n_tool_calls, m.stop_reason) == (2, "tool_use")


def test_stream_without_done_is_emitted_after_silence_and_late_errors_open_nothing(spark):
    st = _State()
    first = pd.DataFrame([p for p in PARTS[:4]], columns=COLS).assign(ts_s=[100, 101, 102, 103])
    out = list(J._assemble_fn((1,), iter([first]), st))
    assert st.exists and st.timeout_ms == (103 + J.SILENT_S) * 1000 and _blocks(spark, out) == []
    st.hasTimedOut = True
    out += J._assemble_fn((1,), iter([]), st)
    assert sorted((r.position, r.kind, r.content, r.signature, r.stop_reason) for r in _blocks(spark, out)) == [
        (1, "text", "Hello", None, "stop"), (2, "thinking", "hmm", "sig", "stop")]
    assert not st.exists
    late = _State()
    error = pd.DataFrame([(1, 11, "error", None, None, None, None, None, None)], columns=COLS).assign(ts_s=200)
    assert list(J._assemble_fn((1,), iter([error]), late)) == [] and not late.exists


def test_state_does_not_grow_with_the_message():
    st = _State()
    sizes = []
    for a in range(0, 3000, 1000):
        parts = pd.DataFrame([(1, a + i, "text", "x" * 50, None, None, None, None, None) for i in range(1000)], columns=COLS).assign(ts_s=100 + a)
        assert sum(len(o) for o in J._assemble_fn((1,), iter([parts]), st)) == 1000
        sizes.append(len(repr(st.value)))
    assert max(sizes) == min(sizes)


def _turns(*rows):
    return iter([pd.DataFrame(rows, columns=["turn", "tier", "ts_s"])])


def test_idle_conversations_leave_the_state_and_start_anew():
    fn, st = J._pivot_fn(100), _State()
    out = pd.concat(fn((1,), _turns((0, 2, 10), (1, 3, 20)), st))
    assert out["is_pivot"].tolist() == [False, True] and st.timeout_ms == (20 + 100) * 1000
    late = pd.concat(fn((1,), _turns((2, 1, 200)), st))  # the state is still there, the pause counts all the same
    assert late["prev_tier"].isna().all() and not late["is_pivot"].any()
    st.hasTimedOut = True
    assert list(fn((1,), iter([]), st)) == [] and not st.exists
    st.hasTimedOut = False
    assert pd.concat(fn((1,), _turns((3, 2, 400), (4, 2, 410)), st))["prev_tier"].isna().tolist() == [True, False]
    fn, st = J._compact_state_fn(4, 100), _State()
    assert pd.concat(fn((1,), _turns((0, 1, 0), (1, 1, 1), (2, 1, 2)), st))["compact_before"].tolist() == [False, False, True]
    assert pd.concat(fn((1,), _turns((3, 1, 500)), st))["call_no"].tolist() == [1]


def test_expired_keys_leave_the_state_store(spark):
    """Old conversations end when the watermark passes; the store keeps the live one only."""
    w = H.workdir(spark, "idle-test")
    schema = "conv_id long, turn long, tier int, ts_s long"
    rows = [(c, 0, 1, 1000 + c) for c in range(20)] + [(99, 0, 1, 5000), (99, 1, 2, 5010), (99, 2, 2, 5020), (3, 1, 2, 9000)]
    query = None
    for batch in ([r for r in rows if r[3] < 2000], rows[20:21], rows[21:23], rows[23:]):
        spark.createDataFrame(batch, schema).write.mode("append").json(w["input"])
        query = J.pivot_stream(H.file_stream(spark, w["input"], schema), idle_s=600).writeStream.format("parquet").option("path", w["out"]) \
            .option("checkpointLocation", w["ckpt"]).trigger(availableNow=True).start()
        query.awaitTermination()
    kept = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    assert kept[-1] <= 1  # conversation 99 has ended too, 3 is live again
    got = {(r.conv_id, r.turn): (r.prev_tier, r.is_pivot) for r in spark.read.parquet(w["out"]).collect()}
    assert got[(99, 1)] == (1, True) and got[(3, 1)] == (None, False) and len(got) == 24


def test_reset_starts_an_epoch_and_summaries_are_costed_apart():
    cols = ["conv_id", "seq", "kind", "actual_cost_nano", "baseline_cost_nano"]
    st = _State()

    def feed(*rows):
        frames = list(J._roi_state((7,), iter([pd.DataFrame([(7, *r) for r in rows], columns=cols)]), st))
        return [tuple(r) for r in pd.concat(frames).itertuples(index=False)]

    assert feed((2, "summary", 5, 9), (1, "call", 10, 40), (3, "call", 20, 40)) == [(7, 0, 2, 35, 89, 30, 5)]
    assert feed((4, "call", 1, 1), (5, "reset", 0, 0), (6, "reset", 0, 0), (7, "summary", 2, 3)) == [(7, 0, 3, 36, 90, 31, 5), (7, 2, 0, 2, 3, 0, 2)]
    assert feed((8, "reset", 0, 0)) == [] and st.value == (3, 0, 0, 0, 0, 0)


def test_snapshot_writes_only_its_batch_and_merges_levels(spark, monkeypatch):
    monkeypatch.setattr(J, "SNAPSHOT_MERGE", 3)
    path = H.workdir(spark, "snapshot-test")["out"]

    def rows(b):
        return spark.createDataFrame([(f"t{b}", f"q{b}-{i}", 1, 2, 0.5, "corrected") for i in range(5)],
                                     "timestamp string, query string, predicted_tier int, corrected_tier int, confidence double, status string")

    for b in range(10):
        J.refresh_snapshot(rows(b), b, path)
        if b == 4:
            J.refresh_snapshot(rows(b), b, path)  # a replay
        assert J.read_snapshot(spark, path).count() == 5 * (b + 1)
    assert J.snapshot_parts(spark, path) == [(0, 8), (9, 9)]
    assert J.snapshot_parts(spark, path, 6) == [(0, 2), (3, 5), (6, 6)]
    assert J.read_snapshot(spark, path, 6).count() == 35
    got = {(r.timestamp, r.query, r.confidence) for r in J.read_snapshot(spark, path).collect()}
    assert got == {(f"t{b}", f"q{b}-{i}", "0.5") for b in range(10) for i in range(5)}
    assert J.read_snapshot(spark, path + "-none").count() == 0


def test_trigger_reads_batches_since_the_last_one(spark):
    w = H.workdir(spark, "trigger-test")
    acc, arch, trig = (f"{w['out']}/{x}" for x in ("accepted", "archive", "triggers"))
    for b in range(6):
        entries = spark.createDataFrame([(f"q{b}{i}", 1, 2, 0.5, None, "t", False, b, i) for i in range(3)],
                                        "query string, predicted_tier int, corrected_tier int, confidence double, notes string, timestamp string, "
                                        "is_correct boolean, conv_id long, turn long")
        J.W.write_feedback_batch(entries, acc, b)
        J.retrain_step(spark, b, acc, arch, trig, ["conv_id", "turn"], threshold=8)
    got = sorted(tuple(r) for r in spark.read.schema("n_archived long, batch_id long").json(trig).collect())
    assert got == [(9, 2), (9, 5)]
    J.retrain_step(spark, 5, acc, arch, trig, ["conv_id", "turn"], threshold=8)  # a replay of the batch
    assert sorted(tuple(r) for r in spark.read.schema("n_archived long, batch_id long").json(trig).collect()) == got
    assert J.last_closed(spark, 5, trig) == 2


def test_keys_of_a_bucket_give_what_each_gives_alone():
    """Rows of many keys in one group, batch by batch: each key's rows, state and timeout stay its own."""
    keys, alone, bucket = range(5), {k: _State() for k in range(5)}, _State()
    both = B.per_bucket(J._ASSEMBLE)
    got, expected = [], []
    for a in (0, 4, 8):  # key 3 falls silent after its first parts, key 4 comes late
        frames = [pd.DataFrame([(k, *p[1:]) for p in PARTS[a:a + 4]], columns=COLS).assign(ts_s=100 + a) for k in keys if (k != 3 or a == 0) and (k != 4 or a == 8)]
        for f in frames:
            expected += J._assemble_fn((int(f.stream_id.iloc[0]),), iter([f]), alone[int(f.stream_id.iloc[0])])
        mixed = pd.concat(frames).sample(frac=1, random_state=a)
        got += both((0,), iter([mixed.iloc[:7], mixed.iloc[7:]]), bucket)
    assert not any(alone[k].exists for k in (0, 1, 2, 4)) and alone[3].exists
    assert bucket.get[0] == [3] and bucket.timeout_ms == alone[3].timeout_ms

    def rows(frames):
        return sorted(map(str, pd.concat(frames).itertuples(index=False, name=None)))

    assert rows(got) == rows(expected) and len(rows(got)) > 30
    bucket.getCurrentWatermarkMs = lambda: bucket.timeout_ms + 1
    late = pd.DataFrame([(9, *PARTS[0][1:])], columns=COLS).assign(ts_s=2000)
    out = pd.concat(both((0,), iter([late]), bucket))  # another key's rows: the silent key is closed beside them
    assert out[out.stream_id == 3]["stop_reason"].tolist() == ["stop"] and bucket.get[0] == [9]
    bucket.hasTimedOut, bucket.getCurrentWatermarkMs = True, lambda: bucket.timeout_ms + 1
    assert pd.concat(both((0,), iter([late.iloc[:0]]), bucket))["stream_id"].tolist() == [9] and not bucket.exists


def test_groups_do_not_grow_with_the_keys(spark):
    """A micro-batch of many more streams than buckets keeps a state row a bucket, not one a stream."""
    w = H.workdir(spark, "bucket-test")
    schema = "stream_id long, seq long, part_type string, text string, signature string, call_id string, name string, args_delta string, stop_reason string, ts_s long"
    spark.range(3000).selectExpr("id stream_id", "0L seq", "'text' part_type", "'a' text", "'' signature", "'' call_id", "'' name", "'' args_delta", "'' stop_reason",
                                 "100L ts_s").write.json(w["input"])
    q = J.assemble_stream(H.file_stream(spark, w["input"], schema)).writeStream.format("parquet").option("path", w["out"]) \
        .option("checkpointLocation", w["ckpt"]).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]][-1] <= B.BUCKETS
    assert spark.read.parquet(w["out"]).count() == 3000


def test_slices_come_from_a_table_worked_out_once(spark):
    """The input of a replay is derived once, whatever the number of slices."""
    runs, w = spark.sparkContext.accumulator(0), H.workdir(spark, "slices-test")

    def seen(batches):
        for b in batches:
            runs.add(len(b))
            yield b

    rp = H.stage_slices(spark.range(100).mapInPandas(seen, "id long"), w["input"], "id", n_slices=7)
    sizes = [spark.read.schema("id long").json(w["input"]).count()]
    for i in range(1, 7):
        rp.write(i)
        sizes.append(spark.read.schema("id long").json(w["input"]).count())
    assert sizes == [15, 30, 45, 60, 75, 90, 100] and runs.value == 100


def test_stalls_of_many_streams_share_state_rows(spark):
    """Pending calls of more streams than buckets take a state row a bucket; each closes at its own time, with or without later rows."""
    w = H.workdir(spark, "stall-test")
    schema, query = "stream_id long, seq long, part_type string, ts_s long", None
    started = spark.range(3000).selectExpr("id stream_id", "id seq", "'tool_call_start' part_type", "1000 + id % 7 ts_s")
    later = spark.createDataFrame([(1, 5000, "text", 1050), (2, 5001, "text", 1500), (9999, 5002, "text", 1500)], schema)
    last = spark.createDataFrame([(9999, 6000, "text", 1600)], schema)
    kept = []
    for batch in (started, later, last):
        batch.write.mode("append").json(w["input"])
        query = J.stall_stream(H.file_stream(spark, w["input"], schema), 120).writeStream.format("parquet").option("path", w["out"]) \
            .option("checkpointLocation", w["ckpt"]).trigger(availableNow=True).start()
        query.awaitTermination()
        kept += [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    assert max(kept) <= B.BUCKETS and kept[-1] == 0
    got = sorted(tuple(r) for r in spark.read.parquet(w["out"]).collect())
    assert got == [(k, k, 1000 + k % 7 + 120) for k in range(3000) if k != 1]
