import os

from tierlens.operators import context as C


def _brute(cwd, stop, files, global_dir):
    """Ancestor walk by hand: global dir, then stop dir down to cwd; first
    candidate name per directory; each path once."""
    dirs = [global_dir] if global_dir else []
    if cwd == stop:
        dirs.append(stop)
    elif cwd.startswith(stop + "/"):
        parts = cwd[len(stop) + 1:].split("/")
        dirs += [stop] + [stop + "/" + "/".join(parts[:k]) for k in range(1, len(parts) + 1)]
    else:
        dirs.append(cwd)
    out, seen = [], set()
    for d in dirs:
        for name in C.GUIDELINE_FILE_NAMES:
            if (d, name) in files:
                p = os.path.join(d, name)
                if p not in seen:
                    seen.add(p)
                    out.append(p)
                break
    return out


def test_guideline_files_with_global_dir(spark):
    files = {("/cfg", "CLAUDE.md"), ("/cfg", "AGENTS.md"), ("/r", "CLAUDE.md"), ("/r/a", "AGENTS.md"),
             ("/r/a/b", "README.md"), ("/r/a/b", "CLAUDE.md"), ("/other", "AGENTS.md")}
    fdf = spark.createDataFrame([(d, n, os.path.join(d, n), f"{d}:{n}") for d, n in sorted(files)],
                                "dir string, file_name string, path string, content string")
    wds = [("/r/a/b", "/r"), ("/r", "/r"), ("/x/y", "/r"), ("/cfg/sub", "/cfg")]
    wdf = spark.createDataFrame(wds, "cwd string, stop_dir string")
    got = {}
    for r in C.guideline_files(wdf, fdf, global_dir="/cfg").collect():
        got.setdefault(r.cwd, []).append((r.depth, r.path, r.content))
    for cwd, stop in wds:
        rows = sorted(got.get(cwd, []))
        assert [p for _, p, _ in rows] == _brute(cwd, stop, files, "/cfg"), cwd
        assert all(c == p.replace("/AGENTS.md", ":AGENTS.md").replace("/CLAUDE.md", ":CLAUDE.md") for _, p, c in rows)
    assert sorted(got["/r/a/b"])[0] == (-1, "/cfg/AGENTS.md", "/cfg:AGENTS.md")


def test_payload_carries_a_briefing_unless_the_topic_shifted(spark):
    df = spark.createDataFrame([(1, 0, "q1", "r1", 0), (1, 1, "q2", None, 1), (2, 0, "x", None, 0)],
                               "conv_id long, turn long, query string, response string, segment_id long")
    briefings = spark.createDataFrame([(1, " earlier facts "), (2, "none.")], "conv_id long, briefing string")
    got = {r.conv_id: [(m["role"], m["content"]) for m in r.messages] for r in C.latest_payload(df, briefings).collect()}
    assert got == {1: [("system", C.BRIEFING_PREFIX + "earlier facts"), ("user", "q2")], 2: [("user", "x")]}


def test_segments_in_chunks_of_any_size_equal_a_loop(spark):
    import random

    rnd = random.Random(4)
    rows = [(c, t, rnd.randint(1, 2)) for c in range(6) for t in sorted(rnd.sample(range(40), rnd.randint(1, 25)))]
    want, last = {}, {}
    for c, t, tier in rows:
        prev, seg = last.get(c, (None, 0))
        pivot = prev is not None and prev != tier
        want[(c, t)] = (prev, pivot, seg + pivot)
        last[c] = (tier, seg + pivot)
    df = spark.createDataFrame(rows, "conv_id int, turn int, tier int").repartition(4)
    for chunk in (1, 3, 7, 1 << 20):
        got = {(r.conv_id, r.turn): (r.prev_tier, r.is_pivot, r.segment_id) for r in C.segments(df, chunk=chunk).collect()}
        assert got == want, chunk
