from pyspark.sql import functions as F

from tierlens.operators import corpus as K


def _diff(spark, old, new):
    o = spark.createDataFrame([(1, old)], "doc_id long, text string")
    n = spark.createDataFrame([(1, new)], "doc_id long, text string")
    ch = K.changed_lines(K.numbered_lines(o, "doc_id"), K.numbered_lines(n, "doc_id"), "doc_id")
    r = K.diff_counts(ch, "doc_id").collect()
    return (r[0].added, r[0].removed) if r else (0, 0)


def test_diff_cases(spark):
    assert _diff(spark, "line1\nline2\nline3", "line1\nmodified\nline3") == (1, 1)
    assert _diff(spark, "line1\nline2", "line1\nline2\nline3") == (1, 0)
    assert _diff(spark, "line1\nline2\nline3", "line1\nline3") == (0, 1)
    assert _diff(spark, "", "line1\nline2") == (2, 0)
    assert _diff(spark, "line1\nline2", "") == (0, 2)
    assert _diff(spark, "a\nb\nc", "a\nb\nc") == (0, 0)


def test_prompt_history_keeps_last_50(spark):
    rows = [(1, i, f"entry-{i}") for i in range(60)] + [(1, 60, "entry-59"), (1, 61, "")]
    df = spark.createDataFrame(rows, "k long, t long, text string")
    kept = K.prompt_history(df, "k", "t").orderBy(F.col("recency").desc()).collect()
    assert len(kept) == 50
    assert kept[0].text == "entry-10" and kept[-1].text == "entry-59"


def _py_score(q, c):
    if not q:
        return 1.0
    q, c = q.lower(), c.lower()
    pos, idx = [], 0
    for ch in q:
        idx = c.find(ch, idx)
        if idx == -1:
            return 0.0
        pos.append(idx)
        idx += 1
    starts, ws = set(), True
    for i, ch in enumerate(c):
        if ch.isalnum():
            if ws:
                starts.add(i)
                ws = False
        else:
            ws = True
    s = float(len(pos)) + 0.5 * sum(1 for p in pos if p in starts)
    groups = 1 + sum(1 for i in range(1, len(pos)) if pos[i] != pos[i - 1] + 1)
    if len(pos) > 1:
        s *= 1 + (len(pos) - groups + 1) / len(pos)
    if pos[0] == 0:
        s *= 1.2
    return s


def test_fuzzy_scores_match_brute_force(spark):
    cands = ["src/main.py", "tests/test_main.py", "README.md", "src/utils/helpers.py", "docs/index.md", "setup.cfg"]
    queries = ["smp", "tst", "rd", "", "zz", "SRC"]
    c = spark.createDataFrame([(x, i) for i, x in enumerate(cands)], "candidate string, cand_order long")
    q = spark.createDataFrame([(i, x) for i, x in enumerate(queries)], "query_id int, query string")
    got = {(r.query, r.candidate): r.score for r in K.fuzzy_match(c, q).collect()}
    for qq in queries:
        for cc in cands:
            exp = _py_score(qq, cc)
            if exp > 0:
                assert abs(got[(qq, cc)] - round(exp, 9)) < 1e-9, (qq, cc)
            else:
                assert (qq, cc) not in got


def test_fuzzy_pairs_hold_every_query_character(spark):
    cands = ["abc", "cba", "ab", "xyz", "a\u00e9b", "\U0001f600ab", "", None]
    c = spark.createDataFrame([(x, i) for i, x in enumerate(cands)], "candidate string, cand_order long")
    q = spark.createDataFrame([(1, "ABC"), (2, "\u00e9"), (3, "\U0001f600B"), (4, "q"), (5, None)], "query_id int, query string")
    pairs = {(r.query_id, r.candidate) for r in K.fuzzy_pairs(c, q).collect()}
    assert pairs == {(1, "abc"), (1, "cba"), (2, "a\u00e9b"), (3, "\U0001f600ab")}
    got = {(r.query_id, r.candidate) for r in K.fuzzy_match(c, q).collect()}
    assert got == pairs - {(1, "cba")}
    assert K.fuzzy_match(c, q.limit(0)).count() == 0 and K.fuzzy_match(c.limit(0), q).count() == 0


def test_fuzzy_repeated_and_missing_characters(spark):
    """A character that is not found again fails, whatever follows it."""
    c = spark.createDataFrame([("banana", 0), ("bnaa", 1)], "candidate string, cand_order long")
    q = spark.createDataFrame([(1, "aaa"), (2, "aab"), (3, "nab")], "query_id int, query string")
    assert {(r.query_id, r.candidate) for r in K.fuzzy_match(c, q).collect()} == {(1, "banana")}


def test_tail_truncation(spark):
    text = "\n".join(f"line {i:05d}" for i in range(3000))
    df = spark.createDataFrame([(1, text), (2, "short\ntext")], "doc_id long, text string")
    r = {x.doc_id: x for x in K.tail_truncate(df, "doc_id").collect()}
    assert r[1].truncated and r[1].kept_lines == 2000 and r[1].total_lines == 3000
    assert r[1].kept_text == "\n".join(f"line {i:05d}" for i in range(1000, 3000))
    assert not r[2].truncated and r[2].kept_text == "short\ntext"


def test_paste_fold_and_expand(spark):
    big = "\n".join(str(i) for i in range(8))
    df = spark.createDataFrame([(1, 0, "hi"), (1, 1, big), (1, 2, "x" * 600), (1, 3, "[paste #9 +3 lines]")],
                               "k long, t long, text string")
    folded, side = K.fold_pastes(df, "k", "t")
    f = {r.t: r.folded for r in folded.collect()}
    assert f[1] == "[paste #1 +8 lines]" and f[2] == "[paste #2 600 chars]" and f[0] == "hi"
    ex = {r.t: r.expanded for r in K.expand_pastes(folded, side, "k", "t").collect()}
    assert ex[1] == big and ex[2] == "x" * 600 and ex[3] == "[paste #9 +3 lines]"


def test_glob_and_grep(spark):
    assert K.glob_to_regex("*.py") == r"^(?:.*/)?[^/]*\.py$"
    lines = spark.createDataFrame([("/a/x.py", 2, 1, "def f(): pass"), ("/a/y.txt", 3, 1, "def g"),
                                   ("/b/z.py", 1, 4, "class C: pass")], "path string, mtime long, line_no long, line string")
    r = K.grep(lines, r"^(def|class)", "*.py").collect()
    assert [x.path for x in r] == ["/a/x.py", "/b/z.py"] and r[0].total_matches == 2


def test_format_helpers(spark):
    df = spark.createDataFrame([(999,), (12_345,), (3_400_000,)], "n long")
    assert [r.f for r in df.select(K.format_tokens(F.col("n")).alias("f")).collect()] == ["999", "12k", "3m"]
    ages = spark.createDataFrame([(0, 30), (0, 7200), (0, 3 * 86400), (0, 20 * 86400), (0, 400 * 86400), (100, 0)],
                                 "m long, now long").select(K.age_bucket(F.col("now"), F.col("m")).alias("a"))
    assert [r.a for r in ages.collect()] == [" 0m", " 2h", " 3d", " 2w", " 1y", " 0m"]


def test_lone_surrogates_after_many_backslashes(spark):
    from tierlens.operators.corpus import sanitize_json_surrogates

    cases = []
    for n in (0, 1, 2, 40, 41, 50, 10_000):
        even = "\\\\" * n
        cases += [(even + r"\ud83d x", even + r"\ufffd x"), (even + r"\ud83d\ude00!", even + r"\ud83d\ude00!"),
                  (even + r"\\ud83d", even + r"\\ud83d"), (even + r"\ude00\ud83d\ude01\uD800", even + r"\ufffd\ud83d\ude01\ufffd")]
    cases += [("", ""), (None, None), ("plain\n\\", "plain\n\\"), ("é🤦 \\u00e9 \\n" * 3, "é🤦 \\u00e9 \\n" * 3)]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, t string")
    got = dict(df.select("i", sanitize_json_surrogates(F.col("t"))).collect())
    assert [got[i] for i in range(len(cases))] == [b for _, b in cases]
