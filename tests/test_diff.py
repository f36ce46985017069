import difflib
import random

import pytest

from tierlens.operators import diff as D


def diffs(spark, pairs, context=D.CONTEXT_LINES):
    old = spark.createDataFrame([(i, o) for i, (o, _) in enumerate(pairs)], "k int, text string")
    new = spark.createDataFrame([(i, n) for i, (_, n) in enumerate(pairs)], "k int, text string")
    d = D.diff_texts(old, new, "k")
    rows = d.select("k", D.rendered(context).alias("text"), D.added().alias("added"), D.removed().alias("removed")).collect()
    return [(r.text, r.added, r.removed) for r in sorted(rows, key=lambda r: r.k)]


CASES = [  # old, new, added, removed, lines that the rendered diff holds
    ("line1\nline2\nline3", "line1\nmodified\nline3", 1, 1, ["-2 line2", "+2 modified"]),
    ("line1\nline2", "line1\nline2\nline3", 1, 0, ["+3 line3"]),
    ("line1\nline2\nline3", "line1\nline3", 0, 1, ["-2 line2"]),
    ("", "line1\nline2", 2, 0, []), ("line1\nline2", "", 0, 2, []), ("line1\nline2\nline3", "line1\nline2\nline3", 0, 0, None),
    ("a\nb\nc\nd\ne", "a\nx\ny\nz\ne", 3, 3, []), ("first\nmiddle\nlast", "FIRST\nmiddle\nlast", 1, 1, ["-1 first", "+1 FIRST"]),
    ("first\nmiddle\nlast", "first\nmiddle\nLAST", 1, 1, ["-3 last", "+3 LAST"]),
    ("\n".join("1 2 3 4 5 6 7 8 9 10 11 12 13 14 15".split()), "\n".join("1 TWO 3 4 5 6 7 8 9 10 11 12 13 FOURTEEN 15".split()), 2, 2,
     ["- 2 2", "+ 2 TWO", "-14 14", "+14 FOURTEEN", "    ..."])]


def test_known_diffs(spark):
    got = diffs(spark, [c[:2] for c in CASES])
    for (text, added, removed), (_, _, a, r, lines) in zip(got, CASES):
        assert (added, removed) == (a, r)
        assert text == "" if lines is None else all(x in text.split("\n") for x in lines)


def test_context_and_dots(spark):
    ten = [str(i) for i in range(1, 11)]
    twenty = [str(i) for i in range(1, 21)]
    (text, *_), (long, a, r) = diffs(spark, [("\n".join(ten), "\n".join([*ten[:4], "FIVE", *ten[5:]])),
                                             ("\n".join(twenty), "\n".join([*twenty[:9], "CHANGED", *twenty[10:]]))], 2)
    assert text.split("\n") == ["    ...", "  3 3", "  4 4", "- 5 5", "+ 5 FIVE", "  6 6", "  7 7", "    ..."]
    assert "    ..." in long.split("\n") and (a, r) == (1, 1)


def written_out(old, new, keep):
    """The rendering rules for one pair of texts, on its own."""
    a, b = old.splitlines(), new.splitlines()
    ops = difflib.SequenceMatcher(None, a, b).get_opcodes()
    w = len(str(max(len(a), len(b))))
    out = []
    for i, (tag, i1, i2, j1, j2) in enumerate(ops):
        if tag != "equal":
            out += [f"-{n + 1:>{w}} {a[n]}" for n in range(i1, i2)] + [f"+{n + 1:>{w}} {b[n]}" for n in range(j1, j2)]
            continue
        near_start, near_end = i > 0, i < len(ops) - 1
        shown = [n for n in range(i1, i2) if near_start and n < i1 + keep or near_end and n >= i2 - keep]
        lines = [f" {n + 1:>{w}} {a[n]}" for n in shown]
        if shown and len(shown) < i2 - i1:
            at = 0 if not near_start else keep
            lines.insert(at, " " + " " * w + " ...")
        out += lines
    return "\n".join(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts_with_moves_and_repeats(spark, seed):
    rnd = random.Random(seed)
    pairs = []
    for _ in range(60):
        old = [rnd.choice(["a", "b", "c", "", "d" * rnd.randint(1, 3), f"x{rnd.randint(0, 40)}"]) for _ in range(rnd.randint(0, 60))]
        new = list(old)
        for _ in range(rnd.randint(0, 6)):
            i = rnd.randint(0, len(new))
            if rnd.random() < 0.3 and new:
                cut = new[i:i + 5]
                del new[i:i + 5]
                j = rnd.randint(0, len(new))
                new[j:j] = cut
            elif rnd.random() < 0.5:
                new.insert(i, f"n{rnd.randint(0, 9)}")
            else:
                del new[i:i + 1]
        end = rnd.choice(["", "\n", "\r\n"])
        pairs.append((rnd.choice(["\n", "\r\n", "\u2028"]).join(old) + end, "\n".join(new)))
    pairs.append(("same\n" * 300 + "tail", "same\n" * 250 + "new\n" + "same\n" * 50))  # popular lines
    pairs += [("x\x0by\x0cz\x85w\r", "x\ny\nz\nw"), ("\n\n", "\n"), ("", "")]
    for keep, got in ((4, diffs(spark, pairs)), (1, diffs(spark, pairs, 1))):
        for (text, added, removed), (o, n) in zip(got, pairs):
            ops = difflib.SequenceMatcher(None, o.splitlines(), n.splitlines()).get_opcodes()
            assert (added, removed) == (sum(x[4] - x[3] for x in ops if x[0] != "equal"), sum(x[2] - x[1] for x in ops if x[0] != "equal"))
            assert text == written_out(o, n, keep)


def test_lines_of_a_diff_and_missing_sides(spark):
    old = spark.createDataFrame([(1, "a\nb\nc"), (2, "gone"), (3, None)], "k int, text string")
    new = spark.createDataFrame([(1, "c\na\nB"), (4, "come"), (3, None)], "k int, text string")
    d = D.diff_texts(old, new, "k")
    got = [tuple(r) for r in D.diff_lines(d, "k").orderBy("k", "position").collect()]
    assert got == [(1, 0, "added", None, 1, "c"), (1, 1, "kept", 1, 2, "a"), (1, 2, "removed", 2, None, "b"), (1, 3, "removed", 3, None, "c"),
                   (1, 4, "added", None, 3, "B"), (2, 0, "removed", 1, None, "gone"), (4, 0, "added", None, 1, "come")]
    assert {r.k: r.text for r in d.select("k", D.rendered().alias("text")).collect()}[3] == ""


def test_line_diff_compares_every_text_once(spark, sf_dir):
    """The query joins the two versions once and passes the joined rows through the matcher once."""
    from tierlens.plans.q_corpus import h20_line_diff

    plan = h20_line_diff(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("Join FullOuter"), plan.count("EvalPython") + plan.count("MapInPandas"), plan.count("Union")) == (1, 1, 0)


def test_columns_of_a_diff_come_with_its_lines(spark):
    old = spark.createDataFrame([(1, "a\nb"), (2, "x")], "k int, text string")
    new = spark.createDataFrame([(1, "a\nc"), (2, "x")], "k int, text string")
    d = D.diff_texts(old, new, "k").withColumn("n", D.added())
    got = [tuple(r) for r in D.diff_lines(d, "k", "n").orderBy("k", "position").select("k", "n", "kind", "line").collect()]
    assert got == [(1, 1, "kept", "a"), (1, 1, "removed", "b"), (1, 1, "added", "c"), (2, 0, "kept", "x")]
