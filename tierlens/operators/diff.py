"""Line diffs between two versions of every text.

The two versions of a text meet in one row (an equi-join on the key). Texts
that are equal are settled by a comparison in the plan; for the rest, the
standard library's sequence matcher gives the spans of lines that stay, go or
come, as small integer arrays. Lines of a diff, counts and the rendered diff
with its context are columns over those arrays: no text leaves its row, and no
line is shuffled.

Lines end at every line boundary of Unicode, as ``str.splitlines`` cuts them.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT_LINES = 4
#: Line boundaries: a carriage return with a line feed is one.
_BOUNDARY = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"

_OPS = "array<struct<tag:string,a:int,b:int,c:int,d:int>>"


def lines_of(text: Column) -> Column:
    """The lines of a text, without an empty one after a last boundary; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), _BOUNDARY, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def opcodes(old: list[str], new: list[str]) -> list[tuple]:
    """(tag, a, b, c, d): lines a..b of the old text become c..d of the new one."""
    return difflib.SequenceMatcher(None, old, new).get_opcodes()


def _spans(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([None if o is None else [dict(zip("tag a b c d".split(), op)) for op in opcodes(list(o), list(n))] for o, n in zip(old, new)], dtype=object)


def diff_texts(old: DataFrame, new: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """One row per key of either side: ``key, old_lines, new_lines, ops``. A key
    that one side lacks, or a null text, has no lines there. Keys are taken as
    unique per side; repeated rows of a key pair up each with each."""
    o = old.select(F.col(key), F.col(text_col).alias("_old"))
    n = new.select(F.col(key), F.col(text_col).alias("_new"))
    both = o.join(n, key, "full_outer").select(key, lines_of(F.col("_old")).alias("old_lines"), lines_of(F.col("_new")).alias("new_lines"))
    same = F.col("old_lines") == F.col("new_lines")
    size = F.size("old_lines")
    whole = F.when(size > 0, F.array(F.struct(F.lit("equal").alias("tag"), F.lit(0).alias("a"), size.alias("b"), F.lit(0).alias("c"), size.alias("d")))) \
        .otherwise(F.array()).cast(_OPS)
    # one pass over the joined rows; as a non-deterministic function it is worked out once, however often ops is used
    spans = F.pandas_udf(_spans, _OPS).asNondeterministic()
    found = both.withColumn("_ops", spans(F.when(~same, F.col("old_lines")), F.when(~same, F.col("new_lines"))))
    return found.select(key, "old_lines", "new_lines", F.when(same, whole).otherwise(F.col("_ops")).alias("ops"))


def _total(of) -> Column:
    return F.aggregate(F.transform("ops", of), F.lit(0), lambda acc, x: acc + x).cast("bigint")


def added() -> Column:
    return _total(lambda op: F.when(op.tag == "equal", 0).otherwise(op.d - op.c))


def removed() -> Column:
    return _total(lambda op: F.when(op.tag == "equal", 0).otherwise(op.b - op.a))


def diff_lines(diffs: DataFrame, key: str, *more: str) -> DataFrame:
    """The lines of every diff in order: ``key, position, kind`` (kept, removed,
    added), ``old_line_no, new_line_no, line``; removed lines of a span come
    before its added ones. Columns ``more`` of the diff come along with each line."""
    def rows(kind: str, lines: str, start: Column, end: Column, old: Column | None, new: Column | None) -> Column:
        none = F.lit(None).cast("bigint")
        return F.transform(F.slice(F.col(lines), start + 1, end - start), lambda line, i: F.struct(
            F.lit(kind).alias("kind"), (none if old is None else (old + i + 1).cast("bigint")).alias("old_line_no"),
            (none if new is None else (new + i + 1).cast("bigint")).alias("new_line_no"), line.alias("line")))

    def of(op: Column) -> Column:
        gone, come = rows("removed", "old_lines", op.a, op.b, op.a, None), rows("added", "new_lines", op.c, op.d, None, op.c)
        return F.when(op.tag == "equal", rows("kept", "old_lines", op.a, op.b, op.a, op.c)).otherwise(F.concat(gone, come))

    return diffs.select(key, *more, F.posexplode(F.flatten(F.transform("ops", of))).alias("position", "x")).select(key, *more, "position", "x.*")


def rendered(context_lines: int = CONTEXT_LINES) -> Column:
    """The diff as text: changed lines with their numbers after a minus or plus,
    ``context_lines`` of unchanged ones around them after a blank, a line of
    three dots where more were left out. Without a change the text is empty."""
    width = F.length(F.greatest(F.size("old_lines"), F.size("new_lines")).cast("string"))
    keep = F.lit(context_lines)
    dots = F.array(F.concat(F.lit(" "), F.repeat(F.lit(" "), width), F.lit(" ...")))

    def shown(mark: str, lines: str, start: Column, count: Column) -> Column:
        return F.transform(F.slice(F.col(lines), start + 1, F.greatest(count, F.lit(0))), lambda line, i: F.concat(
            F.lit(mark), F.lpad((start + i + 1).cast("string"), width, " "), F.lit(" "), line))

    def of(op: Column, i: Column) -> Column:
        n, after, before = op.b - op.a, i > 0, i < F.size("ops") - 1
        head, tail = shown(" ", "old_lines", op.a, keep), shown(" ", "old_lines", op.b - keep, keep)
        every = shown(" ", "old_lines", op.a, n)
        equal = (F.when(after & before, F.when(n > 2 * keep, F.concat(head, dots, tail)).otherwise(every))
                 .when(after, F.when(n > keep, F.concat(head, dots)).otherwise(every))
                 .when(before, F.when(n > keep, F.concat(dots, tail)).otherwise(every))
                 .otherwise(F.array().cast("array<string>")))
        changed = F.concat(shown("-", "old_lines", op.a, n), shown("+", "new_lines", op.c, op.d - op.c))
        return F.when(op.tag == "equal", equal).otherwise(changed)

    return F.array_join(F.flatten(F.transform("ops", of)), "\n")
