"""Corpus and text operators applied as jobs over document / message tables.

A12 numbered-line pages, B11 regex line search, B12 exact replace, H1-H3
formatting, H7 sanitising, H8 tail / H9 head truncation, H10 paste folding,
H11 mixed-content text, H20 changed lines, F1 fuzzy matching, E10 prompt history.

Every per-text step is a Catalyst expression on the row (split, slice,
higher-order array functions); per-line work explodes lines of one text and
groups them back by the text's key.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tierlens.operators import ordered

# ---- FIXED VALUES ----------------------------------------------------------
READ_MAX_LINES = 2000
READ_MAX_CHARS = 2000
GREP_MAX_MATCHES = 100
GREP_MAX_LINE = 2000
TAIL_MAX_LINES = 2000
TAIL_MAX_BYTES = 50 * 1024
HEAD_LINES_EXPORT = 20
HEAD_LINES_VIEW = 5
PASTE_LINE_THRESHOLD = 5
PASTE_CHAR_THRESHOLD = 500
PASTE_MARKER = r"\[paste #(\d+)(?: (\+\d+ lines|\d+ chars))?\]"
ANSI_ESCAPE = r"\x1b\[[0-9;]*[a-zA-Z]|\x1b\][^\x07]*\x07|\x1b[()][AB012]"
HISTORY_MAX = 50
FUZZY_TOP = 50
LABEL_WIDTH = 72
# ---- end of fixed values ---------------------------------------------------


# ---------------------------------------------------------------- lines
def split_lines(text: Column) -> Column:
    """Lines of a text split on newline, without a trailing empty element
    when the text ends with a newline (file-iteration semantics)."""
    parts = F.split(text, "\n", -1)
    return (F.when(text == "", F.array().cast("array<string>"))
             .when(text.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def numbered_lines(df: DataFrame, key: str, text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carried columns, line_no 1-based, line, has_newline) -- one row per line, whole text."""
    t = F.col(text_col)
    return (df.select(key, *carry, F.posexplode(split_lines(t)).alias("_p", "line"),
                      t.endswith("\n").alias("_nl"), F.size(split_lines(t)).alias("_n"))
              .select(key, *carry, (F.col("_p") + 1).cast("bigint").alias("line_no"), "line",
                      (((F.col("_p") + 1) < F.col("_n")) | F.col("_nl")).alias("has_newline")))


def read_page(df: DataFrame, key: str, text_col: str = "text", offset: int | None = None,
              limit: int | None = None) -> DataFrame:
    """Numbered lines ``{n:6d}<TAB>{line}`` from ``offset`` (1-based) up to
    ``limit`` lines (at most 2000, then a truncation marker row); a line longer
    than 2000 characters (newline included) is cut with a marker."""
    start = (offset - 1) if offset else 0
    eff = min(limit, READ_MAX_LINES) if limit else READ_MAX_LINES
    # one pass: the row after the page becomes the truncation marker when the
    # page hit the 2000-line cap
    last = start + eff + (1 if eff == READ_MAX_LINES else 0)
    lines = numbered_lines(df, key, text_col).filter((F.col("line_no") > start) & (F.col("line_no") <= last))
    full_len = F.length("line") + F.col("has_newline").cast("int")
    body = F.when(full_len > READ_MAX_CHARS,
                  F.concat(F.substring("line", 1, READ_MAX_CHARS),
                           F.lit(f" [output truncated after {READ_MAX_CHARS} chars]\n"))) \
            .otherwise(F.concat("line", F.when(F.col("has_newline"), F.lit("\n")).otherwise(F.lit(""))))
    rendered = F.concat(F.lpad(F.col("line_no").cast("string"), 6, " "), F.lit("\t"), body)
    marker = F.lit(f"[output truncated after {READ_MAX_LINES} lines]")
    out = F.when(F.col("line_no") > start + eff, marker).otherwise(rendered)
    return lines.select(key, "line_no", out.alias("rendered"))


def _glob_body(glob: str) -> str:
    """A path glob as a Java regex without anchors; ``[!...]`` negates, braces hold globs."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            j = glob.find("]", i)
            if j < 0:
                out.append(re.escape(c))
            else:
                cls = glob[i + 1:j]
                out.append("[^" + cls[1:] + "]" if cls[:1] == "!" else f"[{cls}]")
                i = j
        elif c == "{":
            j = glob.find("}", i)
            if j < 0:
                out.append(re.escape(c))
            else:
                out.append("(?:" + "|".join(_glob_body(x) for x in glob[i + 1:j].split(",")) + ")")
                i = j
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def glob_to_regex(glob: str) -> str:
    """A path glob as a Java regex over the whole path; a glob without a slash
    matches the file name in any directory."""
    return ("^(?:.*/)?" if "/" not in glob else "^") + _glob_body(glob) + "$"


def grep(lines: DataFrame, pattern: str, include: str | None = None, path_col: str = "path",
         mtime_col: str = "mtime", max_matches: int = GREP_MAX_MATCHES) -> DataFrame:
    """Regex line search; newest file first (then path, line), first 100
    matches, each line cut at 2000 characters with ``...``; ``total_matches``
    counts all matches. The corpus is read once: the top 100 is a
    TakeOrderedAndProject (per-partition top-k, then a merge), and the total is
    observed on the rows that flow into it. The report, ``max_matches`` rows at
    most, passes through the driver."""
    m = lines.filter(F.col("line").rlike(pattern))
    if include:
        m = m.filter(F.col(path_col).rlike(glob_to_regex(include)))
    seen = Observation("grep")
    m = m.observe(seen, F.count(F.lit(1)).alias("total_matches"))
    text = F.when(F.length("line") > GREP_MAX_LINE, F.concat(F.substring("line", 1, GREP_MAX_LINE), F.lit("..."))) \
            .otherwise(F.col("line"))
    top = m.orderBy(F.col(mtime_col).desc(), F.col(path_col), F.col("line_no")).limit(max_matches).select(path_col, mtime_col, "line_no", text.alias("line"))
    rows = top.collect()  # max_matches at most
    found = lines.sparkSession.createDataFrame(rows, top.schema)
    return found.withColumn("total_matches", F.lit(seen.get["total_matches"]).cast("bigint"))


def replace_text(df: DataFrame, text_col: str, old: str, new: str, replace_all: bool) -> DataFrame:
    """Literal replace of ``old`` by ``new`` (all or only the first
    occurrence); ``status`` is updated / not_found (text lacks ``old``) /
    missing (no text)."""
    t = F.col(text_col)
    pos = F.instr(t, old)
    if replace_all:
        new_t = F.replace(t, F.lit(old), F.lit(new))
    else:
        new_t = F.concat(F.substring(t, 1, pos - 1), F.lit(new), t.substr(pos + F.lit(len(old)), F.length(t)))
    status = F.when(t.isNull(), "missing").when(pos == 0, "not_found").otherwise("updated")
    return (df.withColumn("status", status)
              .withColumn("new_text", F.when(status == "updated", new_t).otherwise(t)))


def changed_lines(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Kept / removed / added lines between two versions of each text,
    compared as multisets of lines (where a moved line counts as kept; the diff
    in order is :mod:`tierlens.operators.diff`): a line's n-th occurrence in the old text
    pairs with its n-th occurrence in the new one (full outer equi-join on
    key, line hash and occurrence). ``old``/``new``: (key, line_no, line)."""
    def occ(d):
        # all lines of a text come out of one row, so a window per (text, line) holds no more than that row did
        return d.withColumn("_h", F.md5("line")).withColumn("_occ", F.row_number().over(Window.partitionBy(key, "_h").orderBy("line_no")))
    o = occ(old).select(key, "_h", "_occ", F.col("line_no").alias("old_line_no"), F.col("line").alias("old_line"))
    n = occ(new).select(key, "_h", "_occ", F.col("line_no").alias("new_line_no"), F.col("line").alias("new_line"))
    j = o.join(n, [key, "_h", "_occ"], "full_outer")
    kind = (F.when(F.col("old_line_no").isNull(), "added").when(F.col("new_line_no").isNull(), "removed")
             .otherwise("kept"))
    return j.select(key, kind.alias("kind"), "old_line_no", "new_line_no",
                    F.coalesce("new_line", "old_line").alias("line"))


def diff_counts(changes: DataFrame, key: str) -> DataFrame:
    """H20 totals per text: added and removed line counts."""
    return changes.groupBy(key).agg(
        F.count(F.when(F.col("kind") == "added", 1)).alias("added"),
        F.count(F.when(F.col("kind") == "removed", 1)).alias("removed"))


# ---------------------------------------------------------------- formatting
def token_estimate(text: Column) -> Column:
    """H1: characters // 4."""
    return F.floor(F.coalesce(F.length(text), F.lit(0)) / 4).cast("bigint")


def format_tokens(n: Column) -> Column:
    """H2: 12k / 3m style (floor); below 1000 the plain number."""
    return (F.when(n >= 1_000_000, F.concat((n / 1_000_000).cast("bigint").cast("string"), F.lit("m")))
             .when(n >= 1_000, F.concat((n / 1_000).cast("bigint").cast("string"), F.lit("k")))
             .otherwise(n.cast("string")))


def session_label(text: Column, width: int = LABEL_WIDTH) -> Column:
    """H3: whitespace collapsed, cut to width-3 + ``...`` when longer, right padded."""
    norm = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "), r"^ | $", "")
    cut = F.concat(F.regexp_replace(F.substring(norm, 1, width - 3), r"\s+$", ""), F.lit("..."))
    lab = F.when(F.length(norm) > width, cut).otherwise(norm)
    return F.when(F.length(lab) < width, F.rpad(lab, width, " ")).otherwise(lab)


def age_bucket(now_s: Column, modified_s: Column) -> Column:
    """H3: age as m / h / d / w / y, never negative, right-aligned width 2."""
    d = F.greatest(F.lit(0), (now_s - modified_s).cast("bigint"))
    mins, hours, days = F.floor(d / 60), F.floor(d / 3600), F.floor(d / 86400)
    weeks = F.floor(days / 7)
    val = (F.when(mins < 60, mins).when(hours < 24, hours).when(days < 7, days).when(weeks < 52, weeks)
            .otherwise(F.floor(weeks / 52))).cast("bigint")
    unit = (F.when(mins < 60, "m").when(hours < 24, "h").when(days < 7, "d").when(weeks < 52, "w").otherwise("y"))
    return F.concat(F.lpad(val.cast("string"), 2, " "), unit)


# ---------------------------------------------------------------- sanitising
def sanitize_output(text: Column) -> Column:
    """H7 (tool output): ANSI escapes removed, CRLF -> LF, other CR removed,
    control characters other than tab and newline removed."""
    t = F.regexp_replace(text, ANSI_ESCAPE, "")
    t = F.replace(t, F.lit("\r\n"), F.lit("\n"))
    t = F.replace(t, F.lit("\r"), F.lit(""))
    return F.regexp_replace(t, r"[\x00-\x08\x0b-\x1f]", "")


def sanitize_json_surrogates(raw_json: Column) -> Column:
    """H7 (model text): lone UTF-16 surrogate escapes in raw JSON text become
    U+FFFD before the text is decoded (a decoded Spark string cannot hold one)."""
    lone = r"\\u[dD][89a-fA-F][0-9a-fA-F]{2}"
    pair = r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}"
    # forward, one token after the other: plain text, a pair, a lone surrogate, any other escape (so an escaped backslash opens none)
    tokens = F.regexp_extract_all(raw_json, F.lit(rf"[^\\]+|{pair}|{lone}|\\[\s\S]?"), F.lit(0))
    fixed = F.transform(tokens, lambda t: F.when(F.regexp_like(t, F.lit(rf"^{lone}$")), F.lit(r"\ufffd")).otherwise(t))
    return F.array_join(fixed, "")


# ---------------------------------------------------------------- truncation
def tail_truncate(df: DataFrame, key: str, text_col: str = "text", max_lines: int = TAIL_MAX_LINES,
                  max_bytes: int = TAIL_MAX_BYTES) -> DataFrame:
    """H8: keep the newest lines within 2000 lines and 50 KB (bytes of the
    kept lines plus one newline between them), stopping at the first line
    that does not fit; returns kept text, kept and total line counts. Row by
    row, from the last lines backwards; a null text is left out."""
    t = F.col(text_col)
    parts = F.split(t, "\n", -1)
    base = df.filter(t.isNotNull()).select(key, t.alias("_t"), parts.alias("_l"), F.size(parts).alias("total_lines"))
    fits = (F.col("total_lines") <= max_lines) & (F.octet_length("_t") <= max_bytes)
    newest = F.reverse(F.slice("_l", F.greatest(F.col("total_lines") - max_lines + 1, F.lit(1)), max_lines))

    def take(acc: Column, line: Column) -> Column:
        room = acc["open"] & (acc["bytes"] + F.octet_length(line) <= max_bytes)
        return F.when(room, F.struct((acc["bytes"] + F.octet_length(line) + 1).alias("bytes"), (acc["lines"] + 1).alias("lines"), F.lit(True).alias("open"))) \
                .otherwise(F.struct(acc["bytes"].alias("bytes"), acc["lines"].alias("lines"), F.lit(False).alias("open")))

    start = F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("lines"), F.lit(True).alias("open"))
    kept = F.when(fits, F.col("total_lines")).otherwise(F.aggregate(newest, start, take, lambda acc: acc["lines"]))
    base = base.withColumn("_k", kept)
    text = F.when(fits, F.col("_t")).otherwise(F.array_join(F.slice("_l", F.col("total_lines") - F.col("_k") + 1, F.col("_k")), "\n"))
    return base.select(key, text.alias("kept_text"), F.col("_k").cast("bigint").alias("kept_lines"), "total_lines", (~fits).alias("truncated"))


def head_truncate(text: Column, max_lines: int) -> Column:
    """H9: the first ``max_lines`` lines plus ``... (k lines hidden)``."""
    parts = F.split(text, "\n", -1)
    hidden = F.size(parts) - max_lines
    cut = F.concat(F.array_join(F.slice(parts, 1, max_lines), "\n"), F.lit("\n... ("), hidden.cast("string"),
                   F.lit(" lines hidden)"))
    return F.when((text.isNull()) | (text == ""), text).when(hidden > 0, cut).otherwise(text)


# ---------------------------------------------------------------- paste folding
def fold_pastes(df: DataFrame, key: str, order: str, text_col: str = "text",
                chunk: int = ordered.DEFAULT_CHUNK) -> tuple[DataFrame, DataFrame]:
    """A block of more than 5 lines or 500 characters (after newline
    normalisation and control-character removal) is replaced by a numbered
    marker; numbers run per ``key`` in ``order``. Returns (messages with
    ``folded`` text, side table key/paste_id/content)."""
    t = F.replace(F.replace(F.col(text_col), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.regexp_replace(t, r"[\x00-\x09\x0b-\x1f]", "")
    d = df.withColumn("_norm", t).withColumn("_nl", F.size(F.split(t, "\n", -1))).withColumn("_nc", F.length(t))
    big = (F.col("_nl") > PASTE_LINE_THRESHOLD) | (F.col("_nc") > PASTE_CHAR_THRESHOLD)
    d = d.withColumn("_big", big)
    d = ordered.running_sum(d, key, order, F.col("_big").cast("int"), "_pid", chunk)
    marker = F.when(F.col("_nl") > PASTE_LINE_THRESHOLD,
                    F.format_string("[paste #%d +%d lines]", F.col("_pid"), F.col("_nl"))) \
              .otherwise(F.format_string("[paste #%d %d chars]", F.col("_pid"), F.col("_nc")))
    out = d.withColumn("folded", F.when(F.col("_big"), marker).otherwise(F.col("_norm")))
    side = out.filter("_big").select(key, F.col("_pid").alias("paste_id"), F.col("_norm").alias("content"))
    return out.drop("_norm", "_nl", "_nc", "_big", "_pid"), side


def expand_pastes(df: DataFrame, side: DataFrame, key: str, row_key: str, text_col: str = "folded") -> DataFrame:
    """Markers replaced by their content (known ids of the same key);
    unknown markers stay. Marker pieces are exploded, left-joined to the side
    table and concatenated back in order."""
    t = F.col(text_col)
    ex = df.select(key, row_key, F.posexplode(F.regexp_extract_all(
        F.concat(t, F.lit("")), F.lit(f"({PASTE_MARKER})|((?:(?!{PASTE_MARKER})[\\s\\S])+)"), 0)).alias("_p", "_piece"))
    ex = ex.withColumn("_id", F.regexp_extract("_piece", f"^{PASTE_MARKER}$", 1))
    ex = ex.withColumn("_pid", F.when(F.col("_id") != "", F.col("_id").cast("bigint")))
    j = ex.join(side.withColumnRenamed("paste_id", "_pid"), [key, "_pid"], "left")
    piece = F.coalesce(F.col("content"), F.col("_piece"))
    g = j.groupBy(key, row_key).agg(F.array_sort(F.collect_list(F.struct("_p", piece.alias("s")))).alias("_a"))
    expanded = g.select(key, row_key, F.array_join(F.transform("_a", lambda x: x["s"]), "").alias("expanded"))
    return df.join(expanded, [key, row_key], "left").withColumn(
        "expanded", F.coalesce(F.col("expanded"), F.when(t == "", F.lit("")).otherwise(t)))


# ---------------------------------------------------------------- mixed content
def content_text(content: Column) -> Column:
    """Text of ``array<struct<type,text>>`` content: text parts as is,
    images as ``[image]``, stripped, ``(no content)`` when empty."""
    parts = F.transform(content, lambda p: F.when(p["type"] == "text", F.coalesce(p["text"], F.lit("")))
                        .when(p["type"] == "image", F.lit("[image]")).otherwise(F.lit("")))
    s = F.regexp_replace(F.array_join(parts, ""), r"^\s+|\s+$", "")
    return F.when(s == "", F.lit("(no content)")).otherwise(s)


# ---------------------------------------------------------------- fuzzy match
def _positions_sql(q: str, low: str) -> str:
    """SQL expression: 1-based positions of a greedy left-to-right match of the
    characters of ``q`` in ``low``, a zero first; a character that is not found
    gives a further zero, so a match is an array without one after the first."""
    return (f"aggregate({q}, cast(array(0) as array<int>), "
            f"(acc, ch) -> array_append(acc, locate(ch, {low}, element_at(acc, -1) + 1)))")


def _chars(lowered: Column) -> Column:
    return F.filter(F.split(lowered, ""), lambda ch: ch != "")


def _mask(chars: Column) -> Column:
    """64-bit set of characters, each at its code point modulo 64."""
    return F.aggregate(chars, F.lit(0).cast("bigint"),
                       lambda acc, ch: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.ascii(ch) % 64)))


def fuzzy_pairs(candidates: DataFrame, queries: DataFrame, cand_col: str = "candidate",
                order_col: str = "cand_order", top: int = FUZZY_TOP) -> DataFrame:
    """The (query, candidate) pairs that may match: candidates with the query's
    rarest character whose character set covers the query's, characters modulo 64.
    Lowered text (``_low``) and query characters (``_q``) come along. A null
    candidate or query has no pairs."""
    low = candidates.select(cand_col, order_col, F.lower(cand_col).alias("_low"))
    cand = low.withColumn("_set", F.array_distinct(_chars(F.col("_low"))))
    # one row per distinct character; AQE sizes this join from the measured shuffle
    freq = cand.select(F.explode("_set").alias("_ch")).groupBy("_ch").agg(F.count(F.lit(1)).alias("_n"))
    q = queries.select("query_id", "query", _chars(F.lower("query")).alias("_q"))
    anchor = (q.select("query_id", F.explode(F.array_distinct("_q")).alias("_ch")).join(freq, "_ch", "left")
               .groupBy("query_id").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_ch"))["_ch"].alias("_ch")))
    cand = cand.select(cand_col, order_col, "_low", _mask(F.col("_set")).alias("_mask"), F.explode("_set").alias("_ch"))
    asked = anchor.join(q, "query_id").withColumn("_need", _mask(F.col("_q")))
    covers = F.bitwise_not("_mask").bitwiseAND(F.col("_need")) == 0
    # the empty query lists the first ``top`` candidates in input order: its
    # anchor is the empty string, which only those candidates carry
    first = low.orderBy(order_col).limit(top).withColumns({"_mask": F.lit(0).cast("bigint"), "_ch": F.lit("")})
    asked = asked.unionByName(q.filter(F.col("query") == "").withColumns({"_need": F.lit(0).cast("bigint"), "_ch": F.lit("")}))
    pairs = cand.unionByName(first).alias("c").join(asked.alias("a"), (F.col("c._ch") == F.col("a._ch")) & covers)
    return pairs.select("query_id", "query", "_q", cand_col, order_col, "_low")


def fuzzy_match(candidates: DataFrame, queries: DataFrame, cand_col: str = "candidate",
                order_col: str = "cand_order", top: int = FUZZY_TOP) -> DataFrame:
    """F1: every query scored against every candidate that can match it, top 50
    per query by score (then candidate, then input order); an empty query keeps
    the first 50 candidates in input order.

    A match needs every (lower-cased) query character in the candidate, so each
    query is anchored on the character the fewest candidates contain (counts
    from one aggregate whose groups are the distinct characters), and the
    candidates meet the queries through an equi-join on that anchor, then a test
    of character sets as bits (:func:`fuzzy_pairs`) -- exact pruning, no cross
    product. AQE broadcasts a request batch that measures small; a larger one
    gets a shuffled join whose hot anchor characters AQE splits. Positions are
    searched only in pairs that pass, one search a character. The per-query top-k
    runs in two salted stages."""
    m = fuzzy_pairs(candidates, queries, cand_col, order_col, top).withColumn("_p", F.expr(_positions_sql("_q", "_low")))
    m = m.withColumn("_p", F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0))))
    empty_q = F.col("query") == ""
    p, low = F.col("_p"), F.col("_low")
    n = F.size(p)
    letter = r"^[\p{L}\p{N}]$"
    word_start = F.filter(p, lambda i: F.substring(low, i, 1).rlike(letter) & ((i == 1) | ~F.substring(low, i - 1, 1).rlike(letter)))
    groups = F.lit(1) + F.size(F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
                                        lambda k: (k < n) & (F.element_at(p, k + 1) != F.element_at(p, k) + 1)))
    base = n.cast("double") + F.size(word_start) * 0.5
    score = base * F.when(n > 1, F.lit(1.0) + (n - groups + 1).cast("double") / n).otherwise(F.lit(1.0))
    score = score * F.when(F.element_at(p, 1) == 1, F.lit(1.2)).otherwise(F.lit(1.0))
    found = (n > 0) & ~F.array_contains(p, 0)
    scored = m.withColumn("score", F.when(empty_q, F.lit(1.0)).when(found, score).otherwise(F.lit(0.0))).filter(F.col("score") > 0)
    order = [F.when(empty_q, F.lit(0.0)).otherwise(-F.col("score")),
             F.when(empty_q, F.lit(None).cast("string")).otherwise(F.col(cand_col)), F.col(order_col)]
    top_rows = ordered.top_k(scored, "query_id", order, top, F.col(order_col))
    return top_rows.select("query_id", "query", cand_col, order_col, F.round("score", 9).alias("score"), "rank")


# ---------------------------------------------------------------- prompt history
def prompt_history(df: DataFrame, key: str, order: str, text_col: str = "text",
                   keep: int = HISTORY_MAX, chunk: int = ordered.DEFAULT_CHUNK) -> DataFrame:
    """Prompts appended in order: empty ones and repeats of the previous
    kept prompt are dropped, the newest 50 kept (rank 1 = newest)."""
    ne = df.filter(F.coalesce(F.col(text_col), F.lit("")) != "")
    d = ordered.previous(ne, key, order, F.col(text_col), "_prev", chunk)
    kept = d.filter(~F.col("_prev").eqNullSafe(F.col(text_col))).drop("_prev")
    return ordered.top_k(kept, key, [F.col(order).desc()], keep, F.col(order), out="recency")
