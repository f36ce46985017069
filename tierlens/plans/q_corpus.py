"""Corpus queries over documents, conversations, events and pages (A12, B11, B12,
E10, F1, H1-H3, H7-H11, H20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierlens.fixtures import register
from tierlens.functions.text import md5_len
from tierlens.operators import corpus as K
from tierlens.operators import diff as D
from tierlens.operators import sessions as S
from tierlens.plans import query


def _t(spark, sf_dir, name):
    register(spark, sf_dir)
    return spark.table(name)


_LINES = """
, d0 AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts, ends_with(text, chr(10)) AS nl FROM documents),
d1 AS (SELECT doc_id, nl, CASE WHEN text = '' THEN CAST([] AS VARCHAR[]) WHEN nl THEN parts[1:len(parts) - 1] ELSE parts END AS lines FROM d0),
l0 AS (SELECT doc_id, nl, len(lines) AS n, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM d1),
lines AS (SELECT doc_id, line_no, line, (line_no < n) OR nl AS has_nl FROM l0)
"""


@query("a12_read_lines", _LINES + """
SELECT doc_id, line_no, md5(concat(lpad(CAST(line_no AS VARCHAR), 6, ' '), chr(9),
  CASE WHEN length(line) + CASE WHEN has_nl THEN 1 ELSE 0 END > 2000
       THEN concat(substring(line, 1, 2000), ' [output truncated after 2000 chars]', chr(10))
       ELSE concat(line, CASE WHEN has_nl THEN chr(10) ELSE '' END) END)) AS rendered_md5
FROM lines WHERE line_no <= 2000
UNION ALL SELECT doc_id, line_no, md5('[output truncated after 2000 lines]') FROM lines WHERE line_no = 2001""")
def a12_read_lines(spark, sf_dir):
    """Every document as numbered lines (first page of 2000 lines, long lines cut)."""
    p = K.read_page(_t(spark, sf_dir, "documents"), "doc_id")
    return p.select("doc_id", "line_no", F.md5("rendered").alias("rendered_md5"))


_GREP_PATTERN = r"\b[Tt]he [a-z]+ing\b"


def _doc_lines(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(
        "doc_id", "text",
        F.concat(F.lit("/corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang", F.lit(".txt")).alias("path"),
        (F.lit(1704067200) + (F.col("doc_id") * 7919) % 100000).alias("mtime"))
    return K.numbered_lines(d, "doc_id", carry=("path", "mtime"))


@query("b11_grep", _LINES + r"""
, m AS (SELECT l.doc_id, l.line_no, l.line,
               concat('/corpus/', d.source, '/', CAST(d.doc_id AS VARCHAR), '.', d.lang, '.txt') AS path,
               1704067200 + (d.doc_id * 7919) % 100000 AS mtime
        FROM lines l JOIN documents d ON l.doc_id = d.doc_id
        WHERE regexp_matches(l.line, '\b[Tt]he [a-z]+ing\b') AND regexp_matches(concat('/corpus/', d.source, '/', CAST(d.doc_id AS VARCHAR), '.', d.lang, '.txt'), '^(?:.*/)?[^/]*\.en\.txt$')),
t AS (SELECT count(*) AS total_matches FROM m)
SELECT path, mtime, line_no, md5(CASE WHEN length(line) > 2000 THEN concat(substring(line, 1, 2000), '...') ELSE line END) AS line_md5,
       (SELECT total_matches FROM t) AS total_matches
FROM m ORDER BY mtime DESC, path, line_no LIMIT 100""")
def b11_grep(spark, sf_dir):
    """Regex line search over every document with include glob ``*.en.txt``:
    newest files first, first 100 matches, total count."""
    g = K.grep(_doc_lines(spark, sf_dir), _GREP_PATTERN, "*.en.txt")
    return g.select("path", "mtime", "line_no", F.md5("line").alias("line_md5"), "total_matches")


_REQ = """
, req AS (SELECT doc_id AS request_id, doc_id FROM documents
          UNION ALL SELECT doc_id + 1000000, doc_id + 1000000 FROM documents WHERE doc_id % 50 = 0),
rq AS (SELECT r.request_id, d.text FROM req r LEFT JOIN documents d ON r.doc_id = d.doc_id)
"""


def _requests(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    req = docs.select(F.col("doc_id").alias("request_id"), "doc_id").unionByName(
        docs.filter(F.col("doc_id") % 50 == 0).select((F.col("doc_id") + 1000000).alias("request_id"),
                                                      (F.col("doc_id") + 1000000).alias("doc_id")))
    return req.join(docs.select("doc_id", "text"), "doc_id", "left")


@query("b12_replace_first", _REQ + """
SELECT request_id, CASE WHEN text IS NULL THEN 'missing' WHEN strpos(text, ' the ') = 0 THEN 'not_found' ELSE 'updated' END AS status,
       md5(CASE WHEN strpos(text, ' the ') > 0 THEN concat(substring(text, 1, strpos(text, ' the ') - 1), ' THE ', substring(text, strpos(text, ' the ') + 5)) ELSE text END) AS new_md5
FROM rq""")
def b12_replace_first(spark, sf_dir):
    """Exact replace of the first `` the `` in every requested document (missing ids flagged)."""
    r = K.replace_text(_requests(spark, sf_dir), "text", " the ", " THE ", replace_all=False)
    return r.select("request_id", "status", F.md5("new_text").alias("new_md5"))


@query("b12_replace_all", _REQ + """
SELECT request_id, CASE WHEN text IS NULL THEN 'missing' WHEN strpos(text, ' the ') = 0 THEN 'not_found' ELSE 'updated' END AS status,
       md5(replace(text, ' the ', ' THE ')) AS new_md5
FROM rq""")
def b12_replace_all(spark, sf_dir):
    """Exact replace of every `` the `` in every requested document."""
    r = K.replace_text(_requests(spark, sf_dir), "text", " the ", " THE ", replace_all=True)
    return r.select("request_id", "status", F.md5("new_text").alias("new_md5"))


@query("h20_changed_lines", _LINES + """
, newdocs AS (SELECT doc_id, replace(text, ' the ', ' THE ') AS text FROM documents),
n0 AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts, ends_with(text, chr(10)) AS nl FROM newdocs),
n1 AS (SELECT doc_id, CASE WHEN text = '' THEN CAST([] AS VARCHAR[]) WHEN nl THEN parts[1:len(parts) - 1] ELSE parts END AS lines FROM n0),
nl AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM n1),
o2 AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) AS occ FROM lines),
n2 AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) AS occ FROM nl),
j AS (SELECT coalesce(o2.doc_id, n2.doc_id) AS doc_id, o2.line IS NULL AS is_added, n2.line IS NULL AS is_removed
      FROM o2 FULL OUTER JOIN n2 ON o2.doc_id = n2.doc_id AND o2.line = n2.line AND o2.occ = n2.occ)
SELECT doc_id, count(*) FILTER (WHERE is_added) AS added, count(*) FILTER (WHERE is_removed) AS removed FROM j GROUP BY doc_id""")
def h20_changed_lines(spark, sf_dir):
    """Added / removed lines per document between each text and its edited version."""
    docs = _t(spark, sf_dir, "documents")
    edited = K.replace_text(docs, "text", " the ", " THE ", replace_all=True).select("doc_id", F.col("new_text").alias("text"))
    ch = K.changed_lines(K.numbered_lines(docs, "doc_id"), K.numbered_lines(edited, "doc_id"), "doc_id")
    return K.diff_counts(ch, "doc_id")


# Every line carries its number, so lines are unique and what stays is known: the
# last third of the lines moves to the front and ' the ' is rewritten. Lines that
# stay in order belong to the block that holds the longest unchanged run (the
# first block if equal); those of the other block go and come.
_MOVED = _LINES + """
, k AS (SELECT doc_id, line_no, concat(CAST(line_no AS VARCHAR), ': ', line) AS line, count(*) OVER (PARTITION BY doc_id) AS n FROM lines),
e AS (SELECT *, replace(line, ' the ', ' THE ') AS edited, line_no > n - n // 3 AS tail FROM k),
r AS (SELECT *, line = edited AS same, line_no - row_number() OVER (PARTITION BY doc_id, tail, line = edited ORDER BY line_no) AS grp FROM e),
run AS (SELECT doc_id, tail, count(*) AS len, min(line_no) AS first FROM r WHERE same GROUP BY doc_id, tail, grp),
best AS (SELECT doc_id, arg_min(tail, {'a': -len, 'b': first}) AS tail FROM run GROUP BY doc_id),
x AS (SELECT r.doc_id, line_no, CASE WHEN r.tail THEN line_no - (n - n // 3) ELSE line_no + n // 3 END AS new_no,
             same AND r.tail = best.tail IS TRUE AS kept, edited FROM r LEFT JOIN best USING (doc_id))
SELECT d.doc_id, count(*) FILTER (WHERE NOT kept) AS added, count(*) FILTER (WHERE NOT kept) AS removed,
       md5(coalesce(string_agg(CASE WHEN NOT kept THEN CAST(line_no AS VARCHAR) END, ',' ORDER BY line_no), '')) AS removed_md5,
       md5(coalesce(string_agg(CASE WHEN NOT kept THEN concat(CAST(new_no AS VARCHAR), ' ', edited) END, chr(10) ORDER BY new_no), '')) AS added_md5
FROM documents d JOIN x USING (doc_id) GROUP BY d.doc_id"""


@query("h20_line_diff", _MOVED)
def h20_line_diff(spark, sf_dir):
    """Diff in order between the numbered lines of every document and a version
    whose last third comes first and whose ' the ' is rewritten."""
    docs = _t(spark, sf_dir, "documents")
    lines = F.transform(K.split_lines(F.col("text")), lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), F.regexp_replace(x, D._BOUNDARY, " ")))
    d = docs.select("doc_id", lines.alias("x")).filter(F.size("x") > 0)
    edited = F.transform("x", lambda x: F.replace(x, F.lit(" the "), F.lit(" THE ")))
    keep = F.size("x") - F.floor(F.size("x") / 3).cast("int")
    moved = F.concat(F.slice(edited, keep + 1, F.size("x") - keep), F.slice(edited, F.lit(1), keep))
    old, new = d.select("doc_id", F.array_join("x", "\n").alias("text")), d.select("doc_id", F.array_join(moved, "\n").alias("text"))
    diffs = D.diff_texts(old, new, "doc_id").withColumns({"n_added": D.added(), "n_removed": D.removed()})
    # a document's first line stands for it where nothing changed
    changes = D.diff_lines(diffs, "doc_id", "n_added", "n_removed").filter("kind != 'kept' or position = 0")
    removed = F.array_sort(F.collect_list(F.when(F.col("kind") == "removed", F.col("old_line_no"))))
    added = F.array_sort(F.collect_list(F.when(F.col("kind") == "added", F.struct("new_line_no", "line"))))
    return changes.groupBy("doc_id").agg(
        F.first("n_added").alias("added"), F.first("n_removed").alias("removed"),
        F.md5(F.array_join(removed.cast("array<string>"), ",")).alias("removed_md5"),
        F.md5(F.array_join(F.transform(added, lambda x: F.concat(x.new_line_no.cast("string"), F.lit(" "), x.line)), "\n")).alias("added_md5"))


@query("h1_token_estimate", """
SELECT conv_id, turn, CAST(floor(coalesce(length(text), 0) / 4) AS BIGINT) AS tokens FROM conversations""")
def h1_token_estimate(spark, sf_dir):
    """Token estimate (characters // 4) of every message."""
    c = _t(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", K.token_estimate(F.col("text")).alias("tokens"))


_FMT = """CASE WHEN {n} >= 1000000 THEN concat(CAST(CAST(trunc({n} / 1000000) AS BIGINT) AS VARCHAR), 'm')
     WHEN {n} >= 1000 THEN concat(CAST(CAST(trunc({n} / 1000) AS BIGINT) AS VARCHAR), 'k') ELSE CAST({n} AS VARCHAR) END"""


@query("h2_format_tokens", f"""
SELECT doc_id, {_FMT.format(n='n_chars')} AS f_chars, {_FMT.format(n='n_chars * 977')} AS f_scaled,
       {_FMT.format(n='n_chars * 977 * 977')} AS f_big FROM documents""")
def h2_format_tokens(spark, sf_dir):
    """Compact counts (12k, 3m) of document sizes at three scales."""
    d = _t(spark, sf_dir, "documents")
    n = F.col("n_chars")
    return d.select("doc_id", K.format_tokens(n).alias("f_chars"), K.format_tokens(n * 977).alias("f_scaled"),
                    K.format_tokens(n * 977 * 977).alias("f_big"))


@query("h3_session_label", r"""
, f AS (SELECT session_id, arg_min(text, seq) AS first_text FROM v_entry
        WHERE type = 'message' AND role = 'user' AND coalesce(text, '') <> '' GROUP BY session_id),
s AS (SELECT DISTINCT session_id FROM v_entry),
n AS (SELECT s.session_id, regexp_replace(regexp_replace(coalesce(substring(f.first_text, 1, 100), '(no messages)'), '\s+', ' ', 'g'), '^ | $', '', 'g') AS norm
      FROM s LEFT JOIN f ON s.session_id = f.session_id),
l AS (SELECT session_id, CASE WHEN length(norm) > 72 THEN concat(regexp_replace(substring(norm, 1, 69), '\s+$', ''), '...') ELSE norm END AS lab FROM n)
SELECT session_id, md5(rpad(lab, 72, ' ')) AS label_md5 FROM l""")
def h3_session_label(spark, sf_dir):
    """Session-list label of every session (whitespace collapsed, 72 wide)."""
    e = _t(spark, sf_dir, "v_entry")
    files = e.select("session_id").distinct().withColumn("cwd", F.lit("")) \
             .withColumn("created_s", F.lit(0)).withColumn("modified_s", F.lit(0))
    lst = S.listing(e, files)
    return lst.select("session_id", F.md5(K.session_label(F.col("first_message"))).alias("label_md5"))


@query("h3_age_bucket", """
, a AS (SELECT event_id, greatest(0, 1705000000 - CAST(floor(epoch(ts)) AS BIGINT)) AS d FROM events)
SELECT event_id, concat(lpad(CAST(CASE WHEN d // 60 < 60 THEN d // 60 WHEN d // 3600 < 24 THEN d // 3600 WHEN d // 86400 < 7 THEN d // 86400
                                      WHEN d // 86400 // 7 < 52 THEN d // 86400 // 7 ELSE d // 86400 // 7 // 52 END AS VARCHAR), 2, ' '),
                        CASE WHEN d // 60 < 60 THEN 'm' WHEN d // 3600 < 24 THEN 'h' WHEN d // 86400 < 7 THEN 'd'
                             WHEN d // 86400 // 7 < 52 THEN 'w' ELSE 'y' END) AS age FROM a""")
def h3_age_bucket(spark, sf_dir):
    """Age bucket of every event relative to a fixed now (2024-01-11 19:06:40 UTC)."""
    ev = _t(spark, sf_dir, "events")
    secs = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint")
    return ev.select("event_id", K.age_bucket(F.lit(1705000000), secs).alias("age"))


@query("h7_sanitize", r"""
SELECT doc_id, md5(regexp_replace(replace(replace(regexp_replace(text, '\x1b\[[0-9;]*[a-zA-Z]|\x1b\][^\x07]*\x07|\x1b[()][AB012]', '', 'g'),
                                                  concat(chr(13), chr(10)), chr(10)), chr(13), ''), '[\x00-\x08\x0b-\x1f]', '', 'g')) AS clean_md5
FROM documents""")
def h7_sanitize(spark, sf_dir):
    """Tool-output sanitising of every document (ANSI codes, CR, control characters)."""
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(K.sanitize_output(F.col("text"))).alias("clean_md5"))


# raw JSON text with valid pairs and lone halves of UTF-16 escapes after every line
_RAW_JSON = r"""replace(text, chr(10), concat('\ud83d\ude00 ', CASE doc_id % 4 WHEN 0 THEN '\ud83d x' WHEN 1 THEN '\ude00\ud83d\ude01' WHEN 2 THEN '\ud83d\ud83d\ude02' ELSE '\uDC00\uD800' END, ' '))"""


@query("h7_surrogates", rf"""
, raw AS (SELECT doc_id, {_RAW_JSON} AS t FROM documents),
cut AS (SELECT doc_id, string_split_regex(t, '\\u[dD][89abAB][0-9a-fA-F]{{2}}\\u[dD][c-fC-F][0-9a-fA-F]{{2}}') AS gaps,
               regexp_extract_all(t, '\\u[dD][89abAB][0-9a-fA-F]{{2}}\\u[dD][c-fC-F][0-9a-fA-F]{{2}}') AS pairs FROM raw)
SELECT doc_id, md5(array_to_string(list_transform(range(len(gaps)), lambda i: concat(
         regexp_replace(gaps[i + 1], '\\u[dD][89a-fA-F][0-9a-fA-F]{{2}}', chr(92) || chr(92) || 'ufffd', 'g'), coalesce(pairs[i + 1], ''))), '')) AS clean_md5
FROM cut""")
def h7_surrogates(spark, sf_dir):
    """Lone surrogate escapes in raw JSON text replaced, valid pairs kept."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.expr(_RAW_JSON.replace("\\", "\\\\")).alias("t"))
    return d.select("doc_id", F.md5(K.sanitize_json_surrogates(F.col("t"))).alias("clean_md5"))


@query("h8_tail_truncate", """
, p AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
s AS (SELECT doc_id, text, len(parts) AS total_lines, octet_length(encode(text)) AS nbytes, parts FROM p),
small AS (SELECT doc_id, md5(text) AS kept_md5, CAST(total_lines AS BIGINT) AS kept_lines, CAST(total_lines AS BIGINT) AS total_lines, false AS truncated
          FROM s WHERE total_lines <= 2000 AND nbytes <= 51200),
big AS (SELECT doc_id, total_lines, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM s WHERE NOT (total_lines <= 2000 AND nbytes <= 51200)),
rb AS (SELECT *, sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS b,
              row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) AS k FROM big),
kept AS (SELECT s.doc_id, s.total_lines, md5(coalesce(string_agg(line, chr(10) ORDER BY pos), '')) AS kept_md5, count(line) AS kept_lines
         FROM (SELECT DISTINCT doc_id, total_lines FROM big) s LEFT JOIN rb ON rb.doc_id = s.doc_id AND b <= 51200 AND k <= 2000 GROUP BY s.doc_id, s.total_lines)
SELECT * FROM small
UNION ALL SELECT doc_id, kept_md5, CAST(kept_lines AS BIGINT), CAST(total_lines AS BIGINT), true FROM kept""")
def h8_tail_truncate(spark, sf_dir):
    """Tail of every document within 2000 lines and 50 KB, with kept / total line counts."""
    d = _t(spark, sf_dir, "documents")
    t = K.tail_truncate(d, "doc_id")
    return t.select("doc_id", F.md5("kept_text").alias("kept_md5"), "kept_lines",
                    F.col("total_lines").cast("bigint").alias("total_lines"), "truncated")


_HEAD = """CASE WHEN text IS NULL OR text = '' THEN text WHEN len(string_split(text, chr(10))) > {k}
     THEN concat(array_to_string(string_split(text, chr(10))[1:{k}], chr(10)), chr(10), '... (',
                 CAST(len(string_split(text, chr(10))) - {k} AS VARCHAR), ' lines hidden)') ELSE text END"""


@query("h9_head_truncate", f"""
SELECT doc_id, md5({_HEAD.format(k=20)}) AS head20_md5, md5({_HEAD.format(k=5)}) AS head5_md5 FROM documents""")
def h9_head_truncate(spark, sf_dir):
    """First 20 (export) and 5 (view) lines of every document plus a hidden-lines note."""
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(K.head_truncate(F.col("text"), 20)).alias("head20_md5"),
                    F.md5(K.head_truncate(F.col("text"), 5)).alias("head5_md5"))


@query("h10_paste_fold", r"""
, n AS (SELECT conv_id, turn, regexp_replace(replace(replace(text, concat(chr(13), chr(10)), chr(10)), chr(13), chr(10)), '[\x00-\x09\x0b-\x1f]', '', 'g') AS t FROM conversations),
m AS (SELECT *, len(string_split(t, chr(10))) AS nl, length(t) AS nc FROM n),
b AS (SELECT *, nl > 5 OR nc > 500 AS big,
             sum(CASE WHEN nl > 5 OR nc > 500 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pid FROM m)
SELECT conv_id, turn,
       md5(CASE WHEN NOT big THEN t WHEN nl > 5 THEN concat('[paste #', CAST(pid AS VARCHAR), ' +', CAST(nl AS VARCHAR), ' lines]')
                ELSE concat('[paste #', CAST(pid AS VARCHAR), ' ', CAST(nc AS VARCHAR), ' chars]') END) AS folded_md5,
       md5(t) AS expanded_md5
FROM b""")
def h10_paste_fold(spark, sf_dir):
    """Large messages folded into numbered paste markers per conversation, then expanded back."""
    c = _t(spark, sf_dir, "conversations")
    folded, side = K.fold_pastes(c, "conv_id", "turn")
    out = K.expand_pastes(folded, side, "conv_id", "turn")
    return out.select("conv_id", "turn", F.md5("folded").alias("folded_md5"), F.md5("expanded").alias("expanded_md5"))


@query("h11_content_text", r"""
, p AS (SELECT conv_id, turn, regexp_replace(concat(CASE WHEN turn % 4 = 0 THEN '' ELSE text END,
                                                    CASE WHEN turn % 3 = 0 THEN '[image]' ELSE '' END), '^\s+|\s+$', '', 'g') AS s FROM conversations)
SELECT conv_id, turn, md5(CASE WHEN s = '' THEN '(no content)' ELSE s END) AS text_md5 FROM p""")
def h11_content_text(spark, sf_dir):
    """Display text of mixed text / image message content."""
    c = _t(spark, sf_dir, "conversations")
    txt = F.struct(F.lit("text").alias("type"), F.when(F.col("turn") % 4 == 0, F.lit("")).otherwise(F.col("text")).alias("text"))
    img = F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"))
    content = F.when(F.col("turn") % 3 == 0, F.array(txt, img)).otherwise(F.array(txt))
    return c.select("conv_id", "turn", F.md5(K.content_text(content)).alias("text_md5"))


@query("e10_prompt_history", """
, u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND coalesce(text, '') <> ''),
l AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM u),
k AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS recency FROM l WHERE prev IS DISTINCT FROM text)
SELECT conv_id, turn, CAST(recency AS INTEGER) AS recency FROM k WHERE recency <= 50""")
def e10_prompt_history(spark, sf_dir):
    """Prompt history per conversation: empties and consecutive repeats dropped, newest 50 kept."""
    c = _t(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return K.prompt_history(c, "conv_id", "turn").select("conv_id", "turn", "recency")


# F1: rows-only (no SQL twin); checked against a brute-force scorer in tests.
FUZZY_QUERIES = [(1, "exmpl"), (2, "th/en"), (3, ""), (4, "zzq"), (5, "HTTPS ORG")]


# Brute force: every (query, page) pair walks the query's characters through
# the page URL with a recursive CTE; scored and ranked like the Spark job.
_F1_SQL = ("WITH RECURSIVE qs AS (SELECT * FROM (VALUES "
           + ", ".join(f"({i}, '{q}')" for i, q in FUZZY_QUERIES) + ") AS t(query_id, query)),"
           + r"""
pairs AS (SELECT q.query_id, q.query, lower(q.query) AS lq, p.url AS candidate, lower(p.url) AS lc, p.page_id AS cand_order
          FROM qs q, pages p WHERE q.query <> ''),
walk AS (
  SELECT query_id, query, lq, candidate, lc, cand_order, 0 AS k, 1 AS i, []::INTEGER[] AS ps FROM pairs
  UNION ALL
  SELECT query_id, query, lq, candidate, lc, cand_order, k + 1,
         i + instr(substr(lc, i), substr(lq, k + 1, 1)),
         list_append(ps, i + instr(substr(lc, i), substr(lq, k + 1, 1)) - 2)
  FROM walk WHERE k < length(lq) AND instr(substr(lc, i), substr(lq, k + 1, 1)) > 0
),
matched AS (SELECT query_id, query, candidate, lc, cand_order, ps, len(ps) AS n FROM walk WHERE k = length(lq) AND k > 0),
scored AS (
  SELECT query_id, query, candidate, cand_order, n,
         (n + 0.5 * len(list_filter(ps, lambda x: regexp_matches(substr(lc, x + 1, 1), '^[\p{L}\p{N}]$')
                                      AND (x = 0 OR NOT regexp_matches(substr(lc, x, 1), '^[\p{L}\p{N}]$')))))
         * CASE WHEN n > 1 THEN 1.0 + (n - (1 + len(list_filter(range(1, n), lambda kk: ps[kk + 1] <> ps[kk] + 1))) + 1)::DOUBLE / n ELSE 1.0 END
         * CASE WHEN ps[1] = 0 THEN 1.2 ELSE 1.0 END AS score
  FROM matched),
nonempty AS (SELECT query_id, query, candidate, cand_order, round(score, 9) AS score,
                    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate, cand_order) AS rank
             FROM scored WHERE score > 0),
empty AS (SELECT q.query_id, q.query, p.url AS candidate, p.page_id AS cand_order, 1.0 AS score,
                 row_number() OVER (PARTITION BY q.query_id ORDER BY p.page_id) AS rank
          FROM qs q, pages p WHERE q.query = '')
SELECT query_id, query, candidate, cand_order, score, CAST(rank AS INTEGER) AS rank FROM nonempty WHERE rank <= 50
UNION ALL SELECT query_id, query, candidate, cand_order, score, CAST(rank AS INTEGER) AS rank FROM empty WHERE rank <= 50""")


@query("f1_fuzzy_match", _F1_SQL, views=False)
def f1_fuzzy_match(spark, sf_dir):
    """Fuzzy completion of a batch of queries against every page URL, top 50 per query."""
    pages = _t(spark, sf_dir, "pages").select(F.col("url").alias("candidate"), F.col("page_id").alias("cand_order"))
    q = spark.createDataFrame(FUZZY_QUERIES, "query_id int, query string")
    return K.fuzzy_match(pages, q)
