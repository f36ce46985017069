"""Context-management operators.

Routing context: E3 pivots, E4 segments, E13 compaction schedule, E14 context
text, E16 request payloads, E17 latest input, H21 briefing rule.
Agent context documents: H4 frontmatter, H5 skill checks, C11 skill overlay,
C10 guideline files of ancestor directories, H6 prompt sections.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlens import dims
from tierlens.functions.text import strip_ws
from tierlens.operators import ordered

# ---- FIXED VALUES ----------------------------------------------------------
SUMMARY_HEADER = "## Summary of earlier conversation\n\n"
BRIEFING_PREFIX = ("CONTEXT BRIEFING: Use the following information ONLY if it is directly relevant "
                   "to the user's current query. If the user has changed the subject, ignore this context.\n"
                   "--- PRIOR CONTEXT ---\n")
TOPIC_SHIFT_WORD = "NONE"
TOPIC_SHIFT_MAX_LEN = 15
SKILL_NAME_MAX = 64
SKILL_DESCRIPTION_MAX = 1024
SKILL_NAME_PATTERN = r"^[a-z0-9-]+$"
WARN_DIRECTORY = 'name "%s" does not match directory "%s"'
WARN_NAME_LENGTH = f"name exceeds {SKILL_NAME_MAX} characters"
WARN_NAME_CHARACTERS = "name must be lowercase a-z, 0-9, hyphens only"
WARN_HYPHEN_ENDS = "name must not start or end with hyphen"
WARN_HYPHEN_PAIRS = "name must not contain consecutive hyphens"
WARN_NO_DESCRIPTION = "description is required"
WARN_DESCRIPTION_LENGTH = f"description exceeds {SKILL_DESCRIPTION_MAX} characters"
GUIDELINE_FILE_NAMES = ["AGENTS.md", "CLAUDE.md"]
SKILLS_SECTION_HEAD = [
    "# Skills",
    "",
    "The following skills provide specialized instructions for specific tasks.",
    "Use the read tool to load a skill's file when the task matches its description.",
    "",
    "<available_skills>",
]
GUIDELINES_SECTION_HEAD = ["# Project Context", "", "Project guidelines for coding agents.", "", "<project_guidelines>"]
# ---- end of fixed values ---------------------------------------------------


# ---------------------------------------------------------------- routing context
def pivots(df: DataFrame, key: str = "conv_id", order: str = "turn", tier_col: str = "tier",
           chunk: int = ordered.DEFAULT_CHUNK) -> DataFrame:
    """A turn pivots when its tier differs from the previous turn's; the
    first turn never does."""
    d = ordered.previous(df, key, order, F.col(tier_col), "prev_tier", chunk)
    return d.withColumn("is_pivot", F.coalesce(F.col("prev_tier") != F.col(tier_col), F.lit(False)))


def segments(df: DataFrame, key: str = "conv_id", order: str = "turn", tier_col: str = "tier",
             chunk: int = ordered.DEFAULT_CHUNK) -> DataFrame:
    """E3 and E4 in one pass over routed turns: ``prev_tier``, ``is_pivot`` and
    the segment id, a running count of pivots; the turns of a segment are the
    pending turns, earlier segments are folded into the briefing."""
    d = ordered.changes(df, key, order, F.col(tier_col), lambda prev, cur: prev != cur, "prev_tier", "segment_id", chunk=chunk)
    return d.withColumn("is_pivot", F.coalesce(F.col("prev_tier") != F.col(tier_col), F.lit(False)))


def segment_summary(df: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """E4 per segment: first / last turn, turns and characters pending when the
    next pivot folds them into a briefing (one grouped aggregate)."""
    chars = F.coalesce(F.length("query"), F.lit(0)) + F.coalesce(F.length("response"), F.lit(0))
    return df.groupBy(key, "segment_id").agg(
        F.min(order).alias("first_turn"), F.max(order).alias("last_turn"),
        F.count(F.lit(1)).alias("n_turns"), F.sum(chars).cast("bigint").alias("pending_chars"))


def payload_stats(df: DataFrame, key: str = "conv_id", order: str = "turn", briefings: DataFrame | None = None,
                  chunk: int = ordered.DEFAULT_CHUNK) -> DataFrame:
    """E16 without materialising payloads: per turn, whether a briefing system
    message leads (the pivot into its segment left one; with ``briefings``, a
    (key, segment_id, briefing) frame, only one that signals no topic shift, H21),
    how many pending messages precede the
    new query (2 per earlier turn of the same segment), and their characters.
    Running sums keep this linear instead of one array per turn."""
    chars = F.coalesce(F.length("query"), F.lit(0)) + F.coalesce(F.length("response"), F.lit(0))
    d = ordered.scan(df, [key, "segment_id"], order, [("sum", F.lit(1), "_k", False),
                                                      ("sum", chars, "_c", False)], chunk)
    leads = F.col("segment_id") > 0
    if briefings is not None:
        kept = briefings.select(key, "segment_id", (F.coalesce(briefing_after_rule(F.col("briefing")), F.lit("")) != "").alias("_b"))
        d = d.join(kept, [key, "segment_id"], "left")
        leads = leads & F.coalesce("_b", F.lit(False))
    return (d.withColumn("has_briefing", leads)
             .withColumn("pending_messages", (2 * F.col("_k")).cast("bigint"))
             .withColumn("pending_chars", F.col("_c").cast("bigint"))
             .withColumn("n_messages", F.col("pending_messages") + 1 + F.col("has_briefing").cast("int"))
             .drop("_k", "_c", "_b"))


def latest_payload(df: DataFrame, briefings: DataFrame | None = None, key: str = "conv_id",
                   order: str = "turn") -> DataFrame:
    """E16 materialised for the newest turn of each conversation only: the
    briefing (if any) as a system message, the open segment's turns in order,
    then the new query. ``briefings``: (key, briefing); one that signals a topic
    shift (H21) is left out."""
    newest = df.groupBy(key).agg(F.max_by("segment_id", order).alias("_seg"), F.max(order).alias("_last"))
    open_seg = df.join(newest, key).filter((F.col("segment_id") == F.col("_seg")) & (F.col(order) < F.col("_last")))
    pend = open_seg.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "query", "response"))).alias("_t"))
    q = df.join(newest, key).filter(F.col(order) == F.col("_last")).select(key, "query")
    out = q.join(pend, key, "left")
    if briefings is not None:
        out = out.join(briefings, key, "left").withColumn("briefing", briefing_after_rule(F.col("briefing")))
    else:
        out = out.withColumn("briefing", F.lit(None).cast("string"))
    turns = F.flatten(F.transform(F.coalesce(F.col("_t"), F.array()), lambda t: F.array(
        F.struct(F.lit("user").alias("role"), t["query"].alias("content")),
        F.struct(F.lit("assistant").alias("role"), t["response"].alias("content")))))
    sys_msg = F.when(F.coalesce(F.col("briefing"), F.lit("")) != "", F.array(F.struct(
        F.lit("system").alias("role"), F.concat(F.lit(BRIEFING_PREFIX), F.col("briefing")).alias("content")))) \
        .otherwise(F.array().cast("array<struct<role:string,content:string>>"))
    last = F.array(F.struct(F.lit("user").alias("role"), F.col("query").alias("content")))
    return out.select(key, F.concat(sys_msg, turns, last).alias("messages"))


def compaction_schedule(df: DataFrame, key: str = "conv_id", order: str = "turn",
                        interval: int = dims.SUMMARY_INTERVAL, chunk: int = ordered.DEFAULT_CHUNK) -> DataFrame:
    """Before call n the log is compacted when it holds >= K entries; every
    call adds two entries and a compaction leaves one. Counting this through
    gives: the first compaction comes before call n1 = ceil(K/2) + 1, then every
    p = max(1, ceil((K-1)/2)) calls. Call numbers come from a running count."""
    n1 = math.ceil(interval / 2) + 1
    p = max(1, math.ceil((interval - 1) / 2))
    d = ordered.running_sum(df, key, order, F.lit(1), "call_no", chunk)
    n = F.col("call_no")
    return d.withColumn("compact_before", (n >= n1) & (((n - n1) % p) == 0))


#: What stands between two entries of a context text, and characters of a block of it, about.
CONTEXT_SEPARATOR = "\n\n"
CONTEXT_BLOCK_CHARS = 16_384


def context_entries(entries: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """(key, order, piece): the entries of a router log as they stand in its
    context: ``[role]: content``, the summary under its header. Only entries from
    the newest summary on are kept, which is what the compacted log holds."""
    is_sum = F.col("role") == "summary"
    last_sum = entries.filter(is_sum).groupBy(key).agg(F.max(order).alias("_s"))
    e = entries.join(last_sum, key, "left").filter(F.col("_s").isNull() | (F.col(order) >= F.col("_s")))
    piece = F.when(is_sum, F.concat(F.lit(SUMMARY_HEADER), F.coalesce("text", F.lit(""))))\
             .otherwise(F.concat(F.lit("["), F.coalesce("role", F.lit("")), F.lit("]: "), F.coalesce("text", F.lit(""))))
    return e.select(key, order, piece.alias("piece"))


def _joined(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("piece").alias("b")))).alias("_a"))
    return g.select(*keys, F.array_join(F.transform("_a", lambda x: x["b"]), CONTEXT_SEPARATOR).alias("text"))


def context_text(entries: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Context string of a router log, its pieces separated by a blank line.
    One row holds one conversation's text; :func:`context_blocks` is for any length."""
    return _joined(context_entries(entries, key, order), [key], order).withColumnRenamed("text", "context")


def context_blocks(entries: DataFrame, key: str = "conv_id", order: str = "turn", block_chars: int = CONTEXT_BLOCK_CHARS,
                   chunk: int = ordered.DEFAULT_CHUNK) -> DataFrame:
    """E14 in blocks: ``key, block_no, text``; a conversation's blocks in order,
    joined by the separator, are its context text. An entry belongs to the block
    in which it starts (a running sum of lengths, cut into chunks), so a block holds
    about ``block_chars`` characters however long the conversation."""
    size = F.length("piece") + len(CONTEXT_SEPARATOR)
    d = ordered.running_sum(context_entries(entries, key, order), key, order, size, "_at", chunk, include_current=False)
    d = d.withColumn("block_no", F.floor(F.col("_at") / block_chars).cast("bigint"))
    return _joined(d, [key, "block_no"], order)


def latest_input(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The newest user or tool-result message per conversation; its text
    parts joined by newlines and images as ``Image: <data>`` (``parts``, where
    the messages have them, else ``text``), with a ``Tool result for <name>:``
    prefix."""
    if "parts" in messages.columns:
        shown = F.transform("parts", lambda p: F.when((p["kind"] == "text") & (p["text"] != ""), p["text"])
                            .when((p["kind"] == "image") & (p["data"] != ""), F.concat(F.lit("Image: "), p["data"])))
        messages = messages.withColumn("text", F.array_join(shown, "\n"))
    cand = messages.filter(F.col("role").isin("user", "tool_result"))
    newest = cand.groupBy(key).agg(F.max_by(F.struct("role", "text", "tool_name"), order).alias("_m"))
    m = F.col("_m")
    return newest.select(key, F.when(m["role"] == "tool_result",
                                     F.concat(F.lit("Tool result for "), F.coalesce(m["tool_name"], F.lit("")), F.lit(":\n"),
                                              F.coalesce(m["text"], F.lit(""))))
                         .otherwise(F.coalesce(m["text"], F.lit(""))).alias("latest_input"))


def briefing_after_rule(briefing: Column) -> Column:
    """A briefing containing NONE (any case) and shorter than 15
    characters signals a topic shift and clears the briefing."""
    b = strip_ws(briefing)
    shift = F.upper(b).contains(TOPIC_SHIFT_WORD) & (F.length(b) < TOPIC_SHIFT_MAX_LEN)
    return F.when(shift, F.lit("")).otherwise(b)


# ---------------------------------------------------------------- documents
def frontmatter(content: Column) -> Column:
    """H4: ``map<string,string>`` from a leading ``---`` block closed by a
    ``---`` line; blank and ``#`` lines skipped, the first colon splits, one
    pair of matching quotes stripped, the last duplicate key wins. Empty map
    when the block is absent or unclosed."""
    block = F.regexp_extract(content, r"(?s)^---(.*?)\n---\s*\n", 1)
    has = content.startswith("---") & content.rlike(r"(?s)^---.*?\n---\s*\n")
    lines = F.filter(F.transform(F.split(block, "\n"), lambda x: strip_ws(x)),
                     lambda x: (x != "") & ~x.startswith("#") & x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(
        strip_ws(F.substring_index(x, ":", 1)).alias("key"),
        _unquote(strip_ws(F.regexp_extract(x, r"^[^:]*:(.*)$", 1))).alias("value")))
    # the pairs bound to a name: a lambda over an expression would evaluate it for every element
    last_wins = F.get(F.transform(F.array(pairs), lambda all_: F.map_from_entries(F.filter(
        all_, lambda p, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda q: q["key"] == p["key"])))), F.lit(0))
    empty = F.create_map().cast("map<string,string>")
    return F.when(has, last_wins).otherwise(empty)


def _unquote(v: Column) -> Column:
    first, last = F.substring(v, 1, 1), F.substring(v, -1, 1)
    quoted = (F.length(v) > 0) & first.isin('"', "'") & (last == first)
    return F.when(quoted, v.substr(F.lit(2), F.length(v) - 2)).otherwise(v)


def skill_checks(name: Column, description: Column, dir_name: Column) -> Column:
    """H5: warnings of one skill, in rule order (array of strings)."""
    d = F.coalesce(description, F.lit(""))
    rules = [
        F.when(name != dir_name, F.format_string(WARN_DIRECTORY, name, dir_name)),
        F.when(F.length(name) > SKILL_NAME_MAX, F.lit(WARN_NAME_LENGTH)),
        F.when(~name.rlike(SKILL_NAME_PATTERN), F.lit(WARN_NAME_CHARACTERS)),
        F.when(name.startswith("-") | name.endswith("-"), F.lit(WARN_HYPHEN_ENDS)),
        F.when(name.contains("--"), F.lit(WARN_HYPHEN_PAIRS)),
        F.when(strip_ws(d) == "", F.lit(WARN_NO_DESCRIPTION)),
        F.when(F.length(d) > SKILL_DESCRIPTION_MAX, F.lit(WARN_DESCRIPTION_LENGTH)),
    ]
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def load_skills(files: DataFrame) -> DataFrame:
    """H4 + H5 per skill file (``path``, ``dir_name``, ``layer``, ``content``):
    name (falls back to the directory), description, warnings, loaded flag
    (skills without a description are not loaded)."""
    fm = files.select("*", F.explode(F.array(frontmatter(F.col("content")))).alias("_fm"))  # parsed once, not in every use
    name = F.coalesce(F.when(F.col("_fm")["name"] != "", F.col("_fm")["name"]), F.col("dir_name"))
    desc = F.coalesce(F.col("_fm")["description"], F.lit(""))
    out = fm.withColumn("name", name).withColumn("description", desc)
    return (out.withColumn("warnings", skill_checks(F.col("name"), F.col("description"), F.col("dir_name")))
               .withColumn("loaded", strip_ws(F.col("description")) != "").drop("_fm"))


def overlay_skills(skills: DataFrame, layer_order=("local", "global")) -> DataFrame:
    """C11: local beats global per name (then path order inside a layer); the
    losers are reported as collisions against the winner. Winner per name is a
    grouped min over (layer rank, path): partial aggregation, no window."""
    rank = F.lit(len(layer_order))
    for i, lay in reversed(list(enumerate(layer_order))):
        rank = F.when(F.col("layer") == lay, F.lit(i)).otherwise(rank)
    s = skills.filter("loaded").withColumn("_r", rank)
    win = s.groupBy("name").agg(F.min(F.struct("_r", "path")).alias("_w")).select("name", F.col("_w.path").alias("winner_path"))
    out = s.join(win, "name")
    return out.select("name", "path", "layer", (F.col("path") == F.col("winner_path")).alias("is_winner"),
                      F.when(F.col("path") != F.col("winner_path"),
                             F.format_string('name collision: "%s" already loaded from %s', F.col("name"), F.col("winner_path")))
                      .alias("warning"))


def escape_xml(c: Column) -> Column:
    """H6: ampersand first, then < > " '."""
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def ancestor_dirs(cwd: Column, stop_dir: Column) -> Column:
    """Directories from ``stop_dir`` down to ``cwd`` (root first) as
    array<struct<depth, dir>>; just ``cwd`` when it is not under ``stop_dir``."""
    under = cwd.startswith(F.concat(stop_dir, F.lit("/")))
    rest = cwd.substr(F.length(stop_dir) + 2, F.length(cwd))
    parts = F.split(rest, "/")
    lst = F.transform(F.sequence(F.lit(1), F.size(parts)),
                      lambda k: F.struct(k.alias("depth"),
                                         F.concat(stop_dir, F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")).alias("dir")))
    root = F.array(F.struct(F.lit(0).alias("depth"), stop_dir.alias("dir")))
    return F.when(cwd == stop_dir, root).when(under, F.concat(root, lst)) \
            .otherwise(F.array(F.struct(F.lit(0).alias("depth"), cwd.alias("dir"))))


def guideline_files(workdirs: DataFrame, files: DataFrame, global_dir: str | None = None) -> DataFrame:
    """Per working directory (``cwd``, ``stop_dir``), the guideline file of
    every ancestor directory from the stop directory down to it, at most one
    per directory (the first candidate name wins), root first; the global
    config directory comes first (depth -1); a path is listed once per
    working directory.

    ``files``: (dir, file_name, path, content). The global directory is one
    more exploded ancestor, so every directory (global included) meets its
    file through one equi-join on ``dir``: no per-directory scan, no nested
    loop, no cross join."""
    prio = F.array_position(F.array(*[F.lit(n) for n in GUIDELINE_FILE_NAMES]), F.col("file_name"))
    cands = files.filter(prio > 0).withColumn("_prio", prio)
    best = cands.groupBy("dir").agg(F.min(F.struct("_prio", "path", "content")).alias("_b")) \
                .select("dir", F.col("_b.path").alias("path"), F.col("_b.content").alias("content"))
    dirs = ancestor_dirs(F.col("cwd"), F.col("stop_dir"))
    if global_dir is not None:
        dirs = F.concat(F.array(F.struct(F.lit(-1).alias("depth"), F.lit(global_dir).alias("dir"))), dirs)
    anc = workdirs.select("cwd", F.explode(dirs).alias("_a")) \
                  .select("cwd", F.col("_a.depth").alias("depth"), F.col("_a.dir").alias("dir"))
    out = anc.join(best, "dir").select("cwd", "depth", "path", "content")
    if global_dir is not None:
        out = out.groupBy("cwd", "path").agg(F.min(F.struct("depth", "content")).alias("_d")) \
                 .select("cwd", F.col("_d.depth").alias("depth"), "path", F.col("_d.content").alias("content"))
    return out


def guidelines_section(files: DataFrame) -> DataFrame:
    """H6: the project-guidelines prompt section per working directory, files
    in depth order, paths and contents escaped."""
    block = F.concat(F.lit('<file path="'), escape_xml(F.col("path")), F.lit('">\n'),
                     escape_xml(F.col("content")), F.lit("\n</file>"))
    g = files.groupBy("cwd").agg(F.array_sort(F.collect_list(F.struct("depth", block.alias("b")))).alias("_a"))
    head = "\n".join(GUIDELINES_SECTION_HEAD)
    return g.select("cwd", F.concat(F.lit(head + "\n"), F.array_join(F.transform("_a", lambda x: x["b"]), "\n"),
                                    F.lit("\n</project_guidelines>")).alias("section"))


def skill_block(name: Column, description: Column, path: Column) -> Column:
    """H6: one ``<skill>`` entry of the skills section."""
    return F.concat(F.lit("<skill>\n<name>"), escape_xml(name), F.lit("</name>\n<description>"), escape_xml(description),
                    F.lit("</description>\n<location>"), escape_xml(path), F.lit("</location>\n</skill>"))


def skill_blocks(skills: DataFrame) -> DataFrame:
    """H6 for catalogues of any size: one escaped ``<skill>`` block per row,
    ordered by (name, path); the section head and tail are fixed text. A
    writer streams the blocks in that order, so no catalogue is gathered
    into a single row."""
    return skills.withColumn("block", skill_block(F.col("name"), F.col("description"), F.col("path")))
