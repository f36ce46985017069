"""Session-log operators over a tagged entry table.

Entry schema (one wide nullable row per entry): ``session_id, seq, type,
role, text, input_tokens, output_tokens, value`` plus optional ``id``,
``parent_id``, ``stop_reason``, ``cache_read``, ``cache_write``.

Per-session aggregates are grouped aggregates (map-side partial aggregation,
so a hot session is combined in parallel); per-session ordered scans use the
chunked scans of :mod:`tierlens.operators.ordered`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlens.functions.text import strip_ws
from tierlens.operators import ordered

# ---- FIXED VALUES ----------------------------------------------------------
COMPACTION_QUESTION = "What did we do so far?"
NO_MESSAGES = "(no messages)"
FIRST_MESSAGE_CHARS = 100
DEFAULT_CONTEXT_WINDOW = 200_000
DEFAULT_BUFFER = 20_000
# ---- end of fixed values ---------------------------------------------------


def _col_or_null(df: DataFrame, name: str, dtype: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def last_compaction(entries: DataFrame) -> DataFrame:
    """(session_id, c_seq, summary) of the newest compaction entry per session."""
    return (entries.filter(F.col("type") == "compaction").groupBy("session_id")
                   .agg(F.max_by(F.struct(F.col("seq").alias("c_seq"), F.col("value").alias("summary")), "seq").alias("_c"))
                   .select("session_id", "_c.*"))


def compacted_view(entries: DataFrame) -> DataFrame:
    """Messages for the model context. Without a compaction: every message.
    Otherwise: a synthetic question, the newest summary, then the messages
    after that compaction entry. Ordered by (part, seq)."""
    lc = last_compaction(entries)
    msgs = entries.filter(F.col("type") == "message").join(lc, "session_id", "left")
    kept = (msgs.filter(F.col("c_seq").isNull() | (F.col("seq") > F.col("c_seq")))
                .select("session_id", F.lit(2).alias("part"), "seq", "role", "text",
                        _col_or_null(msgs, "stop_reason", "string").alias("stop_reason")))
    q = lc.select("session_id", F.lit(0).alias("part"), F.col("c_seq").alias("seq"), F.lit("user").alias("role"),
                  F.lit(COMPACTION_QUESTION).alias("text"), F.lit(None).cast("string").alias("stop_reason"))
    a = lc.select("session_id", F.lit(1).alias("part"), F.col("c_seq").alias("seq"), F.lit("assistant").alias("role"),
                  F.col("summary").alias("text"), F.lit("stop").alias("stop_reason"))
    return q.unionByName(a).unionByName(kept)


def last_assistant_text(view: DataFrame) -> DataFrame:
    """Text of the newest assistant message of the compacted view, skipping
    interrupted empty ones; trimmed, empty -> NULL (no further look-back)."""
    skip = (F.col("stop_reason") == "interrupted") & (F.coalesce(F.col("text"), F.lit("")) == "")
    cand = view.filter((F.col("role") == "assistant") & ~F.coalesce(skip, F.lit(False)))
    out = cand.groupBy("session_id").agg(F.max_by("text", F.struct("part", "seq")).alias("_t"))
    t = strip_ws(F.coalesce(F.col("_t"), F.lit("")))
    return out.select("session_id", F.when(t != "", t).alias("last_assistant_text"))


def settings_in_effect(entries: DataFrame, initial_model: str | None = None,
                       chunk: int = ordered.DEFAULT_CHUNK) -> DataFrame:
    """E5: model, session name and (where the log has it) thinking level in
    effect at every entry (initial model when none was set; empty names ignored)."""
    model_v = F.when(F.col("type") == "model_change", F.col("value"))
    name_v = F.when((F.col("type") == "session_info") & (F.coalesce(F.col("value"), F.lit("")) != ""), F.col("value"))
    specs = [("last", model_v, "_m", True), ("last", name_v, "session_name", True)]
    if "thinking_level" in entries.columns:
        entries = entries.withColumnRenamed("thinking_level", "_level")
        specs.append(("last", F.when(F.col("type") == "thinking_level_change", F.col("_level")), "thinking_level", True))
    d = ordered.scan(entries, "session_id", "seq", specs, chunk).drop("_level")
    return d.withColumn("model", F.coalesce(F.col("_m"), F.lit(initial_model))).drop("_m")


def settings_at_end(entries: DataFrame, initial_model: str | None = None) -> DataFrame:
    """E5 at session end: one grouped aggregate per session; the thinking level
    too where the log has it (null: none was set)."""
    def newest(value: Column, kind: str, set_: Column) -> Column:
        return F.max_by(value, F.when((F.col("type") == kind) & set_, F.col("seq")))

    value = F.col("value")
    aggs = [newest(value, "model_change", value.isNotNull()).alias("_m"),
            newest(value, "session_info", F.coalesce(value, F.lit("")) != "").alias("session_name")]
    cols = [F.coalesce("_m", F.lit(initial_model)).alias("model"), F.col("session_name")]
    if "thinking_level" in entries.columns:
        level = F.col("thinking_level")
        aggs.append(newest(level, "thinking_level_change", level.isNotNull()).alias("_level"))
        cols.append(F.col("_level").alias("thinking_level"))
    return entries.groupBy("session_id").agg(*aggs).select("session_id", *cols)


def drop_noop_changes(entries: DataFrame, initial_model: str | None = None,
                      chunk: int = ordered.DEFAULT_CHUNK) -> DataFrame:
    """A model change equal to the model already in effect is dropped. A
    model is its id together with provider and base address, where the log has
    them; ``initial_model`` has neither."""
    def model(value: Column, provider: Column, base_url: Column) -> Column:
        return F.struct(value.alias("model_id"), provider.alias("provider"), base_url.alias("base_url"))

    none = F.lit(None).cast("string")
    own = model(F.col("value"), _col_or_null(entries, "provider", "string"), _col_or_null(entries, "base_url", "string"))
    is_change = F.col("type") == "model_change"
    d = ordered.running_last(entries.withColumn("_model", own), "session_id", "seq", F.when(is_change, F.col("_model")), "_before", chunk,
                             include_current=False)
    before = F.coalesce(F.col("_before"), model(F.lit(initial_model).cast("string"), none, none))
    noop = is_change & before.eqNullSafe(F.col("_model"))
    return d.filter(~noop).drop("_before", "_model")


def overflow_turns(entries: DataFrame, context_window: int = DEFAULT_CONTEXT_WINDOW,
                   max_output: int = 16384, buffer: int = DEFAULT_BUFFER) -> DataFrame:
    """Per assistant turn with usage (error turns skipped): the sum of the
    four usage counters against ``window - min(buffer, max_output)``."""
    cr = _col_or_null(entries, "cache_read", "bigint")
    cw = _col_or_null(entries, "cache_write", "bigint")
    sr = _col_or_null(entries, "stop_reason", "string")
    has_usage = F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull()
    turns = entries.filter((F.col("type") == "message") & (F.col("role") == "assistant") & has_usage
                           & ~F.coalesce(sr == "error", F.lit(False)))
    used = (F.coalesce(F.col("input_tokens"), F.lit(0)) + F.coalesce(F.col("output_tokens"), F.lit(0))
            + F.coalesce(cr, F.lit(0)) + F.coalesce(cw, F.lit(0)))
    limit = context_window - min(buffer, max_output)
    return (turns.withColumn("tokens_before", used.cast("bigint"))
                 .withColumn("overflow", F.col("tokens_before") >= F.lit(limit)))


def listing(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Id, cwd, created, modified, message count (all roles), first
    user text (100 chars) or ``(no messages)``; newest file first. A user message
    counts with its first part: if that is no text (an image), the next user
    message is asked; logs without parts count with their text. ``files``
    carries the header and file metadata: session_id, cwd, created_s,
    modified_s; sessions without a header row are not listed."""
    is_msg = F.col("type") == "message"
    text = F.col("text")
    if "parts" in entries.columns:
        lead = F.get("parts", F.lit(0))
        text = F.when(lead["kind"] == "text", lead["text"])
    first_user = F.when(is_msg & (F.col("role") == "user") & (F.coalesce(text, F.lit("")) != ""), F.col("seq"))
    g = entries.groupBy("session_id").agg(
        F.sum(is_msg.cast("int")).cast("bigint").alias("message_count"),
        F.min_by(text, first_user).alias("_first"))
    out = (files.join(g, "session_id", "left")
                .withColumn("message_count", F.coalesce("message_count", F.lit(0)).cast("bigint"))
                .withColumn("first_message", F.coalesce(F.substring("_first", 1, FIRST_MESSAGE_CHARS), F.lit(NO_MESSAGES))))
    return out.drop("_first").orderBy(F.col("modified_s").desc(), "session_id")


def counts(entries: DataFrame) -> DataFrame:
    """User / assistant / tool-call / tool-result counts and token totals, cached tokens apart."""
    is_msg = F.col("type") == "message"
    n_calls = F.size(F.col("tool_calls")) if "tool_calls" in entries.columns else F.lit(0)
    asst = is_msg & (F.col("role") == "assistant")
    return entries.groupBy("session_id").agg(
        F.sum((is_msg & (F.col("role") == "user")).cast("int")).cast("bigint").alias("n_user"),
        F.sum(asst.cast("int")).cast("bigint").alias("n_assistant"),
        F.sum(F.when(asst, F.greatest(n_calls, F.lit(0))).otherwise(0)).cast("bigint").alias("n_tool_calls"),
        F.sum((is_msg & (F.col("role") == "tool_result")).cast("int")).cast("bigint").alias("n_tool_results"),
        F.coalesce(F.sum(F.when(asst, F.col("input_tokens"))), F.lit(0)).cast("bigint").alias("input_tokens"),
        F.coalesce(F.sum(F.when(asst, F.col("output_tokens"))), F.lit(0)).cast("bigint").alias("output_tokens"),
        F.coalesce(F.sum(F.when(asst, _col_or_null(entries, "cache_read", "bigint"))), F.lit(0)).cast("bigint").alias("cached_tokens"),
    ).withColumn("n_messages", F.col("n_user") + F.col("n_assistant")) \
     .withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


def token_totals(entries: DataFrame) -> DataFrame:
    """Token sums over assistant usage and the current context size =
    input + output of the newest assistant usage."""
    cr = _col_or_null(entries, "cache_read", "bigint")
    asst = (F.col("type") == "message") & (F.col("role") == "assistant") & \
        (F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull())
    ctx = F.coalesce(F.col("input_tokens"), F.lit(0)) + F.coalesce(F.col("output_tokens"), F.lit(0))
    return entries.filter(asst).groupBy("session_id").agg(
        F.sum(F.coalesce("input_tokens", F.lit(0))).cast("bigint").alias("input_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).cast("bigint").alias("output_tokens"),
        F.sum(F.coalesce(cr, F.lit(0))).cast("bigint").alias("cached_tokens"),
        F.max_by(ctx, "seq").cast("bigint").alias("context_tokens"))


def run_usage(entries: DataFrame, continue_text: str | Column | None = None,
              chunk: int = ordered.DEFAULT_CHUNK) -> DataFrame:
    """Usage per agent run; a run starts at a user message (the
    synthetic continue message after a compaction does not start one)."""
    is_user = (F.col("type") == "message") & (F.col("role") == "user")
    if continue_text is not None:
        is_user = is_user & (F.coalesce(F.col("text"), F.lit("")) != continue_text)
    d = ordered.running_sum(entries, "session_id", "seq", is_user.cast("int"), "run_no", chunk)
    asst = (F.col("type") == "message") & (F.col("role") == "assistant")
    cr = _col_or_null(d, "cache_read", "bigint")
    cw = _col_or_null(d, "cache_write", "bigint")
    sr = _col_or_null(d, "stop_reason", "string")
    return (d.filter(F.col("run_no") > 0).groupBy("session_id", "run_no").agg(
        F.sum(F.when(asst, F.coalesce("input_tokens", F.lit(0))).otherwise(0)).cast("bigint").alias("input_tokens"),
        F.sum(F.when(asst, F.coalesce("output_tokens", F.lit(0))).otherwise(0)).cast("bigint").alias("output_tokens"),
        F.sum(F.when(asst, F.coalesce(cr, F.lit(0))).otherwise(0)).cast("bigint").alias("cache_read"),
        F.sum(F.when(asst, F.coalesce(cw, F.lit(0))).otherwise(0)).cast("bigint").alias("cache_write"),
        F.sum(asst.cast("int")).cast("bigint").alias("turns"),
        F.max_by(sr, F.when(asst, F.col("seq"))).alias("stop_reason")))


def chain_check(entries: DataFrame, chunk: int = ordered.DEFAULT_CHUNK) -> DataFrame:
    """Each entry's parent must be the previous entry; report broken
    links, parents missing from the session and duplicate ids."""
    d = ordered.previous(entries, "session_id", "seq", F.col("id"), "_expected", chunk)
    ids = entries.groupBy("session_id", "id").agg(F.count(F.lit(1)).alias("_n"))
    parents = ids.select("session_id", F.col("id").alias("parent_id"), F.lit(True).alias("_found"))
    d = d.join(ids, ["session_id", "id"], "left").join(parents, ["session_id", "parent_id"], "left")
    return d.select(
        "session_id", "seq", "id", "parent_id",
        (~F.col("parent_id").eqNullSafe(F.col("_expected"))).alias("broken_link"),
        (F.col("parent_id").isNotNull() & F.col("_found").isNull()).alias("missing_parent"),
        (F.col("_n") > 1).alias("duplicate_id"))


def rewrite_last_user(entries: DataFrame, prompts: DataFrame) -> DataFrame:
    """The newest user message of each session gets the session's original
    prompt (``prompts``: session_id, prompt); other entries are unchanged."""
    newest = (entries.filter((F.col("type") == "message") & (F.col("role") == "user"))
                     .groupBy("session_id").agg(F.max("seq").alias("_useq")))
    d = entries.join(newest, "session_id", "left").join(prompts, "session_id", "left")
    hit = (F.col("seq") == F.col("_useq")) & F.col("prompt").isNotNull()
    return (d.withColumn("text", F.when(hit, F.col("prompt")).otherwise(F.col("text")))
             .withColumn("rewritten", F.coalesce(hit, F.lit(False))).drop("_useq", "prompt"))


def resolve_ids(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """Resolve partial session ids (trimmed, case-insensitive): a unique
    exact match wins, else a unique prefix match; otherwise ambiguous, not
    found, or empty.

    Every id is exploded into its prefixes of the lengths that are asked for
    (one small array), and the prefixes are aggregated first (count, any id,
    exact-id count and id): one row per distinct prefix, with map-side partial
    aggregation. A request then equi-joins one row, so a one-letter request
    never fans out to all the ids it matches."""
    sid = F.lower(F.col("sid"))
    asked = requests.agg(F.collect_set(F.length(F.trim("request"))).alias("l")).scalar()
    pref = (sessions.select(F.col("session_key").alias("sid"))
                    .select("sid", asked.alias("_asked"))
                    .select("sid", F.explode(F.filter("_asked", lambda l: (l > 0) & (l <= F.length("sid")))).alias("_l"))
                    .select("sid", F.substring(sid, 1, F.col("_l")).alias("_p"), (F.col("_l") == F.length("sid")).alias("_full")))
    stats = pref.groupBy("_p").agg(
        F.count(F.lit(1)).alias("n_prefix"),
        F.max("sid").alias("_any_sid"),
        F.count(F.when(F.col("_full"), 1)).alias("n_exact"),
        F.max(F.when(F.col("_full"), F.col("sid"))).alias("_exact_sid"))
    req = requests.select("request_id", "request", F.lower(F.trim("request")).alias("_p"))
    g = req.join(stats, "_p", "left").fillna(0, ["n_prefix", "n_exact"])
    status = (F.when(F.col("_p") == "", "empty").when(F.col("n_exact") == 1, "exact")
               .when(F.col("n_prefix") == 1, "prefix").when(F.col("n_prefix") > 1, "ambiguous").otherwise("not_found"))
    resolved = F.when(F.col("n_exact") == 1, F.col("_exact_sid")).when(F.col("n_prefix") == 1, F.col("_any_sid"))
    return g.select("request_id", "request", status.alias("status"),
                    F.when(F.col("_p") != "", resolved).alias("session_key"))


def most_recent_per_dir(sessions: DataFrame) -> DataFrame:
    """the newest session file per working directory."""
    return sessions.groupBy("cwd").agg(F.max_by("path", F.struct("mtime", "path")).alias("path"),
                                       F.max("mtime").alias("mtime"))
