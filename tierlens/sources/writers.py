"""Writers (A7-A11, A14): append logs, split outputs, preference triples,
feedback batch close and session logs. All writes go through Spark's
committer (task output is promoted only on job commit)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Consecutive entries of a session that go to one file.
SESSION_CHUNK = 1 << 20


def append_cost_records(df: DataFrame, path: str) -> None:
    """Append cost records, partitioned by kind."""
    df.write.mode("append").partitionBy("kind").json(path)


def append_history(df: DataFrame, path: str) -> None:
    """Append router history entries."""
    df.write.mode("append").json(path)


def write_feedback_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Feedback entries of one ingest batch under ``batch=<id>`` (overwrite of
    that partition only, so a replayed batch replaces itself)."""
    (df.withColumn("batch", F.lit(batch_id)).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy("batch").json(path))


def close_batch(open_rows: DataFrame, archive_path: str, archive_ts: str) -> None:
    """Archive the consumed rows under ``archive_ts=<ts>``; the open set
    is then the entries left-anti-joined with the archive."""
    (open_rows.withColumn("archive_ts", F.lit(archive_ts)).write.mode("overwrite")
              .option("partitionOverwriteMode", "dynamic").partitionBy("archive_ts").json(archive_path))


def write_session_logs(headers: DataFrame, entries: DataFrame, path: str, chunk: int = SESSION_CHUNK) -> None:
    """One file per session under its cleaned working directory; the header
    row first (seq -1), then the entries in order. Sessions without an assistant
    message are not written (left-semi).

    Rows are dealt by (directory, session, chunk of ``chunk`` consecutive ``seq``
    values), so a session holding a third of all rows is written by many tasks: its
    later chunks are files of their own, which the reader joins by name order. An
    earlier folder at ``path`` is replaced."""
    from tierlens.sources import session_files as SF

    has_asst = entries.filter((F.col("type") == "message") & (F.col("role") == "assistant")).select("session_id").distinct()
    h = headers.join(has_asst, "session_id", "left_semi")
    e = entries.join(has_asst, "session_id", "left_semi")
    cwd_key = F.regexp_replace(F.regexp_replace(F.col("cwd"), r"[/\\]", "-"), "^-+|-+$", "")
    head_lines = h.select("session_id", cwd_key.alias("cwd_key"), F.lit(-1).cast("bigint").alias("seq"),
                          F.to_json(F.struct(F.lit("header").alias("type"), F.lit(1).alias("version"),
                                             F.col("session_id").alias("id"), F.col("created").alias("timestamp"),
                                             F.col("cwd").alias("cwd"))).alias("value"))
    ent_lines = e.join(h.select("session_id", cwd_key.alias("cwd_key")), "session_id").select(
        "session_id", "cwd_key", F.col("seq").cast("bigint").alias("seq"), F.to_json(session_line(e)).alias("value"))
    nth = F.floor(F.greatest(F.col("seq"), F.lit(0)) / F.lit(chunk)).cast("bigint")
    out = head_lines.unionByName(ent_lines).withColumns({"session_id": F.col("session_id").cast("string"), "chunk": nth})
    key = ["cwd_key", "session_id", "chunk"]
    headers.sparkSession.dataSource.register(SF.SessionFiles)
    (out.repartition(*key).sortWithinPartitions(*key, "seq").select(*key, "value")
        .write.format(SF.FORMAT).mode("overwrite").save(path))


def write_key_files(df: DataFrame, key: str, order: str, path: str, mode: str = "overwrite", folders: int = 128) -> None:
    """One file of JSON lines per value of ``key`` (``.json``, rows in ``order``), spread
    over ``folders`` folders by hash. Files are written and named by the tasks, a
    folder's by one; the number of tasks is fixed, for a file costs more than its bytes."""
    from tierlens.sources import session_files as SF

    df.sparkSession.dataSource.register(SF.SessionFiles)
    folder = F.pmod(F.xxhash64(key), F.lit(folders)).cast("string")
    lines = df.select(folder.alias("cwd_key"), F.coalesce(F.col(key).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("session_id"),
                      F.lit(0).cast("bigint").alias("chunk"), F.to_json(F.struct(*df.columns)).alias("value"), F.col(order).alias("_order"))
    (lines.repartition(folders, "cwd_key").sortWithinPartitions("cwd_key", "session_id", "_order").drop("_order")
          .write.format(SF.FORMAT).option("suffix", ".json").mode(mode).save(path))


def stored_parts(parts: Column) -> Column:
    """Content parts (as the reader gives them) in their stored form, a variant;
    arguments are stored as the JSON they are (keys in alphabetical order), where they are JSON."""
    def of(p: Column) -> Column:
        think, arguments = p["kind"] == "thinking", F.coalesce(F.try_parse_json(p["arguments"]), p["arguments"].cast("variant"))
        return F.struct(p["kind"].alias("type"), F.when(~think, p["text"]).alias("text"), F.when(think, p["text"]).alias("thinking"), p["signature"].alias("signature"),
                        p["call_id"].alias("id"), p["name"].alias("name"), arguments.alias("arguments"), p["mime"].alias("mime_type"), p["data"].alias("data"))

    return F.parse_json(F.to_json(F.transform(parts, of)))


def session_line(entries: DataFrame):
    """Wide entry row (session_id, seq, type, role, text, input/output tokens,
    value, and where the frame has them: id, parent_id, timestamp, parts, call_id,
    tool_name, is_error, cache counters, stop reason, thinking level, provider,
    base address, first kept entry, tokens before, custom type, display) -> the
    typed session-line struct (NULL fields are not written). Content is its list
    of parts, or the text alone where there are none."""
    def col(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in entries.columns else F.lit(None).cast(kind)

    t = F.col("type")
    eid = F.coalesce(col("id"), F.concat(F.col("session_id").cast("string"), F.lit("-"), F.col("seq").cast("string")))
    counters = {"input_tokens": F.col("input_tokens"), "output_tokens": F.col("output_tokens"),
                "cache_read_tokens": col("cache_read", "bigint"), "cache_write_tokens": col("cache_write", "bigint")}
    usage = F.when(F.coalesce(*counters.values()).isNotNull(), F.struct(*[c.alias(n) for n, c in counters.items()]))
    text = F.col("text").cast("variant")
    content = F.when(F.col("parts").isNotNull(), stored_parts(F.col("parts"))).otherwise(text) if "parts" in entries.columns else text
    message = F.struct(F.col("role").alias("role"), content.alias("content"), col("stop_reason").alias("stop_reason"), usage.alias("usage"),
                       col("call_id").alias("tool_call_id"), col("tool_name").alias("tool_name"), col("is_error", "boolean").alias("is_error"))
    change, compaction, custom = t == "model_change", t == "compaction", t == "custom_message"
    return F.struct(
        t.alias("type"), eid.alias("id"), col("parent_id").alias("parent_id"), col("timestamp").alias("timestamp"),
        F.when(t == "message", message).alias("message"),
        F.when(t == "thinking_level_change", col("thinking_level")).alias("thinking_level"),
        F.when(compaction, F.col("value")).alias("summary"), F.when(compaction, col("first_kept_entry_id")).alias("first_kept_entry_id"),
        F.when(compaction, col("tokens_before", "bigint")).alias("tokens_before"),
        F.when(change, F.col("value")).alias("model_id"), F.when(change, col("provider")).alias("provider"), F.when(change, col("base_url")).alias("base_url"),
        F.when(custom, col("custom_type")).alias("custom_type"), F.when(custom, F.col("value")).alias("content"),
        F.when(custom, col("display", "boolean")).alias("display"), F.when(t == "session_info", F.col("value")).alias("name"))


def with_header_lines(lines: DataFrame, header: str) -> DataFrame:
    """A header line at the start of every partition of a one-column text
    frame (``value``), so each written part file is a complete CSV document
    that Spark's reader (``header=True``) parses on its own. Rows keep their
    partitions: no shuffle, no single-file funnel."""
    import pandas as pd

    def add(batches):
        yield pd.DataFrame({"value": [header]})
        for b in batches:
            yield b

    return lines.select("value").mapInPandas(add, "value string")


def write_table_snapshots(df: DataFrame, columns: list[str], path: str, group_cols: list[str] | None = None,
                          rows_per_doc: int = 10_000) -> None:
    """Columnar JSON snapshots ``{columns: [...], data: [[...], ...]}``, one
    per group of ``group_cols`` (the whole table when none), each split into
    documents of at most ``rows_per_doc`` rows (consecutive rows of a partition).
    Every document goes to its own file (``partitionBy`` on the
    document key), because a multi-line JSON file holds exactly one document."""
    groups = list(group_cols or [])
    row = F.array(*[F.col(c).cast("string") for c in columns])
    # the id counts the rows of a partition from partition * 2^33 on
    doc = F.floor(F.monotonically_increasing_id() / rows_per_doc).cast("bigint")
    snap = df.groupBy(*groups, doc.alias("doc")).agg(F.to_json(F.struct(
        F.array(*[F.lit(c) for c in columns]).alias("columns"), F.collect_list(row).alias("data"))).alias("value"))
    snap.write.mode("overwrite").partitionBy(*groups, "doc").text(path)
