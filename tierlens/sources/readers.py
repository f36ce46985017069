"""Readers (A1-A8, A13): every file format of the routing and agent stores as a DataFrame.

Every reader fixes its schema (no inference) and yields an order key where the
source has one (``seq`` = line number inside the file), since Spark has no
file order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierlens.sources.session_files import LATER_CHUNK

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
CHAT_EXAMPLE = T.StructType([T.StructField("messages", T.ArrayType(MESSAGE))])
FEEDBACK = T.StructType([
    T.StructField("query", T.StringType()), T.StructField("predicted_tier", T.IntegerType()),
    T.StructField("corrected_tier", T.IntegerType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("notes", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("is_correct", T.BooleanType())])
PROMPT_LABEL = T.StructType([T.StructField("prompt", T.StringType()), T.StructField("label", T.StringType())])
TELEMETRY = T.StructType([
    T.StructField("turn", T.LongType()), T.StructField("model_used", T.StringType()),
    T.StructField("tokens_used", T.LongType()), T.StructField("input_complexity", T.StringType()),
    T.StructField("cumulative_cost", T.DoubleType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("status", T.StringType())])
COST_RECORD = T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("is_summarisation", T.BooleanType()), T.StructField("model", T.StringType()),
    T.StructField("decision_tier", T.IntegerType()), T.StructField("actual_tier", T.IntegerType()),
    T.StructField("baseline_tier", T.IntegerType()), T.StructField("prompt_tokens", T.LongType()),
    T.StructField("completion_tokens", T.LongType()), T.StructField("total_tokens", T.LongType()),
    T.StructField("actual_cost", T.DoubleType()), T.StructField("baseline_cost", T.DoubleType()),
    T.StructField("savings_pct", T.DoubleType())])
HISTORY = T.StructType([
    T.StructField("role", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("model", T.StringType()), T.StructField("conversation_id", T.StringType()),
    T.StructField("timestamp", T.StringType())])
# Wide nullable row for every session entry type; ``message.content`` is kept
# as JSON text because it is a string or an array of parts.
SESSION_LINE = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("version", T.IntegerType()),
    T.StructField("id", T.StringType()), T.StructField("parent_id", T.StringType()),
    T.StructField("timestamp", T.StringType()), T.StructField("cwd", T.StringType()),
    T.StructField("message", T.StructType([
        T.StructField("role", T.StringType()), T.StructField("content", T.StringType()),
        T.StructField("stop_reason", T.StringType()),
        T.StructField("usage", T.StructType([
            T.StructField("input_tokens", T.LongType()), T.StructField("output_tokens", T.LongType()),
            T.StructField("cache_read_tokens", T.LongType()), T.StructField("cache_write_tokens", T.LongType())])),
        T.StructField("tool_call_id", T.StringType()), T.StructField("tool_name", T.StringType()),
        T.StructField("is_error", T.BooleanType())])),
    T.StructField("thinking_level", T.StringType()), T.StructField("provider", T.StringType()),
    T.StructField("model_id", T.StringType()), T.StructField("base_url", T.StringType()),
    T.StructField("summary", T.StringType()), T.StructField("first_kept_entry_id", T.StringType()),
    T.StructField("tokens_before", T.LongType()), T.StructField("custom_type", T.StringType()),
    T.StructField("content", T.StringType()), T.StructField("display", T.BooleanType()),
    T.StructField("name", T.StringType())])
# One content part as stored; arguments stay JSON text.
CONTENT_PART = ("array<struct<type:string,text:string,thinking:string,signature:string,id:string,name:string,arguments:string,"
                "data:string,mime_type:string>>")
ENTRY_TYPES = ["header", "message", "thinking_level_change", "model_change", "compaction", "custom_message", "session_info"]


def read_chat_examples(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A1: chat-example JSONL files or folders; ``split`` is the file's base
    name (``train.jsonl`` -> train) or the folder name of Spark part files."""
    df = spark.read.schema(CHAT_EXAMPLE).json(paths)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.jsonl?)?(?:/part-[^/]*)?$", 1)
    return df.select("messages", name.alias("split"))


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """A2: feedback JSONL; blank lines are skipped by the JSON reader."""
    return spark.read.schema(FEEDBACK).json(path)


def read_prompt_labels(spark: SparkSession, path: str) -> DataFrame:
    """A3: one JSON array of ``{prompt, label}`` objects per file."""
    return spark.read.schema(PROMPT_LABEL).option("multiLine", True).json(path) \
                .withColumn("label", F.col("label").cast("int"))


def read_telemetry_csv(spark: SparkSession, path: str) -> DataFrame:
    """A4: ragged telemetry CSV read with an explicit 7-column schema; short
    rows are padded with NULL, longer rows cut (the header has only 5 names)."""
    return (spark.read.schema(TELEMETRY).option("header", True).option("mode", "PERMISSIVE")
                 .option("enforceSchema", True).csv(path))


def numbered_file_lines(spark: SparkSession, path: str, later: str | None = None) -> DataFrame:
    """(file, seq, line) for every line of the text files under ``path``;
    ``seq`` is the 0-based line number within its file. Files whose names differ
    only by what the pattern ``later`` matches are one file, joined by name order.

    Files are read by line, so a large file is split across tasks. A line's
    number comes from its split (start offset in the file) and its position
    in the split (the row ids of one split are consecutive); one small row
    per split, summed over the earlier splits of the same file, gives each
    split's first line number."""
    name = F.col("_metadata.file_path")
    raw = spark.read.text(path).select(
        (F.regexp_replace(name, later, ".jsonl") if later else name).alias("file"), name.alias("_name"),
        F.col("_metadata.file_block_start").alias("_blk"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    split = ["file", "_name", "_blk"]
    splits = raw.groupBy(*split).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_id0"))
    earlier = Window.partitionBy("file").orderBy("_name", "_blk").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(*split, "_id0", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    return raw.join(splits, split).select(
        "file", (F.col("_off") + F.col("_id") - F.col("_id0")).cast("bigint").alias("seq"), "line")


def read_session_lines(spark: SparkSession, path: str) -> DataFrame:
    """Session JSONL files as (file, seq, raw line, parsed row); blank lines and
    lines that are not JSON objects are dropped; ``seq`` is the true line
    number (files are read by line, not whole). A session written in several
    chunks is one file."""
    lines = numbered_file_lines(spark, path, LATER_CHUNK).filter(F.trim("line") != "")
    parsed = lines.withColumn("e", F.from_json("line", SESSION_LINE, {"mode": "PERMISSIVE"}))
    ok = F.trim("line").startswith("{") & F.col("e.type").isNotNull()
    return parsed.filter(ok)


def read_session_logs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A5: typed session logs of a directory -> (headers, entries).

    Dispatch on ``type``; unknown types, bad JSON and blank lines are skipped;
    files without a header line are rejected (left-semi on headers)."""
    rows = read_session_lines(spark, path)
    headers = rows.filter(F.col("e.type") == "header").select(
        "file", "seq", F.col("e.id").alias("session_id"), F.col("e.cwd").alias("cwd"),
        F.col("e.timestamp").alias("created"), F.col("e.version").alias("version"))
    ents = rows.filter(F.col("e.type").isin(*ENTRY_TYPES[1:])).select("file", "seq", "e.*")
    one_header = headers.groupBy("file").agg(F.max_by("session_id", "seq").alias("session_id"))
    entries = ents.join(one_header, "file")
    return headers.drop("seq"), entries


def read_table_snapshot(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Columnar JSON snapshots ``{columns: [...], data: [[...], ...]}`` to
    long rows (file, row_idx, column, value) -- values read as strings."""
    schema = T.StructType([T.StructField("columns", T.ArrayType(T.StringType())),
                           T.StructField("data", T.ArrayType(T.ArrayType(T.StringType())))])
    several = isinstance(path, list)  # folders of their own, whose names are no partition columns
    read = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", several)
    df = read.json(path).withColumn("file", F.col("_metadata.file_path"))
    rows = df.select("file", "columns", F.posexplode("data").alias("row_idx", "row"))
    return rows.select("file", "row_idx", F.posexplode(F.arrays_zip("columns", "row")).alias("col_idx", "z")) \
               .select("file", "row_idx", "col_idx", F.col("z.columns").alias("column"), F.col("z.row").alias("value"))


def pivot_snapshot(long_rows: DataFrame, columns: list[str]) -> DataFrame:
    """Long snapshot rows back to one column per name (fixed column list, no pivot discovery job)."""
    return long_rows.groupBy("file", "row_idx").agg(
        *[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns])


def read_cost_records(spark: SparkSession, path: str) -> DataFrame:
    """Router cost-log JSONL."""
    return spark.read.schema(COST_RECORD).json(path)


def read_router_history(spark: SparkSession, path: str) -> DataFrame:
    """Router history JSONL with its line order (``seq``, the line number)."""
    rows = numbered_file_lines(spark, path).filter(F.trim("line") != "")
    return rows.select("file", "seq", F.from_json("line", HISTORY).alias("h")).select("file", "seq", "h.*")


def list_files(spark: SparkSession, path: str, pattern: str, limit: int = 100) -> DataFrame:
    """Files under ``path`` matching a file-name glob, newest first, top
    ``limit``. Only path and mtime are selected, so file contents are never read."""
    df = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
               .option("recursiveFileLookup", True).load(path))
    return (df.select("path", F.col("modificationTime").alias("mtime"), "length")
              .orderBy(F.col("mtime").desc(), "path").limit(limit))


def content_parts(content: Column) -> Column:
    """Stored message content (a string, or a JSON array of parts) as
    array<struct<kind, text, signature, call_id, name, arguments, mime, data>>."""
    kind = "array<struct<kind:string,text:string,signature:string,call_id:string,name:string,arguments:string,mime:string,data:string>>"
    none = F.lit(None).cast("string")

    def part(**values) -> Column:
        return F.struct(*[values.get(n, none).alias(n) for n in ("kind", "text", "signature", "call_id", "name", "arguments", "mime", "data")])

    listed = F.transform(F.from_json(content, CONTENT_PART), lambda p: part(
        kind=p["type"], text=F.coalesce(p["text"], p["thinking"]), signature=p["signature"], call_id=p["id"], name=p["name"],
        arguments=p["arguments"], mime=p["mime_type"], data=p["data"]))
    plain = F.array(part(kind=F.lit("text"), text=content))
    return F.when(content.startswith("["), F.coalesce(listed, plain)).when(content.isNotNull(), plain).cast(kind)


def entries_wide(entries: DataFrame) -> DataFrame:
    """A5 rows back to the wide entry schema used by the session operators:
    ``text`` is the message's text parts joined, ``parts`` its whole content,
    ``tool_calls`` the calls among them; usage with cache counters, thinking
    level and the model's provider and base address come along."""
    e = entries.withColumn("parts", content_parts(F.col("message.content")))
    text = F.array_join(F.transform(F.filter("parts", lambda p: p["kind"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), "")
    usage = [F.col(f"message.usage.{c}_tokens").alias(n) for c, n in (
        ("input", "input_tokens"), ("output", "output_tokens"), ("cache_read", "cache_read"), ("cache_write", "cache_write"))]
    return e.select(
        "session_id", "seq", "type", F.col("message.role").alias("role"), text.alias("text"), "parts",
        F.filter("parts", lambda p: p["kind"] == "tool_call").alias("tool_calls"), *usage,
        F.col("message.stop_reason").alias("stop_reason"), F.col("message.tool_call_id").alias("call_id"),
        F.col("message.tool_name").alias("tool_name"), F.coalesce("message.is_error", F.lit(False)).alias("is_error"),
        "thinking_level", "provider", "base_url", F.coalesce("summary", "model_id", "name", "content").alias("value"), "id", "parent_id",
        "timestamp", "first_kept_entry_id", "tokens_before", "custom_type", "display")
