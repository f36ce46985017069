"""Tool calls written into assistant text, as column expressions.

The text holds calls as ``<tool_call name="...">arguments</tool_call>``. Calls
and the text between them become rows; arguments become a map of variants, so
numbers, lists and nested objects keep their types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlens.functions.text import strip_ws

# ---- FIXED VALUES ----------------------------------------------------------
TOOL_CALL = r'(?s)<tool_call name="([^"]+)">(.*?)</tool_call>'
FENCE_START = r"^```(?:json)?\s*"
FENCE_END = r"\s*```$"
OWN_KEYS = ["path", "content", "command"]
QUOTED_PATH = r'"path":\s*"([^"]+)"'
QUOTED_CONTENT = r'(?s)"content":\s*"(.*)"\s*\}'
LOOSE_PATH = r'path["\s:]+([^"\n]+)'
LOOSE_CONTENT = r'(?s)content["\s:]+(.*)'
# ---- end of fixed values ---------------------------------------------------

ARGUMENTS = "map<string,variant>"


def _members(doc: Column) -> Column:
    """Members of a JSON object, null for anything else."""
    return F.when(F.schema_of_variant(doc).startswith("OBJECT"), F.try_variant_get(doc, "$", ARGUMENTS))


def _document(body: Column) -> Column:
    """The arguments as a variant: the body itself, else its outermost braces; an empty body is an empty object."""
    braces = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return F.coalesce(F.try_parse_json(F.when(body == "", "{}").otherwise(body)), F.try_parse_json(F.when(braces != "", braces)))


def _unwrapped(doc: Column, tool: Column, body: Column) -> Column:
    """Objects that only wrap another object are opened, as deep as they go: a
    body cannot nest deeper than it has opening braces."""
    def open_(state: Column, step: Column) -> Column:
        inside = _members(state)
        key, value = F.get(F.map_keys(inside), F.lit(0)), F.get(F.map_values(inside), F.lit(0))
        wraps = (F.size(inside) == 1) & F.schema_of_variant(value).startswith("OBJECT")
        return F.when(wraps & (((step == 1) & (key == tool)) | ~key.isin(OWN_KEYS)), value).otherwise(state)

    braces = F.length(body) - F.length(F.replace(body, F.lit("{"), F.lit("")))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(braces, F.lit(1))), doc, open_)


def _found(text: Column, pattern: str) -> Column:
    """First group of the pattern, null where it does not match."""
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, 1))


def _entry(key: str, value: Column) -> Column:
    return F.create_map(F.lit(key), value.cast("variant"))


def _trim_of(text: Column, chars: str) -> Column:
    return F.regexp_replace(text, f"^[{chars}]+|[{chars}]+$", "")


def tool_arguments(tool: Column, raw: Column) -> Column:
    """Arguments of one call as map<string, variant>, null if it is unusable.

    ``bash`` without a command takes its single value, or the raw text;
    ``write`` finds path and content by pattern where the JSON lacks or breaks
    them, and a single line with a slash is its path.
    """
    raw = F.coalesce(raw, F.lit(""))
    body = strip_ws(raw)
    body = F.when(body.startswith("```"), strip_ws(F.regexp_replace(F.regexp_replace(body, FENCE_START, ""), FENCE_END, ""))).otherwise(body)
    doc = _unwrapped(_document(body), tool, body)
    have = _members(doc)
    none = F.create_map().cast(ARGUMENTS)

    single = F.get(F.map_values(have), F.lit(0))
    command = (F.when(F.map_contains_key(have, "command"), have)
               .when(F.size(have) == 1, F.create_map(F.lit("command"), single))
               .when(F.size(have) == 0, _entry("command", strip_ws(raw))).otherwise(have))

    def missing(key: str, value: Column) -> Column:
        found = F.coalesce(have, none)
        return F.when(~F.map_contains_key(found, key) & value.isNotNull(), _entry(key, value)).otherwise(none)

    written = F.map_concat(F.coalesce(have, none), missing("path", _found(raw, QUOTED_PATH)),
                           missing("content", strip_ws(_found(raw, QUOTED_CONTENT))))
    path, content = _found(body, LOOSE_PATH), _found(body, LOOSE_CONTENT)
    loose = (F.when(path.isNotNull() & content.isNotNull(),
                    F.map_concat(_entry("path", _trim_of(path, " \"'")), _entry("content", _trim_of(content, " \"'\n}"))))
             .when((body != "") & ~F.contains(body, F.lit("\n")) & F.contains(body, F.lit("/")),
                   F.map_concat(_entry("path", body), _entry("content", F.lit("")))))
    parsed = F.when(tool == "bash", command).when(tool == "write", F.when(F.size(written) > 0, written)).otherwise(have)
    broken = F.when((tool == "bash") & (body != ""), _entry("command", body)).when(tool == "write", loose)
    return F.when(doc.isNotNull(), parsed).otherwise(broken)


def extract_tool_calls(df: DataFrame, key_cols, text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(text parts, calls, unusable calls). The calls carry ``arguments``
    as map<string, variant>; the unusable ones their raw text."""
    t, keys = F.col(text_col), list(key_cols)
    between = F.split(t, TOOL_CALL, -1)
    texts = df.select(*keys, F.posexplode(F.transform(between, strip_ws)).alias("part_idx", "text")).filter(F.col("text") != "")
    found = F.arrays_zip(F.regexp_extract_all(t, F.lit(TOOL_CALL), F.lit(1)).alias("name"),
                         F.regexp_extract_all(t, F.lit(TOOL_CALL), F.lit(2)).alias("raw"))
    calls = df.select(*keys, F.posexplode(found).alias("call_index", "c")).select(
        *keys, "call_index", F.col("c.name").alias("name"), F.col("c.raw").alias("raw"))
    calls = calls.withColumn("arguments", tool_arguments(F.col("name"), F.col("raw")))
    usable = F.col("arguments").isNotNull()
    return texts, calls.filter(usable).drop("raw"), calls.filter(~usable).drop("arguments")
