"""Conversations exported to three provider message layouts.

A message row is (key, seq, role, parts, call_id, is_error): ``role`` is
system, user, assistant or tool_result, and ``parts`` its content in order as
array<struct<kind, text, signature, call_id, name, arguments, mime, data>>
with kind text, image, thinking or tool_call.

The result has one row per provider message: (key, seq, sub, out_role,
item_type, call_id, blocks, cache_mark), where ``blocks`` is
array<struct<type, text, field, call_id, name, arguments>>. Everything is
column work on the message's own array; only images that wait for the next
message that is no tool result need the neighbours, through one ordered scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlens.functions.text import strip_ws
from tierlens.operators import ordered

# ---- FIXED VALUES ----------------------------------------------------------
THINKING_FIELD = "reasoning_content"
IMAGES_FROM_TOOL = "Attached image(s) from tool result:"
SEE_IMAGE = "(see attached image)"
SEE_ATTACHED = "(see attached)"
NO_OUTPUT = "(no output)"
# ---- end of fixed values ---------------------------------------------------

PARTS = ("array<struct<kind:string,text:string,signature:string,call_id:string,name:string,arguments:string,"
         "mime:string,data:string>>")
BLOCKS = "array<struct<type:string,text:string,field:string,call_id:string,name:string,arguments:string>>"
LAYOUTS = ("openai-completions", "anthropic", "openai-responses")


def _block(kind, text=None, field=None, call_id=None, name=None, arguments=None) -> Column:
    values = {"type": kind, "text": text, "field": field, "call_id": call_id, "name": name, "arguments": arguments}
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("string").alias(k) for k, v in values.items()])


def _of(kind: str, parts: Column | str = "parts") -> Column:
    return F.filter(parts, lambda p: p["kind"] == kind)


def _url(p: Column) -> Column:
    return F.concat(F.lit("data:"), p["mime"], F.lit(";base64,"), p["data"])


def _said(text: Column) -> Column:
    return strip_ws(F.coalesce(text, F.lit(""))) != ""


def _texts(parts: Column | str = "parts") -> Column:
    return F.array_join(F.transform(_of("text", parts), lambda p: F.coalesce(p["text"], F.lit(""))), "\n")


def _text_and_image(text_type: str, image_type: str) -> Column:
    """Blocks of a user message in order."""
    return F.transform(F.filter("parts", lambda p: p["kind"].isin("text", "image")),
                       lambda p: F.when(p["kind"] == "text", _block(text_type, p["text"])).otherwise(_block(image_type, _url(p))))


def _completions_assistant() -> Column:
    texts = F.transform(F.filter(_of("text"), lambda p: _said(p["text"])), lambda p: _block("text", p["text"]))
    thought = F.filter(_of("thinking"), lambda p: _said(p["text"]))

    def field(p: Column) -> Column:
        return F.when(F.coalesce(p["signature"], F.lit("")) != "", p["signature"]).otherwise(THINKING_FIELD)

    fields = F.array_distinct(F.transform(thought, field))
    thinking = F.transform(fields, lambda f: _block("thinking", F.array_join(
        F.transform(F.filter(thought, lambda p: field(p) == f), lambda p: p["text"]), "\n"), f))
    calls = F.transform(_of("tool_call"), lambda p: _block("function", None, None, p["call_id"], p["name"], p["arguments"]))
    bare = F.array(_block("text", ""))
    return F.when((F.size(texts) == 0) & (F.size(calls) == 0), bare).otherwise(F.concat(texts, thinking, calls))


def _anthropic_assistant() -> Column:
    def block(p: Column) -> Column:
        thinking = _block("thinking", p["text"], F.when(p["signature"] != "", p["signature"]))
        call = _block("tool_use", None, None, p["call_id"], p["name"], p["arguments"])
        return F.when(p["kind"] == "thinking", thinking).when(p["kind"] == "tool_call", call).otherwise(_block("text", p["text"]))

    return F.transform(F.filter("parts", lambda p: p["kind"].isin("thinking", "text", "tool_call")), block)


def _rows(msgs: DataFrame, keys: list[str], out_role: Column, item_type: Column, blocks: Column, call_id: Column | None = None) -> DataFrame:
    call = F.lit(None).cast("string") if call_id is None else call_id
    return msgs.select(*keys, F.col("seq").cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("sub"), out_role.alias("out_role"),
                       item_type.alias("item_type"), call.alias("call_id"), blocks.cast(BLOCKS).alias("blocks"))


def _held_images(msgs: DataFrame, keys: list[str], text_type: str, image_type: str) -> DataFrame:
    """One user message per run of tool results that carry images, right after
    the run: the running count of other messages names the run."""
    plain = msgs.select(*keys, F.col("seq").cast("bigint").alias("seq"), "role",
                        F.transform(_of("image"), lambda p: _url(p)).alias("urls"))
    runs = ordered.running_sum(plain, keys, "seq", (F.col("role") != "tool_result").cast("int"), "run_no")
    with_images = runs.filter((F.col("role") == "tool_result"))
    g = with_images.groupBy(*keys, "run_no").agg(
        F.max("seq").alias("seq"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.size("urls") > 0, F.struct("seq", "urls")))), lambda x: x["urls"])).alias("urls"))
    blocks = F.concat(F.array(_block(text_type, IMAGES_FROM_TOOL)), F.transform("urls", lambda u: _block(image_type, u)))
    return g.filter(F.size("urls") > 0).select(
        *keys, "seq", F.lit(1).cast("bigint").alias("sub"), F.lit("user").alias("out_role"), F.lit("message").alias("item_type"),
        F.lit(None).cast("string").alias("call_id"), blocks.cast(BLOCKS).alias("blocks"))


def _bare_call(call_id: Column) -> Column:
    """The call id before a ``|``."""
    return F.substring_index(call_id, "|", 1)


def _responses_items(msgs: DataFrame, keys: list[str]) -> DataFrame:
    """Assistant content as one item per part: reasoning (a signature that is
    JSON), message, function call; other parts fall away."""
    items = msgs.filter(F.col("role") == "assistant").select(*keys, "seq", F.posexplode("parts").alias("sub", "p"))
    p, kind = F.col("p"), F.col("p.kind")
    reasoning = (kind == "thinking") & F.try_parse_json(F.when(p["signature"] != "", p["signature"])).isNotNull()
    kept = items.filter(reasoning | kind.isin("text", "tool_call"))
    item = F.when(kind == "thinking", "reasoning").when(kind == "text", "message").otherwise("function_call")
    own_id = F.when(F.contains(p["call_id"], F.lit("|")), F.substring_index(p["call_id"], "|", -1))
    block = (F.when(kind == "thinking", _block("reasoning", p["signature"]))
             .when(kind == "text", _block("output_text", p["text"]))
             .otherwise(_block("function_call", None, own_id, _bare_call(p["call_id"]), p["name"], p["arguments"])))
    return kept.select(*keys, F.col("seq").cast("bigint").alias("seq"), F.col("sub").cast("bigint").alias("sub"),
                       F.lit("assistant").alias("out_role"), item.alias("item_type"),
                       F.when(kind == "tool_call", _bare_call(p["call_id"])).alias("call_id"), F.array(block).cast(BLOCKS).alias("blocks"))


def to_provider_messages(msgs: DataFrame, layout: str, keys=("conv_id",)) -> DataFrame:
    """Messages of ``layout`` (one of :data:`LAYOUTS`).

    openai-completions: thinking joined per signature field, tool calls as
    functions, tool results as role ``tool`` with a placeholder where they have
    no text. openai-responses: one item per assistant part, reasoning items from
    JSON signatures, call ids cut at ``|``. Both hold the images of tool results
    back until the next message that is no tool result. anthropic: the system
    text apart, tool results (images included) as user blocks, a cache mark on
    the last message if it is the user's.
    """
    keys = list(keys)
    role, none = F.col("role"), F.lit(None).cast("string")
    of = lambda *roles: msgs.filter(role.isin(*roles))
    is_tool = role == "tool_result"
    if layout == "anthropic":
        result = F.concat(F.array(_block("tool_result", None, F.when(F.col("is_error"), F.lit("error")), F.col("call_id"))),
                          _text_and_image("text", "image"))
        blocks = F.when(role == "assistant", _anthropic_assistant()).when(is_tool, result).otherwise(_text_and_image("text", "image"))
        kind = F.when(role == "system", "system").when(is_tool, "tool_result").otherwise("message")
        out = _rows(msgs, keys, F.when(is_tool, "user").otherwise(role), kind, blocks, F.when(is_tool, F.col("call_id")).otherwise(none))
        last = out.filter(F.col("item_type") != "system").groupBy(*keys).agg(F.max("seq").alias("_last"))
        return out.join(last, keys, "left").withColumn(
            "cache_mark", F.coalesce((F.col("seq") == F.col("_last")) & (F.col("out_role") == "user"), F.lit(False))).drop("_last")
    if layout == "openai-completions":
        n_images = F.size(_of("image"))
        said = F.when(F.size(_of("text")) > 0, _texts()).when(n_images > 0, SEE_IMAGE).otherwise(NO_OUTPUT)
        out = _rows(of("system", "user"), keys, role, F.lit("message"), _text_and_image("text", "image_url")) \
            .unionByName(_rows(of("assistant"), keys, role, F.lit("message"), _completions_assistant())) \
            .unionByName(_rows(of("tool_result"), keys, F.lit("tool"), F.lit("tool"), F.array(_block("tool", said)), F.col("call_id"))) \
            .unionByName(_held_images(msgs, keys, "text", "image_url"))
    elif layout == "openai-responses":
        said = F.when(F.size(_of("text")) > 0, _texts()).otherwise(SEE_ATTACHED)
        users = _rows(of("user"), keys, role, F.lit("message"), _text_and_image("input_text", "input_image"))
        out = _rows(of("system"), keys, F.lit("developer"), F.lit("message"), _text_and_image("input_text", "input_image")) \
            .unionByName(users.filter(F.size("blocks") > 0)) \
            .unionByName(_responses_items(msgs, keys)) \
            .unionByName(_rows(of("tool_result"), keys, none, F.lit("function_call_output"), F.array(_block("output", said)),
                               _bare_call(F.col("call_id")))) \
            .unionByName(_held_images(msgs, keys, "input_text", "input_image"))
    else:
        raise ValueError(f"unknown layout {layout}")
    return out.withColumn("cache_mark", F.lit(False))
