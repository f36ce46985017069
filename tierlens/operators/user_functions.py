"""User-function slots (J1-J3): the model calls of the routing system become
user-supplied Python functions run with ``mapInPandas`` (Arrow batches, one
model load per task). Everything around them stays in Spark.

A slot takes a *factory* (called once per task, where a real model or client
would be created) returning a function ``list[str] -> list[str]``. A batch
that raises is turned into error rows instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierlens.operators import catalog, context, feedback as fb, routing

Factory = Callable[[], Callable[[list[str]], list[str]]]


def _call_slot(df: DataFrame, key_cols: list[str], text_col: str, factory: Factory, out_col: str,
               key_types: dict[str, T.DataType]) -> DataFrame:
    """Run ``factory()`` per task over Arrow batches; adds ``out_col`` and
    ``call_error`` (the exception text of a failed call; a failing batch is
    retried item by item so one bad input fails only its own row)."""
    fields = [T.StructField(k, key_types[k]) for k in key_cols]
    schema = T.StructType(fields + [T.StructField(out_col, T.StringType()), T.StructField("call_error", T.StringType())])

    def run(batches: Iterator):
        import pandas as pd

        fn = factory()
        for pdf in batches:
            texts = pdf[text_col].tolist()
            try:
                outs = list(fn(texts))
                errs = [None] * len(texts)
            except Exception:  # noqa: BLE001 - retry one by one, failures become error rows
                outs, errs = [], []
                for t in texts:
                    try:
                        outs.append(fn([t])[0])
                        errs.append(None)
                    except Exception as e:  # noqa: BLE001
                        outs.append(None)
                        errs.append(f"{type(e).__name__}: {e}")
            res = pdf[key_cols].copy()
            res[out_col] = outs
            res["call_error"] = errs
            yield pd.DataFrame(res)

    return df.select(*key_cols, text_col).mapInPandas(run, schema)


def classify(df: DataFrame, scorer: Factory, query_col: str = "query") -> DataFrame:
    """Route queries with a user scorer. Distinct queries are scored once
    (dedup before the Python hop), results go through the service fallback,
    tolerant parsing, clamping and enrichment (B5 -> B3 -> B2 -> B1) and are
    joined back by a hash of the query text."""
    qs = df.select(F.md5(F.col(query_col)).alias("qkey"), F.col(query_col).alias("q")).dropDuplicates(["qkey"])
    scored = _call_slot(qs, ["qkey"], "q", scorer, "raw", {"qkey": T.StringType()})
    decided = routing.service_fallback(scored, "raw", "call_error").select(
        "qkey", "parse_path", "model_tier", "confidence", "tier_label", "model_name")
    return df.withColumn("qkey", F.md5(F.col(query_col))).join(decided, "qkey", "left").drop("qkey")


#: Reads a conversation's context block by block and returns its summary.
Summariser = Callable[[], Callable[[Iterator[str]], str]]


def of_whole_text(factory: Factory) -> Summariser:
    """A summariser from a function of whole texts, for conversations that fit a task."""
    def make():
        fn = factory()
        return lambda blocks: fn([context.CONTEXT_SEPARATOR.join(blocks)])[0]
    return make


def _fold_slot(blocks: DataFrame, key: str, factory: Summariser, out_col: str) -> DataFrame:
    """Run ``factory()`` per task over the blocks of one key after the other, in
    order (Spark sorts them, on disk where needed); a task holds one Arrow batch
    of blocks. A key whose call raises becomes an error row."""
    schema = T.StructType([T.StructField(key, blocks.schema[key].dataType), T.StructField(out_col, T.StringType()), T.StructField("call_error", T.StringType())])

    def run(batches: Iterator):
        import itertools

        import pandas as pd

        fn = factory()
        rows = (pair for pdf in batches for pair in zip(pdf[key].tolist(), pdf["text"].tolist()))
        for value, own in itertools.groupby(rows, key=lambda pair: pair[0]):
            texts = (text for _, text in own)
            try:
                out, error = fn(texts), None
            except Exception as e:  # noqa: BLE001 - one conversation fails, not the job
                out, error = None, f"{type(e).__name__}: {e}"
            for _ in texts:  # what the function left unread
                pass
            yield pd.DataFrame({key: [value], out_col: [out], "call_error": [error]}, dtype=object)

    return blocks.select(key, "block_no", "text").repartition(key).sortWithinPartitions(key, "block_no").mapInPandas(run, schema)


def summarise(entries: DataFrame, summariser: Summariser, key: str = "conv_id", order: str = "turn",
              block_chars: int = context.CONTEXT_BLOCK_CHARS) -> DataFrame:
    """Context per conversation (E14) summarised by a user function, which
    reads it block by block; the result is a compaction entry with the summary,
    its token estimate and the tokens before compaction. No conversation's text
    is gathered into one row."""
    blocks = context.context_blocks(entries, key, order, block_chars)
    out = _fold_slot(blocks, key, summariser, "summary")
    between = len(context.CONTEXT_SEPARATOR)
    sizes = context.context_entries(entries, key, order).groupBy(key).agg((F.sum(F.length("piece") + between) - between).alias("_chars"))
    return (out.join(sizes, key)
               .withColumn("type", F.lit("compaction"))
               .withColumn("summary_tokens", F.floor(F.length("summary") / 4).cast("bigint"))
               .withColumn("tokens_before", F.floor(F.col("_chars") / 4).cast("bigint"))
               .drop("_chars"))


def generate(grid: DataFrame, teacher: Factory) -> tuple[DataFrame, DataFrame]:
    """Every grid cell's prompt goes to a user teacher; its response is
    parsed into a query list (H12), cut to the cell quota (E12) and turned
    into chat examples (H14). Returns (examples, failed cells)."""
    cells = grid.select("tier", "tier_label", "category", "category_idx", "quota", "prompt")
    resp = _call_slot(cells, ["tier", "tier_label", "category", "category_idx", "quota"], "prompt", teacher, "response",
                      {"tier": T.IntegerType(), "tier_label": T.StringType(), "category": T.StringType(),
                       "category_idx": T.IntegerType(), "quota": T.IntegerType()})
    failed = resp.filter(F.col("call_error").isNotNull()).select("tier_label", "category", "call_error")
    ok = resp.filter(F.col("call_error").isNull())
    qs = ok.select("tier", "tier_label", "category", "quota",
                   F.posexplode(catalog.parse_query_list(F.col("response"))).alias("position", "query"))
    cut = catalog.quota_cut(qs, ["tier_label", "category"], "position", F.col("quota"))
    conf = fb.hashed_confidence(7, F.concat_ws("|", "tier_label", "category", F.col("position").cast("string")), 0.85, 0.99)
    examples = fb.sft_examples(cut, "query", "tier", conf)
    return examples, failed


# ---- deterministic stubs used by the registered queries and tests ----------
def stub_scorer() -> Callable[[list[str]], list[str]]:
    """A stand-in classifier: output shape chosen by the query length."""
    def score(qs: list[str]) -> list[str]:
        out = []
        for q in qs:
            n = len(q)
            k, t = n % 7, 1 + n % 4
            if k == 0:
                out.append(None)
            elif k == 1:
                out.append(f'{{"model_tier": {t}, "confidence": 0.{n % 10}5}}')
            elif k == 2:
                out.append(f"Tier: {t} confidence: 0.{n % 10}")
            elif k == 3:
                out.append("no idea")
            elif k == 4:
                out.append(f'Sure! {{"model_tier": {n % 6}}} ok')
            elif k == 5:
                out.append(f'{{"model_tier": {t}, "confidence": 0.95}}')
            else:
                out.append(f"level - {t}")
        return out
    return score


def stub_summariser() -> Callable[[Iterator[str]], str]:
    """A stand-in summariser that reads block after block."""
    def summarise_blocks(blocks: Iterator[str]) -> str:
        words = breaks = chars = 0
        for i, t in enumerate(blocks):
            between = context.CONTEXT_SEPARATOR if i else ""
            words += len(t.split())
            breaks += t.count("\n") + between.count("\n")
            chars += len(t) + len(between)
        return f"{words} words, {breaks + 1} lines, {chars} chars"
    return summarise_blocks


def stub_teacher() -> Callable[[list[str]], list[str]]:
    """A stand-in teacher: reads category and count from the prompt and
    answers with quota + 2 queries; one category always fails."""
    import re

    def teach(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            cat = re.search(r"Category: (\S+)", p).group(1)
            n = int(re.search(r"Generate (\d+) diverse", p).group(1))
            tier = re.search(r"belong to Tier (\d)", p).group(1)
            if cat == "legal_and_compliance":
                raise RuntimeError("teacher unavailable")
            items = ", ".join(f'"  {cat} question {i} for tier {tier} "' for i in range(n + 2))
            out.append(f"Here are the queries:\n[{items}]" if len(cat) % 2 == 0 else items)
        return out
    return teach
