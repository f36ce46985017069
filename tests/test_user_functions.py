from pyspark.sql import functions as F

from tierlens.operators import context as C
from tierlens.operators import user_functions as U


def _log(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"text {c} {t} " + "x\n" * (t % 5)) for c in range(3) for t in range(23)]
    rows += [(1, 9, "summary", "what happened"), (2, 40, "user", None)]
    rows = [r for r in rows if (r[0], r[1], r[2]) != (1, 9, "assistant")]
    return spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(3)


def test_blocks_join_to_the_context_text(spark):
    log = _log(spark)
    whole = {r.conv_id: r.context for r in C.context_text(log).collect()}
    assert whole[1].startswith(C.SUMMARY_HEADER + "what happened\n\n[user]: text 1 10") and whole[2].endswith("[user]: ")
    for block_chars, chunk in ((1, 2), (60, 3), (10**6, 1 << 20)):
        blocks = C.context_blocks(log, block_chars=block_chars, chunk=chunk).orderBy("conv_id", "block_no").collect()
        assert {c: C.CONTEXT_SEPARATOR.join(r.text for r in blocks if r.conv_id == c) for c in whole} == whole
        assert all(len(r.text) <= block_chars + 60 for r in blocks)


def test_summaries_read_block_by_block_equal_those_of_whole_texts(spark):
    log = _log(spark)

    def whole():
        return lambda texts: [f"{len(t.split())} words, {t.count(chr(10)) + 1} lines, {len(t)} chars" for t in texts]

    cols = ["conv_id", "summary", "summary_tokens", "tokens_before", "type", "call_error"]
    want = sorted(tuple(r) for r in U.summarise(log, U.of_whole_text(whole)).select(cols).collect())
    assert len(want) == 3 and all(r[5] is None for r in want)
    for block_chars in (1, 70, 10**6):
        assert sorted(tuple(r) for r in U.summarise(log, U.stub_summariser, block_chars=block_chars).select(cols).collect()) == want


def test_a_long_conversation_is_never_one_row(spark):
    log = spark.range(0, 200_000, numPartitions=8).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"),
                                                           F.concat(F.lit("turn "), F.col("id").cast("string")).alias("text"))
    blocks = C.context_blocks(log, chunk=10_000)
    assert blocks.agg(F.max(F.length("text"))).first()[0] < C.CONTEXT_BLOCK_CHARS + 100
    row = U.summarise(log, U.stub_summariser).first()
    assert row.summary.startswith("600000 words, 399999 lines")


def test_errors_and_unread_blocks_stay_with_their_conversation(spark):
    def picky():
        def fn(blocks):
            if "text 0" in next(blocks):
                raise RuntimeError("no")
            return "read one block"
        return fn

    got = {r.conv_id: (r.summary, r.call_error) for r in U.summarise(_log(spark), picky, block_chars=20).collect()}
    assert got == {0: (None, "RuntimeError: no"), 1: ("read one block", None), 2: ("read one block", None)}


def test_generated_examples_are_cut_to_each_cells_quota(spark):
    grid = spark.createDataFrame([(1, "small", "math", 0, 2), (2, "medium", "math", 0, 4), (1, "small", "legal_and_compliance", 1, 3)],
                                 "tier int, tier_label string, category string, category_idx int, quota int")
    grid = grid.withColumn("prompt", F.concat(F.lit("Category: "), "category", F.lit("\nGenerate "), F.col("quota").cast("string"),
                                              F.lit(" diverse queries that belong to Tier "), F.col("tier").cast("string")))
    examples, failed = U.generate(grid, U.stub_teacher)
    got = {(r.tier_label, r.n) for r in examples.groupBy("tier_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {("small", 2), ("medium", 4)}
    assert [tuple(r) for r in failed.collect()] == [("small", "legal_and_compliance", "RuntimeError: teacher unavailable")]
