from pyspark.sql import functions as F

from tierlens.operators import cost


def test_known_cost_cases(spark):
    # (tier, in, out, is_summary): 0.52 USD actual, 3.84 USD baseline
    calls = spark.createDataFrame(
        [(1, 1, 500_000, 500_000, False), (1, 1, 100_000, 100_000, True), (1, 2, 1_000_000, 1_000_000, False)],
        "conv_id long, tier int, input_tokens long, output_tokens long, is_summarisation boolean")
    r = cost.session_roi(cost.turn_roi(calls)).first()
    assert r.actual_total_nano == 520_000_000
    assert r.baseline_total_nano == 3_840_000_000
    assert r.total_turns == 2  # summaries are not turns
    assert r.summarisation_nano == 20_000_000
    assert r.savings_nano == r.baseline_total_nano - r.actual_total_nano


def test_price_books_disagree_on_unknown_tier(spark):
    df = spark.createDataFrame([(7, 10, 10), (2, 1000, 1000)], "tier int, input_tokens long, output_tokens long")
    roi = {r.tier: r.cost_nano for r in cost.price_calls(df, "roi").collect()}
    log = {r.tier: r.cost_nano for r in cost.price_calls(df, "router_log").collect()}
    assert roi[7] == 0 and log[7] is None
    assert roi[2] == 1000 * 100 + 1000 * 300
    assert log[2] == 1000 * 50 + 1000 * 80


def test_zero_baseline_gives_zero_roi(spark):
    df = spark.createDataFrame([(1, 1, 0, 0)], "conv_id long, tier int, input_tokens long, output_tokens long")
    assert cost.session_roi(cost.turn_roi(df)).first().roi_pct == 0.0


def test_summariser_has_null_tier_and_cost(spark):
    df = spark.createDataFrame([("summary", "magistral-small-2509", 100, 10, 110)],
                               "kind string, model string, prompt_tokens long, completion_tokens long, total_tokens long")
    r = cost.cost_records(df).first()
    assert r.actual_tier is None and r.actual_cost_nano is None and r.savings_pct is None
    assert r.baseline_cost_nano == 100 * 400 + 10 * 2000


def test_running_cost_matches_python(spark):
    rows = [(1, t, 10 * t) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, actual_cost_nano long")
    got = [r.cumulative_cost_nano for r in cost.running_cost(df).orderBy("turn").collect()]
    assert got == [0, 10, 30, 60, 100, 150]
    assert F is not None
