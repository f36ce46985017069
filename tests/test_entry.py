import __spark_entry__ as se


def test_entry_runs(spark):
    df = se.entry(spark)
    assert df.count() > 0
    assert "roi_pct" in df.columns


def test_registry_consistent():
    qs, ors = se.queries(), se.oracle_sql()
    assert set(ors) <= set(qs)
    assert len(qs) >= 111


def test_streaming_twin_equals_batch(spark, sf_dir):
    qs = se.queries()
    a = {tuple(r) for r in qs["i4_pivot_stream"](spark, sf_dir).collect()}
    b = {tuple(r) for r in qs["e3_tier_pivots"](spark, sf_dir).collect()}
    assert a == b
    a = {tuple(r) for r in qs["i5_assemble_stream"](spark, sf_dir).collect()}
    b = {tuple(r) for r in qs["i5_assemble_batch"](spark, sf_dir).collect()}
    assert a == b
