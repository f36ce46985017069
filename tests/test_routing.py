import pytest

from tierlens.operators import routing


CASES = [
    ('{"model_tier": 3, "confidence": 0.9}', "json", 3, 0.9),
    ('Sure! {"model_tier": 2, "confidence": 0.8} done', "embedded_json", 2, 0.8),
    ("Tier: 4 confidence: 0.7", "keyword", 4, 0.7),
    ("Tier: 4 confidence: 1.0", "keyword", 4, 0.5),    # the confidence pattern needs 0?.d+
    ("no idea", "fallback", 2, 0.3),
    ('{"model_tier": 9, "confidence": 1.7}', "json", 4, 1.0),  # clamped
    ("level - 4", "keyword", 4, 0.5),
    ('{"confidence": 0.4}', "json", 2, 0.4),           # missing tier -> 2
    ("7", "fallback", 2, 0.3),                         # a JSON scalar is not an object
    ('{"model_tier": 1} trailing', "embedded_json", 1, 0.5),
    ('{"model_tier": 2.7}', "json", 2, 0.5),           # int truncation
]


@pytest.mark.parametrize("raw,path,tier,conf", CASES)
def test_tolerant_parse(spark, raw, path, tier, conf):
    df = spark.createDataFrame([(raw,)], "raw string")
    r = routing.route_decisions(df).first()
    assert (r.parse_path, r.model_tier, round(r.confidence, 6)) == (path, tier, conf)
    assert r.model_name and r.tier_label


def test_strict_parse_quarantines(spark):
    df = spark.createDataFrame([('x {"model_tier": 9}\n y', ), ("Tier: 3",), ('{"confidence": 0.5}',)], "raw string")
    ok, bad = routing.strict_parse(df)
    rows = {r.raw: r for r in ok.collect()}
    assert rows['x {"model_tier": 9}\n y'].model_name == "ministral-3b-latest"   # unknown tier -> default model
    assert rows['{"confidence": 0.5}'].model_tier == 1                           # default tier 1
    assert [r.raw for r in bad.collect()] == ["Tier: 3"]


def test_service_fallback(spark):
    df = spark.createDataFrame([(None, "timeout"), (None, None), ("  Tier: 3 ", None)], "raw string, call_error string")
    out = [(r.parse_path, r.model_tier, r.confidence) for r in routing.service_fallback(df).collect()]
    assert out == [("service_error", 2, 0.0), ("malformed_body", 2, 0.3), ("keyword", 3, 0.5)]
