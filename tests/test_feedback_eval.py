from pyspark.sql import functions as F

from tierlens.operators import evaluate as ev
from tierlens.operators import export
from tierlens.operators import feedback as fb
from tierlens.operators import validate


def test_stats_of_empty_store_has_full_schema(spark):
    r = fb.stats(fb.empty_feedback(spark)).first()
    assert (r.total, r.correct, r.incorrect, r.accuracy, r.threshold, r.ready_for_retrain) == (0, 0, 0, 0.0, 20, False)


def test_dpo_null_confidence_stays_null(spark):
    df = spark.createDataFrame([("q", 1, 3, None, False), ("q2", 2, 2, 0.9, True)],
                               "query string, predicted_tier int, corrected_tier int, confidence double, is_correct boolean")
    rows = fb.dpo_triples(df).collect()
    assert len(rows) == 1
    assert rows[0].chosen == '{"model_tier": 3, "confidence": 1.0}'
    assert rows[0].rejected == '{"model_tier": 1, "confidence": null}'
    assert rows[0].prompt.endswith("\n\nUser Query: q")


def test_acceptance_quarantines_bad_tiers(spark):
    df = spark.createDataFrame([("a", 1, 1), ("b", 0, 2), ("c", 2, 5)], "query string, predicted_tier int, corrected_tier int")
    ok, bad = fb.accept(df)
    assert [(r.query, r.is_correct) for r in ok.collect()] == [("a", True)]
    assert sorted(r.reject_reason for r in bad.collect()) == ["corrected_tier must be 1-4", "predicted_tier must be 1-4"]


def test_metrics_against_hand_computed(spark):
    # truth/pred pairs; labels present {1,2,3}
    pairs = [(1, 1), (1, 2), (2, 2), (2, 2), (3, 1), (3, 3)]
    df = spark.createDataFrame([(t, p, 0.95) for t, p in pairs], "true_tier int, predicted_tier int, confidence double")
    m = ev.metrics(df).first()
    # per label: 1: tp1 fp1 fn1 -> f1 .5; 2: tp2 fp1 fn0 -> .8; 3: tp1 fp0 fn1 -> 2/3
    assert abs(m.accuracy - 4 / 6) < 1e-9
    assert abs(m.f1_macro - (0.5 + 0.8 + 2 / 3) / 3) < 1e-9
    assert abs(m.f1_weighted - (0.5 * 2 + 0.8 * 2 + 2 / 3 * 2) / 6) < 1e-9
    # ECE: one bin (0.9, 1.0]: |4/6 - 0.95|
    assert abs(m.ece - abs(4 / 6 - 0.95)) < 1e-9
    cm = {r.true_tier: (r.pred_1, r.pred_2, r.pred_3, r.pred_4) for r in ev.confusion_matrix(df).collect()}
    assert cm == {1: (1, 1, 0, 0), 2: (0, 2, 0, 0), 3: (1, 0, 1, 0), 4: (0, 0, 0, 0)}
    assert sum(sum(v) for v in cm.values()) == len(pairs)


def test_confidence_zero_is_in_no_bin(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (1, 1, 1.0)], "true_tier int, predicted_tier int, confidence double")
    rel = {r.bin: r.n for r in ev.reliability(df).collect()}
    assert rel == {None: 1, 9: 1}
    assert abs(ev.ece(df).first().ece - 0.0) < 1e-12


def test_split_sizes_add_up(spark):
    df = spark.range(0, 1003).withColumnRenamed("id", "k")
    out = export.split_assign(df, ["k"], seed=42)
    counts = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"train": 802, "val": 100, "test": 101}
    assert out.select("rank").distinct().count() == 1003


def test_validator_rule_order(spark):
    lines = [
        ("{bad",), ('{"x": 1}',), ('{"messages": [{"role": "user", "content": "q"}]}',),
        ('{"messages": [{"role": "assistant", "content": "a"}, {"role": "user", "content": "q"}]}',),
        ('{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "nope"}]}',),
        ('{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "{\\"model_tier\\": 5, \\"confidence\\": 0.5}"}]}',),
        ('{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "{\\"model_tier\\": 2, \\"confidence\\": 2}"}]}',),
        ('{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "{\\"model_tier\\": 2, \\"confidence\\": 0.9}"}]}',),
    ]
    df = spark.createDataFrame(lines, "line string")
    got = [r.error_code for r in validate.validate_examples(df).collect()]
    assert got == ["invalid_json", "missing_messages", "too_few_messages", "last_not_assistant",
                   "content_not_json", "invalid_tier", "invalid_confidence", None]


def test_recover_turns_dedups_and_skips_known(spark):
    scratch = spark.createDataFrame([(1, 0, "a", 2), (1, 2, "b", 2), (2, 0, "a", 3), (2, 2, "c", 3)],
                                    "conv_id long, turn long, query string, last_tier int")
    stored = spark.createDataFrame([("c",)], "query string")
    got = sorted((r.query, r.conv_id, r.predicted_tier) for r in fb.recover_turns(scratch, stored).collect())
    assert got == [("a", 1, 2), ("b", 1, 2)]
    assert F is not None


def _py_metrics(rows):
    """Brute force of D6: labels present in truth or prediction (a missing tier
    is a label that matches nothing), ECE over (lo, hi] bins, missing confidence 0.5."""
    import math

    labels = {t for t, _, _ in rows} | {p for _, p, _ in rows}
    f1s, precs, recs, sups = [], [], [], []
    for lab in labels:
        if lab is None:
            tp = pn = sup = 0
        else:
            tp = sum(1 for t, p, _ in rows if t == lab and p == lab)
            pn = sum(1 for _, p, _ in rows if p == lab)
            sup = sum(1 for t, _, _ in rows if t == lab)
        precs.append(tp / pn if pn else 0.0)
        recs.append(tp / sup if sup else 0.0)
        f1s.append(2 * tp / (pn + sup) if pn + sup else 0.0)
        sups.append(sup)
    n = len(rows)
    ok = sum(1 for t, p, _ in rows if t is not None and p is not None and t == p)
    bins = {}
    for t, p, c in rows:
        c = 0.5 if c is None else c
        b = math.ceil(c * 10) - 1 if 0 < c <= 1 else None
        bins.setdefault(b, []).append((c, None if t is None or p is None else float(t == p)))
    gap = 0.0
    for b, xs in bins.items():
        oks = [o for _, o in xs if o is not None]
        if b is not None and oks:
            gap += len(xs) * abs(sum(oks) / len(oks) - sum(c for c, _ in xs) / len(xs))
    return {"n": n, "accuracy": ok / n, "f1_macro": sum(f1s) / len(f1s),
            "f1_weighted": sum(f * s for f, s in zip(f1s, sups)) / sum(sups) if sum(sups) else 0.0,
            "precision_macro": sum(precs) / len(precs), "recall_macro": sum(recs) / len(recs), "ece": gap / n}


def test_metrics_with_missing_tiers_and_stray_labels(spark):
    rows = [(1, 1, 0.9), (1, 2, 0.4), (2, 2, None), (3, None, 0.7), (None, 3, 0.2), (4, 7, 1.0),
            (7, 7, 0.0), (2, 1, 0.55), (3, 3, 0.35), (None, None, 0.8), (4, 4, 1.3), (2, 2, 0.61)]
    df = spark.createDataFrame(rows, "true_tier int, predicted_tier int, confidence double")
    got = ev.metrics(df).first().asDict()
    exp = _py_metrics(rows)
    for k, v in exp.items():
        assert abs(got[k] - round(v, 9)) < 1e-9, (k, got[k], v)
