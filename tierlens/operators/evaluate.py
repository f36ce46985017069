"""Classifier evaluation: C8 attach predictions, D6 metrics, D7 confusion matrix,
D8 per-tier report, D9 calibration, D10 tier distribution.

Everything starts from one ``groupBy(true, pred).count()`` (a handful of rows
regardless of data size); the metric algebra then runs on that tiny frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlens import dims

LABELS = dims.TIER_NUMBERS
LABEL_NAMES = {t: lab for t, lab, _ in dims.TIERS}


def _div0(a: Column, b: Column) -> Column:
    """a / b with zero division giving 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def fixed_labels(spark) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(t,) for t in LABELS], "label int"))


def metrics(df: DataFrame, true_col: str = "true_tier", pred_col: str = "predicted_tier",
            conf_col: str | None = "confidence", n_bins: int = 10) -> DataFrame:
    """Accuracy, macro/weighted F1, macro precision/recall over the labels
    present in truth or prediction; plus ECE (D9). One row.

    The input is read once: one aggregate by (true, predicted, confidence bin)
    -- a few dozen rows whatever the data size -- feeds both the per-label
    counts (each cell counted on its true and its predicted side) and the
    per-bin calibration; the two tiny frames meet in one final aggregate."""
    t, p = F.col(true_col), F.col(pred_col)
    if conf_col:
        c = F.coalesce(F.col(conf_col).cast("double"), F.lit(dims.DPO_REJECTED_DEFAULT_CONFIDENCE))
        b = F.when((c > 0) & (c <= 1), F.ceil(c * n_bins).cast("int") - 1)
    else:
        c, b = F.lit(0.0), F.lit(None).cast("int")
    g = (df.select(t.alias("t"), p.alias("p"), b.alias("bin"), c.alias("c"))
           .groupBy("t", "p", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("sc")))
    hit = F.coalesce(F.col("t") == F.col("p"), F.lit(False))
    zero = F.lit(0).cast("bigint")
    sides = g.select(F.explode(F.array(
        F.struct(F.col("t").alias("label"), F.col("n").alias("sup"), zero.alias("pn"),
                 F.when(hit, F.col("n")).otherwise(zero).alias("tp")),
        F.struct(F.col("p").alias("label"), zero.alias("sup"), F.col("n").alias("pn"), zero.alias("tp")))).alias("s"))
    lab = sides.groupBy(F.col("s.label").alias("label")).agg(
        F.sum("s.sup").alias("sup"), F.sum("s.pn").alias("pn"), F.sum("s.tp").alias("tp"))
    # a missing tier is a present label that matches nothing: zero counts
    known = F.col("label").isNotNull()
    sup, pn, tp = [F.when(known, F.col(x)).otherwise(zero) for x in ("sup", "pn", "tp")]
    lab = lab.select(F.lit(True).alias("is_label"), sup.alias("sup"), tp.alias("tp"),
                     _div0(tp, pn).alias("prec"), _div0(tp, sup).alias("rec"), _div0(2 * tp, pn + sup).alias("f1"),
                     F.lit(None).cast("bigint").alias("nb"), F.lit(None).cast("double").alias("gap"))
    ok_val = F.when(F.col("t").isNotNull() & F.col("p").isNotNull(), hit.cast("double"))
    bins = g.groupBy("bin").agg(
        F.sum("n").alias("nb"), F.sum("sc").alias("sc"),
        F.sum(F.col("n") * ok_val).alias("sok"), F.sum(F.when(ok_val.isNotNull(), F.col("n"))).alias("cok"))
    gap = F.when(F.col("bin").isNotNull(),
                 F.col("nb") * F.abs(F.try_divide(F.col("sok"), F.col("cok")) - F.col("sc") / F.col("nb")))
    bins = bins.select(F.lit(False).alias("is_label"), *[F.lit(None).cast(ty).alias(x) for x, ty in (
        ("sup", "bigint"), ("tp", "bigint"), ("prec", "double"), ("rec", "double"), ("f1", "double"))],
        "nb", gap.alias("gap"))
    u = lab.unionByName(bins)
    on_label = F.col("is_label")
    out = u.agg(
        F.sum("nb").alias("total"), F.sum("tp").alias("ok"),
        F.avg(F.when(on_label, F.col("f1"))).alias("f1_macro"),
        F.avg(F.when(on_label, F.col("prec"))).alias("precision_macro"),
        F.avg(F.when(on_label, F.col("rec"))).alias("recall_macro"),
        F.sum(F.col("f1") * F.col("sup")).alias("_wf1"), F.sum("sup").alias("_sup"),
        F.sum("gap").alias("_gap"))
    cols = [F.col("total").cast("bigint").alias("n"),
            F.round(_div0(F.col("ok"), F.col("total")), 9).alias("accuracy"),
            F.round(F.coalesce("f1_macro", F.lit(0.0)), 9).alias("f1_macro"),
            F.round(_div0(F.col("_wf1"), F.col("_sup")), 9).alias("f1_weighted"),
            F.round(F.coalesce("precision_macro", F.lit(0.0)), 9).alias("precision_macro"),
            F.round(F.coalesce("recall_macro", F.lit(0.0)), 9).alias("recall_macro")]
    if conf_col:
        cols.append(F.round(F.coalesce(F.col("_gap") / F.col("total"), F.lit(0.0)), 9).alias("ece"))
    return out.select(*cols)


def _fixed_label_counts(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """One global aggregate (partial per task, one tiny final merge) with the
    pair counts of the fixed tiers 1..4 plus totals."""
    t, p = F.col(true_col), F.col(pred_col)
    cells = [F.count(F.when((t == a) & (p == b), 1)).alias(f"c_{a}_{b}") for a in LABELS for b in LABELS]
    per = []
    for lab in LABELS:
        per += [F.count(F.when(p == lab, 1)).alias(f"pn_{lab}"), F.count(F.when(t == lab, 1)).alias(f"sup_{lab}")]
    return df.agg(*cells, *per, F.count(F.lit(1)).alias("total"), F.count(F.when(t == p, 1)).alias("ok"))


def confusion_matrix(df: DataFrame, true_col: str = "true_tier", pred_col: str = "predicted_tier") -> DataFrame:
    """rows = true tier 1..4, columns p1..p4 = predicted; other labels ignored."""
    c = _fixed_label_counts(df, true_col, pred_col)
    rows = F.array(*[F.struct(F.lit(a).alias("true_tier"),
                              *[F.col(f"c_{a}_{b}").cast("bigint").alias(f"pred_{b}") for b in LABELS]) for a in LABELS])
    return c.select(F.inline(rows))


def report(df: DataFrame, true_col: str = "true_tier", pred_col: str = "predicted_tier") -> DataFrame:
    """Per-tier precision/recall/F1/support on tiers 1..4, then accuracy,
    macro avg and weighted avg rows (averages over the four fixed tiers).
    Everything is derived from one aggregate row."""
    c = _fixed_label_counts(df, true_col, pred_col)
    prec, rec, f1, sup = {}, {}, {}, {}
    for lab in LABELS:
        tp, pn, su = F.col(f"c_{lab}_{lab}"), F.col(f"pn_{lab}"), F.col(f"sup_{lab}")
        prec[lab], rec[lab], f1[lab], sup[lab] = _div0(tp, pn), _div0(tp, su), _div0(2 * tp, pn + su), su
    total_sup = sum((sup[lab] for lab in LABELS), F.lit(0))

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("row_name"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.cast("double").alias("f1"), s.cast("bigint").alias("support"))

    def avg(d):
        return sum((d[lab] for lab in LABELS), F.lit(0.0)) / len(LABELS)

    def wavg(d):
        return _div0(sum((d[lab] * sup[lab] for lab in LABELS), F.lit(0.0)), total_sup)

    rows = [row(LABEL_NAMES[lab], F.round(prec[lab], 9), F.round(rec[lab], 9), F.round(f1[lab], 9), sup[lab]) for lab in LABELS]
    rows.append(row("accuracy", F.lit(None), F.lit(None), F.round(_div0(F.col("ok"), F.col("total")), 9), F.col("total")))
    rows.append(row("macro avg", F.round(avg(prec), 9), F.round(avg(rec), 9), F.round(avg(f1), 9), total_sup))
    rows.append(row("weighted avg", F.round(wavg(prec), 9), F.round(wavg(rec), 9), F.round(wavg(f1), 9), total_sup))
    return c.select(F.inline(F.array(*rows)))


def reliability(df: DataFrame, true_col: str = "true_tier", pred_col: str = "predicted_tier",
                conf_col: str = "confidence", n_bins: int = 10) -> DataFrame:
    """D9 table: equal bins (lo, hi]; missing confidence counts as 0.5; a
    confidence of 0 (or outside 0..1) falls in no bin but stays in the total."""
    c = F.coalesce(F.col(conf_col).cast("double"), F.lit(dims.DPO_REJECTED_DEFAULT_CONFIDENCE))
    b = F.when((c > 0) & (c <= 1), F.ceil(c * n_bins).cast("int") - 1)
    x = df.select(b.alias("bin"), c.alias("c"), (F.col(true_col) == F.col(pred_col)).cast("double").alias("ok"))
    per = (x.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("avg_confidence"), F.avg("ok").alias("accuracy")))
    return per


def ece(df: DataFrame, true_col: str = "true_tier", pred_col: str = "predicted_tier",
        conf_col: str = "confidence", n_bins: int = 10) -> DataFrame:
    """ECE = sum over bins of n_bin / N * |accuracy - avg confidence|."""
    per = reliability(df, true_col, pred_col, conf_col, n_bins)
    return per.agg(
        F.round(F.coalesce(F.sum(F.when(F.col("bin").isNotNull(),
                                        F.col("n") * F.abs(F.col("accuracy") - F.col("avg_confidence")))) /
                           F.sum("n"), F.lit(0.0)), 9).alias("ece"))


def tier_distribution(df: DataFrame, tier_col: str, valid: Column | None = None) -> DataFrame:
    """Count per tier 1..4 (valid rows only) and % of all rows (errors included)."""
    spark = df.sparkSession
    v = valid if valid is not None else F.lit(True)
    x = df.select(F.when(v, F.col(tier_col)).alias("tier"))
    counts = x.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    total = x.agg(F.count(F.lit(1)).alias("total")).scalar()
    out = (fixed_labels(spark).withColumnRenamed("label", "tier").join(counts, "tier", "left")
           .select("tier", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), total.alias("total")))
    return out.select("tier", "n", F.when(F.col("total") > 0, F.round(F.col("n") * 100.0 / F.col("total"), 9))
                      .otherwise(0.0).alias("pct"))


def attach_predictions(examples: DataFrame, predictions: DataFrame) -> DataFrame:
    """First user text and first assistant JSON tier of each labelled
    example, left-joined with the scored queries (one prediction per query)."""
    user = F.filter("messages", lambda m: m["role"] == "user")[0]["content"]
    asst = F.filter("messages", lambda m: m["role"] == "assistant")[0]["content"]
    ex = examples.select("*", user.alias("query"),
                         F.try_variant_get(F.try_parse_json(asst), "$.model_tier", "int").alias("true_tier"))
    preds = (predictions.groupBy("query")
                        .agg(F.min(F.struct("predicted_tier", "confidence")).alias("_p"))
                        .select("query", "_p.*"))
    return ex.join(preds, "query", "left")
