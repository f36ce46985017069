import hashlib
import math
import re
from collections import Counter

from pyspark.sql import functions as F

from tierlens.llm import multiset_hash as mh
from tierlens.llm.queries import QUERIES
from tierlens.llm.tables import read


def brute_edits(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        out[i] = t[:len(t) - cut] + n[:cut]
    return out


def test_edits_of_the_table(spark, sf_dir):
    rows = {r.doc_id: r.text for r in read(spark, sf_dir, "documents").collect()}
    want = brute_edits(list(rows.items()))
    got = QUERIES["op4_multiset_hash"](spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_chars == len(rows[r.doc_id]) and r.edited_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == r.edited_fingerprint) <= (r.near_edited == 1.0)
    long_ = [r for r in got if r.n_chars > 1500]
    assert sum(r.near_edited for r in long_) > 3 * sum(r.near_next for r in long_)


def test_many_ranges_and_odd_ids(spark, monkeypatch):
    monkeypatch.setattr(mh, "RANGE_BYTES", 40)
    rows = [(i * i - 50, f"text {i} é🤦 " * (i % 5)) for i in range(60)] + [(-10**15, None), (2**62, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r.edited for r in mh.compare_with_edit(df).collect()}
    assert got == brute_edits(rows)


def test_single_document_is_its_own_next(spark):
    df = spark.createDataFrame([(5, "abcdef")], "doc_id bigint, text string")
    r = mh.compare_with_edit(df).first()
    assert r.edited == "abcdab" and r.near_next == 1.0


def test_order_insertion_and_deletion(spark):
    df = spark.createDataFrame([("one\ntwo\nthree", "three\none\ntwo", "one\ntwo", "three")], "a string, b string, c string, d string")
    v = {c: mh.vector(F.col(c)) for c in "abcd"}
    r = df.select(v["a"].alias("va"), v["b"].alias("vb"), mh.insert(v["c"], v["d"]).alias("more"),
                  mh.delete(v["a"], v["d"]).alias("less"), v["c"].alias("vc")).first()
    assert r.va == r.vb == r.more and r.less == r.vc and r.va != r.vc


def test_equal_texts_and_distinct_texts(spark, sf_dir):
    rows = QUERIES["op4_multiset_hash"](spark, sf_dir).select("doc_id", "fingerprint").collect()
    texts = {r.doc_id: r.text for r in read(spark, sf_dir, "documents").collect()}
    by = {}
    for r in rows:
        by.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in by.values()) and len({next(iter(f)) for f in by.values()}) == len(by)


def cosine(a, b):
    a, b = (Counter(p for p in re.split(mh.PIECE_END, t) if p) for t in (a, b))
    norm = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    return sum(v * b[p] for p, v in a.items()) / norm


def test_likeness_of_long_texts(spark):
    def lines(tag, n):
        return "\n".join(f"{tag} line {i}" for i in range(n))

    rows = [(90, lines("a", 5000)), (80, lines("b", 5000)), (70, lines("c", 10_000)), (60, lines("d", 10_000)), (50, "short text\nof two lines"),
            (40, lines("e", 50_000)), (30, lines("f", 50_000)), (20, "the same line\n" * 10_000), (10, "another line!\n" * 10_000), (0, lines("g", 12_000))]
    texts = [t for _, t in rows]
    got = {r.doc_id: r for r in mh.compare_with_edit(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    edits = brute_edits(rows)
    for k, (i, t) in enumerate(rows):
        assert abs(got[i].near_edited - cosine(t, edits[i])) < 0.2, i
        assert abs(got[i].near_next - cosine(t, texts[(k + 1) % len(texts)])) < 0.35, i
    assert got[20].vector[0] == 10_000


def test_messy_and_empty(spark, messy, empty):
    got = mh.compare_with_edit(messy).collect()
    assert len(got) == messy.count()
    assert mh.compare_with_edit(empty).collect() == []


def test_plan_has_no_python(spark, sf_dir):
    plan = QUERIES["op4_multiset_hash"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
