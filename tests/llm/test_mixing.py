import hashlib
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from tierlens.llm import mixing as mx
from tierlens.llm.queries import ORACLES, QUERIES


def test_table_against_sql(spark, sf_dir):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    want = c.sql(ORACLES["op8_mixing"])
    rows = sorted(want.fetchall())
    assert sorted(tuple(r[x] for x in want.columns) for r in QUERIES["op8_mixing"](spark, sf_dir).collect()) == rows and rows


def leaves(spark, rows):
    return spark.createDataFrame(rows, "domain string, lang string, source string, have bigint, w_domain bigint, w_lang bigint, w_source bigint")


def budget(spark, rows, total, epochs=1):
    return {(r.domain, r.lang, r.source): r.budget for r in mx.budgets(leaves(spark, rows), F.lit(total), epochs).collect()}


def test_shortage_goes_to_siblings_first(spark):
    rows = [("a", "en", "s1", 10, 1, 1, 1), ("a", "en", "s2", 1000, 1, 1, 1), ("a", "de", "s3", 1000, 1, 1, 1), ("b", "en", "s4", 1000, 1, 1, 1)]
    got = budget(spark, rows, 400)
    assert got == {("a", "en", "s1"): 10, ("a", "en", "s2"): 90, ("a", "de", "s3"): 100, ("b", "en", "s4"): 200}


def test_shortage_of_a_whole_branch_goes_up(spark):
    rows = [("a", "en", "s1", 10, 1, 1, 1), ("a", "de", "s3", 20, 1, 1, 1), ("b", "en", "s4", 1000, 1, 1, 1), ("c", "en", "s5", 1000, 2, 1, 1)]
    got = budget(spark, rows, 330)
    assert got == {("a", "en", "s1"): 10, ("a", "de", "s3"): 20, ("b", "en", "s4"): 100, ("c", "en", "s5"): 200}
    assert sum(budget(spark, rows, 10**9).values()) == 2030


def test_prefix_is_the_longest_that_fits(spark, messy):
    docs = messy.withColumn("domain", F.lit("d"))
    weights = {"domain": F.lit(1), "lang": F.lit(1), "source": F.lit(1)}
    rows = mx.mix_sources(docs, weights, 0.5, epochs=3, seed=4).collect()
    have, words = defaultdict(int), {}
    light = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), mx.words().alias("n")).collect()
    for r in light:
        have[r.lang, r.source] += r.n
    used = defaultdict(int)
    for r in rows:
        used[r.lang, r.source] += r.n_tokens
    total = sum(have.values())
    assert sum(used.values()) <= total * 0.5
    assert all(n <= 3 * have[k] for k, n in used.items())
    for r in rows:  # order of the last epoch
        words.setdefault((r.lang, r.source), []).append((r.epoch, hashlib.md5(f"4:{r.epoch}:{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest()))


def test_hot_leaf_in_hash_ranges_equals_one_window(spark):
    rows = [(i, "d", "en", "s", " ".join(["w"] * (i % 7))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, domain string, lang string, source string, text string")
    weights = {k: F.lit(1) for k in mx.LEVELS}
    got = {r.doc_id for r in mx.mix_sources(docs, weights, 0.4, 1, 1).collect()}
    order = sorted(rows, key=lambda r: hashlib.md5(f"1:0:{r[0]}".encode()).hexdigest())
    rest = int(sum(i % 7 for i in range(3000)) * 0.4)
    want, total = set(), 0
    for r in order:
        total += r[0] % 7
        if total <= rest:
            want.add(r[0])
    assert got == want


def test_empty(empty):
    weights = {k: F.lit(1) for k in mx.LEVELS}
    assert mx.mix_sources(mx.with_domain(empty), weights, 0.5).collect() == []
