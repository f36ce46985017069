import hashlib
import re
from collections import Counter

import pytest

from tierlens.llm import exact_dedup as ed
from tierlens.llm import near_dedup as nd
from tierlens.llm.tables import read

LAST = 2**63


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), LAST if i is None else i))
    out = []
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[norm])[1]
        out.append((i, None if keep == LAST else keep, len(groups[norm]), keep == (LAST if i is None else i), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def exact(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in ed.exact_dedup(df).collect()), key=str)


def test_exact_messy(messy, messy_rows):
    assert exact(messy) == brute_exact([r[:2] for r in messy_rows])


def test_exact_many_runs_through_several_levels(spark):
    rows = [(i, f"text {i % 37}" + " " * (i % 3)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(70)
    assert exact(df) == brute_exact(rows)


def test_exact_empty(empty):
    assert ed.exact_dedup(empty).collect() == []


def brute_near(rows, k, percent):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = {tuple(w[p:p + k]) for p in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
        sets.append((LAST if i is None else i, s))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = {}
    for a, (_, s) in enumerate(sets):
        for g, n in Counter(b for x in s for b in held.get(x, ())).items():
            if 100 * n >= percent * (len(s) + len(sets[g][1]) - n):
                parent[root(a)] = root(g)
        for x in s:
            held.setdefault(x, []).append(a)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[root(a)] = min(i, least.get(root(a), LAST))
    shown = lambda i: None if i == LAST else i
    return sorted(((shown(i), len(s), shown(least[root(a)]), i == least[root(a)]) for a, (i, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_messy(messy, messy_rows, k, percent):
    assert sorted(map(tuple, nd.near_dedup(messy, k, percent).collect()), key=str) == brute_near([r[:2] for r in messy_rows], k, percent)


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_table(spark, sf_dir, k, percent):
    docs = read(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, nd.near_dedup(docs, k, percent).collect()), key=str) == brute_near(rows, k, percent)


def test_near_large_group_of_unequal_copies(spark, monkeypatch):
    """One base text with many independent edits: a bucket of hundreds of sets in several components."""
    import random

    monkeypatch.setattr(nd, "CHUNK", 32)
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(260):
        words = list(base)
        for p in rnd.sample(range(150), rnd.choice([0, 1, 2, 4, 6])):
            words[p] = f"e{i}_{p}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sorted(map(tuple, nd.near_dedup(df, 3, 85).collect()), key=str)
    want = brute_near(rows, 3, 85)
    assert got == want and len({r[2] for r in want}) > 5


def test_near_empty(empty):
    assert nd.near_dedup(empty).collect() == []


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 200), (300, 200)], "u bigint, v bigint")
    got = {r.node: r.component for r in nd.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}
