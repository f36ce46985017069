import math
import random

import numpy as np
import pytest

from tierlens.llm import hard_negatives as hn
from tierlens.llm.tables import read

SCHEMA = "vec_id bigint, embedding array<float>, label int, mark string, score int"


def brute(rows):
    """Distinct rows, every pair scored."""
    clean = {}
    for i, x, label in rows:
        if i is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        q = tuple(math.floor(256 * float(v)) for v in x)
        clean[(i, (label + 1) % 10 if i % 7 == 0 else label, q)] = 1
    clean = list(clean)
    out = []

    def score(a, b):
        return sum(x * y for x, y in zip(a[2], b[2]))

    for a in clean:
        if a[0] % 100:
            continue
        pos = sorted(((-score(a, b), b[0]) for b in clean if b != a and b[1] == a[1]))[:5]
        neg = sorted(((-score(a, b), b[0]) for b in clean if b[1] != a[1]))
        for p, pid in pos:
            fit = [(s, i) for s, i in neg if -80 * p <= -100 * s <= -100 * p][:5]
            out += [(a[0], pid, r, i, -p, -s) for r, (s, i) in enumerate(fit, 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in hn.hard_negatives(hn.relabelled(hn.scaled(df))).collect())


def test_table(spark, sf_dir):
    df = read(spark, sf_dir, "embeddings")
    want = brute([(r.vec_id, r.embedding, r.label) for r in df.select("vec_id", "embedding", "label").collect()])
    assert len(want) > 20 and found(df) == want


def clustered(n, dim, seed, hot=0):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 0.4) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = centres[0] if i < hot else [x + rnd.gauss(0, 0.05) for x in rnd.choice(centres)]
        rows.append((i, [round(x, 2) for x in c], i % 3, "x", 1))
    return rows


@pytest.mark.parametrize("dim,hot", [(8, 0), (2, 0), (6, 260)])
def test_many_small_parts_and_pages_equal_brute_force(spark, monkeypatch, dim, hot):
    for name, value in {"PAGE_ROWS": 16, "LEAST_PART_ROWS": 64, "BLOCK_ANCHORS": 3, "TOGETHER": 2}.items():
        monkeypatch.setattr(hn, name, value)
    rows = clustered(800, dim, dim, hot)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(df) == brute([r[:3] for r in rows])


def test_pages_out_of_reach_are_left_out(monkeypatch):
    """Two far clusters: the queue ends before the far pages are scored."""
    import pandas as pd

    x = np.concatenate([np.full((64, 4), 100), np.full((64, 4), -100)]) + np.arange(128)[:, None] % 5
    pages = pd.DataFrame([{"dim": 4, "lo": p.min(0).tobytes(), "hi": p.max(0).tobytes(), "vectors": p.tobytes(), "ids": i.tobytes(),
                           "labels": np.zeros(16, np.int64).tobytes(), "marks": i.tobytes()}
                          for p, i in ((x[a:a + 16].astype(np.int64), np.arange(a, a + 16)) for a in range(0, 128, 16))])
    part = hn.Part(pages)
    scored = []
    part.vectors = [type("V", (), {"T": v.T, "seen": scored.append})() for v in part.vectors]

    class Watched(list):
        def __getitem__(self, p):
            scored.append(p)
            return list.__getitem__(self, p)

    part.vectors = Watched(part.vectors)
    slots = pd.DataFrame({"anchor": [0], "slot": [0], "low": [hn._WIDE.min], "high": [hn._WIDE.max], "kth": [hn._WIDE.min]})
    best = hn.search(part, np.array([[1, 1, 1, 1]]), np.array([0]), np.array([-1]), np.array([-1]), slots, 5, True)
    assert best.id.tolist() == [4, 9, 14, 19, 24] and set(scored) <= {0, 1, 2, 3}


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 1, "a", 1), (0, [1.0, 0.0], 1, "a", 1), (1, [1.0, 0.5], 1, "a", 1), (1, [0.5, 1.0], 1, "b", 2), (2, [0.9, 0.1], 2, "a", 1),
            (3, [0.9, 0.1], 3, "a", 1), (4, None, 1, "a", 1), (5, [None, 1.0], 2, "a", 1), (6, [float("nan"), 1.0], 2, "a", 1), (8, [float("inf"), 1.0], 2, "a", 1),
            (9, [0.95], 2, "a", 1), (10, [], 2, "a", 1), (11, [1.0, 0.0], None, "a", 1), (None, [1.0, 0.0], 2, "a", 1), (100, [-1.0, 0.0], 1, "a", 1),
            (200, [0.0, 0.0], 4, "a", 1), (201, [0.3, 0.4], 4, "a", 1), (300, [2e9, 1e9], 2, "a", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    want = brute([r[:3] for r in rows])
    assert any(r[0] == 200 for r in want) and any(r[0] == 300 for r in want)
    assert found(df) == want


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert found(df) == []
    assert found(spark.createDataFrame([(1, [1.0], 1, "", 0), (100, [1.0], 5, "", 0)], SCHEMA)) == []
