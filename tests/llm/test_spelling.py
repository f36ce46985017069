import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tierlens.llm import spelling as sp
from tierlens.llm.tables import read

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UP = {c: c + 32 for c in range(65, 91)}


def counted(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(UP)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def near_by_deletion(words):
    """Near pairs through the strings that one deletion leaves, for larger word lists."""
    at = defaultdict(set)
    for w in words:
        at[w].add(w)
        for i in range(len(w)):
            at[w[:i] + w[i + 1:]].add(w)
    pairs = set()
    for group in at.values():
        group = sorted(group)
        pairs |= {(a, b) for i, a in enumerate(group) for b in group[i + 1:] if near(a, b)}
    return pairs | {(b, a) for a, b in pairs}


def brute(counts):
    friends = defaultdict(list)
    for a, b in near_by_deletion(counts):
        friends[a].append(b)
    form = {}
    for w, own in friends.items():
        best = min(own, key=lambda x: (-counts[x], x))
        if counts[best] >= 5 * counts[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, n, len(friends[w]), form.get(w), counts[form[w]] if w in form else None, root(w)) for w, n in counts.items())


def found(df):
    return sorted(tuple(r) for r in sp.spelling_variants(df).select("word", "n", "n_near", "form", "form_n", "root").collect())


def key(rows):
    return sorted(rows, key=str)


def test_table(spark, sf_dir):
    df = read(spark, sf_dir, "documents")
    counts = counted([(r.doc_id, r.text) for r in df.collect()])
    got = found(df)
    assert len(got) > 500 and sum(r[3] is not None for r in got) > 10
    assert key(got) == key(brute(counts))


@pytest.fixture(scope="module")
def variants():
    """Words in chains of variants, accented letters, long words, anagrams, ties."""
    rnd = random.Random(11)
    letters = "abcdeoßéüÿ×"
    words = {}
    for _ in range(300):
        w = "".join(rnd.choice(letters) for _ in range(rnd.randint(6, 9)))
        n = 5
        for _ in range(4):
            words[w] = n
            i = rnd.randrange(len(w))
            w = rnd.choice([w[:i] + w[i + 1:], w[:i] + rnd.choice(letters) + w[i:], w[:i] + rnd.choice(letters) + w[i + 1:]])
            n *= rnd.choice([3, 5, 6])
    words |= {"a" * 400: 5, "a" * 401: 25, "a" * 402: 125, "b" + "a" * 400: 25, "listens": 6, "silents": 6, "tinsels": 30}
    return {w: n for w, n in words.items() if len(w) >= 6}


@pytest.mark.parametrize("cell,leaf,sample", [(16_384, 32, 100_000), (40, 4, 100_000), (25, 3, 60)])
def test_near_words_for_any_size_of_cells(spark, monkeypatch, variants, cell, leaf, sample):
    for name, value in {"CELL_WORDS": cell, "LEAF_WORDS": leaf, "SAMPLE_WORDS": sample, "BATCH": 64}.items():
        monkeypatch.setattr(sp, name, value)
    df = spark.createDataFrame(list(variants.items()), "word string, n long").repartition(4)
    got = [tuple(r) for r in sp.near_words(df).collect()]
    assert len(got) == len(set(got))
    assert {g[:2] for g in got} == near_by_deletion(variants)
    assert all(variants[b] == n for _, b, n in got)


def test_forms_and_roots(spark, variants):
    text = [(None, " ".join(w for w, n in variants.items() for _ in range(n)))]
    df = spark.createDataFrame(text, "doc_id long, text string")
    assert key(found(df)) == key(brute(variants))


def test_messy_rows(spark, messy, messy_rows, empty):
    assert key(found(messy)) == key(brute(counted([r[:2] for r in messy_rows])))
    assert found(empty) == []


def test_runs_and_deletions(spark):
    texts = ["Straße ÄÖÜabc naïveĀŒuvreŽ ÀÿÐþ x\xa0y\x85z", "İstanbul 日本word🤦word", "A-B c'd e_f 1g2", "¿ÀÿĀ"]
    for t in texts:
        assert [r.decode("latin-1") for r in sp.runs_of(t)] == [x.translate(UP) for x in RUN.findall(t)]
    rows = [(i, "wordlike éclairs straßen " * 2) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.word: r.n for r in sp.word_counts(df).collect() if len(r.word) >= 6 and r.n >= 5}
    assert got == counted(rows) and len(got) > 3


def test_table_is_sent_when_full(spark, monkeypatch):
    monkeypatch.setattr(sp, "TABLE_WORDS", 3)
    df = spark.createDataFrame([(1, "alphabet betatest gammaray deltawing"), (2, "alphabet alphabet epsilons")], "doc_id long, text string").coalesce(1)
    assert {r.word: r.n for r in sp.word_counts(df).collect()}["alphabet"] == 3


def test_letter_counts_bound_one_edit():
    rnd = random.Random(2)
    letters = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]
    for _ in range(300):
        w = "".join(rnd.choice(letters[:8] + letters[30:60]) for _ in range(rnd.randint(1, 12)))
        i, c = rnd.randrange(len(w)), rnd.choice(letters)
        codes = {k: sp.letter_counts(sp.padded([x.encode("latin-1")], len(x))) for k, x in
                 (("w", w), ("replaced", w[:i] + c + w[i + 1:]), ("longer", w[:i] + c + w[i:]))}
        assert sp.reachable(codes["w"], codes["replaced"], codes["replaced"], False).all()
        assert sp.reachable(codes["w"], codes["longer"], codes["longer"], True).all()
    one = sp.letter_counts(np.frombuffer(b"aaab", np.uint8).reshape(1, 4))
    two = sp.letter_counts(np.frombuffer(b"aabb", np.uint8).reshape(1, 4))
    assert sp.reachable(one, two, two, False).all() and not sp.reachable(one, two, two, True).any()
