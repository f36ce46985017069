import random
import re

import pytest

from tierlens.llm import pii
from tierlens.llm.tables import read

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for kind, pattern, ok in ((2, CARD, lambda d: 14 <= len(d) <= 19 and luhn(d)), (3, PHONE, lambda d: 10 <= len(d) <= 15)):
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if ok(re.sub("[^0-9]", "", m.group()))]
    return sorted(out)


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = sorted(pii.find_pii(df).collect(), key=lambda r: r.doc_id)
    return [[(s.s, s.k, s.e) for s in r.base] for r in rows], [[(s.s, s.k, s.e) for s in r.spans] for r in rows]


CASES = ["", "mail a.b+c@x-y.example.com.", "a@b", "a@b.c_d@e.f @x.y a@b.c.@x.y", "1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 00001.02.3.255",
         "4111 1111 1111 1111 4111-1111-1111-1112 12  34", "+1 (659) 555-3949, ++4912345678901 +1-2", "é🤦 x@y.zz 日本 +1 234 567 8901 🤦 10.0.0.1",
         "a" * 3000 + "@" + "b" * 3000 + ".c", "1" * 20_000, "1 " * 5_000, "." * 4_000 + "@", "+" * 3_000 + "1234567890 1", "9" * 4_000 + ".1.1.1"]


def test_edge_cases(spark):
    base, spans = found(spark, CASES)
    assert base == [brute(t) for t in CASES]
    assert all(set(b) <= set(s) for b, s in zip(base, spans))


def test_cards_without_two_adjacent_digits(spark):
    texts = [sep.join("4111111111111111") for sep in " -"] + ["paid 4 1 1 1-1 1 1 1 1 1 1 1 1 1 1-1 é", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 2"]
    want = [brute(t) for t in texts]
    assert [len(w) for w in want] == [1, 1, 1, 0] and found(spark, texts)[0] == want


def test_random_texts(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("0123456789 .-+()@ab_é\n") for _ in range(rnd.randint(0, 300))) for _ in range(400)]
    texts += [" ".join(rnd.choice(["4111 1111 1111 1111", "+44 20 7946 0958", "x@y.z", "8.8.8.8", "255.255.255.256", "word"]) for _ in range(20)) for _ in range(100)]
    assert found(spark, texts)[0] == [brute(t) for t in texts]


def test_table(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.find_pii(docs).collect():
        assert [(s.s, s.k, s.e) for s in r.base] == brute(texts[r.doc_id])


def card(rnd):
    d = "".join(str(rnd.randint(1, 9)) for _ in range(15))
    return d + next(str(x) for x in range(10) if luhn(d + str(x)))


def planted(rnd):
    """Plain personal data for the trees to learn from, and numbers that are none."""
    number = card(rnd)
    phone = f"+1 ({rnd.randint(200, 999)}) {rnd.randint(200, 999)}-{rnd.randint(1000, 9999)}"
    wrong = number[:-1] + str((int(number[-1]) + 1) % 10)
    name, host = rnd.choice(["anna", "b.smith", f"user{rnd.randint(1, 999)}"]), rnd.choice(["post", f"host{rnd.randint(1, 99)}"])
    return (f"write to {name}@{host}.example.com or call {phone} now, paid with "
            f"{number[:4]}-{number[4:8]}-{number[8:12]}-{number[12:]} from {rnd.randint(1, 255)}.{rnd.randint(0, 255)}.{rnd.randint(0, 255)}.7 today; "
            f"order {wrong[:4]} {wrong[4:8]} {wrong[8:12]} {wrong[12:]}, item 1234567, built 9.300.{rnd.randint(300, 900)}.2 here")


def test_disguised_data_are_added_and_other_numbers_are_not(spark):
    rnd = random.Random(8)
    plain = [planted(rnd) for _ in range(400)]
    hidden, want = [], []
    for i in range(24):
        number = card(rnd)
        groups = [number[:4], number[4:8], number[8:12], number[12:]]
        span, kind = [("/".join(groups), 2), (f"user{i} [at] host{i}.example.com", 0), (f"user{i}(at)host{i} [dot] example [dot] com", 0), (f"001 {rnd.randint(200, 999)} {rnd.randint(200, 999)}-{rnd.randint(1000, 9999)}", 3),
                      (f"{rnd.randint(100, 255)}[.]{rnd.randint(100, 255)}[.]{rnd.randint(10, 255)}[.]7", 1), (" - ".join(groups), 2)][i % 6]
        hidden.append(f"please note {span} for me")
        want.append((12, kind, 12 + len(span)))
    clean = []
    for i in range(24):
        number = card(rnd)
        wrong = number[:-1] + str((int(number[-1]) + 3) % 10)
        clean.append([f"batch {'/'.join(wrong[k:k + 4] for k in range(0, 16, 4))} done", f"look at item {i} of the list", f"build 7[.]999[.]{300 + i}[.]1 runs",
                      "a" * 70 + " at the river"][i % 4])
    base, spans = found(spark, [*plain, *hidden, *clean])
    assert base == [brute(t) for t in (*plain, *hidden, *clean)]
    assert all(set(b) <= set(s) for b, s in zip(base, spans))
    caught = sum(w in s for w, s in zip(want, spans[400:424]))
    assert caught >= 20, caught
    assert sum(len(s) for s in spans[424:]) <= 3, [(c, s) for c, s in zip(clean, spans[424:]) if s][:4]
    assert sum(len(s) - len(b) for b, s in zip(base[:400], spans)) <= 15


def test_long_local_part_written_out(spark):
    rnd = random.Random(9)
    base, spans = found(spark, [planted(rnd) for _ in range(200)] + ["x" * 70 + " [at] host.example.com"])
    assert base[200] == [] and (0, 0, 92) in spans[200]


def test_many_matches_in_one_text(spark):
    text = " ".join(f"a{i}@b{i}.com" for i in range(20_000))
    assert found(spark, [text])[0] == [brute(text)]


def test_messy_and_empty(spark, messy, empty):
    assert pii.find_pii(messy).count() == messy.count()
    assert pii.find_pii(empty).collect() == []


@pytest.mark.parametrize("name", ["op2_pii"])
def test_plan_has_no_python(spark, sf_dir, name):
    from tierlens.llm.queries import QUERIES

    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
