import random
import re
from collections import Counter

import zstandard

from tierlens.llm import compression_rules as cr
from tierlens.llm.tables import read

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def base_of(text):
    """The base counts as the rules word them, character by character."""
    text = text or ""
    words = SPACE.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    marked = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked), n < 50 or 100 * len(marked) > 50 * n


def verdict(text):
    """The bands, written out."""
    raw = (text or "").encode()
    if base_of(text)[-1]:
        return False

    def odd(part):
        low, high = next((lo, hi) for end, lo, hi in cr.BANDS if len(part) <= end)
        return not low <= len(zstandard.compress(part, 3)) / len(part) <= high

    chunks = [raw[i:i + 2048] for i in range(0, len(raw), 2048)]
    return not odd(raw) and 2 * sum(len(c) for c in chunks if odd(c)) <= len(raw)


def compare(df):
    texts = sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)
    got = sorted(((r.doc_id, *[r[c] for c in BASE], r.kept) for r in cr.compression_rules(df).collect()), key=str)
    assert got == sorted(((i, *base_of(t), verdict(t)) for i, t in texts), key=str)
    return got


def test_table(spark, sf_dir):
    got = compare(read(spark, sf_dir, "documents"))
    assert 0.5 < sum(r[-1] for r in got) / len(got) < 1


def test_messy_and_empty(spark, messy, empty):
    compare(messy)
    assert cr.compression_rules(empty).collect() == []
    assert cr.compression_rules(empty).columns == [c.split()[0] for c in cr.RESULT.split(", ")]


def test_bands_reject_repetition_noise_and_half_junk(spark, sf_dir):
    rnd = random.Random(5)
    words = sorted({w for r in read(spark, sf_dir, "documents").limit(50).collect() for w in (r.text or "").split()})
    prose = " ".join(rnd.choice(words) for _ in range(900))
    noise = " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(40)) for _ in range(150))
    # every sentence differs in one number: no 3-word window repeats often enough, the text compresses to a fraction
    template = " ".join(f"order{i} shipped{i} from{i}" for i in range(1000, 1400))
    texts = {"prose": prose, "noise": noise, "template": template, "half": prose[:6000] + " " + noise + noise[::-1], "short": "too few words"}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts.values())], "doc_id long, text string")
    rows = dict(zip(texts, sorted(cr.compression_rules(df).collect(), key=lambda r: r.doc_id)))
    assert {k: r.base_failed for k, r in rows.items()} == {"prose": False, "noise": False, "template": False, "half": False, "short": True}
    assert {k: r.kept for k, r in rows.items()} == {"prose": True, "noise": False, "template": False, "half": False, "short": False}


def test_long_text_is_measured_whole(spark):
    text = " ".join(f"q{i * 7919 % 100_003}" for i in range(200_000))
    row = cr.compression_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_words, row.word_chars, row.n_bytes) == (200_000, len(text.replace(" ", "")), len(text))
    assert row.n_chunks == -(-len(text) // cr.CHUNK)
