import math
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tierlens.llm import toxicity as tx
from tierlens.llm.tables import read


def test_windows_cover_the_whole_text():
    raw = b"Some  words\tand\nmore " * 50
    assert b" ".join(tx.windows(raw)) == b" ".join(raw.lower().split())
    assert tx.windows(b"") == tx.windows(b" \n") == []


def test_score_matches_a_plain_reckoning():
    """Lengths from a fresh compressor per window, features and curve one number at a time."""
    texts = [(f"you are a vile idiot number {i} " if i % 2 else f"the garden of house {i} is quiet ").encode() * (1 + i % 5) for i in range(90)]
    model = tx.Classifier(texts, [i % 2 for i in range(90)], 0.2)
    assert model.beta is not None and model.distance.parts[0] != model.distance.parts[1]

    def length(window, raw):
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=tx.LEVEL)
        made = zstandard.ZstdCompressor(level=tx.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        packed = made.compress(window)
        assert zstandard.ZstdDecompressor(dict_data=d).decompress(packed, max_output_size=len(window)) == window
        return len(packed)

    for text in [b"You are a VILE person", b"a quiet garden " * 40, texts[1], texts[2], b"x", b"vile " * 300 + b"garden " * 300, b"\xff\xfe odd bytes"]:
        toxic, ordinary = model.distance.parts
        saved = [length(w, ordinary) - length(w, toxic) for w in tx.windows(text)]
        feats = [sum(saved) / len(saved), math.log1p(len(saved)), *[sum(s >= c for s in saved) / len(saved) for c in tx.CUTS]]
        z = model.beta[0] + sum(b * (f - m) / s for b, f, m, s in zip(model.beta[1:], feats, model.mean, model.scale))
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), abs=1e-12)
    assert model.score(b"") == model.score(b" \n") == 0.0


def test_calibrated_to_the_rate():
    """The curve's mean over the calibration rows, weighted to the rate, is the rate."""
    texts = [(f"vile idiot {i} " if i % 3 == 0 else f"quiet garden {i} ").encode() * (1 + i % 7) for i in range(120)]
    y = [int(i % 3 == 0 or i % 10 == 1) for i in range(120)]
    for rate in (0.05, 0.4):
        model = tx.Classifier(texts, y, rate)
        rest = [(model.score(t), k) for i, (t, k) in enumerate(zip(texts, y)) if i % 3 == 2]
        share = sum(k for _, k in rest) / len(rest)
        mean = sum(s * (rate / share if k else (1 - rate) / (1 - share)) for s, k in rest) / len(rest)
        assert mean == pytest.approx(rate, abs=1e-3)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = read(spark, sf, "documents")
    labels = read(spark, sf, "labels")
    rows = {r.doc_id: r for r in tx.score_documents(docs, tx.fit(docs, labels)).collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    pairs = [(rows[r.doc_id].score, r.toxic) for r in labels.collect() if rows[r.doc_id].held_out]
    bad = np.array([s for s, t in pairs if t == 1])
    good = np.array([s for s, t in pairs if t == 0])
    auc = np.mean(bad[:, None] > good[None, :]) + 0.5 * np.mean(bad[:, None] == good[None, :])
    assert auc > 0.85 and np.mean(good >= tx.THRESHOLD) < 0.05 and np.mean(bad >= tx.THRESHOLD) > 0.6


def test_messy_and_empty(spark, sf_dir, messy, empty):
    model = tx.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    got = tx.score_documents(messy, model).collect()
    assert len(got) == messy.count()
    assert all(r.score == 0 for r in got if r.doc_id in (3, 4, 5))
    assert tx.score_documents(empty, model).collect() == []
    assert tx.without_toxic(messy, model).columns == messy.columns


def test_long_labelled_texts_are_skipped_not_the_rows_after_them(spark, monkeypatch):
    def text(i):
        return f"you are a vile idiot number {i} " * 8 if i % 2 else f"the garden of house {i} is quiet " * 8

    docs = spark.createDataFrame([(i, text(i)) for i in range(120)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id bigint, toxic int")
    first = labels.filter("toxic = 1").filter(~tx.held_out()).orderBy(F.xxhash64("doc_id")).first().doc_id
    long_ = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat("text", F.lit(100))).otherwise(F.col("text")))
    monkeypatch.setattr(tx, "SAMPLE_BYTES", 20_000)
    model = tx.fit(long_, labels)
    assert model.beta is not None and model.score(text(1).encode()) > tx.THRESHOLD > model.score(text(2).encode())
    monkeypatch.setattr(tx, "SAMPLE_BYTES", 100)
    with pytest.raises(ValueError, match="toxicity"):
        tx.fit(long_, labels)


def test_no_labels_scores_the_prior(spark, messy):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = tx.fit(messy, labels)
    assert {r.score for r in tx.score_documents(messy, model).collect()} == {0.0}
