"""Toxicity by compression distance.

Two zstandard dictionaries share a background trained on common text: the toxic
one adds the words most typical of toxic text, the ordinary one more ordinary
text (README: a dictionary trained on toxic windows separates worse). A window that compresses shorter with the toxic dictionary than with the
ordinary one speaks for toxicity; the difference, per window of about
``WINDOW`` bytes, is the only thing a score is made of. A document's score is
a logistic curve over the mean difference and the shares of windows beyond
thresholds, over all windows of its whole text; the curve is calibrated to the
share of toxic documents among the labels.

Fitting takes a bounded sample of labelled rows (``SAMPLE_ROWS`` per class).
Two thirds make the dictionaries, the other third calibrates the curve, so the
calibration never sees text its dictionaries were made of. Both dictionaries
start with the same background, trained on ordinary windows, so that plain
text compresses alike with either. Most of a toxic document is ordinary text
too, so the toxic dictionary goes on with what is typical of toxic text: the
words whose numbers of documents tell the classes apart best (likelihood ratio
of at least ``RATIO``). The ordinary one goes on with more ordinary text, as long.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlens.llm.tables import keyed, shown
from tierlens.llm.words import utf8

#: Bytes of a window, about: it ends at the next white space.
WINDOW = 32
#: Labelled rows of each class used for fitting, at most, and their text in bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 8_000_000
#: A class with so many labelled rows must keep as many in the sample and give a curve, or fitting fails.
ENOUGH_ROWS = 12
#: Most words of the toxic part, their least likelihood ratio, and bytes of the common background.
TELLING, RATIO, BACKGROUND_BYTES = 64, 30.0, 4096
LEVEL = 8
#: Bytes saved from which on a window counts, per feature.
CUTS = (2, 3, 5)
THRESHOLD = 0.3


def windows(raw: bytes) -> list[bytes]:
    """The whole text in windows of at least ``WINDOW`` bytes (the last may be
    shorter), cut at white space, lower-cased in ASCII."""
    out, part, size = [], [], 0
    for word in raw.lower().split():
        part.append(word)
        size += len(word) + 1
        if size >= WINDOW:
            out.append(b" ".join(part))
            part, size = [], 0
    if part:
        out.append(b" ".join(part))
    return out


class Distance:
    """Difference of the compressed lengths of a window under two dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.parts = toxic, ordinary
        self._made = None

    def __reduce__(self):
        return Distance, self.parts

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        if self._made is None:
            self._made = []
            for raw in self.parts:
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                self._made.append(zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        toxic, ordinary = self._made
        return np.array([len(ordinary(t)) - len(toxic(t)) for t in texts], np.float64)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """Trained on the samples; where they are too few, their own end."""
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:] or b" " * 8


def _telling(docs: list[set[bytes]], toxic: np.ndarray) -> list[bytes]:
    """The words most typical of toxic documents, best last (the nearest are the cheapest to refer to)."""
    counts = [Counter(w for d, t in zip(docs, toxic) if t == k for w in d) for k in (0, 1)]
    n = [max(int((toxic == k).sum()), 1) for k in (0, 1)]

    def ratio(word: bytes) -> float:
        have = [counts[k][word] for k in (0, 1)]
        due = [sum(have) * n[k] / sum(n) for k in (0, 1)]
        return 2 * sum(h * math.log(h / e) for h, e in zip(have, due) if h)

    typical = sorted((ratio(w), w) for w in counts[1] if counts[1][w] / n[1] > counts[0][w] / n[0])
    return [w for _, w in [x for x in typical if x[0] >= RATIO][-TELLING:] or typical[-8:]]


def _train(texts: list[bytes], toxic: np.ndarray) -> Distance:
    words = b" " + b" ".join(_telling([set(t.lower().split()) for t in texts], toxic)) + b" "
    plain = [w for t, k in zip(texts, toxic) if not k for w in windows(t)]
    background = _dictionary(plain[::2], BACKGROUND_BYTES)
    return Distance(background + words, background + _dictionary(plain[1::2], max(512, len(words)))[-len(words):])


def _features(diff: np.ndarray) -> list[float]:
    if not len(diff):
        return [0.0] * (len(CUTS) + 2)
    return [float(diff.mean()), float(np.log1p(len(diff))), *[float((diff >= c).mean()) for c in CUTS]]


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    ridge = np.eye(len(beta)) * penalty * len(x)
    ridge[0, 0] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


class Classifier:
    """Fitted dictionaries and curve; travels to the tasks. ``rate`` is the
    share of toxic documents to calibrate to."""

    def __init__(self, texts: list[bytes], toxic: list[int], rate: float):
        y = np.array(toxic, int)
        own = np.arange(len(y)) % 3 != 2
        self.prior, self.beta = rate, None
        if min([int((y[h] == k).sum()) for h in (own, ~own) for k in (0, 1)]) < 2:
            return
        self.distance = _train([t for t, o in zip(texts, own) if o], y[own])
        x = np.array([_features(self.distance(windows(t))) for t, o in zip(texts, own) if not o])
        y = y[~own]
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        self.beta = _curve((x - self.mean) / self.scale, y, np.where(y == 1, rate / y.mean(), (1 - rate) / (1 - y.mean())))

    def score(self, raw: bytes) -> float:
        """0 to 1, higher for toxic; an empty text has no window and scores 0."""
        parts = windows(raw)
        if not parts:
            return 0.0
        if self.beta is None:
            return self.prior
        x = (np.array(_features(self.distance(parts))) - self.mean) / self.scale
        return float(1 / (1 + np.exp(-np.clip(self.beta[0] + x @ self.beta[1:], -30, 30))))


def held_out(col: str = "doc_id"):
    """Rows that are never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Learn from labelled rows outside the held-out part: per class the
    ``SAMPLE_ROWS`` rows with the smallest hash of their id, up to
    ``SAMPLE_BYTES`` of text; a row that no longer fits is skipped, and the next
    smaller ones are taken. Raises ValueError if that leaves fewer than
    ``ENOUGH_ROWS`` of a class that has as many, or no curve although rows were
    skipped or both classes have as many. Null labels and ids are not learnt
    from."""
    marked = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter(
        "id is not null and toxic in (0, 1)").filter(~held_out("id"))
    marked = marked.distinct()
    share = marked.agg(F.avg("toxic")).first()[0]
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    rows, seen, kept = [], [], []
    for kind in (0, 1):
        chosen = marked.filter(F.col("toxic") == kind).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
        found = keyed(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select(
            "id", size.alias("size"), F.when(size <= SAMPLE_BYTES, F.col("text")).alias("text"))  # no larger text reaches the driver
        room, n, before = SAMPLE_BYTES, 0, len(rows)
        for r in found.orderBy(F.xxhash64("id"), "id", "text").limit(SAMPLE_ROWS).toLocalIterator():
            n += 1
            if r.size <= room:
                room -= r.size
                rows.append((xxhash.xxh3_64_intdigest(str(r.id)), utf8(r.text), kind))
        seen.append(n)
        kept.append(len(rows) - before)
    rows.sort()
    model = Classifier([r[1] for r in rows], [r[2] for r in rows], share or 0.0)
    thin = any(n >= ENOUGH_ROWS > k for n, k in zip(seen, kept))
    if thin or model.beta is None and (seen != kept or min(seen) >= ENOUGH_ROWS):
        raise ValueError(f"toxicity: no classifier from {kept} of {seen} labelled rows (ordinary, toxic) within {SAMPLE_BYTES} bytes a class")
    return model


def score_documents(docs: DataFrame, model: Classifier) -> DataFrame:
    """Per row: ``doc_id, held_out, score, predicted``. A null text counts as
    empty and scores 0; a null id is not held out; equal texts score alike;
    extra columns are ignored; an empty table gives an empty result."""
    def run(parts):
        for pdf in parts:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "score": [model.score(utf8(t)) for t in pdf.text]})

    scored = keyed(docs).mapInPandas(run, "doc_id long, score double").select(shown(), "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Classifier) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns unchanged; no shuffle."""
    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series([model.score(utf8(t)) for t in text], dtype="float64")

    return docs.filter(score(F.col("text")) < THRESHOLD)
