"""Quality rules by compression bands.

**Method.** The whole text (UTF-8) and each of its fixed chunks of ``CHUNK``
bytes are compressed with zstandard; the ratio is compressed bytes by raw bytes.
A short text compresses worse than a long one of the same language, so every
length class has limits of its own: a ratio below the lower one means that the
text repeats itself, a ratio above the upper one that it is no language (keys,
encoded data, noise). A document is rejected if its whole ratio is outside the
limits of its length, or if chunks that are outside theirs hold more than
``OUTSIDE_SHARE`` of its bytes, which catches a text that is half junk though
its whole ratio looks ordinary.

**Base rules.** Two rules come first and reject on their own: fewer than
``LEAST_WORDS`` words, or more than half of the words in repeated 3-word windows.

Everything happens in one pass without a shuffle; a text is held by one task
while it is measured, nothing is collected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlens.llm.tables import keyed, shown
from tierlens.llm.words import utf8

LEAST_WORDS, REPEAT_PERCENT = 50, 50
LEVEL, CHUNK = 3, 2048
#: (bytes up to, lowest ratio, highest ratio). The lower limits are about three quarters of what prose of an
#: alphabetic language reaches at that length, the upper ones lie between prose and random printable
#: characters (0.75 and more whatever the length).
BANDS = (
    (64, 0.30, 2.00), (128, 0.35, 1.30), (256, 0.40, 0.98), (512, 0.42, 0.88), (1024, 0.42, 0.78), (2048, 0.38, 0.70),
    (4096, 0.36, 0.66), (8192, 0.34, 0.64), (16384, 0.32, 0.62), (65536, 0.30, 0.60), (2**63, 0.25, 0.60))
OUTSIDE_SHARE = 0.5

_SYMBOLS = b"#*$%&|<>"
_BLANK = b"\t\n\v\f\r "
_CONTINUED = bytes(range(0x80, 0xC0))
_ENDS = np.array([b[0] for b in BANDS[:-1]], np.int64)
_LOW, _HIGH = (np.array([b[i] for b in BANDS]) for i in (1, 2))

RESULT = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "kept boolean, n_bytes long, ratio double, n_chunks int, outside_share double")


def outside(sizes: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Which ratios lie outside the band of their raw size?"""
    band = np.searchsorted(_ENDS, sizes)
    return (ratios < _LOW[band]) | (ratios > _HIGH[band])


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows whose words occur as a window twice or more, the
    first occurrence included. Words are numbered, windows compared exactly."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, window, count = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = count[window] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= again
    return int(covered.sum())


def duplicate_lines(raw: bytes) -> int:
    """Lines that hold a word and equal an earlier line of the text."""
    lines = [x for x in raw.split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def measure(raw: bytes, pack: zstandard.ZstdCompressor) -> tuple:
    """Everything about one text, in the order of :data:`RESULT` after the id."""
    words = raw.split()
    n = len(words)
    chars = len(raw.translate(None, _CONTINUED + _BLANK))
    repeats = repeated_words(words)
    failed = n < LEAST_WORDS or 100 * repeats > REPEAT_PERCENT * n
    size = len(raw)
    whole = len(pack.compress(raw)) / size if size else 0.0
    if size <= CHUNK:
        sizes, ratios = np.array([size], np.int64), np.array([whole])
    else:
        chunks = [raw[i:i + CHUNK] for i in range(0, size, CHUNK)]
        sizes = np.array([len(c) for c in chunks], np.int64)
        ratios = np.array([len(pack.compress(c)) for c in chunks]) / sizes
    share = float(sizes[outside(sizes, ratios)].sum() / size) if size else 0.0
    odd = bool(outside(np.array([size]), np.array([whole]))[0]) or share > OUTSIDE_SHARE
    return (n, chars, len(raw) - len(raw.translate(None, _SYMBOLS)), duplicate_lines(raw), repeats, failed,
            not failed and not odd, size, whole, len(sizes) if size else 0, share)


def _measured(parts):
    pack = zstandard.ZstdCompressor(level=LEVEL)
    names = [c.split()[0] for c in RESULT.split(", ")]
    for pdf in parts:
        rows = [measure(utf8(t), pack) for t in pdf.text]
        out = pd.DataFrame(rows, columns=names[1:])
        out.insert(0, "doc_id", pdf.doc_id.to_numpy())
        yield out


def compression_rules(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` the columns of :data:`RESULT`: counts, the base
    verdict ``base_failed``, ``kept`` (false where the base rules or the
    compression bands reject), and what the bands saw (``n_bytes``, ``ratio``
    of the whole text, ``n_chunks``, ``outside_share``).

    A null or empty text has no words, fails the base rules and is not kept. A
    null ``doc_id`` stays null. Equal rows give equal rows; extra columns are
    ignored; an empty table gives an empty result. Very long texts are measured
    whole, chunk by chunk.
    """
    rows = keyed(docs).mapInPandas(_measured, RESULT)
    return rows.select(shown(), *[F.col(c) for c in rows.columns[1:]])
