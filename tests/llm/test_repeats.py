import numpy as np
import pytest

from tierlens.llm import names as nm
from tierlens.llm.substring_dedup import recompress, substring_dedup
from tierlens.llm.suffix_dedup import COVER, PERIOD, suffix_dedup
from tierlens.llm.tables import read

LAST = 2**63


def brute(rows, units, join, window=50):
    """Every window of every document against the smallest id that starts it."""
    first = {}
    docs = [(LAST if i is None else i, units((t or "").encode())) for i, t in rows]
    for i, u in docs:
        for p in range(len(u) - window + 1):
            k = tuple(u[p:p + window])
            first[k] = min(i, first.get(k, LAST))
    out = []
    for i, u in docs:
        gone = bytearray(len(u))
        for p in range(len(u) - window + 1):
            if first[tuple(u[p:p + window])] < i:
                gone[p:p + window] = b"\1" * window
        out.append((None if i == LAST else i, len(u), sum(gone), join(x for x, g in zip(u, gone) if not g)))
    return sorted(out, key=str)


WORDS = (substring_dedup, lambda b: b.split(), b" ".join)
BYTES = (suffix_dedup, lambda b: b, bytes)


def result(df):
    return sorted(((r.doc_id, r.n_units, r.n_removed, bytes(r.kept)) for r in df.select(
        "doc_id", "n_units", "n_removed", "kept").collect()), key=str)


def as_shown(rows):
    return [(None if r[0] == 2**63 - 1 else r[0], *r[1:]) for r in rows]


@pytest.mark.parametrize("op,units,join", [WORDS, BYTES])
def test_messy_against_brute_force(messy, messy_rows, op, units, join):
    got = sorted(as_shown(result(op(messy))), key=str)
    assert got == brute([r[:2] for r in messy_rows], units, join)


@pytest.mark.parametrize("op,units,join", [WORDS, BYTES])
def test_small_blocks_and_buckets(messy, messy_rows, monkeypatch, op, units, join):
    from tierlens.llm import repeats

    monkeypatch.setattr(repeats, "BLOCK_BYTES", 5_000)
    monkeypatch.setattr(nm, "BUCKET_NAMES", 1_000)
    got = sorted(as_shown(result(op(messy))), key=str)
    assert got == brute([r[:2] for r in messy_rows], units, join)


@pytest.mark.parametrize("op,units,join", [WORDS, BYTES])
def test_several_blocks_to_a_range(messy, messy_rows, monkeypatch, op, units, join):
    from tierlens.llm import repeats

    monkeypatch.setattr(repeats, "BLOCK_BYTES", 5_000)
    monkeypatch.setattr(repeats, "MOST_RANGES", 3)
    got = sorted(as_shown(result(op(messy))), key=str)
    assert got == brute([r[:2] for r in messy_rows], units, join)


@pytest.mark.parametrize("low", [0, 2, 52])
@pytest.mark.parametrize("op,units,join", [WORDS, BYTES])
def test_any_width_of_names(messy, messy_rows, monkeypatch, op, units, join, low):
    """Full names, too few spare bits for the texts of a block, names that mostly meet by chance."""
    from tierlens.llm import repeats

    monkeypatch.setattr(repeats, "free_bits", lambda names: low)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 20_000)
    got = sorted(as_shown(result(op(messy))), key=str)
    assert got == brute([r[:2] for r in messy_rows], units, join)


def test_names_widen_with_their_number():
    from tierlens.llm.repeats import free_bits

    assert [free_bits(n) for n in (0, 2**20, 2**28, 2**29, 2**45, 2**60)] == [24, 24, 24, 23, 7, 0]


@pytest.mark.parametrize("op,units,join", [WORDS, BYTES])
def test_table_against_brute_force(spark, sf_dir, op, units, join):
    docs = read(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(op(docs)) == brute(rows, units, join)


@pytest.mark.parametrize("op", [substring_dedup, suffix_dedup])
def test_empty_table(empty, op):
    assert op(empty).collect() == []


def test_spans_are_the_removed_runs(messy):
    for r in substring_dedup(messy).collect():
        assert sum(s["end"] - s["start"] for s in r.spans) == r.n_removed


def test_symbols_are_the_same_wherever_their_extent_repeats():
    rng = np.random.default_rng(5)
    shared = rng.integers(0, 4, 60).astype(np.uint64)
    a = np.concatenate([rng.integers(0, 4, 13).astype(np.uint64), shared, rng.integers(0, 4, 9).astype(np.uint64)])
    b = np.concatenate([rng.integers(0, 4, 7).astype(np.uint64), shared, rng.integers(0, 4, 21).astype(np.uint64)])
    found = []
    for x, at in ((a, 13), (b, 7)):
        sym, _, lo, hi = recompress(x, np.zeros(len(x), np.int64))
        found.append({(s, i - at, j - at) for s, i, j in zip(sym.tolist(), lo.tolist(), hi.tolist()) if i >= at and j < at + 60})
    assert found[0] == found[1] and len(found[0]) > 5


def test_difference_cover_meets_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_packed_names_round_trip():
    rng = np.random.default_rng(2)
    names = np.unique(rng.integers(0, 2**64, 10_000, dtype=np.uint64))
    assert (nm.unpack(nm.pack(names)) == names).all()
    assert len(nm.unpack(nm.pack(names[:0]))) == 0
