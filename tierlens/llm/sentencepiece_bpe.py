"""SentencePiece BPE: encoding by vectorised merge rounds, and decoding.

A text becomes units: a run of spaces with the characters up to the next
space. No piece of the vocabulary crosses a unit's border (checked when the
model is loaded), so units are encoded once each and remembered per task.

Units not seen yet are encoded together: one flat symbol array, cut into
segments by unit. A round looks up the rank of every neighbouring pair, takes
the smallest rank of each segment, merges all its leftmost non-overlapping
occurrences at once, and compacts the arrays; finished segments leave. The
library merges one pair at a time. Both give the same pieces unless a merge
makes a pair that ranks no worse than the pair just merged; such segments (the
space-only pieces all tie) are encoded again pair by pair from a heap, as are
segments so long that rounds over all of them would not pay.

Characters without a piece become their UTF-8 bytes' pieces.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tierlens.llm.tables import keyed

SPACE = "▁"
_UNIT = re.compile(" *[^ ]+| +")
_NONE = np.int32(2**31 - 1)

#: Units remembered per worker before the table starts afresh; bounds memory, not results.
TABLE_UNITS = 300_000
#: Characters encoded together, about.
ROUND_CHARS = 1_000_000
#: Units of more characters are merged one pair at a time.
LONG_UNIT = 5_000


class Model:
    """Vocabulary, merge ranks and byte pieces of a SentencePiece BPE model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, kinds = proto.normalizer_spec, proto.SentencePiece
        if (proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or norm.precompiled_charsmap
                or not norm.add_dummy_prefix or norm.remove_extra_whitespaces):
            raise ValueError("only BPE models with byte fallback, dummy prefix and identity normalisation")
        pieces = list(proto.pieces)
        self.size = len(pieces)
        self.bos, self.eos = proto.trainer_spec.bos_id, proto.trainer_spec.eos_id
        normal = {p.piece: i for i, p in enumerate(pieces) if p.type == kinds.NORMAL}
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in pieces) or any(
                SPACE in x.lstrip(SPACE) or (x[:2] == SPACE * 2 and x.strip(SPACE)) for x in normal):
            raise ValueError("pieces that cross units, user-defined and unused pieces are not supported")
        self.byte_id = np.zeros(256, np.int64)
        self.surface = [b""] * self.size
        self.is_byte = np.zeros(self.size, bool)
        for i, p in enumerate(pieces):
            if p.type == kinds.BYTE:
                self.byte_id[int(p.piece[1:-1], 16)] = i
                self.surface[i], self.is_byte[i] = bytes([int(p.piece[1:-1], 16)]), True
            elif p.type == kinds.NORMAL:
                self.surface[i] = p.piece.replace(SPACE, " ").encode()
            elif p.type == kinds.UNKNOWN:
                self.surface[i] = proto.trainer_spec.unk_surface.encode()
        # the symbol of a character: its piece, or past the vocabulary the character itself
        self.symbol = np.arange(0x110000, dtype=np.int32) + np.int32(self.size)
        for text, i in normal.items():
            if len(text) == 1:
                self.symbol[ord(text)] = i
        order = {s: r for r, s in enumerate(sorted({-pieces[i].score for i in normal.values()}))}
        pairs = {}
        for text, i in normal.items():
            for cut in range(1, len(text)):
                a, b = normal.get(text[:cut]), normal.get(text[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = (order[-pieces[i].score], i)
        self.table = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in sorted(pairs)] + [_NONE], np.int32)
        self.merged = np.array([pairs[k][1] for k in sorted(pairs)] + [0], np.int32)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of each pair in ``ranks`` and ``merged``; the last one if it never merges."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, len(self.keys)).astype(np.int32)


def _merge_rounds(model: Model, sym: np.ndarray, unit: np.ndarray, n: int):
    """Merge until no pair remains. Returns (symbols, their units, units that
    need one merge at a time)."""
    done_sym, done_unit, again = [], [], np.zeros(n, bool)
    last = np.full(n, -1, np.int64)
    end = np.empty(len(sym), bool)
    end[-1:] = True
    end[:-1] = unit[1:] != unit[:-1]
    at = np.full(len(sym), len(model.keys), np.int32)
    at[:-1] = model.pair(sym[:-1], sym[1:])
    at[end] = len(model.keys)
    while len(sym):
        start = np.flatnonzero(np.concatenate(([True], end[:-1])))
        rank = model.ranks[at]
        least = np.minimum.reduceat(rank, start)
        u = unit[start]
        again[u] |= (least <= last[u]) & (least != _NONE)
        last[u] = least
        live = (least != _NONE) & ~again[u]
        size = np.diff(np.append(start, len(sym)))
        if not live.all():
            keep = np.repeat(live, size)
            gone = np.repeat(least == _NONE, size)
            done_sym.append(sym[gone])
            done_unit.append(unit[gone])
            sym, unit, at, end, rank = sym[keep], unit[keep], at[keep], end[keep], rank[keep]
            least, size = least[live], size[live]
            if not len(sym):
                break
            start = np.concatenate(([0], np.cumsum(size)[:-1]))
        hit = rank == np.repeat(least, size)
        # of neighbouring occurrences every other one, from the left
        run = np.concatenate(([0], np.cumsum(~hit)))[:-1]
        where = np.flatnonzero(hit)
        group = run[where]
        head = np.concatenate(([True], group[1:] != group[:-1])) if len(where) else np.empty(0, bool)
        odd = (where - where[np.flatnonzero(head)][np.cumsum(head) - 1]) % 2
        hit[where[odd == 1]] = False
        left = np.flatnonzero(hit)
        sym[left] = model.merged[at[left]]
        end[left] = end[left + 1]
        stay = np.ones(len(sym), bool)
        stay[left + 1] = False
        fresh = hit[stay]
        sym, unit, at, end = sym[stay], unit[stay], at[stay], end[stay]
        look = fresh.copy()
        look[:-1] |= fresh[1:]
        look = np.flatnonzero(look & ~end)
        at[look] = model.pair(sym[look], sym[look + 1])
        at[end] = len(model.keys)
    if done_sym:
        sym, unit = np.concatenate(done_sym), np.concatenate(done_unit)
        order = np.argsort(unit, kind="stable")
        sym, unit = sym[order], unit[order]
    return sym, unit, again


def _merge_singly(model: Model, sym: list[int]) -> list[int]:
    """One segment, one merge at a time: best rank first, of equal ranks the leftmost."""
    before, after = list(range(-1, len(sym) - 1)), [*range(1, len(sym)), -1]
    heap = []

    def offer(left: int) -> None:
        right = after[left] if left >= 0 else -1
        if right >= 0 and (found := model.table.get(sym[left] << 32 | sym[right])):
            heapq.heappush(heap, (found[0], left, right, sym[left], sym[right], found[1]))

    for i in range(len(sym)):
        offer(i)
    while heap:
        _, left, right, a, b, made = heapq.heappop(heap)
        if sym[left] != a or sym[right] != b or after[left] != right:
            continue
        sym[left], sym[right] = made, -1
        after[left] = after[right]
        if after[left] >= 0:
            before[after[left]] = left
        offer(before[left])
        offer(left)
    return [x for x in sym if x >= 0]


def encode_units(model: Model, units: list[str]) -> list[bytes]:
    """Ids (little-endian unsigned 32 bit) of each non-empty unit."""
    chars = np.frombuffer("".join(units).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(u) for u in units])
    unit = np.repeat(np.arange(len(units)), sizes)
    sym = model.symbol[chars]
    short = sizes[unit] <= LONG_UNIT
    out, unit_out, again = _merge_rounds(model, sym[short], unit[short], len(units))
    again |= sizes > LONG_UNIT
    if again.any():
        at = np.concatenate(([0], np.cumsum(sizes)))
        redo = [_merge_singly(model, sym[at[i]:at[i + 1]].tolist()) for i in np.flatnonzero(again)]
        out = np.concatenate([out, *[np.array(r, out.dtype) for r in redo]])
        unit_out = np.concatenate([unit_out, np.repeat(np.flatnonzero(again), [len(r) for r in redo])])
        order = np.argsort(unit_out, kind="stable")
        out, unit_out = out[order], unit_out[order]
    strange = np.flatnonzero(out >= model.size)
    if len(strange):
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in (out[strange] - model.size)]
        times = np.ones(len(out), np.int64)
        times[strange] = [len(r) for r in raw]
        unit_out = np.repeat(unit_out, times)
        wide = np.repeat(out.astype(np.int64), times)
        wide[wide >= model.size] = model.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        out = wide
    flat = out.astype("<u4")
    at = np.searchsorted(unit_out, np.arange(len(units) + 1))
    return [flat[at[i]:at[i + 1]].tobytes() for i in range(len(units))]


def _units(text: str) -> list[str]:
    """Units of a text after the dummy prefix; the space symbol itself counts as a space."""
    return _UNIT.findall(" " + text.replace(SPACE, " ")) if text else []


class Encoder:
    """Texts to ids, with a bounded table of units."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def _learn(self, new: list[str]) -> None:
        part, size = [], 0
        for u in new:
            part.append(u)
            size += len(u)
            if size >= ROUND_CHARS:
                self.known.update(zip(part, encode_units(self.model, part)))
                part, size = [], 0
        if part:
            self.known.update(zip(part, encode_units(self.model, part)))

    def encode(self, text: str) -> bytes:
        """Ids with begin and end id; an empty text has only these."""
        units = _units(text)
        new = {u for u in units if u not in self.known}
        if new:
            if len(self.known) + len(new) > TABLE_UNITS:
                self.known.clear()
                new = set(units)
            self._learn(list(new))
        ids = b"".join(map(self.known.__getitem__, units))
        return np.uint32(self.model.bos).tobytes() + ids + np.uint32(self.model.eos).tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """As :meth:`encode`; the unseen units of all texts go through the rounds together."""
        new = set()
        for t in texts:
            new.update(u for u in _units(t) if u not in self.known)
            if len(new) >= TABLE_UNITS // 2:
                break
        if len(self.known) + len(new) > TABLE_UNITS:
            self.known.clear()
        self._learn(list(new))
        return [self.encode(t) for t in texts]


def _bytes_text(raw: bytes) -> bytes:
    """A run of byte pieces: valid UTF-8 stays, every other byte becomes U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                raw[i:i + n].decode()
                out.append(raw[i:i + n])
                break
            except UnicodeDecodeError:
                pass
        else:
            n = 1
            out.append("�".encode())
        i += n
    return b"".join(out)


def decode(model: Model, ids: bytes) -> str:
    """Text of ids: pieces joined, the first space dropped, byte pieces read as UTF-8."""
    numbers = np.frombuffer(ids, "<u4")
    surface = model.surface
    raw = b"".join([surface[i] for i in numbers.tolist()])
    first = numbers[(numbers != model.bos) & (numbers != model.eos)][:1]
    if len(first) and surface[first[0]][:1] == b" " and not model.is_byte[first[0]]:
        raw = raw[1:]
    try:
        return raw.decode()
    except UnicodeDecodeError:
        parts, run = [], []
        for i in numbers.tolist():
            if model.is_byte[i]:
                run.append(surface[i])
                continue
            if run:
                parts.append(_bytes_text(b"".join(run)))
                run = []
            parts.append(surface[i])
        parts.append(_bytes_text(b"".join(run)))
        text = b"".join(parts).decode(errors="replace")
        return text[1:] if len(first) and surface[first[0]][:1] == b" " and not model.is_byte[first[0]] else text


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a model file, made once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(Model(path))
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_tokens, ids`` (binary, little-endian
    unsigned 32 bit, with begin and end id) and ``decoded``, the text of the ids.

    ``model_path`` is a file that every worker can open. A null text counts as
    empty (begin and end id only). No shuffle: rows stay in their partition,
    equal rows give equal results, extra columns are ignored, an empty table
    gives an empty result.
    """
    def run(parts):
        enc = encoder(model_path)
        for pdf in parts:
            for a in range(0, len(pdf), 500):
                rows = pdf.iloc[a:a + 500]
                ids = enc.encode_many([t or "" for t in rows.text])
                yield pd.DataFrame({"doc_id": rows.doc_id.values, "n_tokens": [len(x) // 4 for x in ids], "ids": ids,
                                    "decoded": [decode(enc.model, x) for x in ids]})

    return keyed(docs).mapInPandas(run, "doc_id long, n_tokens long, ids binary, decoded string")
