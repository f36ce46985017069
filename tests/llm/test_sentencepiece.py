import random

import public_tokenizers
import pytest
import sentencepiece

from tierlens.llm import sentencepiece_bpe as sp
from tierlens.llm.tables import read

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(library, texts):
    enc = sp.Encoder(sp.Model(PATH))
    for t, raw in zip(texts, enc.encode_many(texts)):
        ids = [int.from_bytes(raw[i:i + 4], "little") for i in range(0, len(raw), 4)]
        want = library.encode(t, add_bos=True, add_eos=True)
        assert ids == want, t
        assert sp.decode(enc.model, raw) == library.decode(want), t


def test_edge_cases(library):
    same(library, ["", " ", "  ", "a", " a", "a ", "   a   b  ", "aaaaaaaaaaa", "▁", "▁▁a ▁", "<s>", "</s> <unk> <0x0A>", "\n\n\t x",
                   "日本語のテキスト", "🤦🏼‍♂️ é", "\x00\x01", "a" * 3000, " " * 100, "=" * 77 + " " * 37 + "x" * 9, "x▁y", "1234567 89"])


def test_random_texts(library):
    rnd = random.Random(9)
    alphabet = "abcdefghi  \n.,;ÀéßñΩж日本🤦1234=-_#▁"
    same(library, ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 200))) for _ in range(1500)])


def test_table(spark, sf_dir, library):
    docs = read(spark, sf_dir, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in sp.encode_documents(docs, PATH).collect():
        want = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(want)
        assert bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in want)
        assert r.decoded == library.decode(want)


def test_messy_and_empty(spark, messy, messy_rows, empty, library):
    got = sorted((str(r.doc_id), r.n_tokens, r.decoded) for r in sp.encode_documents(messy, PATH).collect())
    want = sorted((str(2**63 - 1 if i is None else i), len(library.encode(t or "", add_bos=True, add_eos=True)), t or "")
                  for i, t, *_ in messy_rows)
    assert got == want
    assert sp.encode_documents(empty, PATH).collect() == []


def test_small_unit_table_gives_the_same(library, monkeypatch):
    monkeypatch.setattr(sp, "TABLE_UNITS", 20)
    monkeypatch.setattr(sp, "ROUND_CHARS", 30)
    same(library, ["one two three four five six seven eight nine ten " * 3, "eleven twelve  thirteen", "x" * 40])


def test_invalid_byte_pieces_decode_like_the_library(library):
    m = sp.Model(PATH)
    for ids in ([3 + 0xE3, 3 + 0x81], [3 + 0xFF, 300, 3 + 0xC3, 3 + 0xA9], [1, 3 + 0x80, 2]):
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert sp.decode(m, raw) == library.decode(ids)
