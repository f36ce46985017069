import hashlib
import re
from collections import Counter

import public_tokenizers
import sentencepiece

import corpus_pipeline as cp
from tierlens.llm import mixing, near_dedup, toxicity
from tierlens.llm.tables import read
from tests.llm.test_dedup import brute_exact, brute_near


def test_stages_one_after_another(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").cache()
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    stage = dict(cp.STAGES)
    a = stage["toxicity"](spark, docs, sf_dir)
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in a.collect()}
    assert a.columns == docs.columns and kept == {i for i, t in rows.items() if model.score(t.encode()) < toxicity.THRESHOLD}
    b = stage["exact_dedup"](spark, a, sf_dir)
    kept_b = {r[0] for r in brute_exact([(i, rows[i]) for i in kept]) if r[3]}
    assert {r.doc_id for r in b.collect()} == kept_b
    c = stage["near_dedup"](spark, b, sf_dir)
    kept_c = {r[0] for r in brute_near([(i, rows[i]) for i in kept_b], 5, 80) if r[3]}
    assert {r.doc_id for r in c.collect()} == kept_c
    d = stage["mixing"](spark, c, sf_dir)
    chosen = {r.doc_id for r in mixing.mix_sources(mixing.with_domain(c), mixing.table_weights(), cp.MIX_SHARE, 1, cp.MIX_SEED).collect()}
    assert {r.doc_id for r in d.collect()} == chosen and d.columns == docs.columns
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in stage["sentencepiece"](spark, d, sf_dir).collect():
        assert bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in library.encode(rows[r.doc_id], add_bos=True, add_eos=True))
    assert {r.doc_id for r in cp.run(spark, sf_dir).collect()} == chosen


def test_stages_take_odd_rows(spark, sf_dir, messy, empty):
    docs = messy.select(*cp.COLUMNS)
    for name, stage in cp.STAGES[:4]:
        assert stage(spark, docs, sf_dir).columns == list(cp.COLUMNS)
        assert stage(spark, empty, sf_dir).collect() == []
    assert near_dedup.BANDS * near_dedup.ROWS > 100


def test_encoding_stage_of_odd_rows(spark, sf_dir, messy, messy_rows, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def expected(doc_id, text):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        return doc_id, len(ids), b"".join(i.to_bytes(4, "little") for i in ids), hashlib.sha256(library.decode(ids).encode()).hexdigest()

    got = [(r.doc_id, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in cp.encode(spark, messy, sf_dir).collect()]
    assert Counter(got) == Counter(expected(r[0], r[1]) for r in messy_rows)
    assert cp.encode(spark, empty, sf_dir).collect() == []


def test_dedup_stages_of_odd_rows(spark, sf_dir, messy, messy_rows):
    """Rows whose id stays go on, null ids among them."""
    def last(i):
        return float("inf") if i is None else i

    texts = {}
    for i, text, *_ in sorted(messy_rows, key=lambda r: last(r[0])):
        key = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        if key not in texts or len(text or "") > texts[key][0]:
            texts[key] = (len(text or ""), i)
    stay = {i for _, i in texts.values()}
    got = cp.drop_copies(spark, messy, sf_dir)
    assert Counter(r.doc_id for r in got.collect()) == Counter(r[0] for r in messy_rows if r[0] in stay)
    near = {r.doc_id for r in cp.drop_near_copies(spark, got, sf_dir).collect()}
    assert {8, 9, 12, 14, 19, None} <= near and 6 not in near and 18 not in near
