"""Exact equality with the sentencepiece library."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rfmlens.llm import pieces as P

spm = pytest.importorskip("sentencepiece")
MODEL = P.model_bytes()
SP = spm.SentencePieceProcessor(model_proto=MODEL)
CODER = P.Coder(MODEL)
EDGE = ["", None, " ", "  ", "\n", " a", "a ", "x" * 2000, "ab" * 1500, "the of " * 1000, "thequickbrownfox" * 200,
        "日本語テキスト" * 300, "▁▁a", "\x01 b", "<s></s><unk><0x0A>", "a\r\n;\r\n\tb", "\x00", "𝄞𝄞"]


def check(texts):
    for t, (n, ids_sha, text_sha, ids, text) in zip(texts, CODER.code(texts), strict=True):
        want = [1, *SP.encode(t or ""), 2]
        got = np.frombuffer(ids, "<u4").tolist()
        assert got == want and n == len(want)
        assert text.decode() == SP.decode(want) == CODER.p.decode(want)
        assert ids_sha == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert text_sha == hashlib.sha256(SP.decode(want).encode()).hexdigest()


def test_edges():
    check(EDGE)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aebtho in\n\t\r ▁éß中字𝄞\x01<>/s;)({}.,", max_size=80), min_size=1, max_size=4))
def test_any_text(texts):
    check(texts)


def test_long_text_in_blocks(monkeypatch):
    monkeypatch.setattr(P, "BLOCK_CHARS", 50)
    check(["The quick  brown fox\njumps over. " * 40, "a" * 400, " " * 300])


def test_decode_of_broken_bytes():
    ids = [CODER.p.byte_ids[0xE6], CODER.p.byte_ids[0x97], 300, CODER.p.byte_ids[0xFF], 1, 2]
    ids = [int(i) for i in ids]
    assert CODER.p.decode(ids) == SP.decode(ids)


def test_frame(spark):
    rows = [(i, t, "x") for i, t in enumerate(EDGE)] + [(None, "a b", "x"), (1, "a b", "x"), (1, "a b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = P.code_documents(docs, MODEL, more=("ids", "decoded")).collect()
    want = {r[1]: [1, *SP.encode(r[1] or ""), 2] for r in rows}
    assert len(got) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in got) == sorted((r[0] is None, r[0] or 0, want[r[1]]) for r in rows)
    assert all(r.decoded == SP.decode(r.ids) for r in got)
    assert P.code_documents(docs.where("false"), MODEL).count() == 0


def test_other_models_are_refused():
    from sentencepiece import sentencepiece_model_pb2
    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(MODEL)
    m.trainer_spec.byte_fallback = False
    with pytest.raises(ValueError):
        P.Pieces(m.SerializeToString())
