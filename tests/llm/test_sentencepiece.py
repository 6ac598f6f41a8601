from __future__ import annotations

import hashlib

import pytest
import sentencepiece as library
from hypothesis import given, settings
from hypothesis import strategies as st

from arcweave.llm import sentencepiece as sp

MODEL = library.SentencePieceProcessor(model_file=sp.MODEL)
ODD = ["", " ", "a", "  a", "a  b ", "ﬁ①", "\n", "a\nb", "\t\t  x", "▁x", "\x00a", "　x", " " * 37 + "q", "日本語テキスト", "a" * 50, "€uro», ñandú”.", "\r\n", "x.y,z...!? (a) “q”, …. ²."]


@pytest.fixture(scope="module")
def encoder():
    return sp.Encoder(sp.prepared(sp.MODEL), memory=500)


def same(encoder, texts):
    ids, counts = encoder.encode([t.encode() for t in texts])
    at = 0
    for text, n in zip(texts, counts.tolist()):
        own = ids[at : at + n].tolist()
        at += n
        assert own == MODEL.encode(text), text
        if "▁" not in text:
            assert sp.decode_ids(encoder.vocabulary, own) == text.encode()


def test_odd_texts(encoder):
    same(encoder, ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aeinrst lo'.,-ABé»ñ”中 \n0129▁\t"), max_size=60), max_size=6))
def test_same_ids_as_the_library(encoder, texts):
    same(encoder, texts)


def test_occurrences_match_a_scan(encoder):
    v = encoder.vocabulary
    text = b"\0".join(w.encode() for w in [" the", " therein", "ing", " naïve", " internationalization", ""])
    position, which = sp.occurrences(v, text)
    found = {(p, v.piece[i]) for p, i in zip(position.tolist(), v.sorted_id[which].tolist())}
    pieces = {v.piece[i] for i in v.usable.tolist()}
    assert found == {(a, text[a:b]) for a in range(len(text)) for b in range(a + 1, min(len(text), a + 60) + 1) if text[a:b] in pieces}


def test_documents(spark, sf_dir, docs_of):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = sp.encode(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(found) == docs.count()
    for r in found:
        assert r.round_trip and r.token_ids == MODEL.encode(r.text) and r.n_tokens == len(r.token_ids)
        assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_nulls_and_repeats(docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "ab ▁"), (4, "word " * 40_000), (4, "x"), (4, "x"), (None, "y")], extra=True)
    found = sp.encode(docs).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == 7 and by[1].token_ids is None and by[1].n_tokens == 0 and by[2].token_ids == []
    assert not by[3].round_trip and all(r.round_trip for r in found if r.doc_id != 3)
    back = {r.doc_id: r.text for r in sp.decode(sp.encode(docs)).collect()}
    assert back[1] is None and back[2] == "" and back[None] == "y"
    assert sp.encode(docs_of([])).collect() == []
