"""Encoding by distinct chunks against the library on whole texts."""

import hashlib

import public_tokenizers
import pytest
import sentencepiece

from siltbed.llm import piece_codec
from siltbed.llm.piece_codec import op11_piece_codec
from tests.llm.test_operators import EDGES, docs, prose

ODD = ["▁", "a▁b", " a  b ", "\n", "a\n b\tc", "\0", "a\0b", "<s> </s> <unk><0x41>", " x　y", "é ﬁ ﻿", "   " * 40 + "x", "漢字" * 3000, "𝄞🙂", "a" * 3000, "1234 56", "x ", "▁▁x▁"]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return piece_codec.read_model(public_tokenizers.path(piece_codec.MODEL))


def test_ids_and_texts_are_the_librarys(spark, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = [*ODD, *prose(40, 1), *[t for _, t in EDGES]]
    rows = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts * 2)], "doc_id long, text string").repartition(3)
    encoded = piece_codec.encode(rows, model)
    got = sorted((repr(r.doc_id), r.ids, r.text) for r in piece_codec.decode(encoded, model, keep_ids=True).collect())
    ids = lambda t: [*library.encode(t or ""), 2]
    assert got == sorted((repr(i if i % 7 else None), ids(t), library.decode(ids(t))) for i, t in enumerate(texts * 2))


def test_edges(spark, model):
    assert piece_codec.encode(docs(spark, []), model).count() == 0
    assert {(r.doc_id, len(r.ids)) for r in piece_codec.encode(docs(spark, EDGES), model).collect()} >= {(1, 1), (2, 1), (None, 3)}
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, 264, 2])], "doc_id long, ids array<long>")
    assert {r.doc_id: r.text for r in piece_codec.decode(odd, model).collect()} == {1: "", 2: "", 3: "a"}


def test_small_tables_change_nothing(model, monkeypatch):
    texts = [*ODD, *prose(20, 2)]
    want = list(piece_codec.Chunks(model).ids(texts))
    monkeypatch.setattr(piece_codec, "CACHED", 3)
    known = piece_codec.Chunks(model)
    assert [ids for t in texts for ids in known.ids([t])] == want
    assert list(known.ids(texts)) == want and all(len(c) <= piece_codec.SHORT for c in known.known)


def test_pieces_across_markers_are_refused(monkeypatch, model):
    class Crossing:
        get_piece_size = staticmethod(lambda: 1)
        id_to_piece = staticmethod(lambda i: "▁a▁b")

    monkeypatch.setattr(piece_codec.sentencepiece, "SentencePieceProcessor", lambda model_proto: Crossing())
    with pytest.raises(ValueError):
        piece_codec.Chunks(model)


def test_the_query(spark, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = [*library.encode(r.text or ""), 2]
        want.add((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert set(map(tuple, op11_piece_codec(spark, SF).collect())) == want
