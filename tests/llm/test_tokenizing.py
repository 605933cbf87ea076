"""Ids against the public libraries."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrand.llm import tokenizing

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

ODD = ["", None, " ", "<|endoftext|> x", "a\x1cb \x1d\x1e c", " 　 x", "it's I'LL don't 's", "  \n\n  a  ", "ACGT" * 900, "x" * 3000, "é" * 700, "😀👩‍👩‍👧" * 20, "\u0085a\x0b\x0c", "١٢٣ ½²", "ǅ ʰ ª", "​﻿ z", "1234567890" * 40, "\t\t\tx\r\n \r\n", "a", "密集的组装GXA_803690652.1拒绝了"]


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(tokenizing.vocabulary())
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def own():
    return tokenizing.ByteBpe(tokenizing.vocabulary())


def ids(own, texts):
    offsets, flat = own.encode(texts)
    return [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


def test_odd_texts(own, reference):
    assert ids(own, ODD) == reference(ODD)
    assert own.count(ODD).tolist() == [len(x) for x in reference(ODD)]


def test_forgetting_changes_nothing(own, reference, monkeypatch):
    monkeypatch.setattr(tokenizing, "KNOWN", 3)
    assert ids(own, ODD) == ids(own, ODD) == reference(ODD)


def test_both_trees_agree(own):
    words = [b"ACGTTGCA" * n for n in (1, 30, 129, 600)] + [bytes(range(256)) * 3]
    for w in words:
        k = max(1, (len(w) - 1).bit_length())
        import numpy as np

        flat, counts = own._trees([w, w], np.array([len(w)] * 2), k)
        assert own._tree(w).tolist() == flat[: counts[0]].tolist() == flat[counts[0] :].tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn"]), max_size=40), max_size=4))
def test_any_text(own, reference, texts):
    # the libraries' tables of letters may be of other Unicode versions; what both know must agree
    known = [t for t in texts if all(ord(c) < 0x2FA20 for c in t)]
    assert ids(own, known) == reference(known)


def test_rows_stay_and_names_may_clash(spark, reference):
    df = spark.createDataFrame([(i % 15, t) for i, t in enumerate(ODD)], "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("key", F.lit(0))
    got = tokenizing.encode(df, "doc_id", "text").collect()
    assert sorted((r["doc_id"], r["ids"]) for r in got) == sorted((i % 15, x) for i, x in enumerate(reference(ODD)))
    assert tokenizing.encode(df.where("false"), "doc_id", "text").count() == 0


def test_corpus(spark, small, reference):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["ids"] for r in tokenizing.p6_ids(spark, small).collect()}
    assert got == dict(zip(texts, reference(list(texts.values()))))
