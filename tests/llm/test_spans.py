"""Shared spans against all windows of texts."""

from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import duck, rows
from pyspark.sql import functions as F

from lodestrand.llm import spans

L, K = 24, 8


def brute(table, least):
    """Pairs and shared amounts by a dictionary of all spans."""
    seen: dict = {}
    for doc, text in table:
        for i in range(len(text or "") - least + 1):
            seen.setdefault(text[i : i + least], []).append((doc, i))
    pairs, at = set(), {}
    for places in seen.values():
        docs = sorted({d for d, _ in places})
        if len(docs) > 1:
            pairs |= {(a, b) for i, a in enumerate(docs) for b in docs[i + 1 :]}
            for d, i in places:
                at.setdefault(d, set()).update(range(i, i + least))
    return pairs, {d: len(at.get(d, ())) for d, _ in table}


def make(seed, n=60):
    r = random.Random(seed)
    alphabet = "ab é\n密😀"
    word = lambda k: "".join(r.choice(alphabet) for _ in range(k))
    shared = [word(r.randint(20, 60)) for _ in range(6)] + ["N" * 70, "xy" * 40]
    table = [(i, word(r.randint(0, 40)) + (r.choice(shared) + word(3)) * r.randint(0, 3) + word(r.randint(0, 30))) for i in range(n)]
    table += [(n, None), (n + 1, ""), (n + 2, table[3][1]), (n + 3, table[3][1]), (n + 4, "q" * (L - 1)), (n + 5, "q" * (L - 1)), (n + 6, "z" * 5000), (n + 7, "z" * 300)]
    return table


def found(spark, table):
    df = spark.createDataFrame(table, "doc_id long, text string").withColumn("kind", F.lit("clash")).withColumn("doc", F.lit(1)).repartition(3)
    s = spans.SharedSpans(df, least=L, anchor=K)
    pairs = [tuple(r) for r in s.pairs().collect()]
    assert len(pairs) == len(set(pairs))
    return set(pairs), {r["doc"]: r["shared_chars"] for r in s.amounts().collect()}, s


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    table = make(seed)
    pairs, amounts, s = found(spark, table)
    assert (pairs, amounts) == brute(table, L) and s.shards == 1


def test_sets_too_large_for_a_shard(spark, monkeypatch):
    monkeypatch.setattr(spans, "MOST", 200)
    monkeypatch.setattr(spans, "SHARD", 300)
    monkeypatch.setattr(spans, "PIECE", 30)
    table = make(3)
    pairs, amounts, s = found(spark, table)
    assert s.shards > 20 and (pairs, amounts) == brute(table, L)


def test_a_set_of_ten_million_characters(spark):
    r = random.Random(5)
    passage = "".join(r.choices("abcdefgh \n", k=500_000))
    table = [(i, f"{i} " * 40 + passage[: 500_000 - i] + f" end {i}" * 30) for i in range(22)]
    s = spans.SharedSpans(spark.createDataFrame(table, "doc_id long, text string").repartition(4))
    assert sum(len(t) for _, t in table) > 10_000_000 and s.shards > 10
    assert {tuple(x) for x in s.pairs().collect()} == {(a, b) for a in range(22) for b in range(a + 1, 22)}
    got = {x["doc"]: x["shared_chars"] for x in s.amounts().collect()}
    assert all(abs(got[i] - (500_000 - i)) < 100 for i in range(22))


def test_links_of_representatives_and_their_members(spark):
    table = make(6)
    s = found(spark, table)[2]
    rep = {r["doc"]: r["rep"] for r in s.members().collect()}
    linked = {tuple(r) for r in s.links().collect()}
    pairs, _ = brute(table, L)
    assert {(a, b) for a, b in pairs if rep[a] == a and rep[b] == b} == linked
    assert all((min(rep[a], rep[b]), max(rep[a], rep[b])) in linked or rep[a] == rep[b] for a, b in pairs)


def test_long_texts_are_streamed_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(spans, "CHUNK", 7)
    table = make(4, 20)
    assert found(spark, table)[:2] == brute(table, L)


def test_empty_table(spark):
    assert found(spark, [])[:2] == (set(), {})


def test_every_window_has_an_anchor_of_its_least_hash():
    r = np.random.default_rng(2)
    for n, high in ((50, 3), (300, 1000), (7, 9), (40, 1)):
        h = r.integers(0, high, n).astype(np.uint64)
        at = set(spans.anchors(h, 8).tolist())
        for i in range(n - 7):
            assert any(j in at and h[j] == h[i : i + 8].min() for j in range(i, i + 8))


def test_gram_hashes_depend_on_the_gram_alone():
    codes = np.array([5, 6, 7, 8, 5, 6, 7, 9] * 3, np.uint32)
    for k in (1, 3, 5):
        h = spans.gram_hashes(codes, k)
        grams = {}
        for i in range(len(codes) - k + 1):
            grams.setdefault(tuple(codes[i : i + k].tolist()), set()).add(int(h[i]))
        assert all(len(v) == 1 for v in grams.values()) and len({v for s in grams.values() for v in s}) == len(grams)


def test_suffixes_are_in_order_and_rank_counts():
    text = np.array([3, 1, 3, 1, 4, 1, 3, 1, 3, 1, 4, 0])
    order, agrees = spans.suffix_array(text, 3)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    assert agrees.tolist() == [i > 0 and text[order[i] :][:3].tolist() == text[order[i - 1] :][:3].tolist() for i in range(len(text))]
    matrix = spans.WaveletMatrix(text, 5)
    for c in range(5):
        assert matrix.rank(np.full(13, c), np.arange(13)).tolist() == [int((text[:i] == c).sum()) for i in range(13)]


def test_real_documents(spark, small):
    table = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    pairs, amounts = brute(table, 160)
    assert {tuple(r) for r in spans.p8_found(spark, small).collect()} == pairs
    assert {r["doc_id"]: r["shared_chars"] for r in spans.p8_shared(spark, small).collect()} == amounts


def test_queries_equal_their_sql(spark, small):
    con = duck(small)
    assert rows(spans.p8_found(spark, small)) == rows(con.execute(spans.P8_SQL).df())
    assert rows(spans.p8_shared(spark, small)) == rows(con.execute(spans.P8_SHARED_SQL).df())
