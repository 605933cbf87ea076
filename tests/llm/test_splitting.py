"""Pieces against the stated rule and its invariants."""

from __future__ import annotations

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestrand.llm import splitting


def brute(data, limit, overlap, gap):
    out, start = [], 0
    while len(data) - start > limit:
        reach = range(start + limit, start + overlap, -1)
        line = next((e for e in reach if data[e - 1 : e] == b"\n"), None)
        runs = {m.end() for m in re.finditer(rb"[Nn]{%d,}" % gap, data)}
        end = line or next((e for e in reach if e in runs), None) or start + limit
        out.append((start, end))
        start = end - overlap
    return [*out, (start, len(data))]


def samples():
    r = random.Random(4)
    for _ in range(120):
        data = b"".join(r.choice([b"ACGT" * r.randint(1, 9), b"\n", b"\r\n", b"n" * r.randint(1, 9), b"Nn" * 4, "é".encode(), b"\x00"]) for _ in range(r.randint(0, 60)))
        yield data, r.choice([20, 50, 200])


def test_full_pieces_follow_the_rule():
    for data, limit in samples():
        for overlap in (0, 5, 19):
            assert splitting.full(data, limit, overlap, 6) == brute(data, limit, overlap, 6)


def test_balanced_pieces_cover_overlap_and_keep_the_limit():
    for data, limit in samples():
        for overlap in (0, 5, 15):
            pieces = splitting.balanced(data, limit, overlap, 6)
            assert pieces[0][0] == 0 and pieces[-1][1] == len(data)
            assert all(e - s <= limit for s, e in pieces)
            assert all(b[0] == a[1] - overlap and b[1] > a[1] for a, b in zip(pieces, pieces[1:]))


def test_balanced_pieces_are_even_without_boundaries():
    pieces = splitting.balanced(b"A" * 10_001, 6000, 200)
    sizes = [e - s for s, e in pieces]
    assert len(pieces) == 2 and max(sizes) - min(sizes) <= 2


def test_items_count_once_and_odd_rows_give_none(spark):
    t1, t2 = datetime(2026, 1, 1), datetime(2026, 1, 2)
    big, other = b"A" * 30, b"C" * 45
    table = [("a", big, t1), ("a", big, t2), ("a", big, None), ("b", None, t1), ("c", b"", t1), ("d", b"A" * 20, t1), ("e", other, t2), ("e", big, t1), (None, big, t1)]
    df = spark.createDataFrame(table, "key string, body binary, at timestamp").withColumn("starts", F.lit(1)).withColumn("digest", F.lit("x"))
    got = {}
    for r in splitting.split(df, "key", "body", "at", limit=20, overlap=5).collect():
        got.setdefault(r["key"], []).append((r["piece_no"], r["start_at"], r["end_at"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: [(0, 0, 20), (1, 15, 30)] for k in ("a", "e", None)}
    with pytest.raises(ValueError):
        splitting.split(df, "key", "body", "at", limit=5, overlap=5)


def test_empty_table(spark):
    assert splitting.split(spark.createDataFrame([], "k string, b binary, t timestamp"), "k", "b", "t").count() == 0


@pytest.mark.parametrize("query", [splitting.p3_found, splitting.p3_balanced])
def test_queries_cover_all_long_items(spark, small, query):
    long = spark.read.parquet(f"{small}/assemblies.parquet").where("octet_length(canonical_bytes) > 6000").select("canonical_path").distinct()
    assert sorted(r[0] for r in query(spark, small).select("canonical_path").distinct().collect()) == sorted(r[0] for r in long.collect())


def test_balanced_pieces_of_a_huge_item_take_linear_time():
    import time

    def took(n):
        data = (b"ACGTTGCA" * 375 + b"\n") * n
        began = time.process_time()
        pieces = splitting.balanced(data)
        assert max(e - s for s, e in pieces) <= 6000 and pieces[-1][1] == len(data)
        return time.process_time() - began

    took(100)
    small, large = took(3_500), took(35_000)  # 10 MB and 105 MB
    assert large < 25 * small + 2


def test_queries_equal_their_sql(spark, small):
    from conftest import duck, rows

    con = duck(small)
    assert rows(splitting.p3_found(spark, small)) == rows(con.execute(splitting.P3_SQL).df())
    assert rows(splitting.p3_balanced(spark, small)) == rows(con.execute(splitting.P3_BALANCED_SQL).df())
