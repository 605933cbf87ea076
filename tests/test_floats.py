"""Binary32 folds, gates, compensated sums and pooling against scalar code."""

from __future__ import annotations

import math
import struct

import numpy as np
from pyspark.sql import functions as F

from lodestrand.functions import floats, texts
from lodestrand.operators import canonical, similarity


def f32(x):
    return struct.unpack("<f", struct.pack("<f", x))[0]


def dot(a, b):
    acc = 0.0
    for x, y in zip(a, b, strict=True):
        acc = f32(acc + f32(x * y))
    return acc


def vectors(n=40, d=33):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((n, d))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def test_scores_are_bit_exact_in_both_scorers(spark):
    v = vectors()
    df = spark.createDataFrame([(f"r{i:02}", "e", x.tolist()) for i, x in enumerate(v)], "record_id string, entity_id string, vector array<float>")
    expected = {(f"r{i:02}", f"r{j:02}"): dot(v[i].tolist(), v[j].tolist()) for i in range(len(v)) for j in range(len(v))}
    for q in (0, 7):
        got = {r["record_id"]: r["score"] for r in similarity.scores(df, v[q].tolist()).collect()}
        assert got == {f"r{j:02}": expected[f"r{q:02}", f"r{j:02}"] for j in range(len(v))}
    many = similarity.top_of_many(df, df, 5).collect()
    assert len(many) == 5 * len(v) and all(r["score"] == expected[r["query_id"], r["record_id"]] for r in many)
    for i in range(len(v)):
        best = sorted(range(len(v)), key=lambda j: (-expected[f"r{i:02}", f"r{j:02}"], j))[:5]
        assert [r["record_id"] for r in sorted((r for r in many if r["query_id"] == f"r{i:02}"), key=lambda r: r["rn"])] == [f"r{j:02}" for j in best]


def test_ties_go_by_record_id_and_zeros_are_equal(spark):
    df = spark.createDataFrame([("b", "e", [1.0, 0.0]), ("a", "e", [1.0, 0.0]), ("c", "e", [0.0, 1.0]), ("d", "e", [-0.0, -1.0])], "record_id string, entity_id string, vector array<float>")
    ranked = similarity.scores(df, [1.0, 0.0])
    assert [r["record_id"] for r in similarity.page(ranked, 9).collect()] == ["a", "b", "c", "d"]
    assert [r["record_id"] for r in similarity.page(ranked, 9, (1.0, "a")).collect()] == ["b", "c", "d"]
    assert [r["record_id"] for r in similarity.page(ranked, 1, (0.0, "c")).collect()] == ["d"]


def test_gates(spark):
    inf, nan = float("inf"), float("nan")
    cases = [([1.0, 0.0], True, True), ([1.00000045, 0.0], True, True), ([1.000004, 0.0], True, False), ([1.0001, 0.0], False, False), ([nan, 1.0], False, False), ([inf, 0.0], False, False), ([], False, False), (None, False, False)]
    df = spark.createDataFrame([(i, v) for i, (v, _, _) in enumerate(cases)], "i int, v array<float>")
    got = df.select("i", F.coalesce(floats.passes_query_gate(F.col("v")), F.lit(False)).alias("q"), F.coalesce(floats.passes_package_gate(F.col("v")), F.lit(False)).alias("p")).orderBy("i").collect()
    assert [(r["q"], r["p"]) for r in got] == [(q, p) for _, q, p in cases]


def test_compensated_sum_equals_the_built_in(spark):
    values = [1e16, 1.0, -1e16, 0.1, 1e-9] * 7
    got = spark.createDataFrame([(values,)], "v array<double>").select(floats.total(F.col("v")).alias("s")).first()["s"]
    assert got == sum(values) and got != math.fsum([]) + np.add.reduce([0.0])


def test_windows_and_pooling(spark):
    seqs = spark.createDataFrame([("a", "A" * 8192), ("b", "C"), ("c", ""), ("d", None)], "k string, s string")
    got = [(r["k"], r["window_no"], len(r["window"])) for r in canonical.windows(seqs, ["k"], "s").orderBy("k", "window_no").collect()]
    assert got == [("a", 0, 8191), ("a", 1, 1), ("b", 0, 1)]
    rows = spark.createDataFrame([("x", 1, [0.0, 1.0]), ("x", 0, [1.0, 0.0]), ("y", 0, [1.0]), ("y", 1, [1.0, 2.0]), ("z", 0, [0.0, 0.0])], "k string, i int, v array<double>")
    pooled = {r["k"]: r["pooled"] for r in canonical.pooled(rows, ["k"], "i", "v", unit=True).collect()}
    assert np.allclose(pooled["x"], [2**-0.5] * 2) and pooled["y"] is None and pooled["z"] is None


def test_canonical_sequences_and_quarantine(spark):
    files = spark.createDataFrame([("ok", ">NZ_B.1 second\n nry\n>NZ_A.1 first\r\n acg t\n"), ("rna", ">x\nACGU"), ("sharp", ">x\nACß"), ("early", "AC\n>x\nAC"), ("twice", ">x\nA\n>x\nC"), ("noname", ">\nA"), ("bare", ">x\n>y\nA")], "accession string, fasta string")
    reported = spark.createDataFrame([("ok", "NZ_A.1"), ("ok", "NZ_B.1"), ("rna", "x"), ("sharp", "x"), ("early", "x"), ("twice", "x"), ("bare", "x"), ("bare", "y")], "accession string, contig_id string")
    from lodestrand.plans.builder import canonicalise_archives

    records, bad = canonicalise_archives(files, reported, "asm", "p")
    got = records.collect()
    assert [(r["accession"], r["canonical"], r["record_id"], r["entity_id"]) for r in got] == [("ok", "NZ_A.1\tACGT\nNZ_B.1\tNRY\n", "asm:ok:p", "asm:ok")]
    assert {r["accession"] for r in bad.collect()} == {"rna", "sharp", "early", "twice", "noname", "bare"}


def test_times(spark):
    df = spark.createDataFrame([("2026-07-21T10:00:00+02:00",), ("2026-07-21T10:00:00.250Z",), ("2026-07-21T10:00:00",), ("x",)], "t string")
    assert [r["u"] for r in df.select(texts.utc(F.col("t")).alias("u")).collect()] == ["2026-07-21T08:00:00Z", "2026-07-21T10:00:00.250000Z", None, None]
