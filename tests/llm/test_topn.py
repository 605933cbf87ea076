"""Top N within groups against sorting, with ties, repeats, nulls and hot groups."""

from __future__ import annotations

import math
import random

from conftest import duck, rows
from pyspark.sql import functions as F

from lodestrand.llm import topn


def brute(table, n):
    groups: dict = {}
    for g, score, tie, item in table:
        if score is None or not math.isfinite(score):
            continue
        key = (-score + 0.0, tie is not None, tie or "", item)
        own = groups.setdefault(g, {})
        own[item] = min(own.get(item, key), key)
    return sorted(((g or ""), i, p + 1) for g, own in groups.items() for p, i in enumerate(sorted(own, key=own.__getitem__)[:n]))


def found(spark, table, n, row_group=topn.ROW_GROUP):
    df = spark.createDataFrame(table, "g string, s double, t string, i long").withColumn("score", F.lit("clash")).withColumn("position", F.lit(1)).repartition(3)
    return sorted((r["g"] or "", r["i"], r["position"]) for r in topn.top_n(df, ["g"], F.col("s"), "t", "i", n, row_group).collect())


def make(n, seed, groups=9):
    r = random.Random(seed)
    nan, inf = float("nan"), float("inf")
    out = []
    for i in range(n):
        g = "hot" if r.random() < 0.4 else r.choice([None, "", *map(str, range(groups))])
        out.append((g, r.choice([None, nan, inf, -inf, 0.0, -0.0, r.randint(-3, 3) / 2, r.random()]), r.choice(["é", "b", "a", "Z", "\U0001f600"]), i))
    return out + out[::7]


def test_equals_brute_force(spark):
    for seed, n in ((1, 3), (2, 10)):
        table = make(600, seed)
        assert found(spark, table, n) == brute(table, n)


def test_small_row_groups_are_skipped_without_loss(spark):
    table = make(4000, 3, groups=3)
    assert found(spark, table, 5, 100) == brute(table, 5)


def test_all_scores_equal(spark):
    table = [("g", 1.0, f"{(i * 37) % 1000:04}", i) for i in range(1000)] * 2
    assert found(spark, table, 4, 50) == brute(table, 4)


def test_differing_deliveries_count_with_the_best(spark):
    table = [("g", 1.0, "a", 1), ("g", 5.0, "b", 1), ("g", 3.0, "a", 2)]
    assert found(spark, table, 2) == [("g", 1, 1), ("g", 2, 2)]


def test_empty_table(spark):
    assert found(spark, [], 3) == []


def skipped(df, row_group, n=10):
    """Row groups, those read, and the best items of a table with g0, rows, score, tie and item, through the layout."""
    import pandas as pd

    from lodestrand.session import Workspace

    paths, seen = topn.clustered(df, Workspace(df.sparkSession, "t"), ["g0"], row_group), []
    read = topn._reader(["g0"], n, ["g0", "score", "tie", "item"], seen)
    out = pd.concat(read(iter([pd.DataFrame({"chunk": range(len(paths)), "path": paths})])))
    return sum(a for a, _ in seen), sum(b for _, b in seen), out


def test_only_better_row_groups_are_read(spark):
    """Of a hot group laid out over many row groups, the first one of each file is read."""
    df = spark.range(20_000).select(F.lit("g").alias("g0"), F.lit(20_000).cast("bigint").alias("rows"), F.rand(1).alias("score"), F.col("id").cast("string").alias("tie"), F.col("id").alias("item"))
    there, reads, out = skipped(df, 500)
    assert len(out) == 10 and reads == 1 and there >= 40


def test_row_groups_of_several_groups_are_skipped(spark):
    """Groups of a few hundred rows share row groups; one is skipped once it can't better any of them."""
    rows = spark.range(40_000).select((F.col("id") % 80).cast("string").alias("g0"), F.lit(500).cast("bigint").alias("rows"), F.rand(2).alias("score"), F.col("id").cast("string").alias("tie"), F.col("id").alias("item"))
    there, reads, out = skipped(rows, 500)
    assert len(out) == 800 and there >= 70 and reads < there / 3


def test_row_groups_of_the_planted_table_are_skipped(spark):
    import os

    import pytest

    if not os.path.isdir("/root/testdata/sf0.1"):
        pytest.skip("no test data")
    table = spark.read.parquet("/root/testdata/sf0.1/comparisons.parquet").where("score is not null and not isnan(score) and abs(score) < double('inf')")
    rows = table.select(F.concat_ws("|", "query_record_id", "profile_id").alias("g0"), "score", F.col("record_id").alias("tie"), F.col("comparison_id").alias("item"))
    rows = rows.join(rows.groupBy("g0").agg(F.count("*").alias("rows")).where("rows > 10"), "g0")
    there, reads, _ = skipped(rows, 1024)
    assert reads < there


def test_query_equals_its_sql(spark, small):
    assert rows(topn.p4_found(spark, small)) == rows(duck(small).execute(topn.P4_SQL).df())
