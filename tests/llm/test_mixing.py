"""Apportionment against the highest quotients, and mixtures against their targets and limits."""

from __future__ import annotations

import random

import pytest

from lodestrand.llm import mixing

pytest.importorskip("public_tokenizers")


def brute(weights, capacities, blocks, names):
    got = [0] * len(weights)
    for _ in range(blocks):
        able = [i for i in range(len(weights)) if weights[i] > 0 and got[i] < capacities[i]]
        if not able:
            break
        got[min(able, key=lambda i: (-weights[i] / (2 * got[i] + 1), names[i]))] += 1
    return got


def test_highest_quotients():
    r = random.Random(1)
    for _ in range(400):
        n = r.randint(0, 7)
        weights, capacities = [r.choice([0, 0.1, 0.1, 0.2, r.random()]) for _ in range(n)], [r.randint(0, 30) for _ in range(n)]
        names, blocks = [chr(97 + i) for i in range(n)], r.randint(0, 90)
        assert mixing.sainte_lague(weights, capacities, blocks, names) == brute(weights, capacities, blocks, names)


TEXT = "the verified scaffold follows the dense record and omits one pending filter"


def make(spark, counts):
    rows = [(i, TEXT + f" {i}" if i % 9 else TEXT, s) for i, s in enumerate(s for s, n in counts for _ in range(n))]
    rows += [(10_000, None, "a"), (10_001, "", "a"), (10_002, "  ", None), (10_003, TEXT, "unlisted")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def run(spark, counts, wanted, **more):
    mixed, report = mixing.mix(make(spark, counts), targets(spark, wanted), **more)
    return {r["doc_id"]: r for r in mixed.collect()}, {r["source"]: r for r in report.collect()}


def test_shares_are_reached_within_repeats(spark):
    wanted = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 4), ("none", 0.05, 3)]
    mixed, report = run(spark, [("a", 300), ("b", 100), ("c", 25)], wanted)
    assert report["none"]["actual_share"] == 0 and report["none"]["documents"] == 0
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert abs(report[s]["actual_share"] - share / 0.95) < 0.01
    limits = {s: m for s, _, m in wanted}
    assert all(1 <= r["uses"] <= limits[r["source"]] for r in mixed.values())
    assert sum(r["n_tokens"] * r["uses"] for r in mixed.values()) == sum(r["tokens"] for r in report.values())
    assert not set(mixed) & {10_000, 10_001, 10_002, 10_003}


def test_many_shards_reach_the_same_shares(spark):
    wanted = [("a", 0.7, 1), ("b", 0.3, 2)]
    mixed, report = run(spark, [("a", 400), ("b", 100)], wanted, shard=500)
    assert abs(report["b"]["actual_share"] - 0.3) < 0.02 and max(r["uses"] for r in mixed.values() if r["source"] == "b") <= 2


def test_seed_decides_not_the_partitions(spark):
    wanted = [("a", 0.5, 1), ("b", 0.5, 1)]
    uses = lambda m: {k: r["uses"] for k, r in m.items()}
    first, again, other = (uses(run(spark, [("a", 90), ("b", 30)], wanted, seed=s)[0]) for s in (1, 1, 2))
    assert first == again != other


def test_a_total_beyond_the_limits_uses_all_repeats(spark):
    mixed, report = run(spark, [("a", 20), ("b", 20)], [("a", 0.9, 2), ("b", 0.1, 1)], total=10**6)
    assert {r["uses"] for r in mixed.values() if r["source"] == "a"} == {2} and report["a"]["tokens"] == 2 * report["a"]["supply"]


def test_odd_targets(spark):
    nan = float("nan")
    mixed, report = run(spark, [("a", 30), ("b", 30)], [("a", 0.5, None), ("b", -1.0, 2), (None, 0.4, 1), ("c", nan, 1), ("a", 0.5, 3)])
    assert set(r["source"] for r in mixed.values()) == {"a"} and max(r["uses"] for r in mixed.values()) == 1
    assert report["a"]["target_share"] == 1.0 and set(report) == {"a", "b", "c"}


def test_nothing_to_mix(spark):
    for counts, wanted in (([], [("a", 1.0, 1)]), ([("a", 5)], [])):
        df = make(spark, counts) if counts else make(spark, []).where("false")
        mixed, report = mixing.mix(df, targets(spark, wanted))
        assert mixed.count() == 0 and report.count() == len(wanted)


def test_blocks_are_chosen_by_the_seed(spark):
    """Documents of a shard come in runs: chosen blocks of neighbouring keys, not single documents."""
    mixed, report = run(spark, [("a", 400), ("b", 400)], [("a", 0.5, 1), ("b", 0.5, 1)], block=200, total=6000)
    used = sorted(k for k in mixed if k < 400)
    runs = 1 + sum(b > a + 1 for a, b in zip(used, used[1:]))
    assert 40 < len(used) < 390 and runs < len(used) / 4 and abs(report["a"]["tokens"] - 3000) < 40


def test_bundles_keep_the_quota(spark):
    wanted = [("a", 0.6, 1), ("b", 0.4, 3)]
    whole, parted = (run(spark, [("a", 400), ("b", 100)], wanted, shard=300, bundle=n)[1] for n in (10**6, 2))
    for s in ("a", "b"):
        assert abs(whole[s]["actual_share"] - parted[s]["actual_share"]) < 0.02


def test_null_and_equal_keys_are_spread(spark):
    rows = [(None if i % 2 else 7, TEXT + f" {i}", "a") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed, report = mixing.mix(df, targets(spark, [("a", 1.0, 1)]), shard=500, total=2000)
    assert abs(sum(r["n_tokens"] for r in mixed.collect()) - 2000) < 200
