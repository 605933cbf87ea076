"""Neighbours and clusters against all pairs."""

from __future__ import annotations

import functools
import os

import numpy as np
import pytest
from conftest import duck, rows
from pyspark.sql import functions as F

from lodestrand.llm import clusters, embeddings, hnsw, neighbours
from lodestrand.session import Workspace


def unit(v):
    return (v / np.linalg.norm(v, axis=-1, keepdims=True)).astype(np.float32)


def grouped(n_groups, size, d=24, spread=0.25, seed=0):
    """Vectors around random centres: pairs of a group are near, others far."""
    r = np.random.default_rng(seed)
    centres = unit(r.standard_normal((n_groups, d)))
    own = np.repeat(np.arange(n_groups), r.integers(1, 2 * size, n_groups))
    return unit(centres[own] + spread * r.standard_normal((len(own), d)) / np.sqrt(d)), own


def frame(spark, v, kinds=None):
    rows = [(i, "k" if kinds is None else kinds[i], bytearray(x.tobytes())) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "id long, kind string, vector binary")


def recall(got, v, k, floor=-2.0):
    sims = v @ v.T
    np.fill_diagonal(sims, -2)
    best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    wanted = [(i, int(j)) for i in range(len(v)) for j in best[i] if sims[i, j] >= floor]
    return np.mean([p in got for p in wanted])


def pairs(df):
    return {(r["src"], r["dst"]) for r in df.collect()}


def test_graph_search_finds_what_is_near():
    v, _ = grouped(60, 20)
    graph = hnsw.Hnsw(v, 1)
    q = unit(v + 0.05 * np.random.default_rng(1).standard_normal(v.shape))
    ids, sims = graph.search(q, 10)
    exact = q @ v.T
    best = np.argsort(-exact, axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(ids.tolist(), best.tolist())]) > 9.3
    assert np.allclose(np.take_along_axis(exact, ids, 1), sims, atol=1e-5) and (np.diff(sims, axis=1) <= 0).all()
    assert graph.layers[0].dtype == np.int32 and graph.layers[0].shape == (len(v), hnsw.LINKS + hnsw.SLACK)


def real(spark, directory):
    """The valid vectors of each profile as one matrix, in the order of the record ids."""
    found = {}
    for r in sorted(embeddings.valid_vectors(spark, directory).collect(), key=lambda r: r["record_id"]):
        found.setdefault(r["profile_id"], []).append(np.frombuffer(r["vector"], "<f4"))
    return {kind: unit(np.array(v, np.float64)) for kind, v in found.items()}


def test_recall_of_the_graph_alone(spark):
    """Held-out vectors of either profile against all pairs, at the default beam, by the graph and nothing else."""
    if not os.path.isdir("/root/testdata/sf0.1"):
        pytest.skip("no test data")
    for kind, v in real(spark, "/root/testdata/sf0.1").items():
        order = np.random.default_rng(7).permutation(len(v))
        q, x = v[order[: len(v) // 4]], v[order[len(v) // 4 :]]
        ids, _ = hnsw.Hnsw(x, 1).search(q, 10)
        exact = q @ x.T
        best = np.argpartition(-exact, 9, axis=1)[:, :10]
        assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids.tolist(), best.tolist())]) >= 0.95, kind


def test_a_walk_follows_links_only():
    """Nodes without links into them are never found, and a search of near queries doesn't visit the whole graph."""
    v, own = grouped(150, 30, seed=5)
    graph = hnsw.Hnsw(v, 1)
    assert graph.top >= 2
    at, graph.visited = own == 3, 0
    ids, sims = graph.search(v[at], 5)
    assert (sims[:, 0] > 0.999).all() and graph.visited < len(v) / 3
    lost = int(np.flatnonzero(at)[0])
    for layer in graph.layers:
        layer[layer == lost] = -1
    if lost != graph.entry:
        assert lost not in graph.search(v[at], 5)[0]


def test_insertion_meets_near_pairs():
    v, _ = grouped(100, 20, seed=6)
    src, dst, _ = hnsw.Hnsw(v, 2).met()
    assert recall(set(zip(src.tolist(), dst.tolist())), v, 10, 0.9) > 0.99


def test_hubs_are_shared_by_a_group():
    v, own = grouped(8, 150, seed=7)
    graph = hnsw.Hnsw(v, 3)
    src, dst = graph.hubs(0.75)
    assert (own[src] == own[dst]).all() and (graph.height[dst] >= graph.height[src]).all() and len(set(src.tolist())) == len(src)
    assert len(src) > 0.9 * len(v) and len(set(dst.tolist())) < len(v) / 4


def test_copies_of_one_vector_stay_linked():
    v = np.concatenate([np.repeat(unit(np.ones((1, 16))), 900, 0), grouped(20, 20, d=16, seed=8)[0]])
    ids, _ = hnsw.Hnsw(v, 1).search(v, 3)
    assert (ids[900:, 0] == np.arange(900, len(v))).mean() > 0.98 and (ids[:900] < 900).all()


def test_the_tree_of_centroids_leads_to_the_nearest(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "UPPER_CELLS", 8)
    monkeypatch.setattr(neighbours, "LOWER_SAMPLE", 16)
    v, _ = grouped(40, 60, seed=9)
    df = frame(spark, v)
    tree = neighbours.trees(df, {("k", 96): len(v)}, 0, 50, 1000)["k", 96]
    assert tree.upper is not None and 0.5 < len(tree.cells) / (len(v) / 50) < 2
    near, sims = tree.near(v, 3)
    exact = np.sort(v @ tree.cells.T, 1)[:, ::-1]
    assert np.mean(sims[:, 0] >= exact[:, 0] - 1e-5) > 0.95 and (near >= 0).all()
    assert recall(pairs(neighbours.merge(neighbours.nearest(df, 5, shard_rows=50, sample=1000), 5, both_ways=True)), v, 5, 0.9) > 0.95


def test_too_many_kinds_are_refused(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "KINDS", 1)
    with pytest.raises(ValueError):
        neighbours.nearest(frame(spark, unit(np.eye(3)), ["a", "b", "c"]))


def test_p1_equals_its_sql(spark, small):
    assert rows(neighbours.p1_found(spark, small)) == rows(duck(small).execute(neighbours.P1_SQL).df())


def test_one_shard_and_many_recall_nearly_all(spark):
    v, _ = grouped(40, 12)
    df = frame(spark, v)
    assert recall(pairs(neighbours.merge(neighbours.nearest(df, 5), 5)), v, 5) > 0.99
    parted = pairs(neighbours.merge(neighbours.nearest(df, 5, shard_rows=64, sample=400), 5))
    assert recall(parted, v, 5, 0.5) > 0.95


def test_hot_cells_are_salted_without_loss(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MOST_ROWS", 40)
    v = unit(np.ones((300, 8)) + 0.3 * np.random.default_rng(3).standard_normal((300, 8)))
    got = pairs(neighbours.merge(neighbours.nearest(frame(spark, v), 4, shard_rows=20, sample=8), 4))
    assert recall(got, v, 4) > 0.9


def test_kinds_and_repeats(spark):
    v = unit(np.array([[1, 0], [1, 0], [1, 0], [0, 1]], float))
    got = neighbours.merge(neighbours.nearest(frame(spark, v, ["a", "a", "b", "c"]), 3), 3)
    assert {(r["src"], r["dst"]): round(r["sim"], 6) for r in got.collect()} == {(0, 1): 1.0, (1, 0): 1.0}


def test_empty_tables(spark):
    empty = frame(spark, np.zeros((0, 4), np.float32))
    assert neighbours.nearest(empty).count() == 0 and clusters.cluster(empty, Workspace(spark, "t")).count() == 0


def test_floor_is_exact(spark):
    v = unit(np.array([[1, 0, 0], [0.97, np.sqrt(1 - 0.97**2), 0], [0.9699, 0, np.sqrt(1 - 0.9699**2)]]))
    got = pairs(neighbours.nearest(frame(spark, v), 3, 0.97))
    assert got <= {(0, 1), (1, 0)}


@pytest.mark.parametrize("rows_of", [8192, 64])
def test_clusters_of_near_vectors(spark, monkeypatch, rows_of):
    monkeypatch.setattr(clusters, "nearest", functools.partial(neighbours.nearest, shard_rows=rows_of, sample=600))
    v, own = grouped(25, 14, seed=2)
    v = np.concatenate([v, np.repeat(v[:1], 60, 0)])
    own = np.concatenate([own, np.repeat(own[:1], 60)])
    found = {r["id"]: r["cluster"] for r in clusters.cluster(frame(spark, v), Workspace(spark, "t"), 0.75).collect()}
    same = lambda labels: {tuple(np.flatnonzero(labels == x)) for x in set(labels.tolist())}
    assert same(np.array([found[i] for i in range(len(v))])) == same(own)


@pytest.mark.parametrize("block", [clusters.BLOCK, 0])
def test_markov_separates_loosely_linked_groups(spark, monkeypatch, block):
    monkeypatch.setattr(clusters, "BLOCK", block)
    edges = [(a, b, 0.9) for g in (range(5), range(5, 10)) for a in g for b in g if a != b] + [(4, 5, 0.1), (5, 4, 0.1)]
    df = spark.createDataFrame(edges, "src long, dst long, sim double")
    labels = {r["node"]: r["label"] for r in clusters.markov(df, Workspace(spark, "t"), "m").collect()}
    assert len({labels[i] for i in range(5)}) == 1 == len({labels[i] for i in range(5, 10)}) and labels[0] != labels[9]


def write(spark, path, shards, instances, references, records):
    spark.createDataFrame(shards, "shard_id string, profile_id string, dimension int, dtype string, digest string, payload binary, row_mapping map<string,string>").write.parquet(f"{path}/vector_shards.parquet")
    spark.createDataFrame(instances, "instance_id string, record_id string, profile_id string, vector_reference struct<shard_id:string,row:long,shard_digest:string>, created_in string, eligibility_status string").write.parquet(f"{path}/instances.parquet")
    spark.createDataFrame(references, "record_id string, profile_id string, vector array<float>").write.parquet(f"{path}/reference_vectors.parquet")
    spark.createDataFrame(records, "record_id string, entity_id string").write.parquet(f"{path}/records.parquet")


def test_which_vector_counts(spark, tmp_path):
    rows = np.array([[1, 0], [0, 1], [2, 0], [np.nan, 1], [0.6, 0.8]], "<f4")
    shard = ("s", "p", 2, "float32le", "d", bytearray(rows.tobytes() + b"\x00"), {"0": "i0", "1": "i1", "2": "i2", "3": "i3", "9": "i9", "x": "ix"})
    inst = lambda i, r, row, e="eligible": (i, r, "p", ("s", row, "d"), "b", e)
    instances = [inst("i0", "r0", 0), inst("i0", "r0", 0), inst("i1", "r1", 1, "withdrawn"), inst("i2", "r2", 2), inst("i3", "r3", 3), inst("i9", "r9", 9), inst("i1", None, 1), inst("i1", "r7", 0)]
    references = [("r0", "p", [0.0, 1.0]), ("r1", "p", [0.6, 0.8]), ("r1", "p", [0.6, 0.8]), ("r2", "p", [1.0, 0.0]), ("r4", "q", [1.0]), ("r5", "p", None), ("r6", "p", [1.0, None]), (None, "p", [1.0, 0.0]), ("r8", "p", [])]
    write(spark, str(tmp_path), [shard, shard, ("t", "p", 2, "float32le", "d", None, {"0": "a"}), ("u", "p", 0, "float32le", "d", bytearray(b""), {"0": "a"})], instances, references, [("r0", "e")])
    got = {r["record_id"]: (r["profile_id"], np.frombuffer(r["vector"], "<f4").tolist()) for r in embeddings.valid_vectors(spark, str(tmp_path)).collect()}
    assert {k: (p, np.round(v, 4).tolist()) for k, (p, v) in got.items()} == {"r0": ("p", [1.0, 0.0]), "r1": ("p", [0.6, 0.8]), "r4": ("q", [1.0])}


def test_queries_on_real_vectors(spark, small):
    vectors = {r["record_id"]: (r["profile_id"], np.frombuffer(r["vector"], "<f4").astype(float)) for r in embeddings.valid_vectors(spark, small).collect()}
    names = sorted(vectors)
    sim = lambda a, b: float(vectors[a][1] @ vectors[b][1] / np.linalg.norm(vectors[a][1]) / np.linalg.norm(vectors[b][1])) if vectors[a][0] == vectors[b][0] else -2.0
    near = {a: sorted((b for b in names if b != a and sim(a, b) > -2), key=lambda b: -sim(a, b))[:10] for a in names}
    expected = {(a, b) for a in names for b in near[a] if a < b and sim(a, b) >= 0.97 and a in near[b]}
    assert {tuple(r) for r in neighbours.p1_found(spark, small).collect()} == expected
    groups: dict = {}
    for a in names:
        groups.setdefault(next((g for g in groups if sim(g, a) >= 0.68), a), []).append(a)
    assert {tuple(r) for r in clusters.p2_found(spark, small).collect()} == {(g, m) for g, ms in groups.items() for m in ms if m != g}
    listed = {r["cluster_id"]: r for r in clusters.p2_clusters(spark, small).collect()}
    assert {g: len(ms) for g, ms in groups.items()} == {g: r["size"] for g, r in listed.items()}
    assert all(set(r["typical_records"]) <= set(groups[g]) and 1 <= len(r["typical_records"]) <= 3 for g, r in listed.items())


def test_visits_grow_with_the_cells(spark, small, monkeypatch):
    v = unit(np.random.default_rng(4).standard_normal((1600, 24)))
    df = frame(spark, v)
    got = lambda **x: pairs(neighbours.merge(neighbours.nearest(df, 10, shard_rows=40, visits=neighbours.WIDE_VISITS, beam=neighbours.WIDE_BEAM, margin=2.0, again=True, **x), 10, both_ways=True))
    wide = got(least_share=neighbours.WIDE_SHARE)
    assert recall(got(), v, 10) < 0.9 < recall(wide, v, 10)
    monkeypatch.setattr(neighbours, "VISITORS", 300)  # shards in copies: the same is found
    assert got(least_share=neighbours.WIDE_SHARE) == wide
    asked = {}
    monkeypatch.setattr(neighbours, "nearest", lambda *a, **x: asked.update(x) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        neighbours.p1_neighbours(spark, small)
    assert asked["least_share"] == neighbours.WIDE_SHARE


@pytest.mark.parametrize("block", [clusters.BLOCK, 0])
def test_markov_ends_or_says_so(spark, monkeypatch, block):
    monkeypatch.setattr(clusters, "BLOCK", block)
    chain = [(a, b, 0.9) for a in range(40) for b in (a - 1, a + 1) if 0 <= b < 40]
    df = spark.createDataFrame(chain, "src long, dst long, sim double")
    labels = {r["node"]: r["label"] for r in clusters.markov(df, Workspace(spark, "t"), "m").collect()}
    assert len(labels) == 40 and all(labels[x] == x for x in labels.values())
    with pytest.raises(Exception, match="still moves"):
        clusters.markov(df, Workspace(spark, "t"), "m", rounds=1)


def test_blocks_and_joins_give_the_same_labels(spark, monkeypatch):
    v, _ = grouped(20, 10, seed=4)
    src, dst, sim = hnsw.Hnsw(v, 1, 3).met()
    near = sim > 0.7
    df = spark.createDataFrame(list(zip(src[near].tolist(), dst[near].tolist(), sim[near].astype(float).tolist())), "src long, dst long, sim double")
    both = []
    for block in (clusters.BLOCK, 0):
        monkeypatch.setattr(clusters, "BLOCK", block)
        both.append({r["node"]: (r["label"], round(r["flow"], 4)) for r in clusters.markov(df, Workspace(spark, "t"), "m").collect()})
    assert both[0] == both[1] and len(set(both[0].values())) > 10


def test_roots_of_long_paths_and_circles(spark):
    to = {0: 5, 5: 9, 9: 5, **{i: i - 1 for i in range(11, 60)}, 10: 10}
    df = spark.createDataFrame(list(to.items()), "node long, to long")
    got = {r["node"]: r["label"] for r in clusters._roots(df, Workspace(spark, "t"), "r").collect()}
    assert got == {0: 5, 5: 5, 9: 5, **dict.fromkeys(range(10, 60), 10)}


def test_p2_equals_its_sql(spark, small):
    assert rows(clusters.p2_found(spark, small)) == rows(duck(small).execute(clusters.P2_SQL).df())


def test_typical_records_have_the_strongest_flow(spark):
    v, own = grouped(6, 30, seed=3)
    got = clusters.cluster(frame(spark, v), Workspace(spark, "t"), 0.75, with_flow=True).toPandas().set_index("id")
    for g in set(own.tolist()):
        part = got.loc[np.flatnonzero(own == g)]
        assert part["mass"].max() == (len(part) if len(part) > 1 else 0) and part["mass"].idxmax() in set(part["cluster"]) | {part.index[0]}


@pytest.mark.parametrize("rows_of", [clusters.ROWS, 60])
def test_p2_equals_its_sql_on_chains_and_wide_groups(spark, tmp_path, monkeypatch, rows_of):
    """Records linked in chains, where a group's least record is no partner of all; pairs about the threshold; many names out of order."""
    monkeypatch.setattr(clusters, "ROWS", rows_of)
    r = np.random.default_rng(11)
    turn = np.arange(90) * 0.3  # neighbours two places away reach 0.68, others don't
    chain = np.stack([np.cos(turn), np.sin(turn)], 1) @ np.linalg.qr(r.standard_normal((12, 2)))[0].T
    v = np.concatenate([unit(chain), unit(r.standard_normal((80, 12))), unit(np.ones((40, 12)) + 0.9 * r.standard_normal((40, 12)))])
    names = [f"r{i:03d}" for i in r.permutation(len(v))]
    references = [(n, "p" if i % 5 else "q", x.tolist()) for i, (n, x) in enumerate(zip(names, v))] + [("n1", None, v[0].tolist()), ("n2", None, v[0].tolist())]
    shard = ("s", "p", 12, "float32le", "d", bytearray(v[0].astype("<f4").tobytes()), {"0": "i0"})
    write(spark, str(tmp_path), [shard], [("i0", "r999", "p", ("s", 0, "d"), "b", "eligible")], references, [("r0", "e")])
    assert rows(clusters.p2_found(spark, str(tmp_path))) == rows(duck(str(tmp_path)).execute(clusters.P2_SQL).df())


@pytest.mark.parametrize("rows_of", [clusters.ROWS, 100])
def test_links_that_the_levels_miss_are_completed(spark, monkeypatch, rows_of):
    """Neighbour lists that hold a tenth of the links, or none: clusters are whole all the same."""
    monkeypatch.setattr(clusters, "ROWS", rows_of)
    v, own = grouped(20, 14, seed=12)
    same = lambda labels: {tuple(np.flatnonzero(labels == x)) for x in set(labels.tolist())}
    for tenths in (1, 0):
        kept = lambda df: df.where(F.pmod(F.hash("src"), F.lit(10)) < tenths)  # noqa: B023, E731
        monkeypatch.setattr(clusters, "nearest", lambda *a, then=None, **x: kept(neighbours.nearest(*a, **x)) if then is None else spark.createDataFrame([], then[1]))
        got = clusters.cluster(frame(spark, v), Workspace(spark, "t"), 0.75, with_flow=True).toPandas().set_index("id")
        assert same(got["cluster"].loc[range(len(v))].to_numpy()) == same(own)
        assert got.groupby("cluster")["mass"].max().to_dict() == {c: n if n > 1 else 0 for c, n in got.groupby("cluster").size().items()}
