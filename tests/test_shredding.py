"""Nested JSON as adjacency rows and entity tables."""

from __future__ import annotations

import json

import pytest
from conftest import duck, rows
from pyspark.sql import functions as F

from lodestrand.operators import shredding


def load(text):
    def constant(_):
        raise ValueError

    return json.loads(text, parse_int=lambda x: 0, parse_constant=constant)


def brute(text):
    """Objects below the root by plain recursion."""
    out = []

    def go(v, path, owner):
        if isinstance(v, str) and v[:1] in ("{", "["):
            try:
                return go(load(v), path, owner)
            except ValueError:
                return None
        if isinstance(v, dict):
            if path:
                out.append((owner, path))
            for k, x in v.items():
                go(x, f"{path}/{k}", path)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                go(x, f"{path}/{i}", owner)
        return None

    try:
        go(load(text), "", "")
    except (TypeError, ValueError):
        return []
    return sorted(out)


BODIES = [
    None, "", " ", "null", "3", '"x"', "{", "{}", "[]", '[{"a":{}}]', ' {"a": [{"b": 1}, [{"c": {}}]]} ', '{"a":"{\\"b\\":{\\"c\\":\\"[{}]\\"}}"}', '{"a":"{broken"}', '{"a":" {}"}', '{"a":NaN}', '{"a":1} x',
    '{"a/b":{"":{}}}', '{"a":{"x":1},"a":{"y":{}}}', '{"n":' + "9" * 6000 + ',"o":{}}', '{"s":"\\ud800","o":{}}', '{"é":{"ß":{}}}', '{"a":[1,2,{"v":true}],}', "﻿{}", '{"a":"[]"}', '"{\\"a\\":{}}"', '{"a":01}', '{"a":"\t"}',
]


def test_objects_equal_brute_force(spark):
    df = spark.createDataFrame([(i, b, "other") for i, b in enumerate(BODIES)], "raw_id long, body string, node string")
    got = {}
    for r in shredding.objects(shredding.adjacency(df, "raw_id", "body"), "raw_id").collect():
        got.setdefault(r["raw_id"], []).append((r["parent"], r["node"]))
    for i, b in enumerate(BODIES):
        expected = [(p, n.replace("\ud800", "�")) for p, n in brute(b)]
        assert sorted(got.get(i, [])) == expected, b


def test_real_bodies_equal_brute_force(spark, small):
    bodies = {r["raw_id"]: r["body"] for r in spark.read.parquet(f"{small}/raw_contracts.parquet").select("raw_id", "body").collect()}
    got = {}
    for r in shredding.p5_found(spark, small).collect():
        got.setdefault(r["raw_id"], []).append((r["parent"], r["node"]))
    assert {k: v for k, b in bodies.items() if (v := brute(b))} == {k: sorted(v) for k, v in got.items()}


@pytest.mark.parametrize("text", [b for b in BODIES if b])
def test_both_parsers_agree(text):
    try:
        slow = True, shredding._iterative(text)
    except ValueError:
        slow = False, None
    assert slow == shredding.parse(text)


def test_deep_nesting_is_read():
    deep = '{"a":' * 30_000 + "{}" + "}" * 30_000
    assert shredding.parse(deep)[0] and not shredding.parse(deep[:-1])[0]


def test_entities_link_to_the_object_around(spark):
    body = json.dumps({"artifacts": [{"path": "p", "size": 1.50, "built": {"stage": "s"}}, {"path": None}, 3], "x": 1})
    df = spark.createDataFrame([(1, body), (1, body)], "raw_id long, body string").withColumn("path", F.lit("clash"))
    tree = shredding.adjacency(df, "raw_id", "body")
    got = shredding.entity(tree, "raw_id", "/artifacts/[0-9]+", ["path", "size"]).orderBy("node").collect()
    # both bodies count, each by itself
    assert [tuple(r) for r in got] == [(1, "/artifacts/0", "", "p", "1.5")] * 2 + [(1, "/artifacts/1", "", None, None)] * 2
    assert [tuple(r) for r in shredding.entity(tree, "raw_id", ".*/built", ["stage"]).collect()] == [(1, "/artifacts/0/built", "/artifacts/0", "s")] * 2


def test_long_paths_come_in_small_batches(spark):
    deep = "[" * 12_000 + "{}" + "]" * 12_000
    df = spark.createDataFrame([(1, deep)], "raw_id long, body string")
    assert shredding.objects(shredding.adjacency(df, "raw_id", "body"), "raw_id").select("parent").collect() == [("",)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "raw_id long, body string")
    assert shredding.objects(shredding.adjacency(df, "raw_id", "body"), "raw_id").count() == 0


def whole(text):
    """Objects (path, owner, kind) with their scalar members, and scalars (path, owner, text), by plain recursion."""
    objs, scalars = [], []

    def go(v, path, owner, kind):
        if isinstance(v, str) and v[:1] in ("{", "["):
            try:
                return go(json.loads(v, parse_int=str, parse_float=str), path, owner, kind)
            except ValueError:
                pass
        if isinstance(v, dict):
            objs.append((path, owner, kind, {k: x for k, x in v.items() if isinstance(x, str) and x[:1] not in ("{", "[")}))
            for k, x in v.items():
                go(x, f"{path}/{k}", path, k)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                go(x, f"{path}/{i}", owner if path else "", kind)
        elif v is not None:
            scalars.append((path, owner, v))

    go(json.loads(text, parse_int=str, parse_float=str), "", None, None)
    return objs, scalars


WHOLE = [
    {"artifacts": [{"path": "p", "size": 2, "built.by": {"stage": "s", "inputs": [{"path": "q", "digest": "d"}, ["x", {"path": "r"}]]}, "parts": [{"offset": 4, "holder": {"room": 5}}]}, "lone"], "odd": {"deep": {"z": "1"}}},
    {"artifacts": {"0": {"path": "in a map"}, "path": "no array"}, "artifacts/0": {"path": "clash"}},
    [{"validation": {"review_status": "ok", "checks": [{"check_id": "c", "sub_checks": [{"check_id": "e", "metric": {"value": 7}, "evidence": json.dumps([{"path": "t", "span": {"from": 1, "to": 2}}])}]}], "waivers": [{"reason": "w", "approvals": [{"by": "b", "at": {"day": 3}}]}]}}],
    {"model": {"revision": "r", "layers": [{"index": 0, "heads": [{"width": 8}]}], "lineage": {"revision": "l", "grown_from": {"revision": "g"}}}},
]


def test_every_object_and_scalar_is_in_one_table(spark, tmp_path):
    from lodestrand.plans import catalog

    bodies = [json.dumps(b) for b in WHOLE]
    spark.createDataFrame([(i, "x", b) for i, b in enumerate(bodies)], "raw_id long, contract string, body string").write.parquet(f"{tmp_path}/raw_contracts.parquet")
    tables = {name: [r.asDict() for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()] for name in [*catalog.QUERIES] if name.startswith("p5_") and name != "p5_found"}
    members = tables.pop("p5_members")
    got = sorted(((r["raw_id"], r["node"], r["parent"], r["kind"]) for rows in tables.values() for r in rows), key=str)
    held = [(i, *whole(b)) for i, b in enumerate(bodies)]
    assert got == sorted(((i, n, p, k) for i, objs, _ in held for n, p, k, _ in objs), key=str)
    assert sorted((r["raw_id"], r["node"], r["scalar"]) for r in members if r["scalar"] is not None) == sorted((i, n, v) for i, _, scalars in held for n, _, v in scalars)
    # pivoted members are those of the object itself, even where two objects have one path
    columns = lambda r: {c: v for c, v in r.items() if c not in ("raw_id", "node", "parent", "kind") and v is not None}
    pivoted = sorted(((r["raw_id"], r["node"], columns(r)) for name, rows in tables.items() if name != "p5_others" for r in rows), key=str)
    known = {k for kinds, _ in shredding.ENTITIES.values() for k in kinds}
    assert pivoted == sorted(((i, n, m) for i, objs, _ in held for n, _, k, m in objs if k in known), key=str)


def test_objects_of_one_path_or_key_are_not_merged(spark):
    bodies = [(1, '{"a/b":{"x":1},"a":{"b":{"x":2}}}'), (2, '{"o":{"x":1,"y":9}}'), (2, '{"o":{"x":5,"y":2}}')]
    tree = shredding.adjacency(spark.createDataFrame(bodies, "key long, body string"), "key", "body")
    got = sorted((r["key"], r["node"], r["x"], r["y"]) for r in shredding.entity(tree, "key", ".+", ["x", "y"]).where("x is not null").collect())
    assert got == [(1, "/a/b", "1", None), (1, "/a/b", "2", None), (2, "/o", "1", "9"), (2, "/o", "5", "2")]


def test_entity_tables_equal_their_sql(spark, small):
    con = duck(small)
    for name in ("p5_found", "p5_checks", "p5_others", "p5_members"):
        assert rows(shredding.QUERIES[name](spark, small)) == rows(con.execute(shredding.ORACLES[name]).df()), name
