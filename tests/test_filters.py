"""Filters against a plain two-valued evaluator, and refusals while compiling."""

from __future__ import annotations

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrand.operators.filters import FIELDS, Compiler, FilterRefused

ABSENT = object()
VALUES = [ABSENT, None, False, True, "", "a", "b"]
RECORDS = [{n: v for n, v in zip(FIELDS, vs) if v is not ABSENT} for vs in [(f"r{i}", VALUES[i % 7], VALUES[(i // 2) % 7], VALUES[(i // 7) % 7], VALUES[(3 * i) % 7]) for i in range(49)]]


def field(name):
    return {"kind": "canonical", "name": name}


def evaluate(e, record):
    ((op, v),) = e.items()
    if op == "all":
        return all([evaluate(c, record) for c in v])
    if op == "any":
        return any([evaluate(c, record) for c in v])
    if op == "not":
        return not evaluate(v, record)
    name = v["field"]["name"]
    held, there = record.get(name), name in record
    same = lambda x: type(held) is type(x) and held == x
    if op == "eq":
        return same(v["value"])
    if op == "in":
        return any(map(same, v["values"]))
    return {"missing": not there, "unavailable": False, "false": held is False, "present": there and held is not None and held is not False}[v["is"]]


names = st.sampled_from(FIELDS[1:])
scalars = st.sampled_from(["a", "b", "", True, False, 0])
leaf = st.one_of(
    st.builds(lambda n, v: {"eq": {"field": field(n), "value": v}}, names, scalars),
    st.builds(lambda n, v: {"in": {"field": field(n), "values": v}}, names, st.lists(scalars, min_size=1, max_size=3)),
    st.builds(lambda n, v: {"state": {"field": field(n), "is": v}}, names, st.sampled_from(["present", "missing", "false", "unavailable"])),
)
trees = st.recursive(leaf, lambda c: st.one_of(st.builds(lambda x: {"not": x}, c), st.builds(lambda k, x: {k: x}, st.sampled_from(["all", "any"]), st.lists(c, min_size=1, max_size=3))), max_leaves=6)


@pytest.fixture(scope="module")
def table(spark):
    texts = [json.dumps(r) for r in RECORDS]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", F.parse_json("t").alias("raw"))
    df = df.select("i", "raw", *(F.when(F.schema_of_variant(F.variant_get("raw", f"$.{n}", "variant")) == "STRING", F.try_variant_get("raw", f"$.{n}", "string")).alias(n) for n in FIELDS))
    return df.cache()


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(expressions=st.lists(trees, min_size=4, max_size=4))
def test_compiled_filters_equal_two_valued_logic(table, expressions):
    compiled = [Compiler(raw=F.col("raw")).compile(e).alias(f"c{k}") for k, e in enumerate(expressions)]
    for row in table.select("i", *compiled).collect():
        assert [row[f"c{k}"] for k in range(4)] == [evaluate(e, RECORDS[row["i"]]) for e in expressions]


@pytest.mark.parametrize(
    ("expression", "code"),
    [
        ({}, "validation_error"),
        ({"eq": {}, "in": {}}, "validation_error"),
        ({"all": []}, "validation_error"),
        ({"eq": {"field": "record_id", "value": "a"}}, "validation_error"),
        ({"eq": {"field": field("sequence_digest"), "value": "a"}}, "validation_error"),
        ({"eq": {"field": field("record_id"), "value": None}}, "validation_error"),
        ({"in": {"field": field("record_id"), "values": []}}, "validation_error"),
        ({"state": {"field": field("record_id"), "value": "missing"}}, "validation_error"),
        ({"range": {"field": field("record_id"), "unit": "bp", "gte": 1}}, "validation_error"),
        ({"range": {"field": field("record_id"), "unit": "bp", "gte": 1, "lt": 2}}, "unsupported_filter"),
        ({"eq": {"field": {"kind": "annotation", "source": "s", "predicate": "p"}, "value": "a"}}, "unsupported_filter"),
        ({"eq": {"field": {"kind": "annotation", "source": "", "predicate": "p"}, "value": "a"}}, "validation_error"),
        ({"relation": {"relation_type": "t", "direction": "outbound"}}, "unsupported_relation"),
        ({"relation": {"relation_type": "t", "direction": "both"}}, "validation_error"),
        ({"any": [{"eq": {"field": field("record_id"), "value": "a"}}, {"relation": {"relation_type": "t", "direction": "inbound"}}]}, "unsupported_relation"),
    ],
)
def test_refusals_come_before_any_row(expression, code):
    with pytest.raises(FilterRefused) as e:
        Compiler().compile(expression)
    assert e.value.code == code


def test_no_filter_selects_all(table):
    assert table.where(Compiler().compile(None)).count() == len(RECORDS)
