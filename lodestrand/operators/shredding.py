"""Deeply nested JSON as flat tables: adjacency-table shredding.

Each body becomes rows of an adjacency table (doc, node, parent, owner, label, ordinal, kind, scalar, member, at, up):
doc tells bodies apart, at and up are the numbers of a node and of the object around it in its body, node and parent the
paths that they are spelt with. Object nodes joined with their scalar children and pivoted give the entity tables, one for each kind of object; `owner` keeps
the link to the object around a node. What is no object stands in one table of members, with its kind and its object.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ADJACENCY = "doc bigint, node string, parent string, owner string, label string, ordinal int, kind string, scalar string, member string, at int, up int"

_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null))')


class Number(str):
    """A number, kept as it is spelt: no digits are lost and none is too long."""


def _constant(_: str) -> None:
    raise ValueError("NaN and Infinity are no JSON")


_DECODER = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_constant)


def _iterative(text: str) -> object:
    """The value of a text that is nested too deeply for the recursive decoder; ValueError if it is no JSON."""
    at, stack, root = 0, [], []  # each entry of the stack: container, pending member name
    put: list = root
    name: str | None = None
    expect = "value"  # value, value-or-end, name, name-or-end, colon, comma-or-end, done
    while True:
        if expect == "done":
            if text[at:].strip(" \t\n\r"):
                raise ValueError("more than one value")
            return root[0]
        found = _TOKEN.match(text, at)
        if not found:
            raise ValueError("no JSON")
        at = found.end()
        mark, string, number, word = found.groups()
        if expect == "colon":
            if mark != ":":
                raise ValueError("a colon is missing")
            expect = "value"
            continue
        if expect in ("name", "name-or-end") and string is not None:
            name, expect = json.loads(string), "colon"
            continue
        if mark in ("}", "]"):
            closes = "}" if isinstance(put, dict) else "]"
            if not stack or mark != closes or expect not in ("comma-or-end", "value-or-end", "name-or-end"):
                raise ValueError("a bracket is out of place")
            put, name = stack.pop()
            expect = "comma-or-end" if stack else "done"
            continue
        if mark == ",":
            if expect != "comma-or-end":
                raise ValueError("a comma is out of place")
            expect = "name" if isinstance(put, dict) else "value"
            continue
        if expect not in ("value", "value-or-end") or mark == ":":
            raise ValueError("a value is out of place")
        value = {} if mark == "{" else [] if mark == "[" else json.loads(string) if string is not None else Number(number) if number is not None else {"true": True, "false": False, "null": None}[word]
        if isinstance(put, dict):
            put[name] = value
        else:
            put.append(value)
        if mark in ("{", "["):
            stack.append((put, name))
            put, name, expect = value, None, "name-or-end" if mark == "{" else "value-or-end"
        else:
            expect = "comma-or-end" if stack else "done"


def parse(text: str | None) -> tuple[bool, object]:
    """Whether the text is as a whole one valid JSON value, and the value. Of equal member names the last one counts."""
    if not text:
        return False, None
    try:
        return True, _DECODER.decode(text.strip(" \t\n\r"))
    except ValueError:
        return False, None
    except RecursionError:
        try:
            return True, _iterative(text)
        except ValueError:
            return False, None


def nodes(text: str | None) -> Iterator[tuple]:
    """The adjacency rows of one body, the root first, with path "". A string that is JSON of an object or array counts as that."""
    valid, value = parse(text)
    if not valid:
        return
    # parent: the container around; owner: the nearest object around; member: the name in owner that leads here
    # at, up: numbers of the node and of its owner in the body, as names that hold "/" can give two nodes one path
    todo = [("", None, None, None, None, value, None, None)]
    at = -1
    while todo:
        node, parent, owner, label, ordinal, value, member, up = todo.pop()
        at += 1
        place = member, at, up
        while isinstance(value, str) and not isinstance(value, Number) and value[:1] in ("{", "["):
            inner, held = parse(value)
            if not inner:
                break
            value = held
        if isinstance(value, dict):
            yield node, parent, owner, label, ordinal, "object", None, *place
            todo.extend((f"{node}/{k}", node, node, k, i, v, k, at) for i, (k, v) in reversed(list(enumerate(value.items()))))
        elif isinstance(value, list):
            yield node, parent, owner, label, ordinal, "array", None, *place
            todo.extend((f"{node}/{i}", node, owner, str(i), i, v, member, up) for i, v in reversed(list(enumerate(value))))
        elif value is None:
            yield node, parent, owner, label, ordinal, "null", None, *place
        elif isinstance(value, bool):
            yield node, parent, owner, label, ordinal, "boolean", "true" if value else "false", *place
        else:
            yield node, parent, owner, label, ordinal, "number" if isinstance(value, Number) else "string", str(value), *place


def _clean(text: str | None) -> str | None:
    """Arrow holds UTF-8 only; a lone surrogate, which JSON can spell, becomes U+FFFD."""
    return text if text is None or text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def adjacency(df: DataFrame, key: str, body: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The adjacency table of every body: the key, the columns of keep and those of ADJACENCY.

    Bodies that are null, empty or not as a whole valid JSON give no row; every row of df counts by itself, repeated or
    not. The root is a node "" with null parent and owner; an object right below it, or below arrays only, has owner
    "" if the root is an object and null if it is an array. Other columns of df, whatever their names, are left out.
    No shuffle: each body is shredded where it is read.
    """
    out = [key, *keep]
    source = df.select(*(df[c] for c in out), df[body].alias("__body")).where(F.col("__body").isNotNull()).withColumn("__doc", F.monotonically_increasing_id())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-2]) + ", " + ADJACENCY
    width, most, longest = len(out), 50_000, 8 << 20  # rows and characters of paths of a batch

    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 4 + [pa.int32()] + [pa.string()] * 3 + [pa.int32()] * 2
        for batch in batches:
            at: list[int] = []
            cells: list[list] = [[] for _ in kinds]
            size = 0

            def made() -> pa.RecordBatch:
                rows = pa.array(at, pa.int64())
                heads = [batch.column(i).take(rows) for i in (*range(width), width + 1)]
                got = [pa.array([_clean(x) for x in c] if k == pa.string() else c, k) for c, k in zip(cells, kinds)]
                return pa.RecordBatch.from_arrays(heads + got, names=[*out, "doc", "node", "parent", "owner", "label", "ordinal", "kind", "scalar", "member", "at", "up"])

            for row, text in enumerate(batch.column(width)):
                for node in nodes(text.as_py()):
                    at.append(row)
                    size += len(node[0])
                    for cell, value in zip(cells, node):
                        cell.append(value)
                    if len(at) >= most or size >= longest:
                        yield made()
                        at, cells, size = [], [[] for _ in kinds], 0
            if at:
                yield made()

    return source.mapInArrow(shred, schema)


def objects(tree: DataFrame, key: str) -> DataFrame:
    """One row for each object below the root: key, parent (path of the nearest object around, else ""), node."""
    return tree.where("kind = 'object' and node <> ''").select(F.col(key), F.coalesce("owner", F.lit("")).alias("parent"), "node")


def entity(tree: DataFrame, key: str, pattern: str, members: list[str]) -> DataFrame:
    """The entity table of the objects whose path fits the regular expression as a whole.

    Columns: key, node, parent, then one text column for each member; null where it is absent, null or no scalar.
    """
    return pivoted(tree, key, F.col("node").rlike(f"^(?:{pattern})$"), F.col("parent").rlike(f"^(?:{pattern})$"), members, [])


def pivoted(tree: DataFrame, key: str, nodes_of: Column, scalars_of: Column, members: list[str], more: list[str]) -> DataFrame:
    """Object nodes joined with their scalar children, one text column for each member name; `more` are further columns of the node.

    nodes_of chooses among object nodes; scalars_of, of the scalars right below an object, at least those below a chosen one.
    Both sides meet by (key, doc, number of the node) in one grouping, a co-partitioned union with a conditional maximum,
    not a join of the tree with itself. Numbers, not paths, are compared: names that hold "/" can give two nodes one path,
    and two bodies may have one key.
    """
    is_node = (F.col("kind") == "object") & nodes_of
    scalar = F.col("kind").isin("string", "number", "boolean") & F.col("label").isin(*members) & F.coalesce(F.col("parent") == F.col("owner"), F.lit(False)) & scalars_of
    node = F.struct("node", _link().alias("parent"), *more)
    sides = tree.where(is_node | scalar).select(F.col(key), "doc", F.when(is_node, F.col("at")).otherwise(F.col("up")).alias("__at"), F.when(is_node, node).alias("__object"), F.col("label").alias("__label"), F.col("scalar").alias("__scalar"))
    child = lambda m: F.max(F.when(F.col("__object").isNull() & (F.col("__label") == m), F.col("__scalar"))).alias(m)
    return sides.groupBy(key, "doc", "__at").agg(F.max("__object").alias("__object"), *map(child, members)).where("__object is not null").select(key, "__object.node", "__object.parent", *(f"__object.{m}" for m in more), *members)


#: The entity tables by query: the member names whose objects they hold (None: the root, or objects of arrays that are
#: the root) and the columns. Objects of any other member are in p5_others, and all scalars in p5_members.
ENTITIES: dict[str, tuple[tuple[str | None, ...], tuple[str, ...]]] = {
    "p5_contracts": ((None,), ("release_id", "schema_version", "state", "created_at", "base_release", "version", "lifecycle", "profile_id", "citation")),
    "p5_artifacts": (("artifacts",), ("path", "media_type", "digest", "size", "contract_version")),
    "p5_built": (("built.by",), ("stage",)),
    "p5_inputs": (("inputs",), ("path", "digest")),
    "p5_parts": (("parts",), ("offset",)),
    "p5_holders": (("holder",), ("room",)),
    "p5_validation": (("validation",), ("review_status",)),
    "p5_checks": (("checks", "sub_checks"), ("check_id", "status")),
    "p5_metrics": (("metric",), ("name", "value", "direction")),
    "p5_evidence": (("evidence",), ("path",)),
    "p5_spans": (("span",), ("from", "to")),
    "p5_waivers": (("waivers",), ("reason",)),
    "p5_approvals": (("approvals",), ("by",)),
    "p5_approval_times": (("at",), ("day",)),
    "p5_model": (("model",), ("artifact", "revision", "content_digest", "notes")),
    "p5_layers": (("layers",), ("index",)),
    "p5_heads": (("heads",), ("width",)),
    "p5_lineage": (("lineage", "grown_from"), ("revision",)),
}


def _of_kind(kinds: tuple[str | None, ...]) -> Column:
    """Whether a node's member is one of these; never null."""
    found = F.coalesce(F.col("member").isin(*(k for k in kinds if k is not None)), F.lit(False))
    return found | F.col("member").isNull() if None in kinds else found


def _link() -> Column:
    """The path of the nearest object around: "" where that is the root or there is none, null for the root itself."""
    return F.when(F.col("node") != "", F.coalesce("owner", F.lit("")))


def entities(tree: DataFrame, key: str, kinds: tuple[str | None, ...], columns: tuple[str, ...]) -> DataFrame:
    """The entity table of the objects that stand in a member of these names, wherever that is, in arrays of any depth or not.

    Columns: key, node, parent, kind (the member's name), then one text column for each of `columns`; null where it is absent, null or no
    scalar. parent is "" where the object around is the root or there is none, null for the root itself.
    """
    return pivoted(tree.withColumn("of", F.col("member")), key, _of_kind(kinds), F.lit(True), list(columns), ["of"]).withColumnRenamed("of", "kind")


def contract_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/raw_contracts.parquet")
    return adjacency(raw, "raw_id", "body", ("contract",))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object below the root of each body of raw_contracts, with the object around it."""
    return objects(contract_tree(spark, sf_dir), "raw_id")


def _entity_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return entities(contract_tree(spark, sf_dir), "raw_id", *ENTITIES[name])

    query.__name__ = query.__qualname__ = name
    return query


def p5_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objects of every member that has no entity table, one row each; their scalars are in p5_members."""
    known = tuple(k for kinds, _ in ENTITIES.values() for k in kinds)
    return contract_tree(spark, sf_dir).where((F.col("kind") == "object") & ~_of_kind(known)).select("raw_id", "node", _link().alias("parent"), F.col("member").alias("kind"))


def p5_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that is no object, one row each: scalars and nulls, also within arrays, and the arrays.

    parent is the path of the object around, member the name in it, label the own name or place, kind the JSON type.
    """
    return contract_tree(spark, sf_dir).where("kind <> 'object'").select("raw_id", "node", _link().alias("parent"), "member", "label", "kind", "scalar")


#: All of a body: each object is in one of the entity tables or p5_others, all else in p5_members.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p5_found": p5_found, **{name: _entity_query(name) for name in ENTITIES}, "p5_others": p5_others, "p5_members": p5_members}


#: All nodes of all bodies in SQL; paths in json_extract are JSON pointers.
_TREE_SQL = """WITH RECURSIVE tree AS (
  SELECT raw_id, '' AS node, NULL::VARCHAR AS parent, NULL::VARCHAR AS owner, NULL::VARCHAR AS label, NULL::VARCHAR AS member, body::JSON AS v FROM raw_contracts WHERE body IS NOT NULL AND json_valid(body)
  UNION ALL
  SELECT raw_id, node, parent, owner, label, member, CASE WHEN json_type(v) = 'VARCHAR' AND left(v ->> '$', 1) IN ('{', '[') AND json_valid(v ->> '$') THEN (v ->> '$')::JSON ELSE v END
  FROM (SELECT raw_id, node || '/' || k AS node, node AS parent, CASE WHEN json_type(v) = 'OBJECT' THEN node ELSE owner END AS owner, k AS label, CASE WHEN json_type(v) = 'OBJECT' THEN k ELSE member END AS member, json_extract(v, '/' || replace(replace(k, '~', '~0'), '/', '~1')) AS v
    FROM (SELECT *, unnest(CASE json_type(v) WHEN 'OBJECT' THEN list_distinct(json_keys(v)) WHEN 'ARRAY' THEN list_transform(range(json_array_length(v)::BIGINT), lambda i: i::VARCHAR) ELSE [] END) AS k FROM tree))),
kinds AS (SELECT * EXCLUDE (v), v, CASE json_type(v) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string' ELSE 'number' END AS kind, CASE WHEN node <> '' THEN coalesce(owner, '') END AS link FROM tree)"""


def _entity_sql(kinds: tuple[str | None, ...], columns: tuple[str, ...]) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    named = [quoted(k) for k in kinds if k is not None]
    fits = " OR ".join([f"member IN ({', '.join(named)})"] * bool(named) + ["member IS NULL"] * (None in kinds))
    child = lambda c: f"(SELECT max(CASE WHEN s.kind IN ('string', 'number', 'boolean') THEN s.v ->> '$' END) FROM kinds s WHERE s.raw_id = o.raw_id AND s.parent = o.node AND s.label = {quoted(c)})"
    return f"{_TREE_SQL} SELECT raw_id, node, link AS parent, member AS kind, {', '.join(f'{child(c)} AS {chr(34)}{c}{chr(34)}' for c in columns)} FROM kinds o WHERE kind = 'object' AND ({fits})"


_KNOWN = ", ".join(f"'{k}'" for kinds, _ in ENTITIES.values() for k in kinds if k is not None)
ORACLES: dict[str, str] = {
    "p5_found": f"{_TREE_SQL} SELECT raw_id, link AS parent, node FROM kinds WHERE kind = 'object' AND node <> ''",
    **{name: _entity_sql(*spec) for name, spec in ENTITIES.items()},
    "p5_others": f"{_TREE_SQL} SELECT raw_id, node, link AS parent, member AS kind FROM kinds WHERE kind = 'object' AND member NOT IN ({_KNOWN})",
    "p5_members": f"{_TREE_SQL} SELECT raw_id, node, link AS parent, member, label, kind, CASE WHEN kind IN ('string', 'number', 'boolean') THEN v ->> '$' END AS scalar FROM kinds WHERE kind <> 'object'",
}
