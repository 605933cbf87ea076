"""Contracts as closed shapes: what members an object has, of what kind, checked on the driver; and their Spark schemas."""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import types as T


class ContractError(ValueError):
    """A value that isn't of its contract."""


#: Kinds: text (with something besides white space), whole, positive, object, filled (an object with members), array, texts, time, path. A ? marks an optional member.
SHAPES: dict[str, dict[str, str]] = {
    "artifact": {"path": "path", "media_type": "text", "digest": "text", "size": "whole", "contract_version": "text"},
    "release-manifest": {"release_id": "text", "schema_version": "text", "state": "text", "scope": "filled", "created_at": "time?", "base_release": "text?", "citation": "object?", "licenses": "array", "artifacts": "array", "validation": "object"},
    "record": {n: "text" for n in ("record_id", "entity_id", "sequence_digest", "canonicalization_id", "source_provenance_id", "lifecycle_state")},
    "entity": {"entity_id": "text", "entity_type": "text", "record_versions": "texts", "aliases": "array?"},
    "instance": {"instance_id": "text", "record_id": "text", "profile_id": "text", "vector_reference": "filled", "created_in": "text", "runner_provenance": "filled", "eligibility_status": "text"},
    "shard": {"profile_id": "text", "shard_id": "text", "dimension": "whole", "dtype": "text", "row_mapping": "object", "digest": "text", "build_provenance": "object"},
    "embedding-profile": {**dict.fromkeys(("profile_id", "version", "lifecycle"), "text"), **dict.fromkeys(("input_contract", "model", "tokenization", "pooling", "output", "metric", "compatibility", "provenance"), "filled"), "preprocessing": "object", "validation_links": "texts"},
    "stage": {"stage_id": "text", "input_artifacts": "array", "output_artifacts": "array", "exclusions": "array?", "outcome": "text", "verification": "object", "recovery": "object?"},
}
ENUMS = {("release-manifest", "state"): ("Draft", "Candidate", "Published", "Superseded", "Withdrawn"), ("stage", "outcome"): ("succeeded", "failed", "quarantined", "reused")}
#: Members that an object within a contract must have at least; it may have others.
WITHIN = {
    ("embedding-profile", "model"): dict.fromkeys(("artifact", "revision", "content_digest"), "text"),
    ("embedding-profile", "output"): {"dimension": "positive", "dtype": "text"},
    ("embedding-profile", "metric"): dict.fromkeys(("name", "direction"), "text"),
    ("embedding-profile", "provenance"): dict.fromkeys(("plugin_descriptor", "runner_environment", "determinism"), "text"),
}
RECORDS = T.StructType([T.StructField(n, T.StringType(), False) for n in SHAPES["record"]])
ENTITIES = T.StructType([T.StructField("entity_id", T.StringType(), False), T.StructField("entity_type", T.StringType(), False), T.StructField("record_versions", T.ArrayType(T.StringType(), False), False)])
REFERENCE = T.StructType([T.StructField("shard_id", T.StringType()), T.StructField("row", T.LongType()), T.StructField("shard_digest", T.StringType())])


def utc(text: object) -> str:
    """An ISO time with offset in UTC with Z; a time without offset is an error."""
    try:
        time = datetime.fromisoformat(text)  # type: ignore[arg-type]
    except (TypeError, ValueError) as e:
        raise ContractError(f"no ISO time: {text!r}") from e
    if time.tzinfo is None:
        raise ContractError(f"a time without offset: {text!r}")
    return time.astimezone(timezone.utc).isoformat().replace("+00:00", "Z")


def _fits(kind: str, value: object) -> bool:
    match kind:
        case "text":
            return isinstance(value, str) and bool(value.strip())
        case "path":
            return isinstance(value, str) and value not in ("", ".") and not value.startswith("/") and "\\" not in value and ".." not in value.split("/")
        case "whole":
            return isinstance(value, int) and not isinstance(value, bool) and value >= 0
        case "positive":
            return _fits("whole", value) and value > 0
        case "object":
            return isinstance(value, Mapping)
        case "filled":
            return isinstance(value, Mapping) and bool(value)
        case "array":
            return isinstance(value, (list, tuple))
        case "texts":
            return isinstance(value, (list, tuple)) and all(_fits("text", v) for v in value)
        case "time":
            return bool(utc(value))
    raise KeyError(kind)


def check(contract: str, value: object) -> dict:
    """The value as a dict if it has exactly the members of the contract, each of its kind, times in UTC."""
    shape = SHAPES[contract]
    if not isinstance(value, Mapping):
        raise ContractError(f"{contract}: no object")
    needed = {n for n, k in shape.items() if not k.endswith("?")}
    if not needed <= set(value) <= set(shape):
        raise ContractError(f"{contract}: members missing {sorted(needed - set(value))}, unknown {sorted(set(value) - set(shape))}")
    out = {}
    for name, held in value.items():
        kind = shape[name].removesuffix("?")
        if not _fits(kind, held) or held not in ENUMS.get((contract, name), (held,)):
            raise ContractError(f"{contract}: {name} is not of its kind")
        lacking = [n for n, k in WITHIN.get((contract, name), {}).items() if not _fits(k, held.get(n))]
        if lacking:
            raise ContractError(f"{contract}: {name}.{lacking[0]} is not of its kind")
        out[name] = utc(held) if kind == "time" else held
    if contract == "release-manifest":
        out["artifacts"] = [check("artifact", a) for a in out["artifacts"]]
    return out


def to_json(contract: str, value: object) -> str:
    """Compact JSON with sorted members."""
    return json.dumps(check(contract, value), sort_keys=True, separators=(",", ":"))


def from_json(contract: str, text: str) -> dict:
    try:
        value = json.loads(text)
    except (TypeError, ValueError) as e:
        raise ContractError(f"{contract}: no JSON") from e
    return check(contract, value)
