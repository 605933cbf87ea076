"""Verification of a release package and the handle that queries are answered from.

The package is copied to the shared folder first, hashed as it is copied, and all else is read from that copy: what was
hashed is what is parsed, and later changes of the package have no effect. The driver reads the few control documents;
copying, table checks and vector gates are Spark jobs over all files and rows.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import floats
from lodestrand.operators import accounting, similarity
from lodestrand.session import Workspace
from lodestrand.sources import files
from lodestrand.sources.vectors import read_float32

# Places, media types and members of a package.
MANIFEST = "release-manifest.json"
RECORDS, ENTITIES = "records/genome-record-versions.jsonl", "records/atlas-entities.jsonl"
VECTORS, SHARD, INSTANCES = "embeddings/vectors.float32le", "embeddings/vector-shard-manifest.json", "embeddings/embedding-instances.jsonl"
CANONICAL, STAGES, PROFILES = "records/canonical/", "provenance/stages/", "profiles/"
SOURCE, BUILDS = "provenance/source/source-provenance.json", "provenance/build/"
LINES_TYPE, JSON_TYPE, VECTOR_TYPE = "application/x-ndjson", "application/json", "application/octet-stream"
MANIFEST_NEEDED = {"release_id", "schema_version", "state", "scope", "licenses", "artifacts", "validation"}
MANIFEST_ALSO = {"created_at", "base_release", "citation"}
DESCRIPTOR = {"path", "media_type", "digest", "size", "contract_version"}
RECORD_FIELDS = {name: "string" for name in ("record_id", "entity_id", "sequence_digest", "canonicalization_id", "source_provenance_id", "lifecycle_state")}
INSTANCE_FIELDS = {"instance_id": "string", "record_id": "string", "profile_id": "string", "vector_reference": "struct<shard_id:string,row:bigint,shard_digest:string>", "created_in": "string", "eligibility_status": "string"}
CHECKS = ("release-manifest-schema-and-inventory", "canonical-record-and-entity-integrity", "embedding-instance-and-vector-integrity", "logical-release-reconstruction", "provenance-license-and-stage-policy", "credential-scan")


class ReleaseRefused(Exception):
    """A package that isn't there (release_not_found) or fails a check (release_untrusted)."""

    def __init__(self, message: str, code: str = "release_untrusted") -> None:
        self.code, self.message = code, message
        super().__init__(message)


@dataclass(frozen=True)
class Policy:
    """What a package must hold beyond its own consistency. None: not asked for."""

    state: str | None = "Draft"
    records: int | None = None
    dimension: int | None = None
    canonicalization_id: str | None = None
    lifecycle_state: str | None = "eligible"
    namespace: str | None = None  # record ids are namespace:accession:canonicalization_id
    distribution: str | None = None
    license_scope: str | None = None  # of the source provenance's license notice
    environment: str | None = None  # id that plugin, environment declaration and build manifest must agree on
    stages: tuple[str, ...] = ()  # names of stage envelopes that must be there
    profile: dict | None = None  # leaves that a profile declaration must have, of those that Release.profile names


def _need(holds: bool, message: str) -> None:
    if not holds:
        raise ReleaseRefused(message)


def _document(root: str, path: str) -> dict:
    try:
        return files.read_document(os.path.join(root, path))
    except (OSError, ValueError) as e:
        raise ReleaseRefused(f"cannot read JSON: {path}") from e


def is_safe_path(path: object) -> bool:
    """The rule of texts.is_safe_path for one path."""
    return isinstance(path, str) and path not in ("", ".") and not path.startswith("/") and "\\" not in path and ".." not in path.split("/")


def check_manifest(manifest: dict, policy: Policy) -> list[dict]:
    """The descriptors of a manifest of the closed shape."""
    _need(set(manifest) >= MANIFEST_NEEDED and set(manifest) <= MANIFEST_NEEDED | MANIFEST_ALSO, "the manifest's members are not those of the contract")
    _need(policy.state is None or manifest["state"] == policy.state, f"the release state is not {policy.state}")
    _need(isinstance(manifest["scope"], dict), "the scope is no object")
    _need(policy.distribution is None or manifest["scope"].get("distribution") == policy.distribution, "the scope is not the approved one")
    artifacts = manifest["artifacts"]
    _need(isinstance(artifacts, list) and bool(artifacts), "the manifest has no artifacts")
    for a in artifacts:
        _need(isinstance(a, dict) and set(a) == DESCRIPTOR and isinstance(a["size"], int) and not isinstance(a["size"], bool) and a["size"] >= 0, "an artifact descriptor is not of the contract")
        _need(all(isinstance(a[k], str) for k in DESCRIPTOR - {"size"}), "an artifact descriptor is not of the contract")
        _need(is_safe_path(a["path"]), "the manifest has an unsafe artifact path")
    paths = [a["path"] for a in artifacts]
    _need(len(set(paths)) == len(paths) and MANIFEST not in paths, "the artifact inventory is not unique")
    return artifacts


def logical_digest(release_id: str, records: DataFrame, entities: DataFrame, instances: DataFrame, vector_digest: str) -> str:
    """The digest of the release graph: compact ASCII JSON with sorted members, hashed as its rows stream by in order.

    Rows are sorted and spelt on the executors, a batch of them to one value; the driver only hashes, as the digest is one.
    """
    own = hashlib.sha256()
    dump = lambda v: json.dumps(v, sort_keys=True, separators=(",", ":"))

    def part(name: str, df: DataFrame, order: str, shape) -> None:  # noqa: ANN001
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array([",".join(dump(shape(r)) for r in batch.to_pylist()).encode()], pa.binary())], names=["data"])

        own.update(f'"{name}":['.encode())
        for i, row in enumerate(df.orderBy(order).mapInArrow(pack, "data binary").toLocalIterator(prefetchPartitions=True)):
            own.update((b"," if i else b"") + row["data"])
        own.update(b"],")

    own.update(b"{")
    part("entities", entities, "entity_id", lambda r: {"entity_id": r["entity_id"], "record_versions": sorted(r["record_versions"])})
    part("instances", instances, "vector_reference.row", lambda r: {"record_id": r["record_id"], "profile_id": r["profile_id"], "vector_reference": r["vector_reference"]})
    part("records", records, "record_id", lambda r: {k: r[k] for k in ("record_id", "entity_id", "sequence_digest")})
    own.update(f'"release_id":{dump(release_id)},"vector_shard_digest":{dump(vector_digest)}}}'.encode())
    return f"sha256:{own.hexdigest()}"


@dataclass
class Release:
    """An open release: verified tables, written once, and the declarations that requests are bound to."""

    release_id: str
    digest: str
    manifest: dict
    artifacts: dict[str, dict]
    records: DataFrame
    instances: DataFrame
    vectors: DataFrame  # row, vector
    shard: dict
    shard_digest: str
    profile: dict | None
    report: dict
    work: Workspace = field(repr=False)
    root: str = field(default="", repr=False)  # the verified copy

    @cached_property
    def binding(self) -> tuple[DataFrame | None, str | None]:
        """Records with entity, filter fields, raw and vector, one row each; or None and why they can't be bound."""
        mapping = self.shard["row_mapping"]
        spark = self.records.sparkSession
        if not all(k.removeprefix("-").isdigit() for k in mapping):
            return None, "vector-shard row mapping is invalid"
        named = spark.createDataFrame([(int(k), v) for k, v in mapping.items()], "row bigint, instance_id string")
        ref = F.col("vector_reference")
        own = self.instances.where((F.col("profile_id") == self.shard["profile_id"]) & (ref.shard_id == self.shard["shard_id"]) & (ref.shard_digest == self.shard_digest))
        faults = similarity.binding_faults(self.records, own, named).select("fault").distinct().collect()
        kinds = {r["fault"] for r in faults}
        if kinds - {"uncovered_record"}:
            return None, "vector-shard row mapping cannot be bound to records"
        if kinds or not mapping:
            return None, "vector-shard rows do not cover the verified records"
        bound = similarity.bind(self.records, own, named, self.shard["profile_id"], self.shard["shard_id"], self.shard_digest).select("record_id", "row")
        rows = bound.join(self.records, "record_id").join(self.vectors, "row", "left")
        return self.work.write(rows, "bound"), None

    def table(self, path: str) -> DataFrame:
        """A JSON-lines table by its manifest path, nothing else; KeyError or ValueError otherwise.

        Records and instances come with their fields, any other declared table as `raw`, each line as VARIANT.
        """
        if path not in self.artifacts:
            raise KeyError(f"the manifest has no artifact {path}")
        if self.artifacts[path]["media_type"] != LINES_TYPE:
            raise ValueError(f"{path} is no JSON-lines table")
        known = {RECORDS: self.records, INSTANCES: self.instances}
        return known[path] if path in known else files.read_lines(self.work.spark, f"{self.root}/{path}", {})

    def close(self) -> None:
        self.work.clear()


def verify(spark: SparkSession, root: str, policy: Policy = Policy()) -> Release:
    """Checks a package directory and opens it; ReleaseRefused if a check fails. See CHECKS for what is reported."""
    if not os.path.isdir(root):
        raise ReleaseRefused("release package directory does not exist", "release_not_found")
    _need(not os.path.islink(root), "release package directory must not be a symbolic link")
    links = [p for p, folders, names in os.walk(root) for n in [*folders, *names] if os.path.islink(os.path.join(p, n))]
    _need(not links, "an artifact lies outside the package")
    work = Workspace(spark, "release")
    copied = work.write(files.copy_tree(spark, root, work.path("snapshot")), "artifacts")
    root = work.path("snapshot")
    manifest = _document(root, MANIFEST)
    manifest_digest = copied.where(F.col("path") == MANIFEST).first()["digest"]
    descriptors = check_manifest(manifest, policy)
    by_path = {a["path"]: a for a in descriptors}
    declared = spark.createDataFrame([tuple(a[k] for k in sorted(DESCRIPTOR)) for a in descriptors], "contract_version string, digest string, media_type string, path string, size bigint")
    held = copied.where(F.col("path") != MANIFEST)
    fault = accounting.inventory(declared, held).orderBy("path").take(1)
    _need(not fault, f"inventory: {fault[0]['fault']}: {fault[0]['path']}" if fault else "")
    actual = files.read_artifacts(spark, root, content=True).where(F.col("path") != MANIFEST)
    for needed in (RECORDS, ENTITIES, VECTORS, SHARD, INSTANCES):
        _need(needed in by_path, f"the package lacks {needed}")
    for path, kind in ((VECTORS, VECTOR_TYPE), (SHARD, JSON_TYPE), (RECORDS, LINES_TYPE), (INSTANCES, LINES_TYPE)):
        _need(by_path[path]["media_type"] == kind, f"{path} is not declared as {kind}")

    at = lambda p: os.path.join(root, p)
    records = work.write(files.read_lines(spark, at(RECORDS), RECORD_FIELDS).select(F.to_json("raw").alias("raw_text"), *RECORD_FIELDS), "records")
    entities = work.write(files.read_lines(spark, at(ENTITIES), {"entity_id": "string", "entity_type": "string", "record_versions": "array<string>"}).drop("raw"), "entities")
    n_records = _check_records(records, entities, held, policy)

    shard = _document(root, SHARD)
    dimension = shard.get("dimension")
    _need(isinstance(dimension, int) and not isinstance(dimension, bool) and dimension > 0 and isinstance(shard.get("row_mapping"), dict), "the shard declaration is not of the contract")
    _need(all(isinstance(shard.get(k), str) for k in ("profile_id", "shard_id", "digest", "dtype")) and all(isinstance(v, str) for v in shard["row_mapping"].values()), "the shard declaration is not of the contract")
    _need(policy.dimension in (None, dimension), "the shard's dimension is not the expected one")
    _need(shard["digest"] == by_path[VECTORS]["digest"], "the shard declaration does not match the vector bytes")
    _need(by_path[VECTORS]["size"] == n_records * dimension * 4, "the vector bytes do not cover the records")
    vectors = work.write(read_float32(spark, at(VECTORS), dimension), "vectors")
    _need(not vectors.where(~floats.passes_package_gate(F.col("vector"))).take(1), "the shard holds a vector that is not finite or not of length 1")
    instances = work.write(files.read_lines(spark, at(INSTANCES), INSTANCE_FIELDS).drop("raw"), "instances")
    _check_instances(instances, records, shard, n_records)
    profile = _profile(root, by_path, shard)
    _need(profile is None or policy.profile is None or policy.profile.items() <= profile.items(), "the profile declaration is not the expected one")
    _check_stages(actual, policy)
    _check_provenance(root, by_path, shard, policy)
    _need(not accounting.credential_faults(actual).take(1), "the package holds what looks like credentials")
    logical = logical_digest(manifest["release_id"], records, entities, instances, shard["digest"])
    details = ({"artifact_count": len(descriptors)}, {"record_count": n_records}, {"vector_shard_digest": shard["digest"]}, {"logical_release_digest": logical}, {}, {})
    report = {"release_id": manifest["release_id"], "release_manifest_digest": manifest_digest, "state": manifest["state"], "record_count": n_records, "artifact_count": len(descriptors), "vector_shard_digest": shard["digest"], "logical_release_digest": logical, "checks": [{"id": c, "status": "passed"} | d for c, d in zip(CHECKS, details)]}
    return Release(manifest["release_id"], manifest_digest, manifest, by_path, records, instances, vectors, shard, shard["digest"], profile, report, work, root)


def record_counts(records: DataFrame, policy: Policy) -> DataFrame:
    """One row: n, distinct ids, and how many records are incomplete or not of the policy's state, canonicalisation or form."""
    complete = F.lit(True)
    for name in RECORD_FIELDS:
        complete = complete & F.coalesce(F.col(name) != "", F.lit(False))
    state = F.lit(True) if policy.lifecycle_state is None else F.col("lifecycle_state") == policy.lifecycle_state
    canon = F.lit(True) if policy.canonicalization_id is None else F.col("canonicalization_id") == policy.canonicalization_id
    form = F.lit(True) if policy.namespace is None else F.col("record_id").startswith(policy.namespace + ":") & F.col("record_id").endswith(F.concat(F.lit(":"), F.col("canonicalization_id")))
    return records.agg(F.count("*").alias("n"), F.count_distinct("record_id").alias("ids"), *(F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in (("complete", complete), ("state", state), ("canon", canon), ("form", form))))


def _check_records(records: DataFrame, entities: DataFrame, actual: DataFrame, policy: Policy) -> int:
    counted = record_counts(records, policy).first()
    _need(counted["n"] > 0 and policy.records in (None, counted["n"]), "the package does not hold the expected number of records")
    _need(counted["complete"] == 0, "a record is not of the contract")
    _need(counted["state"] == 0 and counted["canon"] == 0, "a record does not satisfy the eligibility policy")
    _need(counted["ids"] == counted["n"], "a record identifier stands twice")
    _need(counted["form"] == 0, "a record identifier is not of the expected form")
    if policy.namespace is not None:
        accession = F.regexp_extract(F.col("record_id"), "^[^:]+:(.*):[^:]+$", 1)
        held = actual.select(F.col("path"), F.col("digest"))
        wrong = records.select(F.concat(F.lit(CANONICAL), accession, F.lit(".txt")).alias("path"), F.col("sequence_digest").alias("digest")).join(held, ["path", "digest"], "left_anti")
        _need(not wrong.take(1), "canonical bytes do not match their declared digest")
    _need(not entities.where(F.col("entity_id").isNull() | F.col("entity_type").isNull() | F.col("record_versions").isNull()).take(1), "an entity is not of the contract")
    _need(not accounting.entity_faults(entities, records).take(1), "entities and records disagree")
    return counted["n"]


def instance_counts(instances: DataFrame, profile_id: Column, shard_digest: Column, rows: Column) -> DataFrame:
    """One row: n, how many don't refer to the shard and a row of it, distinct records and distinct rows."""
    ref = F.col("vector_reference")
    good = F.col("instance_id").isNotNull() & (F.col("profile_id") == profile_id) & (ref.shard_digest == shard_digest) & ref.row.between(F.lit(0), rows - 1)
    return instances.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(good, F.lit(False))).alias("bad"), F.count_distinct("record_id").alias("records"), F.count_distinct(ref.row).alias("rows"))


def _check_instances(instances: DataFrame, records: DataFrame, shard: dict, n: int) -> None:
    counted = instance_counts(instances, F.lit(shard["profile_id"]), F.lit(shard["digest"]), F.lit(n)).first()
    _need(counted["bad"] == 0, "an instance does not refer to the verified shard")
    _need((counted["n"], counted["records"], counted["rows"]) == (n, n, n), "instances, records and rows do not match one to one")
    _need(not instances.join(records, "record_id", "left_anti").take(1), "an instance names an unknown record")
    mapping = shard["row_mapping"]
    _need(set(mapping) == set(map(str, range(n))), "the row mapping is incomplete")
    named = instances.sparkSession.createDataFrame(list(mapping.items()), "row string, instance_id string")
    _need(not named.join(instances.select("instance_id"), "instance_id", "left_anti").take(1), "the row mapping names an unknown instance")


def _profile(root: str, by_path: dict, shard: dict) -> dict | None:
    """The profile declaration of the shard, if the package has one."""
    path = f"{PROFILES}{shard['profile_id']}.json"
    if path not in by_path:
        return None
    _need(by_path[path]["media_type"] == JSON_TYPE, "the profile declaration is not declared as JSON")
    p = _document(root, path)
    try:
        own = {"profile_id": p["profile_id"], "version": p["version"], "dimension": p["output"]["dimension"], "dtype": p["output"]["dtype"], "normalization": p["output"]["normalization"], "metric": p["metric"]["name"], "metric_direction": p["metric"]["direction"], "digest": by_path[path]["digest"]}
    except (KeyError, TypeError) as e:
        raise ReleaseRefused("the profile declaration is not of the contract") from e
    _need((own["profile_id"], own["dimension"], own["dtype"]) == (shard["profile_id"], shard["dimension"], shard["dtype"]), "the profile declaration does not match the shard")
    return own


def _leaf(document: object, path: str) -> object:
    """A value within a document by its member names; None where there is none."""
    for step in path.split("."):
        document = document.get(step) if isinstance(document, dict) else None
    return document


def _check_provenance(root: str, by_path: dict, shard: dict, policy: Policy) -> None:
    """The license scope, and that plugin, environment and build manifest name the same environment and profile."""
    if policy.license_scope is not None:
        _need(_leaf(_document(root, SOURCE), "license_notice.scope") == policy.license_scope, "the license scope is not the approved one")
    if policy.environment is None:
        return
    declared = {p: _document(root, p) for p in by_path if p.startswith(PROFILES) and p.endswith(".json")}
    plugins = [d for d in declared.values() if _leaf(d, "determinism.declaration_id") is not None]
    _need(bool(plugins) and all(_leaf(d, "determinism.declaration_id") == policy.environment for d in plugins), "the plugin does not declare the approved environment")
    own = declared.get(f"{PROFILES}{policy.environment}.json")
    _need(_leaf(own, "execution_environment_id") == policy.environment, "the environment declaration does not agree with the plugin")
    builds = [_document(root, p) for p in by_path if p.startswith(BUILDS) and p.endswith(".json")]
    _need(bool(builds), "the package lacks a build manifest")
    for build in builds:
        _need(build.get("embedding_profiles") == [shard["profile_id"]], "the build manifest does not select the shard's profile alone")
        chosen = build.get("plugins")
        _need(isinstance(chosen, list) and len(chosen) == 1 and _leaf(chosen[0], "execution_environment.id") == policy.environment, "the build manifest does not select the approved environment")


def _check_stages(actual: DataFrame, policy: Policy) -> None:
    wanted = {f"{STAGES}{name}-stage-envelope.json" for name in policy.stages}
    _need(not wanted or wanted == {r["path"] for r in actual.where(F.col("path").isin(*wanted)).select("path").collect()}, "a stage envelope is missing")
    envelope = F.try_parse_json(F.col("content").cast("string"))
    outcome = F.try_variant_get(envelope, "$.outcome", "string")
    stages = actual.where(F.col("path").startswith(STAGES) | F.col("path").endswith("-stage-envelope.json"))
    _need(not stages.where(~F.coalesce(outcome == "succeeded", F.lit(False))).take(1), "a stage did not succeed")


def descriptors(artifacts: DataFrame, media_types: dict[str, str], contract_version: str = "0.1.0") -> DataFrame:
    """Artifact descriptors in order of path, media types by file ending."""
    kind = F.lit(VECTOR_TYPE)
    for ending, media in media_types.items():
        kind = F.when(F.col("path").endswith(ending), media).otherwise(kind)
    return artifacts.select("path", kind.alias("media_type"), "digest", F.col("size").cast("bigint").alias("size"), F.lit(contract_version).alias("contract_version")).orderBy("path")


