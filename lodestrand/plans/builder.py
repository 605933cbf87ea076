"""Building releases: the resumable embedding stage, package assembly and successors.

Rows are embedded on the executors and kept, row by row, under the digest of the run's specification; a run that starts
again computes what is missing. Files of the packaged form are written last, by the driver, from ordered rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from collections.abc import Callable, Iterator, Mapping
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import floats
from lodestrand.operators import accounting, canonical
from lodestrand.plans import release
from lodestrand.sources import files
from lodestrand.sources.vectors import write_float32

#: Takes the windows of one sequence file, each with the prefix token, and gives one vector for each.
Embedder = Callable[[list[str]], "list[list[float]]"]


class StageFailed(Exception):
    """A stage that can't go on; what is finished stays for a later run."""


def hash_embedder(dimension: int) -> Embedder:
    """Vectors from digests of the windows: deterministic, for tests and dry runs without a model."""

    def run(windows: list[str]) -> list[list[float]]:
        out = []
        for w in windows:
            seed = np.frombuffer(hashlib.sha256(w.encode()).digest(), np.uint32)
            v = np.random.default_rng(seed).standard_normal(dimension)
            out.append((v / np.linalg.norm(v)).tolist())
        return out

    return run


def spec_digest(spec: Mapping[str, object]) -> str:
    return "sha256:" + hashlib.sha256(json.dumps(spec, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _vector_of(text: str, embedder: Embedder, size: int) -> list[float]:
    """The pooled unit vector of one canonical file: windows never cross its sequences."""
    windows = [f"{canonical.PREFIX}{bases[i : i + size]}" for line in text.splitlines() for bases in [line.split("\t", 1)[1]] for i in range(0, len(bases), size)]
    if not windows:
        raise StageFailed("a canonical file without sequence")
    rows = embedder(windows)
    if len({len(r) for r in rows}) != 1 or len(rows) != len(windows):
        raise StageFailed("the embedder's vectors differ in number or length")
    mean = [sum(c) / len(rows) for c in zip(*rows)]  # the built-in sum of floats is compensated
    length = sum(x * x for x in mean) ** 0.5
    if not 0 < length < float("inf"):
        raise StageFailed("a mean vector can't be scaled")
    return [x / length for x in mean]


def embed(records: DataFrame, embedder: Embedder, store: str, spec: Mapping[str, object], size: int = canonical.WINDOW) -> DataFrame:
    """row, record_id and vector of every record (row, record_id, canonical), computed where they aren't in the store yet.

    The store is a Parquet folder that executors share; it keeps finished rows by the run's specification. Vectors that
    fail the package gate fail the stage, after the others are kept. Each file is one task's value: files are bounded by
    what one embedder call takes.
    """
    spark, run = records.sparkSession, spec_digest(spec)
    schema = "run_spec string, row bigint, record_id string, vector array<float>"
    base = spark._jvm.org.apache.hadoop.fs.Path(store)
    there = base.getFileSystem(spark._jsc.hadoopConfiguration()).exists(base)
    done = spark.read.schema(schema).parquet(store) if there else spark.createDataFrame([], schema)
    todo = canonical.pending(records.withColumn("run_spec", F.lit(run)), done)

    def compute(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                yield pd.DataFrame({"run_spec": [run], "row": [row.row], "record_id": [row.record_id], "vector": [np.array(_vector_of(row.canonical, embedder, size), np.float32)]})

    todo.select("row", "record_id", "canonical").mapInPandas(compute, schema).write.mode("append").parquet(store)
    rows = spark.read.schema(schema).parquet(store).where(F.col("run_spec") == run).dropDuplicates(["row"]).select("row", "record_id", "vector")
    if rows.where(~floats.passes_package_gate(F.col("vector"))).take(1):
        raise StageFailed("a vector is not finite or not of length 1")
    return rows


def finalise(rows: DataFrame, workspace: str, profile_id: str, shard_id: str, build_id: str, dimension: int, provenance: Mapping[str, object]) -> dict:
    """Writes shard, declaration, instances and envelope of a finished stage; refuses a workspace that has a shard."""
    if not build_id.strip() or not provenance:
        raise StageFailed("a build id and a runner provenance are needed")
    target = os.path.join(workspace, release.VECTORS)
    if os.path.exists(target):
        raise StageFailed("the final shard exists; use a new workspace")
    n = rows.count()
    numbers = rows.agg(F.min("row"), F.max("row"), F.count_distinct("row"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if not n or tuple(numbers) != (0, n - 1, n, dimension, dimension):
        raise StageFailed("the rows aren't 0 to n - 1 with vectors of the profile's dimension")
    os.makedirs(os.path.dirname(target), exist_ok=True)
    write_float32(rows, target)
    digest = files.stream_digest(target)
    instance = F.concat(F.lit("embedding:"), "record_id", F.lit(f":{profile_id}"))
    mapping = {str(r["row"]): r["instance_id"] for r in rows.select("row", instance.alias("instance_id")).toLocalIterator()}
    build = {"build_id": build_id, "runner_provenance": dict(provenance)}
    shard = {"profile_id": profile_id, "shard_id": shard_id, "dimension": dimension, "dtype": "float32", "row_mapping": mapping, "digest": digest, "build_provenance": build}
    files.write_document(shard, os.path.join(workspace, release.SHARD))
    ref = F.struct(F.col("row"), F.lit(digest).alias("shard_digest"), F.lit(shard_id).alias("shard_id"))
    table = rows.select(instance.alias("instance_id"), "record_id", F.lit(profile_id).alias("profile_id"), ref.alias("vector_reference"), F.lit(build_id).alias("created_in"), F.from_json(F.lit(json.dumps(provenance, sort_keys=True)), "map<string,string>").alias("runner_provenance"), F.lit("eligible").alias("eligibility_status"))
    files.write_lines(table, os.path.join(workspace, release.INSTANCES), "vector_reference.row")
    outputs = [{"path": p, "digest": files.stream_digest(os.path.join(workspace, p))} for p in (release.VECTORS, release.SHARD, release.INSTANCES)]
    envelope = {"stage_id": "embed", "input_artifacts": [], "output_artifacts": outputs, "outcome": "succeeded", "verification": {"embedding_instance_count": n, "dimension": dimension, "shard_digest": digest, "runner_provenance": dict(provenance)}}
    files.write_document(envelope, os.path.join(workspace, "embeddings/embedding-stage-envelope.json"))
    return envelope


MEDIA = {".jsonl": release.LINES_TYPE, ".json": release.JSON_TYPE, ".txt": "text/plain", ".yaml": "application/yaml"}


def _manifest(spark: SparkSession, root: str, head: Mapping[str, object]) -> dict:
    rows = release.descriptors(files.read_artifacts(spark, root).where(F.col("path") != release.MANIFEST), MEDIA).collect()  # as many as files
    manifest = dict(head) | {"artifacts": [r.asDict() for r in rows]}
    files.write_document(manifest, os.path.join(root, release.MANIFEST), once=True)
    return manifest


def assemble(spark: SparkSession, workspace: str, target: str, release_id: str, policy: release.Policy = release.Policy()) -> release.Release:
    """Copies a workspace to a new package, scans it for credentials, writes the envelope and manifest, and verifies it."""
    if os.path.exists(target):
        raise StageFailed("the target exists")
    shutil.copytree(workspace, target)
    if accounting.credential_faults(files.read_artifacts(spark, target, content=True)).take(1):
        shutil.rmtree(target)
        raise StageFailed("the inputs hold what looks like credentials")
    os.makedirs(os.path.join(target, release.STAGES), exist_ok=True)
    files.write_document({"stage_id": "package", "input_artifacts": [], "output_artifacts": [], "outcome": "succeeded", "verification": {"credential_scan": "passed"}}, os.path.join(target, release.STAGES, "package-stage-envelope.json"))
    scope = {"distribution": policy.distribution} if policy.distribution else {}
    _manifest(spark, target, {"release_id": release_id, "schema_version": "release-manifest/0.1.0", "state": policy.state or "Draft", "scope": scope, "created_at": _now(), "licenses": [], "validation": {}})
    return release.verify(spark, target, policy)


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def succeed(spark: SparkSession, base: str, target: str, release_id: str, path: str, document: Mapping[str, object], policy: release.Policy = release.Policy()) -> release.Release:
    """A successor that adds one JSON artifact; all others stay as they are but for the package envelope."""
    old = files.read_document(os.path.join(base, release.MANIFEST))
    if old["release_id"] == release_id or os.path.exists(target) or os.path.exists(os.path.join(base, path)) or not release.is_safe_path(path):
        raise StageFailed("a successor needs a new id, a new place and a new artifact")
    shutil.copytree(base, target, ignore=lambda d, names: [release.MANIFEST] if os.path.samefile(d, base) else [])
    os.makedirs(os.path.dirname(os.path.join(target, path)), exist_ok=True)
    files.write_document(dict(document), os.path.join(target, path))
    envelope = os.path.join(target, release.STAGES, "package-stage-envelope.json")
    files.write_document({"stage_id": "package", "input_artifacts": [{"path": release.MANIFEST, "digest": files.stream_digest(os.path.join(base, release.MANIFEST))}], "output_artifacts": [{"path": path}], "outcome": "succeeded", "verification": {"credential_scan": "passed"}}, envelope)
    head = {k: v for k, v in old.items() if k != "artifacts"} | {"release_id": release_id, "base_release": old["release_id"], "created_at": _now()}
    _manifest(spark, target, head)
    before, after = (files.read_artifacts(spark, d).where(F.col("path") != release.MANIFEST) for d in (base, target))
    changed = {(r["path"], r["change"]) for r in accounting.successor_diff(before, after).where("change <> 'preserved'").collect()}
    if changed - {(release.STAGES + "package-stage-envelope.json", "changed"), (release.STAGES + "package-stage-envelope.json", "added")} != {(path, "added")}:
        raise StageFailed("the successor changes more than it may")
    return release.verify(spark, target, policy)


def canonicalise_archives(sources: DataFrame, reported: DataFrame, namespace: str, profile: str) -> tuple[DataFrame, DataFrame]:
    """Canonical records of source files (accession, fasta) with report rows (accession, contig_id), and the quarantined.

    records: accession, record_id, entity_id, canonical, digest; quarantined: accession, reason. A file that fails keeps
    no other from going on.
    """
    found = canonical.contigs(sources)
    judged = canonical.reasons(found, reported)
    empty = sources.select("accession").join(found.select("accession").distinct(), "accession", "left_anti").select("accession", F.lit("an empty source").alias("reason"))
    bad = judged.where("reason is not null").select("accession", "reason").unionByName(empty)
    good = found.join(bad.select("accession"), "accession", "left_anti")
    ids = canonical.identities(good.select("accession").distinct(), "accession", namespace, profile)
    return canonical.canonical_files(good).join(ids, "accession"), bad




def account_archives(members: DataFrame, expected: DataFrame) -> DataFrame:
    """Accounting of assembly reports, read from archives with read_members(), against an inventory's accessions.

    A report line that is no object or has neither identifier stops it: counts would be wrong.
    """
    lines = members.where("member is not null").select(F.explode(F.split(F.decode("content", "UTF-8"), "\r\n|\n|\r")).alias("line")).where(F.length(F.trim("line")) > 0)
    raw = F.try_parse_json("line")
    observed = lines.select(F.try_variant_get(raw, "$.accession", "string").alias("accession"), F.try_variant_get(raw, "$.current_accession", "string").alias("current_accession"))
    named = observed.select(accounting.accession(observed).alias("accession"))
    if named.where(F.col("accession").isNull() | (F.col("accession") == "")).take(1):
        raise StageFailed("a report row has no accession")
    return accounting.account(expected.select("accession"), named, "accession")


def stage_envelope(stage: str, accounted: DataFrame) -> dict:
    """The envelope of an acquisition: counts of each kind in one pass, succeeded only if nothing is amiss."""
    counts = accounted.agg(*(F.count_if(F.col(k)).alias(k) for k in ("registered", "missing", "unexpected", "duplicate"))).first().asDict()
    whole = not (counts["missing"] or counts["unexpected"] or counts["duplicate"])
    return {"stage_id": stage, "input_artifacts": [], "output_artifacts": [], "outcome": "succeeded" if whole else "failed", "verification": counts}


def environment_faults(declared: Mapping[str, object], found: Mapping[str, object], at: str = "") -> list[str]:
    """Paths of the leaves in which a runtime differs from an approved declaration; what isn't declared doesn't count."""
    faults = []
    for name, value in sorted(declared.items()):
        here = f"{at}.{name}".lstrip(".")
        other = found.get(name) if isinstance(found, Mapping) else None
        faults += environment_faults(value, other if isinstance(other, Mapping) else {}, here) if isinstance(value, Mapping) else [here] * (type(value) is not type(other) or value != other)
    return faults


def selects_environment(build: Mapping[str, object], environment_id: str, declaration_digest: str, profile_id: str) -> bool:
    """Whether a build manifest has one plugin, which names the declaration by its digest, and the one profile."""
    plugins = build.get("plugins")
    chosen = plugins[0].get("execution_environment") if isinstance(plugins, list) and len(plugins) == 1 and isinstance(plugins[0], Mapping) else None
    return build.get("embedding_profiles") == [profile_id] and isinstance(chosen, Mapping) and (chosen.get("id"), chosen.get("declaration_digest")) == (environment_id, declaration_digest)


def failed_envelope(stage: str, error: Exception) -> dict:
    """The envelope of a stage that stopped: what went wrong, and that nothing was put out."""
    return {"stage_id": stage, "input_artifacts": [], "output_artifacts": [], "outcome": "failed", "verification": {"error": type(error).__name__, "message": str(error)}}


def accession_of(record_id: str, namespace: str, profile: str) -> str:
    """The accession within a record id of the form namespace:accession:profile."""
    before, after = f"{namespace}:", f":{profile}"
    if not (record_id.startswith(before) and record_id.endswith(after) and len(record_id) > len(before) + len(after)):
        raise StageFailed(f"{record_id} is no record of {namespace} and {profile}")
    return record_id[len(before) : -len(after)]


def canonical_inputs(root: str, expected: int) -> list[str]:
    """The canonical files of a workspace in order of name; any other number than expected stops the stage."""
    place = os.path.join(root, release.CANONICAL)
    found = sorted(f for f in (os.listdir(place) if os.path.isdir(place) else []) if f.endswith(".txt"))
    if len(found) != expected:
        raise StageFailed(f"{len(found)} canonical files are there, {expected} are expected")
    return [os.path.join(place, f) for f in found]


def copy_into(source: str, target: str) -> None:
    """Copies a workspace to a target that must be empty or absent."""
    if os.path.exists(target) and (not os.path.isdir(target) or os.listdir(target)):
        raise StageFailed(f"{target} is not empty")
    shutil.copytree(source, target, dirs_exist_ok=True)


def reusable(inputs: DataFrame, vectors: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Which records of a batch need no new validation: record_id, reused, and the verdict that is taken over.

    inputs: record_id and digest of what is to be validated; vectors and verdicts, kept from earlier runs: record_id, digest
    of the input and vector_digest, verdicts with status too. A record is reused only if both are there for this very
    input and agree on the vector, in one row each; of repeated rows none counts.
    """
    def kept(df: DataFrame, *more: str) -> DataFrame:
        return df.groupBy("record_id", "digest").agg(F.count("*").alias("n"), F.max("vector_digest").alias("vector_digest"), *(F.max(m).alias(m) for m in more)).where("n = 1").drop("n")

    both = kept(vectors).join(kept(verdicts, "status"), ["record_id", "digest", "vector_digest"]).select("record_id", "digest", "status")
    return inputs.select("record_id", "digest").join(both, ["record_id", "digest"], "left").select("record_id", F.col("status").isNotNull().alias("reused"), "status")
