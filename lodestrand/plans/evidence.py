"""Evidence over results: canonical evidence JSON, projections to compare, and replicate and oracle comparison."""

from __future__ import annotations

import json
import os
import platform
import re
from collections.abc import Iterable, Mapping
from decimal import Decimal
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.operators import accounting
from lodestrand.plans.request import canonical

# The fields that diagnostics name, in their order.
FIELDS = ("outcome", "error", "ids", "scores", "next_cursor", "provenance", "warnings")


def plain(value: object) -> object:
    """The value with floats as decimals of their shortest spelling, ready for canonical JSON."""
    match value:
        case bool() | str() | None:
            return value
        case float():
            return Decimal(repr(value))
        case Mapping():
            return {str(k): plain(v) for k, v in value.items()}
        case list() | tuple():
            return [plain(v) for v in value]
    return value


def evidence_json(value: object) -> str:
    return canonical(plain(value))


def evidence_digest(value: object) -> str:
    return "sha256:" + sha256(evidence_json(value).encode()).hexdigest()


def project(request_id: str, result: Mapping[str, object]) -> dict:
    """One result as comparable texts."""
    rows = result.get("rows") or []
    held = {"outcome": result.get("outcome"), "error": result.get("error"), "ids": [r["record_id"] for r in rows], "scores": [r["score"] for r in rows], "next_cursor": result.get("next_cursor"), "provenance": result.get("provenance"), "warnings": result.get("warnings")}
    return {"request_id": request_id, "digest": evidence_digest(result)} | {f: evidence_json(held[f]) for f in FIELDS}


SCHEMA = "request_id string, digest string, " + ", ".join(f"{f} string" for f in FIELDS)


def replicate(spark: SparkSession, results: Iterable[tuple[str, Mapping[str, object]]]) -> DataFrame:
    """The projections of one replicate's results."""
    names = ["request_id", "digest", *FIELDS]
    return spark.createDataFrame([tuple(project(i, r)[n] for n in names) for i, r in results], SCHEMA)


def compare(*replicates: DataFrame) -> tuple[bool, DataFrame, DataFrame]:
    """Whether all agree, the comparison of each request, and the fields in which the first two differ where digests do."""
    compared = accounting.replicate_compare(*replicates)
    a, b = (r.select(F.col("request_id"), *(F.col(f).alias(f"{side}_{f}") for f in ("digest", *FIELDS))) for side, r in zip("ab", replicates))
    differing = a.join(b, "request_id").where(~F.col("a_digest").eqNullSafe(F.col("b_digest")))
    return not compared.where(~F.col("agrees")).take(1), compared, accounting.diagnostics(differing, "request_id", list(FIELDS))


class IncidentLog:
    """An append-only log of a study: entries are numbered and chained by digest, so that none can be changed unseen."""

    def __init__(self, path: str) -> None:
        self.path = path

    def entries(self) -> list[dict]:
        if not os.path.exists(self.path):
            return []
        with open(self.path, encoding="utf-8") as f:
            held = [json.loads(line) for line in f]
        before = None
        for i, e in enumerate(held):
            if (e["number"], e["before"]) != (i, before):
                raise ValueError(f"entry {i} of {self.path} was changed")
            before = evidence_digest(e)
        return held

    def append(self, kind: str, detail: object) -> dict:
        held = self.entries()
        entry = {"number": len(held), "before": evidence_digest(held[-1]) if held else None, "kind": kind, "detail": detail}
        with open(self.path, "a", encoding="utf-8", newline="\n") as f:
            f.write(evidence_json(entry) + "\n")
        return entry


def environment() -> dict:
    """The runtime that a study binds its results to."""
    import numpy
    import pyarrow
    import pyspark

    return {"python": platform.python_version(), "os": platform.system(), "machine": platform.machine(), "pyspark": pyspark.__version__, "pyarrow": pyarrow.__version__, "numpy": numpy.__version__}


class EvidenceRefused(ValueError):
    """Evidence that can't be formed from what is given."""


def validation_evidence(report: Mapping[str, object], bundle_id: str, environment_label: str, executed_at: str) -> tuple[dict, dict]:
    """The validation bundle and the run record of one verification, as documents outside the package."""
    if not (bundle_id.strip() and environment_label.strip()):
        raise EvidenceRefused("bundle id and environment label must be given")
    digest, checks = report.get("release_manifest_digest"), report.get("checks")
    if not isinstance(digest, str) or not isinstance(checks, list):
        raise EvidenceRefused("the report has no digest or no checks")
    bundle = {"bundle_id": bundle_id, "release_digest": digest, "checks": checks, "waivers": [], "review_status": "passed; M1.8 maintainer decision pending"}
    inputs = "package directory and embedded schemas only"
    run = {"run_id": f"{bundle_id}-clean-room", "environment_label": environment_label, "executed_at": executed_at, "release_id": report.get("release_id"), "release_manifest_digest": digest, "reader": __name__, "reader_inputs": inputs, "result": "passed", "checks": checks}
    return bundle, run


def write_validation(report: Mapping[str, object], bundle_path: str, run_path: str, bundle_id: str, environment_label: str, package: str = "") -> None:
    """Writes both documents; the package is never touched, so a target inside it is refused."""
    from datetime import datetime, timezone

    from lodestrand.plans.contracts import utc
    from lodestrand.sources.files import write_document

    for path in (bundle_path, run_path):
        if package and os.path.realpath(path).startswith(os.path.realpath(package) + os.sep):
            raise EvidenceRefused(f"{path} lies in the package")
    documents = validation_evidence(report, bundle_id, environment_label, utc(datetime.now(timezone.utc).isoformat()))
    for path, document in zip((bundle_path, run_path), documents):
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        write_document(document, path)


class OracleRefused(ValueError):
    """A package that the oracle can't rank, because it isn't what its own declarations say."""


class Oracle:
    """Exact rankings of a package, computed without Spark and without the engine's operators, to compare results with.

    It reads the packaged files itself, checks them by rules of its own, and folds products in binary32 one dimension
    after the other. digest: that of the release manifest, if the ranking must be bound to it.
    """

    def __init__(self, package: str, digest: str | None = None, profile_id: str | None = None) -> None:
        import numpy as np

        def raw(path: str) -> bytes:
            try:
                with open(os.path.join(package, path), "rb") as f:
                    return f.read()
            except OSError as e:
                raise OracleRefused(f"{path} can't be read") from e

        def need(holds: bool, what: str) -> None:
            if not holds:
                raise OracleRefused(what)

        manifest, shard = json.loads(raw("release-manifest.json")), json.loads(raw("embeddings/vector-shard-manifest.json"))
        declared = {a["path"]: a["digest"] for a in manifest["artifacts"]}
        self.digest = "sha256:" + sha256(raw("release-manifest.json")).hexdigest()
        need(digest is None or digest == self.digest, "the manifest is not the one that the request is bound to")
        need(all(re.fullmatch("sha256:[0-9a-f]{64}", d) for d in declared.values()), "a declared digest is not spelt as one")
        held = {p: raw(p) for p in ("embeddings/vectors.float32le", "embeddings/embedding-instances.jsonl", "records/genome-record-versions.jsonl")}
        for path, data in held.items():
            need(declared.get(path) == "sha256:" + sha256(data).hexdigest(), f"{path} is not what the manifest declares")
        need(shard["digest"] == declared["embeddings/vectors.float32le"], "the shard declares other vectors")
        need(profile_id is None or shard["profile_id"] == profile_id, "the shard is of another profile")
        instances, records = ([json.loads(x) for x in held[p].splitlines() if x.strip()] for p in ("embeddings/embedding-instances.jsonl", "records/genome-record-versions.jsonl"))
        at = {v: int(k) for k, v in shard["row_mapping"].items()}
        self.rows = {i["record_id"]: at[i["instance_id"]] for i in instances if i["instance_id"] in at}
        need(len(self.rows) == len(instances) == len(records) == len(at) and set(self.rows) == {r["record_id"] for r in records}, "records, instances and rows are not the same")
        need(sorted(self.rows.values()) == list(range(len(at))), "the rows are not those from 0 on")
        self.dimension = shard["dimension"]
        need(len(held["embeddings/vectors.float32le"]) == 4 * self.dimension * len(at), "the vectors do not fill the rows")
        self.vectors = np.frombuffer(held["embeddings/vectors.float32le"], "<f4").reshape(len(at), self.dimension)
        need(bool(np.isfinite(self.vectors).all()) and bool((np.abs(np.linalg.norm(self.vectors.astype(np.float64), axis=1) - 1) <= 1e-6).all()), "a vector is not finite or not of length 1")
        self.records = {r["record_id"]: r for r in records}

    def ranking(self, query_record_id: str) -> list[tuple[str, float]]:
        """All records but by score, greatest first, equal ones by id; a score is the binary32 fold as a double."""
        import numpy as np

        names = sorted(self.records)
        held = self.vectors[[self.rows[n] for n in names]]
        query = self.vectors[self.rows[query_record_id]]
        total = np.zeros(len(names), np.float32)
        for j in range(self.dimension):
            total = total + held[:, j] * query[j]
        return sorted(zip(names, map(float, total)), key=lambda p: (-p[1], p[0]))

    def differs(self, query_record_id: str, rows: Iterable[Mapping[str, object]], skip: int = 0) -> list[str]:
        """What a page of results gets wrong: ids, scores (to the bit) and their order, from place `skip` on."""
        found = []
        for i, (row, (name, score)) in enumerate(zip(rows, self.ranking(query_record_id)[skip:])):
            if row["record_id"] != name:
                found.append(f"{i + skip}: {row['record_id']} stands where {name} belongs")
            elif row["score"] != score:
                found.append(f"{i + skip}: the score of {name} is {row['score']!r}, not {score!r}")
        return found


def environment_lock(path: str, once: bool = True) -> dict:
    """Writes the runtime of a study; with once, a lock that is there must be of the same runtime."""
    from lodestrand.sources.files import read_document, write_document

    own = environment()
    if once and os.path.exists(path):
        held = read_document(path)
        if held != own:
            raise EvidenceRefused(f"{path} locks another runtime: {sorted(k for k in own.keys() | held.keys() if own.get(k) != held.get(k))}")
        return held
    write_document(own, path)
    return own


def pinned_commit(root: str) -> str:
    """The commit that a working copy stands at, read from its files: HEAD, a loose reference or the packed ones."""
    git = os.path.join(root, ".git")
    read = lambda p: open(p, encoding="utf-8").read().strip()  # noqa: E731, SIM115
    try:
        head = read(os.path.join(git, "HEAD"))
        if not head.startswith("ref: "):
            return head
        name = head.removeprefix("ref: ")
        if os.path.exists(os.path.join(git, name)):
            return read(os.path.join(git, name))
        for line in read(os.path.join(git, "packed-refs")).splitlines():
            if line.endswith(" " + name):
                return line.split(" ")[0]
    except OSError as e:
        raise EvidenceRefused(f"{root} is no working copy") from e
    raise EvidenceRefused(f"{name} has no commit")


def deterministic(seed: int = 0, threads: int = 1) -> dict:
    """Sets the policy of a CPU run in this process and gives it for the record: one seed, one thread, no accelerator."""
    import random

    import numpy as np

    chosen = {"PYTHONHASHSEED": str(seed), "CUDA_VISIBLE_DEVICES": "", **dict.fromkeys(("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"), str(threads))}
    os.environ.update(chosen)
    random.seed(seed)
    np.random.seed(seed)
    return {"seed": seed, "threads": threads, "accelerator": None, "environment": chosen}


def run_provenance(root: str, policy: Mapping[str, object]) -> dict:
    """What a run is bound to: the commit of its code, its runtime and its policy, with a digest over all."""
    held = {"commit": pinned_commit(root), "runtime": environment(), "policy": dict(policy)}
    return held | {"digest": evidence_digest(held)}


def fetched(fetch, tries: int = 5, wait=None):  # noqa: ANN001, ANN201
    """The result of fetch(), tried again after 1, 2, 4 ... seconds on an OSError; the last error is raised."""
    import time

    for i in range(tries):
        try:
            return fetch()
        except OSError:
            if i == tries - 1:
                raise
            (wait or time.sleep)(2**i)
    raise ValueError("no try was allowed")
