"""Packages built, verified, tampered with, succeeded and queried."""

from __future__ import annotations

import io
import json
import os
import shutil
import struct

import numpy as np
import pytest

from lodestrand.plans import adapters, builder, evidence, release
from lodestrand.plans import request as R
from lodestrand.plans.core import QueryCore, walk
from lodestrand.sources import files

PROFILE, DIM, N = "p-v1", 16, 6
POLICY = release.Policy(canonicalization_id="canon-v1", namespace="asm")


def write(root, path, text):
    os.makedirs(os.path.dirname(os.path.join(root, path)), exist_ok=True)
    with open(os.path.join(root, path), "w", encoding="utf-8", newline="\n") as f:
        f.write(text)


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    """A workspace through the embedding stage, and the package made of it."""
    root = str(tmp_path_factory.mktemp("work") / "w")
    records = []
    for i in range(N):
        accession = f"G{i}.1"
        canonical = f"c1\t{'ACGT' * (i + 1)}\nc2\tNN\n"
        write(root, f"records/canonical/{accession}.txt", canonical)
        records.append({"record_id": f"asm:{accession}:canon-v1", "entity_id": f"asm:G{i}", "sequence_digest": R.digest_of(canonical), "canonicalization_id": "canon-v1", "source_provenance_id": f"s{i % 2}", "lifecycle_state": "eligible", "canonical": canonical, "row": i})
    write(root, release.RECORDS, "".join(json.dumps({k: v for k, v in r.items() if k in release.RECORD_FIELDS}) + "\n" for r in records))
    write(root, release.ENTITIES, "".join(json.dumps({"entity_id": r["entity_id"], "entity_type": "assembly", "record_versions": [r["record_id"]]}) + "\n\n" for r in records))
    df = spark.createDataFrame([(r["row"], r["record_id"], r["canonical"]) for r in records], "row long, record_id string, canonical string")
    rows = builder.embed(df, builder.hash_embedder(DIM), str(tmp_path_factory.mktemp("store") / "rows"), {"build": "b", "profile": PROFILE})
    builder.finalise(rows, root, PROFILE, "shard-0", "build-1", DIM, {"runner": "test"})
    package = str(tmp_path_factory.mktemp("pack") / "p")
    builder.assemble(spark, root, package, "release-1", POLICY)
    return root, package


@pytest.fixture(scope="module")
def opened(spark, base, tmp_path_factory):
    target = str(tmp_path_factory.mktemp("next") / "p")
    profile = {"profile_id": PROFILE, "version": "1.0.0", "output": {"dimension": DIM, "dtype": "float32", "normalization": "l2"}, "metric": {"name": "cosine", "direction": "higher-is-more-similar"}}
    return builder.succeed(spark, base[1], target, "release-2", f"profiles/{PROFILE}.json", profile, POLICY), target


def request(opened, **changes):
    handle = opened[0]
    payload = {
        "schema_version": R.REQUEST_VERSION, "release_selector": {"release_id": handle.release_id, "release_digest": handle.digest}, "operation": "similarity", "profile_selector": {"profile_id": PROFILE, "profile_version": "1.0.0"},
        "similarity": {"query_record_id": "asm:G2.1:canon-v1", "metric": "cosine", "mode": "exact"}, "filter": None, "traversal": None, "pagination": {"limit": 12, "cursor": None, "ordering_version": R.ORDERING},
    }
    return payload | changes


def vectors(target):
    with open(os.path.join(target, release.VECTORS), "rb") as f:
        return np.frombuffer(f.read(), "<f4").reshape(N, DIM)


def test_report_names_all_checks(opened):
    report = opened[0].report
    assert [c["id"] for c in report["checks"]] == list(release.CHECKS) and all(c["status"] == "passed" for c in report["checks"])
    assert report["record_count"] == N


def test_logical_digest_equals_plain_json(opened):
    handle = opened[0]
    rows = lambda df: [r.asDict(True) for r in df.collect()]
    logical = {
        "release_id": "release-2",
        "records": [{k: r[k] for k in ("record_id", "entity_id", "sequence_digest")} for r in sorted(rows(handle.records), key=lambda r: r["record_id"])],
        "entities": [{"entity_id": f"asm:G{i}", "record_versions": [f"asm:G{i}.1:canon-v1"]} for i in range(N)],
        "instances": [{k: r[k] for k in ("record_id", "profile_id", "vector_reference")} for r in sorted(rows(handle.instances), key=lambda r: r["vector_reference"]["row"])],
        "vector_shard_digest": handle.shard_digest,
    }
    assert handle.report["logical_release_digest"] == R.digest_of(json.dumps(logical, sort_keys=True, separators=(",", ":")))


def test_full_ranking_is_bit_exact_and_pages_concatenate(opened):
    core = QueryCore(opened[0])
    v = vectors(opened[1])
    f32 = lambda x: struct.unpack("<f", struct.pack("<f", x))[0]
    scores = []
    for i in range(N):
        acc = 0.0
        for a, b in zip(v[2].tolist(), v[i].tolist()):
            acc = f32(acc + f32(a * b))
        scores.append((f"asm:G{i}.1:canon-v1", acc))
    expected = sorted(scores, key=lambda s: (-s[1], s[0]))
    result = core.execute(json.dumps(request(opened)))
    assert result["outcome"] == "success" and result["next_cursor"] is None and result["warnings"][0]["code"] == "method_not_evaluated"
    assert [(r["record_id"], r["score"]) for r in result["rows"]] == expected
    small = request(opened)
    small["pagination"]["limit"] = 2
    assert walk(core, small) == result["rows"]
    first = core.execute(json.dumps(small))
    assert first["context"]["canonical_request_digest"] == R.canonicalise(json.dumps(small)).digest
    changed = small | {"filter": {"state": {"field": {"kind": "canonical", "name": "entity_id"}, "is": "present"}}}
    changed["pagination"] = small["pagination"] | {"cursor": first["next_cursor"]}
    assert core.execute(json.dumps(changed))["error"]["code"] == "invalid_cursor"


def test_filter_comes_before_ranking(opened):
    chosen = {"eq": {"field": {"kind": "canonical", "name": "source_provenance_id"}, "value": "s1"}}
    result = QueryCore(opened[0]).execute(json.dumps(request(opened, filter=chosen)))
    assert {r["record_id"] for r in result["rows"]} == {f"asm:G{i}.1:canon-v1" for i in (1, 3, 5)}


@pytest.mark.parametrize(
    ("change", "code", "stage"),
    [
        ({"release_selector": {"release_id": "x", "release_digest": "y"}}, "release_not_found", "resolve"),
        ({"profile_selector": {"profile_id": "x", "profile_version": "1.0.0"}}, "profile_incompatible", "resolve"),
        ({"profile_selector": {"profile_id": PROFILE, "profile_version": "9"}}, "profile_incompatible", "plan"),
        ({"similarity": {"query_record_id": "x", "metric": "cosine", "mode": "exact"}, "filter": {}}, "validation_error", "validate"),
        ({"filter": {}, "pagination": {"limit": 2, "cursor": "opaque", "ordering_version": R.ORDERING}}, "validation_error", "plan"),
        ({"pagination": {"limit": 2, "cursor": "opaque", "ordering_version": R.ORDERING}}, "invalid_cursor", "validate"),
        ({"operation": "evidence"}, "unsupported_operation", "plan"),
        ({"operation": "traversal", "traversal": {"start_record_ids": ["a"], "relation_type": "r", "direction": "both"}}, "unsupported_relation", "plan"),
        ({"operation": "traversal", "traversal": {"start_record_ids": [], "relation_type": "r", "direction": "both"}}, "validation_error", "validate"),
    ],
)
def test_errors_and_their_precedence(opened, change, code, stage):
    text = json.dumps(request(opened, **change))
    result = QueryCore(opened[0]).execute(text)
    assert (result["error"]["code"], result["error"]["stage"]) == (code, stage)
    assert result["error"]["correlation_id"] == R.canonicalise(text).correlation


def test_a_package_without_profile_opens_but_answers_no_similarity(spark, base):
    handle = release.verify(spark, base[1], POLICY)
    assert QueryCore(handle).execute(json.dumps(request((handle, base[1]))))["error"]["code"] == "profile_incompatible"
    with pytest.raises(KeyError):
        handle.table("elsewhere.jsonl")
    with pytest.raises(ValueError):
        handle.table(release.SHARD)


def spoil_vector(root):
    with open(os.path.join(root, release.VECTORS), "r+b") as f:
        f.seek(5)
        f.write(b"\x7f")


def manifest(root, change):
    path = os.path.join(root, release.MANIFEST)
    held = files.read_document(path)
    change(held)
    files.write_document(held, path)


@pytest.mark.parametrize(
    "tamper",
    [
        spoil_vector,
        lambda root: write(root, "extra.txt", "x"),
        lambda root: os.remove(os.path.join(root, release.SHARD)),
        lambda root: manifest(root, lambda m: m.update(state="Candidate")),
        lambda root: manifest(root, lambda m: m["artifacts"][0].update(path="../outside")),
        lambda root: manifest(root, lambda m: m["artifacts"].append(m["artifacts"][0])),
        lambda root: manifest(root, lambda m: m.update(more=1)),
    ],
)
def test_tampered_packages_are_refused(spark, base, tmp_path, tamper):
    root = str(tmp_path / "p")
    shutil.copytree(base[1], root)
    tamper(root)
    with pytest.raises(release.ReleaseRefused) as e:
        release.verify(spark, root, POLICY)
    assert e.value.code == "release_untrusted"


def test_missing_packages_are_not_found(spark, tmp_path):
    with pytest.raises(release.ReleaseRefused) as e:
        release.verify(spark, str(tmp_path / "none"))
    assert e.value.code == "release_not_found"


def test_changes_after_opening_have_no_effect(spark, opened, tmp_path):
    root = str(tmp_path / "p")
    shutil.copytree(opened[1], root)
    handle = release.verify(spark, root, POLICY)
    spoil_vector(root)
    write(root, release.RECORDS, "")
    result = QueryCore(handle).execute(json.dumps(request((handle, root))))
    assert len(result["rows"]) == N


def test_credentials_stop_the_assembly(spark, base, tmp_path):
    work = str(tmp_path / "w")
    shutil.copytree(base[0], work)
    write(work, "notes/a.txt", "aws_secret_access_key=1")
    with pytest.raises(builder.StageFailed):
        builder.assemble(spark, work, str(tmp_path / "p"), "r", POLICY)


def test_a_stage_resumes_with_what_is_missing(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", "c\tACGT\n"), (1, "b", "c\tGGGG\n")], "row long, record_id string, canonical string")
    store, spec = str(tmp_path / "rows"), {"build": 1}
    builder.embed(df.where("row = 0"), builder.hash_embedder(4), store, spec)

    def only_second(windows):
        assert windows == ["<s>GGGG"]
        return builder.hash_embedder(4)(windows)

    assert builder.embed(df, only_second, store, spec).count() == 2
    with pytest.raises(Exception, match="<s>ACGT|AssertionError"):
        builder.embed(df, only_second, store, {"build": 2})
    with pytest.raises(builder.StageFailed):
        builder._vector_of("c\t\n", builder.hash_embedder(4), 8)


def test_adapters_delegate(opened):
    core = QueryCore(opened[0])
    payload = request(opened)
    direct = core.execute(json.dumps(payload))
    assert adapters.Client(core).query(payload) == direct
    app, seen = adapters.Application(core), []

    def call(method="POST", path="/v1/query", body=b"", length=None):
        seen.clear()
        out = app({"REQUEST_METHOD": method, "PATH_INFO": path, "CONTENT_LENGTH": str(len(body)) if length is None else length, "wsgi.input": io.BytesIO(body)}, lambda s, h: seen.append(s))
        return seen[0][:3], json.loads(b"".join(out))

    assert call("GET")[0] == "405" and call(path="/")[0] == "404" and call(length="x")[0] == "400" and call(body=b"\xff")[0] == "400"
    assert call(body=json.dumps(payload).encode()) == ("200", direct)
    status, refused = call(body=b"{")
    assert status == "200" and refused["outcome"] == "error"
    shown = adapters.Presenter(adapters.Client(core).query).query_and_present(payload)
    assert [r["score"] for r in shown["rows"]] == [r["score"] for r in direct["rows"]]
    assert adapters.Presenter().present_result(refused)["presentation_kind"] == "typed-query-error"
    with pytest.raises(adapters.PresentationError):
        adapters.Presenter().present_result({"outcome": "other", "warnings": []})


def test_evidence_of_replicates(spark, opened):
    core = QueryCore(opened[0])
    results = [(f"r{i}", core.execute(json.dumps(request(opened, pagination={"limit": i + 1, "cursor": None, "ordering_version": R.ORDERING})))) for i in range(2)]
    a, b, c = (evidence.replicate(spark, results) for _ in range(3))
    assert evidence.compare(a, b, c)[0]
    changed = evidence.replicate(spark, [results[0], ("r1", results[1][1] | {"next_cursor": "x"})])
    agree, _, differs = evidence.compare(a, changed, c)
    assert not agree and [(r["request_id"], r["differs"]) for r in differs.collect()] == [("r1", ["next_cursor"])]
    assert evidence.evidence_json({"x": 0.1, "n": 1e21}) == '{"n":1000000000000000000000,"x":0.1}'


def test_a_tree_is_copied_with_the_digests_of_the_copy(spark, tmp_path):
    from lodestrand.sources import files

    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.bin").write_bytes(b"x" * 100_000)
    (tmp_path / "a" / "empty").write_bytes(b"")
    rows = {r["path"]: r for r in files.copy_tree(spark, str(tmp_path / "a"), str(tmp_path / "to"), block=1000).collect()}
    assert set(rows) == {"b/x.bin", "empty"} and rows["b/x.bin"]["size"] == 100_000
    for path, r in rows.items():
        assert r["digest"] == files.stream_digest(str(tmp_path / "to" / path)) == files.stream_digest(str(tmp_path / "a" / path))


def test_every_declared_table_can_be_read(opened):
    handle, target = opened
    assert handle.table(release.ENTITIES).count() == N
    named = {r[0] for r in handle.table(release.ENTITIES).selectExpr("variant_get(raw, '$.entity_id', 'string')").collect()}
    assert named == {f"asm:G{i}" for i in range(N)}
    with pytest.raises(KeyError):
        handle.table("records/none.jsonl")
    with pytest.raises(ValueError):
        handle.table(release.SHARD)


def test_a_change_between_hash_and_parse_is_harmless(spark, opened, tmp_path, monkeypatch):
    """The package is emptied as soon as it was copied; all that follows reads the copy."""
    target = str(tmp_path / "p")
    shutil.copytree(opened[1], target)
    old = files.copy_tree

    def then_gone(spark, root, to, **more):
        rows = old(spark, root, to, **more).collect()
        shutil.rmtree(root)
        return spark.createDataFrame([tuple(r) for r in rows], "path string, size bigint, digest string")

    monkeypatch.setattr(files, "copy_tree", then_gone)
    handle = release.verify(spark, target, POLICY)
    assert handle.report["record_count"] == N and handle.table(release.ENTITIES).count() == N and handle.vectors.count() == N


def test_presenter_shows_the_whole_contract(opened):
    handle, _ = opened
    result = QueryCore(handle).execute(json.dumps(request(opened)))
    shown = adapters.Presenter().present_result(result)
    assert set(shown) == {"presentation_kind", "schema_version", "release", "query_context", "provenance", "evidence_status", "warnings", "rows", "next_cursor", "annotation_assertions", "relation_lineage", "projection"}
    assert set(shown["release"]) == {"release_id", "release_digest", "integrity", "scope", "citation", "compatibility"} and len(shown["rows"]) == len(result["rows"])
    error = QueryCore(handle).execute("{}")
    assert set(adapters.Presenter().present_result(error)) == {"presentation_kind", "schema_version", "error", "warnings", "evidence_note"}
    for broken in ({"outcome": "success"}, {"outcome": "x", "warnings": []}, result | {"rows": [1]}, result | {"context": None}):
        with pytest.raises(adapters.PresentationError):
            adapters.Presenter().present_result(broken)


def test_the_oracle_agrees_and_finds_faults(opened):
    handle, target = opened
    oracle = evidence.Oracle(target)
    rows = walk(QueryCore(handle), request(opened, pagination={"limit": 4, "cursor": None, "ordering_version": R.ORDERING}))
    assert len(rows) == N and oracle.differs("asm:G2.1:canon-v1", rows) == []
    assert len(oracle.differs("asm:G2.1:canon-v1", [rows[1], rows[0] | {"score": 0.5}])) == 2
    assert len(oracle.differs("asm:G2.1:canon-v1", [rows[0] | {"score": 0.5}])) == 1


def test_validation_evidence_stays_outside_the_package(opened, tmp_path):
    handle, target = opened
    bundle, run = str(tmp_path / "e" / "bundle.json"), str(tmp_path / "e" / "run.json")
    evidence.write_validation(handle.report, bundle, run, "b1", "clean", target)
    held = files.read_document(bundle), files.read_document(run)
    assert held[0]["release_digest"] == handle.digest == held[1]["release_manifest_digest"] and held[1]["run_id"] == "b1-clean-room"
    for report, path, name in ((handle.report, os.path.join(target, "x.json"), "b"), ({}, bundle, "b"), (handle.report, bundle, " ")):
        with pytest.raises(evidence.EvidenceRefused):
            evidence.write_validation(report, path, run, name, "clean", target)


@pytest.mark.parametrize("change, fault", [({}, None), ({"scope": "other"}, "license"), ({"plugin": "e2"}, "plugin"), ({"own": "e2"}, "environment declaration"), ({"build": "e2"}, "build manifest does not select the approved"), ({"profiles": ["q"]}, "profile alone"), ({"stage": "x"}, "stage envelope")])
def test_license_environment_and_stages(spark, base, tmp_path, change, fault):
    root = str(tmp_path / "w")
    shutil.copytree(base[0], root)
    write(root, release.SOURCE, json.dumps({"license_notice": {"scope": change.get("scope", "research")}}))
    write(root, "profiles/plugin.json", json.dumps({"determinism": {"declaration_id": change.get("plugin", "e1")}}))
    write(root, "profiles/e1.json", json.dumps({"execution_environment_id": change.get("own", "e1")}))
    write(root, "provenance/build/m.json", json.dumps({"embedding_profiles": change.get("profiles", [PROFILE]), "plugins": [{"execution_environment": {"id": change.get("build", "e1")}}]}))
    package = str(tmp_path / "p")
    builder.assemble(spark, root, package, "release-9", POLICY)
    stages = tuple(f.removesuffix("-stage-envelope.json") for f in os.listdir(os.path.join(package, release.STAGES)))[:1]
    policy = release.Policy(license_scope="research", environment="e1", stages=(change["stage"],) if "stage" in change else stages)
    if fault is None:
        assert release.verify(spark, package, policy).report["record_count"] == N
    else:
        with pytest.raises(release.ReleaseRefused, match=fault):
            release.verify(spark, package, policy)


def test_locks_and_pins(tmp_path):
    lock = str(tmp_path / "lock.json")
    held = evidence.environment_lock(lock)
    assert evidence.environment_lock(lock) == held
    files.write_document(held | {"python": "2.0"}, lock)
    with pytest.raises(evidence.EvidenceRefused, match="python"):
        evidence.environment_lock(lock)
    git = tmp_path / ".git"
    git.mkdir()
    (git / "HEAD").write_text("ref: refs/heads/main\n")
    (git / "packed-refs").write_text("# pack\nabc refs/heads/main\n")
    assert evidence.pinned_commit(str(tmp_path)) == "abc"
    (git / "HEAD").write_text("def\n")
    assert evidence.pinned_commit(str(tmp_path)) == "def"
    with pytest.raises(evidence.EvidenceRefused):
        evidence.pinned_commit(str(tmp_path / "none"))


def test_command_line(base, opened, tmp_path, capsys):
    from lodestrand.__main__ import main

    asked = tmp_path / "request.json"
    asked.write_text(json.dumps(request(opened)))
    assert main(["verify", opened[1]]) == 0 and json.loads(capsys.readouterr().out)["record_count"] == N
    assert main(["walk", opened[1], str(asked), "--oracle"]) == 0 and json.loads(capsys.readouterr().out)["differs"] == []
    assert main(["show", opened[1], str(asked)]) == 0 and json.loads(capsys.readouterr().out)["presentation_kind"] == "query-result"
    assert main(["validate", opened[1], str(tmp_path / "b.json"), str(tmp_path / "r.json"), "--bundle-id", "b", "--environment-label", "l"]) == 0
    assert main(["verify", str(tmp_path / "none")]) == 1 and main(["nothing"]) == 2
    assert main(["lock", str(tmp_path / "lock.json")]) == 0


def test_profile_contract():
    from lodestrand.plans import contracts

    profile = {"profile_id": "p", "version": "1", "lifecycle": "active", "input_contract": {"a": 1}, "model": {"artifact": "m", "revision": "r", "content_digest": "d"}, "tokenization": {"a": 1}, "pooling": {"a": 1}, "preprocessing": {}, "output": {"dimension": 3, "dtype": "float32"}, "metric": {"name": "cosine", "direction": "up"}, "compatibility": {"a": 1}, "provenance": {"plugin_descriptor": "x", "runner_environment": "y", "determinism": "z"}, "validation_links": []}
    assert contracts.from_json("embedding-profile", contracts.to_json("embedding-profile", profile)) == profile
    for change in ({"model": {"artifact": "m"}}, {"output": {"dimension": True, "dtype": "f"}}, {"output": {"dimension": 0, "dtype": "f"}}, {"validation_links": [""]}, {"pooling": {}}, {"extra": 1}, {"lifecycle": " "}):
        with pytest.raises(contracts.ContractError):
            contracts.check("embedding-profile", profile | change)


def test_the_oracle_refuses_what_its_declarations_deny(opened, tmp_path):
    target = str(tmp_path / "p")
    shutil.copytree(opened[1], target)
    assert evidence.Oracle(target, opened[0].digest, PROFILE).dimension == DIM
    for more in (("sha256:0", PROFILE), (opened[0].digest, "q")):
        with pytest.raises(evidence.OracleRefused):
            evidence.Oracle(target, *more)
    with open(os.path.join(target, release.VECTORS), "r+b") as f:
        f.write(b"\x00\x00\x00\x00")
    with pytest.raises(evidence.OracleRefused, match="declares"):
        evidence.Oracle(target)


def test_stage_helpers(base, tmp_path):
    assert builder.accession_of("asm:G1.1:canon-v1", "asm", "canon-v1") == "G1.1"
    with pytest.raises(builder.StageFailed):
        builder.accession_of("asm:canon-v1", "asm", "canon-v1")
    assert len(builder.canonical_inputs(base[0], N)) == N
    with pytest.raises(builder.StageFailed):
        builder.canonical_inputs(base[0], N + 1)
    builder.copy_into(base[0], str(tmp_path / "c"))
    with pytest.raises(builder.StageFailed):
        builder.copy_into(base[0], str(tmp_path / "c"))
    assert builder.failed_envelope("s", ValueError("x"))["verification"] == {"error": "ValueError", "message": "x"}
    tries, waits = [], []

    def fetch():
        tries.append(1)
        if len(tries) < 4:
            raise OSError("away")
        return "there"

    assert evidence.fetched(fetch, wait=waits.append) == "there" and waits == [1, 2, 4]
    with pytest.raises(OSError):
        evidence.fetched(lambda: open("/nowhere/at/all"), tries=2, wait=waits.append)  # noqa: SIM115


def test_run_policy_and_provenance(tmp_path, monkeypatch):
    for name in ("PYTHONHASHSEED", "CUDA_VISIBLE_DEVICES", "OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        monkeypatch.setenv(name, os.environ.get(name, ""))
    policy = evidence.deterministic()
    first = np.random.random()
    evidence.deterministic()
    assert np.random.random() == first and policy["threads"] == 1
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "HEAD").write_text("abc\n")
    assert evidence.run_provenance(str(tmp_path), policy) == evidence.run_provenance(str(tmp_path), policy)
