"""Sources and sinks: vectors, JSON lines, artifacts, archives, streams, contracts."""

from __future__ import annotations

import hashlib
import json
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.operators import accounting, canonical
from lodestrand.plans import contracts
from lodestrand.sources import files, vectors
from lodestrand.streaming import ingest


def test_vectors_round_trip(spark, tmp_path):
    v = np.random.default_rng(1).standard_normal((1001, 7)).astype("<f4")
    v[3, 2] = np.nan
    path = str(tmp_path / "v.float32le")
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "row long, vector array<float>").repartition(5)
    assert vectors.write_float32(df, path) == v.nbytes
    with open(path, "rb") as f:
        assert f.read() == v.tobytes()
    got = vectors.read_float32(spark, path, 7, 100)
    assert got.rdd.getNumPartitions() == 11
    assert np.array([r["vector"] for r in got.orderBy("row").collect()], "<f4").tobytes() == v.tobytes()
    with pytest.raises(FileExistsError):
        vectors.write_float32(df, path)
    with pytest.raises(Exception, match="whole number"):
        vectors.read_float32(spark, path, 8).count()


def test_rows_of_a_payload(spark):
    data = np.arange(6, dtype="<f4").tobytes()
    df = spark.createDataFrame([(data, 2, r) for r in (0, 2, 3, -1, None)] + [(None, 2, 0)], "p binary, d int, r long")
    got = [r["v"] for r in df.select(vectors.rows_of_payload("p", "d", "r").alias("v")).collect()]
    assert got == [[0.0, 1.0], [4.0, 5.0], None, None, None, None]


def test_lines_keep_absent_and_null_apart(spark, tmp_path):
    path = tmp_path / "t.jsonl"
    path.write_bytes(b'{"a":"x"}\r\n\n{"a":null}\n{}\n[1]\nbroken\n{"a":"\xe2\x80\xa8"}')
    table = files.read_lines(spark, str(path), {"a": "string"})
    assert table.count() == 6 and files.faulty_lines(table).count() == 2
    held = table.where(F.col("raw").isNotNull()).select("a", F.variant_get("raw", "$.a", "variant").isNull().alias("absent")).collect()
    assert [(r["a"], r["absent"]) for r in held] == [("x", False), (None, False), (None, True), (" ", False)]


def test_line_sink_is_ordered_sorted_json(spark, tmp_path):
    path = str(tmp_path / "o.jsonl")
    df = spark.createDataFrame([(2, None, {"k": "v"}), (1, 'q"\n', {})], "n int, b string, a map<string,string>")
    assert files.write_lines(df, path, "n") == 2
    with open(path) as f:
        assert [json.loads(line) for line in f] == [{"a": {}, "b": 'q"\n', "n": 1}, {"a": {"k": "v"}, "b": None, "n": 2}]
    with pytest.raises(FileExistsError):
        files.write_lines(df, path, "n")


def test_artifacts_and_faults(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.bin").write_bytes(b"\xff\xfeaws_secret_access_key")
    (tmp_path / "ID_rsa").write_bytes(b"")
    got = {r["path"]: r for r in files.read_artifacts(spark, str(tmp_path), content=True).collect()}
    assert set(got) == {"d/a.bin", "ID_rsa"} and got["d/a.bin"]["digest"] == "sha256:" + hashlib.sha256(b"\xff\xfeaws_secret_access_key").hexdigest()
    assert files.stream_digest(str(tmp_path / "d" / "a.bin")) == got["d/a.bin"]["digest"]
    faults = {r["path"]: r["fault"] for r in accounting.credential_faults(files.read_artifacts(spark, str(tmp_path), content=True)).collect()}
    assert faults == {"d/a.bin": "marker", "ID_rsa": "name"}


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/one.txt", "1")
        z.writestr("more.txt", "2")
    (tmp_path / "b.zip").write_bytes(b"no archive")
    members = files.read_members(spark, str(tmp_path), ".txt").cache()
    assert {r["member"] for r in members.collect()} == {"x/one.txt", "more.txt", None}
    faults = {(os.path.basename(r["archive"]), r["member"], r["fault"]) for r in files.member_faults(members, ["x/one.txt", "two.txt"]).collect()}
    assert {("a.zip", "two.txt", "missing"), ("a.zip", "more.txt", "unexpected"), ("b.zip", "two.txt", "missing")} <= faults


def test_inventory_and_lists(spark, tmp_path):
    row = {"accession": "b", "domain": "d", "organism_name": "o"}
    df = files.load_inventory(spark, [row, row | {"accession": "a"}])
    path = str(tmp_path / "l.txt")
    files.write_accessions(df, path)
    with open(path, "rb") as f:
        assert f.read() == b"a\nb\n"
    for bad in ([], {}, [row, row], [row | {"domain": ""}]):
        with pytest.raises(ValueError):
            files.load_inventory(spark, bad)
    with pytest.raises(ValueError):
        files.write_accessions(df.where("false"), str(tmp_path / "e.txt"))


def test_accounting_example(spark):
    expected = spark.createDataFrame([(f"a{i}",) for i in range(12)], "key string")
    observed = spark.createDataFrame([(f"a{i}",) for i in range(11)] + [("a0",), ("stranger",)], "key string")
    for kind, keys in (("missing", ["a11"]), ("unexpected", ["stranger"]), ("duplicate", ["a0"])):
        assert [r["key"] for r in accounting.account_of(expected, observed, "key", kind).collect()] == keys
    assert not accounting.is_complete(accounting.account(expected, observed, "key")) and accounting.is_complete(accounting.account(expected, expected, "key"))
    names = spark.createDataFrame([("", "c"), (None, "d"), ("a", "x")], "accession string, current_accession string")
    assert [r[0] for r in names.select(accounting.accession(names)).collect()] == ["c", "d", "a"]


def test_row_numbers_follow_the_order(spark):
    df = spark.range(0, 5000, 3).selectExpr("id * 7 % 5003 AS k").repartition(6)
    got = sorted((r["k"], r["row"]) for r in canonical.rows_of(df, F.col("k")).collect())
    assert [r for _, r in got] == list(range(len(got)))


def test_streams_land_once(spark, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "id long, at timestamp"
    make = lambda ids: spark.createDataFrame([(i,) for i in ids], "id long").withColumn("at", F.lit("2026-01-01").cast("timestamp"))
    make([1, 2, 2]).write.parquet(source)
    for n in (2, 3):
        stream = ingest.once(ingest.deliveries(spark, source, schema), ["id"], "at")
        ingest.land(stream, target, mark).awaitTermination()
        assert spark.read.schema(schema).parquet(target).count() == n
        make([2, 3]).write.mode("append").parquet(source)


def test_contracts_are_closed():
    record = {n: "x" for n in contracts.SHAPES["record"]}
    assert contracts.from_json("record", contracts.to_json("record", record)) == record
    for bad in (record | {"more": 1}, {k: v for k, v in record.items() if k != "entity_id"}, record | {"entity_id": " "}, []):
        with pytest.raises(contracts.ContractError):
            contracts.check("record", bad)
    stage = {"stage_id": "s", "input_artifacts": [], "output_artifacts": [], "outcome": "reused", "verification": {}}
    assert contracts.check("stage", stage) == stage
    with pytest.raises(contracts.ContractError):
        contracts.check("stage", stage | {"outcome": "maybe"})
    assert contracts.utc("2026-07-21T10:00:00+02:00") == "2026-07-21T08:00:00Z"
    with pytest.raises(contracts.ContractError):
        contracts.utc("2026-07-21T10:00:00")


def test_reports_and_canonical_lines(spark):
    reports = spark.createDataFrame([("a", '{"refseqAccession":"x"}\n\n{"refseqAccession":"y"}\r\n'), ("b", '{"refseqAccession":"x"}\n{"refseqAccession":"x"}\n{"refseqAccession":5}\n[]\n{')], "accession string, report string")
    got = sorted((r["accession"], r["contig_id"] or "", r["fault"] or "") for r in canonical.report_rows(reports).collect())
    assert got == [("a", "x", ""), ("a", "y", ""), ("b", "", "json"), ("b", "", "json"), ("b", "", "member"), ("b", "x", "repeated"), ("b", "x", "repeated")]
    lines = canonical.contig_lines(spark.createDataFrame([("a", "c1\tAC\nc2\tN\n"), ("b", "c1\n\tA\nc\ta\tb\n")], "accession string, canonical string"))
    assert sorted((r["accession"], r["ordinal"], r["fault"]) for r in lines.collect()) == [("a", 0, False), ("a", 1, False), ("b", 0, True), ("b", 1, True), ("b", 2, True)]


def test_acquisition(spark, tmp_path):
    from lodestrand.plans import builder

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/assembly_data_report.jsonl", '{"accession":"a1"}\n{"accession":"","current_accession":"a2"}\n{"accession":"a1"}\n{"accession":"z"}\n')
        z.writestr("d/dataset_catalog.json", '{"x": 1}')
    expected = spark.createDataFrame([("a1",), ("a2",), ("a3",)], "accession string")
    accounted = builder.account_archives(files.read_members(spark, str(tmp_path), "assembly_data_report.jsonl"), expected)
    assert builder.stage_envelope("acquire", accounted)["verification"] == {"registered": 2, "missing": 1, "unexpected": 1, "duplicate": 1}
    digest = files.catalogue_digests(files.read_members(spark, str(tmp_path), "dataset_catalog.json")).first()["digest"]
    assert digest == "sha256:" + hashlib.sha256(b'{"x": 1}').hexdigest()


def test_environments_and_incidents(tmp_path):
    from lodestrand.plans import builder, evidence

    declared = {"runtime": {"python": "3.12", "threads": 1}, "kind": "k"}
    assert builder.environment_faults(declared, declared | {"more": 1}) == []
    assert builder.environment_faults(declared, {"runtime": {"python": "3.13", "threads": True}}) == ["kind", "runtime.python", "runtime.threads"]
    build = {"embedding_profiles": ["p"], "plugins": [{"execution_environment": {"id": "e", "declaration_digest": "d"}}]}
    assert builder.selects_environment(build, "e", "d", "p") and not builder.selects_environment(build | {"plugins": []}, "e", "d", "p")
    log = evidence.IncidentLog(str(tmp_path / "log"))
    log.append("a", {"x": 0.5})
    log.append("b", None)
    assert [e["kind"] for e in log.entries()] == ["a", "b"] and evidence.environment()["python"]
    text = (tmp_path / "log").read_text().replace("0.5", "0.6")
    (tmp_path / "log").write_text(text)
    with pytest.raises(ValueError):
        log.entries()


def test_broadcasts_are_checked_by_true_bytes(spark):
    from pyspark.sql import functions as F

    from lodestrand import session

    wide = spark.range(20_000, numPartitions=8).select("id", F.array_repeat(F.lit(1.5), 131_072).alias("v"))  # 1 MB a row
    rows, held = session.measured(wide)
    assert rows == 20_000 and held > 20_000 << 20 and not session.small(wide)
    nested = spark.range(100).select(F.array(F.struct(F.lit("x" * 1000).alias("s"), F.create_map(F.lit("k"), F.lit("y" * 500)).alias("m"))).alias("a"))
    assert 100 * 1500 < session.measured(nested)[1] < 100 * 2000 and session.small(nested)
    assert not session.small(spark.range(11), rows=10) and session.measured(spark.range(0))[0] == 0
    assert session.measured(spark.sql("select null as n, cast(null as string) as s, cast(null as array<string>) as a"))[1] < 64
