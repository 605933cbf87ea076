"""Queries that run operators of the packaged pipeline over the driver's tables to the bit, with their SQL."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import floats
from lodestrand.operators import canonical
from lodestrand.plans import builder, release
from lodestrand.plans import request as R
from lodestrand.session import Workspace, shared_dir, table
from lodestrand.sources import files, vectors

# The compensated sum as a fold: {s} the sum, {c} what rounding lost, of a list of doubles.
_TOTAL_SQL = """list_reduce(list_prepend({{'s': 0.0::DOUBLE, 'c': 0.0::DOUBLE}}, list_transform({0}, lambda y: {{'s': y::DOUBLE, 'c': 0.0::DOUBLE}})),
    lambda a, e: {{'s': a.s + e.s, 'c': a.c + CASE WHEN abs(a.s) >= abs(e.s) THEN (a.s - (a.s + e.s)) + e.s ELSE (e.s - (a.s + e.s)) + a.s END}})"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as windows of sequences, eight to each."""
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).cast("bigint").alias("sequence"), F.col("vec_id").alias("window_no"), F.col("embedding").alias("vector"))


def pool_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled means to the bit: compensated sums in the order of windows."""
    pooled = canonical.pooled(_windows(spark, sf_dir), ["sequence"], "window_no", "vector")
    return pooled.select("sequence", F.posexplode("pooled").alias("position", "mean")).select("sequence", F.col("position").cast("bigint").alias("position"), "mean")


def unit_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors scaled to length 1 in double, the length being a compensated sum; vectors that can't be scaled give no row."""
    unit = floats.normalised(F.transform("embedding", lambda x: x.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(unit).alias("position", "component")).select("vec_id", F.col("position").cast("bigint").alias("position"), "component")


def sum_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compensated sum of each vector's components, large and small ones mixed so that plain addition would lose bits."""
    mixed = F.transform("embedding", lambda x, i: x.cast("double") * F.when(i % 3 == 0, F.lit(1e15)).when(i % 3 == 1, F.lit(1.0)).otherwise(F.lit(1e-9)))
    return table(spark, sf_dir, "embeddings").select("vec_id", floats.total(mixed).alias("total"))


def record_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the verifier counts of records: rows, distinct ids, incomplete, ineligible, of another canonicalisation or form."""
    policy = release.Policy(canonicalization_id="asmcanon-v1", namespace="asm")
    return release.record_counts(table(spark, sf_dir, "records"), policy)


def instance_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the verifier counts of the instances of each shard, held against the shard's digest, profile and rows."""
    shards = table(spark, sf_dir, "vector_shards").groupBy("shard_id").agg(F.max("profile_id").alias("of"), F.max("digest").alias("own"), F.max(F.floor(F.octet_length("payload") / (F.col("dimension") * 4))).alias("held"))
    own = table(spark, sf_dir, "instances").join(shards, F.col("vector_reference.shard_id") == shards["shard_id"])
    return release.instance_counts(own, F.col("of"), F.col("own"), F.col("held"))


def _lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical files, some with a broken line: one for each document."""
    name = F.col("doc_id").cast("string")
    part = F.col("doc_id") % 7
    second = F.when(part == 3, F.concat(name, F.lit("-b ACGT"))).when(part == 4, F.concat(name, F.lit("-b\t"))).when(part == 5, F.concat(name, F.lit("-b\tAC\tGT"))).otherwise(F.concat(name, F.lit("-b\tNNNN")))
    return table(spark, sf_dir, "documents").select(name.alias("accession"), F.concat(name, F.lit("-a\tACGT\n"), second, F.lit("\n")).alias("canonical"))


def canonical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs read back from canonical files; bases and ids of broken lines aren't shown."""
    found = canonical.contig_lines(_lines_of(spark, sf_dir))
    return found.select("accession", F.col("ordinal").cast("bigint").alias("ordinal"), F.when(~F.col("fault"), F.col("contig_id")).alias("contig_id"), F.when(~F.col("fault"), F.col("bases")).alias("bases"), "fault")


_LINES_SQL = """SELECT doc_id::VARCHAR AS accession, 0::BIGINT AS ordinal, doc_id || '-a' AS contig_id, 'ACGT' AS bases, false AS fault FROM documents
UNION ALL SELECT doc_id::VARCHAR, 1, CASE WHEN doc_id % 7 NOT IN (3, 4, 5) THEN doc_id || '-b' END, CASE WHEN doc_id % 7 NOT IN (3, 4, 5) THEN 'NNNN' END, doc_id % 7 IN (3, 4, 5) FROM documents"""


def report_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report rows of documents taken as reports: good lines, and repeated, nameless and broken ones by the document's number."""
    name = F.col("doc_id").cast("string")
    part = F.col("doc_id") % 6
    first = F.concat(F.lit('{"refseqAccession":"'), name, F.lit('"}\n\n'))
    second = F.when(part == 1, first).when(part == 2, F.lit('{"refseqAccession":""}')).when(part == 3, F.lit('{"refseqAccession":7}')).when(part == 4, F.lit("[1]")).when(part == 5, F.lit('{"refseqAccession":')).otherwise(F.concat(F.lit('{"refseqAccession":"'), name, F.lit('-2"}')))
    reports = table(spark, sf_dir, "documents").select(name.alias("accession"), F.concat(first, second).alias("report"))
    return canonical.report_rows(reports)


_REPORT_SQL = """SELECT doc_id::VARCHAR AS accession, doc_id::VARCHAR AS contig_id, CASE WHEN doc_id % 6 = 1 THEN 'repeated' END AS fault FROM documents
UNION ALL SELECT doc_id::VARCHAR, CASE doc_id % 6 WHEN 0 THEN doc_id || '-2' WHEN 1 THEN doc_id::VARCHAR END, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'repeated' WHEN 2 THEN 'member' WHEN 3 THEN 'member' ELSE 'json' END FROM documents"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as they may arrive, one for each order: members in any order, white space, numbers spelt in several ways."""
    key = F.col("o_orderkey").cast("string")
    limit = F.when(F.col("o_orderkey") % 3 == 0, "12").when(F.col("o_orderkey") % 3 == 1, "12.0").otherwise("1.2e1")
    text = F.concat(
        F.lit('{ "similarity": {"mode":"exact", "metric":"cosine","query_record_id":"r'), key, F.lit('"}, "pagination":{"limit":'), limit,
        F.lit('},\n"filter":{"any":[{"in":{"values":["b","a","b"],"field":"f"}},{"eq":{"value":"'), key, F.lit('","field":"g"}},{"eq":{"value":"'), key, F.lit('","field":"g"}}]},"operation":"similarity"}'),
    )
    broken = F.when(F.col("o_orderkey") % 50 == 0, F.concat(text, F.lit("}"))).when(F.col("o_orderkey") % 50 == 1, F.lit('{"a":1,"a":2}')).when(F.col("o_orderkey") % 50 == 2, F.lit("[]")).otherwise(text)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("request_id"), broken.alias("request"))


def request_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each request's normal form, or the code that it is refused with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, codes = [], []
            for text in batch.column(1).to_pylist():
                try:
                    digests.append(R.canonicalise(text).digest)
                    codes.append(None)
                except R.RequestRefused as e:
                    digests.append(None)
                    codes.append(e.code)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string()), pa.array(codes, pa.string())], names=["request_id", "digest", "code"])

    return _requests(spark, sf_dir).mapInArrow(run, "request_id bigint, digest string, code string")


_REQUEST_SQL = """WITH r AS (SELECT o_orderkey::BIGINT AS request_id, o_orderkey::VARCHAR AS k FROM orders),
n AS (SELECT request_id, '{"filter":{"any":[{"eq":{"field":"g","value":"' || k || '"}},{"in":{"field":"f","values":["a","b"]}}]},"operation":"similarity","pagination":{"cursor":null,"limit":12,"ordering_version":"score-desc-record-id-asc-v1"},"similarity":{"metric":"cosine","mode":"exact","query_record_id":"r' || k || '"}}' AS t FROM r)
SELECT request_id, CASE WHEN request_id % 50 > 2 THEN 'sha256:' || sha256(t) END AS digest, CASE WHEN request_id % 50 <= 2 THEN 'validation_error' END AS code FROM n"""


def _folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for the packaged form, which is written through the driver's file system."""
    path = Workspace(spark, purpose).root.removeprefix("file://")
    if not shared_dir(spark).startswith("file:") and "://" in shared_dir(spark):
        raise RuntimeError("the packaged form is written to a mounted folder")
    os.makedirs(path, exist_ok=True)
    return path


def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as a JSON-lines table and scanned again."""
    path = f"{_folder(spark, 'lines')}/table.jsonl"
    names = list(release.RECORD_FIELDS)
    files.write_lines(table(spark, sf_dir, "records").select("ordinal", *names), path, "ordinal")
    return files.read_lines(spark, path, {"ordinal": "bigint"} | release.RECORD_FIELDS).drop("raw")


def float32_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings written as a headerless float32 file and scanned again by row ranges."""
    path = f"{_folder(spark, 'float32')}/vectors.float32le"
    embeddings = table(spark, sf_dir, "embeddings")
    vectors.write_float32(embeddings, path, "vec_id", "embedding")
    found = vectors.read_float32(spark, path, len(embeddings.select("embedding").first()[0]), 500)
    return found.select("row", F.posexplode("vector").alias("position", "component")).select("row", F.col("position").cast("bigint").alias("position"), "component")


def artifact_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written one for each nation, copied with digests: paths, sizes and digests of the copy."""
    root = _folder(spark, "artifacts")
    for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():  # a fixed table of 25 rows
        os.makedirs(f"{root}/from/{r['n_nationkey'] % 3}", exist_ok=True)
        with open(f"{root}/from/{r['n_nationkey'] % 3}/{r['n_nationkey']}.txt", "w", encoding="utf-8", newline="") as f:
            f.write(r["n_name"] * (r["n_nationkey"] % 4))
    return files.copy_tree(spark, f"{root}/from", f"{root}/to", block=7)


def batch_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a batch of records, of which some have kept vectors and verdicts, some of another input, twice or in dispute."""
    key = F.col("o_orderkey")
    part = key % 12
    rows = table(spark, sf_dir, "orders").select(key.cast("bigint").alias("record_id"), part.alias("part"), F.col("o_orderstatus").alias("status"), F.concat(F.lit("d"), key.cast("string")).alias("digest"))
    kept = rows.select("record_id", "part", "status", F.when(F.col("part") == 1, F.lit("old")).otherwise(F.col("digest")).alias("digest"), F.concat(F.lit("v"), F.col("digest")).alias("vector_digest"))
    vectors_ = kept.where("part <> 2")
    verdicts = kept.where("part <> 3").withColumn("vector_digest", F.when(F.col("part") == 4, F.lit("other")).otherwise(F.col("vector_digest")))
    return builder.reusable(rows, vectors_, verdicts.unionByName(verdicts.where("part = 5")).drop("part"))


QUERIES = {
    "batch_reuse": batch_reuse,
    "pool_exact": pool_exact, "unit_exact": unit_exact, "sum_exact": sum_exact, "record_integrity": record_integrity, "instance_integrity": instance_integrity, "canonical_lines": canonical_lines,
    "report_faults": report_faults, "request_digests": request_digests, "jsonl_round_trip": jsonl_round_trip, "float32_round_trip": float32_round_trip, "artifact_scan": artifact_scan,
}

_MEANS_SQL = _TOTAL_SQL.format("xs")
_LENGTH_SQL = _TOTAL_SQL.format("list_transform(v, lambda x: x * x)")
_MIXED_SQL = _TOTAL_SQL.format("list_transform(embedding, lambda x, i: x::DOUBLE * CASE (i - 1) % 3 WHEN 0 THEN 1e15 WHEN 1 THEN 1.0::DOUBLE ELSE 1e-9 END)")
ORACLES = {
    "batch_reuse": "SELECT o_orderkey::BIGINT AS record_id, o_orderkey % 12 NOT IN (1, 2, 3, 4, 5) AS reused, CASE WHEN o_orderkey % 12 NOT IN (1, 2, 3, 4, 5) THEN o_orderstatus END AS status FROM orders",
    "pool_exact": f"""WITH x AS (SELECT vec_id // 8 AS sequence, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS position FROM embeddings),
        l AS (SELECT sequence, position, list(x ORDER BY vec_id) AS xs FROM x GROUP BY 1, 2), t AS (SELECT sequence, position, len(xs) AS n, {_MEANS_SQL} AS t FROM l) SELECT sequence, position, (t.s + t.c) / n AS mean FROM t""",
    "unit_exact": f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), t AS (SELECT vec_id, v, {_LENGTH_SQL} AS t FROM v)
        SELECT vec_id, unnest(range(len(v))) AS position, unnest(list_transform(v, lambda x: x / sqrt(t.s + t.c))) AS component FROM t""",
    "sum_exact": f"SELECT vec_id, t.s + t.c AS total FROM (SELECT vec_id, {_MIXED_SQL} AS t FROM embeddings)",
    "record_integrity": """SELECT count(*) AS n, count(DISTINCT record_id) AS ids,
        count(*) FILTER (NOT coalesce(record_id <> '' AND entity_id <> '' AND sequence_digest <> '' AND canonicalization_id <> '' AND source_provenance_id <> '' AND lifecycle_state <> '', false)) AS complete,
        count(*) FILTER (lifecycle_state IS DISTINCT FROM 'eligible') AS state, count(*) FILTER (canonicalization_id IS DISTINCT FROM 'asmcanon-v1') AS canon,
        count(*) FILTER (NOT coalesce(starts_with(record_id, 'asm:') AND ends_with(record_id, ':' || canonicalization_id), false)) AS form FROM records""",
    "instance_integrity": """WITH s AS (SELECT shard_id, max(profile_id) AS p, max(digest) AS d, max(octet_length(payload) // (dimension * 4)) AS held FROM vector_shards GROUP BY 1)
        SELECT count(*) AS n, count(*) FILTER (NOT coalesce(instance_id IS NOT NULL AND profile_id = p AND vector_reference.shard_digest = d AND vector_reference.row BETWEEN 0 AND held - 1, false)) AS bad,
        count(DISTINCT record_id) AS records, count(DISTINCT vector_reference.row) AS rows FROM instances i JOIN s ON i.vector_reference.shard_id = s.shard_id""",
    "canonical_lines": _LINES_SQL,
    "report_faults": _REPORT_SQL,
    "request_digests": _REQUEST_SQL,
    "jsonl_round_trip": "SELECT ordinal, record_id, entity_id, sequence_digest, canonicalization_id, source_provenance_id, lifecycle_state FROM records",
    "float32_round_trip": "SELECT vec_id AS row, unnest(range(len(embedding))) AS position, unnest(embedding) AS component FROM embeddings",
    "artifact_scan": "SELECT (n_nationkey % 3) || '/' || n_nationkey || '.txt' AS path, octet_length(encode(repeat(n_name, (n_nationkey % 4)::INT)))::BIGINT AS size, 'sha256:' || sha256(repeat(n_name, (n_nationkey % 4)::INT)) AS digest FROM nation",
}
