"""Queries of accounting, canonicalisation, packaging and evidence over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import texts
from lodestrand.operators import accounting, canonical
from lodestrand.plans import release
from lodestrand.session import Workspace, table
from lodestrand.streaming import ingest


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers and some that never order as the expected keys, the keys of orders as the observed ones, some of them strangers."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("key"))
    expected = customers.unionByName(customers.where("key % 50 = 0").select((F.col("key") + 20_000_000).alias("key")))
    stranger = F.when(F.col("o_orderkey") % 100 == 0, 10_000_000).otherwise(0)
    return expected, table(spark, sf_dir, "orders").select((F.col("o_custkey") + stranger).cast("bigint").alias("key"))


ACCOUNT_SQL = """WITH e AS (SELECT c_custkey::BIGINT AS key FROM customer UNION ALL SELECT c_custkey::BIGINT + 20000000 FROM customer WHERE c_custkey % 50 = 0), o AS (SELECT (o_custkey + CASE WHEN o_orderkey % 100 = 0 THEN 10000000 ELSE 0 END)::BIGINT AS key FROM orders) """
KINDS = {
    "registered": "SELECT key FROM e INTERSECT SELECT key FROM o",
    "missing": "SELECT key FROM e EXCEPT SELECT key FROM o",
    "unexpected": "SELECT key FROM o EXCEPT SELECT key FROM e",
    "duplicate": "SELECT key FROM o GROUP BY key HAVING count(*) > 1",
}


def _account(kind: str):
    return lambda spark, sf_dir: accounting.account_of(*_orders(spark, sf_dir), "key", kind)


# Letters outside the alphabet become bases, so that some texts are sequences and others aren't.
_FROM, _TO = "bdefhijlopquvwxz.,:;!?-_()'\"0123456789", "acgtacgtacgtacgtacgtacgtacgtacgtacgtac"


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.translate(F.regexp_replace("text", ">", "n"), _FROM, _TO).alias("text"))


_SEQ_SQL = f"""seq AS (SELECT doc_id, translate(replace(text, '>', 'n'), '{_FROM.replace("'", "''")}', '{_TO}') AS text FROM documents),
canon AS (SELECT doc_id, text, regexp_replace(translate(text, '{texts.LOWER}', '{texts.UPPER}'), '[ \\t\\r\\n\\f\\x0b]', '', 'g') AS bases FROM seq)"""


def canon_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    bases = texts.canonical_bases(F.col("text"))
    return _sequences(spark, sf_dir).select("doc_id", F.sha2(bases, 256).alias("bases_digest"), texts.is_canonical(bases).alias("ok"))


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a source file of one sequence; those whose report row is missing or whose bases are illegal."""
    name = F.col("doc_id").cast("string")
    files = _sequences(spark, sf_dir).where("text is not null").select(name.alias("accession"), F.concat(F.lit(">"), name, F.lit(" a note\n"), "text").alias("fasta"))
    reported = table(spark, sf_dir, "documents").where("doc_id % 9 <> 0").select(name.alias("accession"), name.alias("contig_id"))
    found = canonical.reasons(canonical.contigs(files), reported)
    return found.where("reason is not null").join(files.select("accession"), "accession").select("accession", "reason")


def pair_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record ids of documents and of records that stand on one side only."""
    left = table(spark, sf_dir, "documents").where("record_id is not null")
    return accounting.mismatch(left, table(spark, sf_dir, "records"), "record_id")


def canon_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines as the sequences of one file, in order of their identifiers."""
    lines = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "bases"))
    return canonical.canonical_files(lines.select("doc_id", F.lpad(F.col("n").cast("string"), 6, "0").alias("contig_id"), "bases"), "doc_id").select("doc_id", "digest")


def dup_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.duplicate_content(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", texts.digest(F.col("text")).alias("digest")), "doc_id", "digest")


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "assemblies").select("accession").distinct()
    return canonical.identities(rows, "accession", "asm", "asmcanon-v1")


def profile_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 512 characters of every document."""
    return canonical.windows(table(spark, sf_dir, "documents"), ["doc_id"], "text", 512).select("doc_id", F.col("window_no").cast("bigint").alias("window_no"), F.col("start").cast("bigint").alias("start"), F.sha2("window", 256).alias("digest"))


def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "records")
    digests = records.where("source_provenance_id is not null").select("record_id", F.col("sequence_digest").alias("digest"))
    return canonical.eligible(records, digests, "asmcanon-v1").select("ordinal", "record_id")


def row_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible records numbered in the order of their arrival."""
    rows = table(spark, sf_dir, "records").where("lifecycle_state = 'eligible'").select("ordinal", "record_id")
    return canonical.rows_of(rows, F.col("ordinal"))


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instance of each row that row_mapping numbers."""
    rows = row_mapping(spark, sf_dir)
    return rows.select(F.concat(F.lit("embedding:"), "record_id", F.lit(":p")).alias("instance_id"), "record_id", F.lit("p").alias("profile_id"), F.lit("shard-0").alias("shard_id"), "row")


def shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, mapped rows, and whether exactly the rows 0 to n - 1 are mapped, of each shard."""
    n = F.floor(F.octet_length("payload") / (F.col("dimension") * 4))
    keys = F.map_keys("row_mapping")
    wanted = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: i.cast("string"))).otherwise(F.array().cast("array<string>"))
    complete = (F.size(keys) == n) & (F.size(F.array_except(wanted, keys)) == 0)
    return table(spark, sf_dir, "vector_shards").select("shard_id", n.alias("n_rows"), F.size(keys).cast("bigint").alias("n_mapped"), complete.alias("complete")).distinct()


def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances whose row isn't among the withdrawn, taken as the finished rows of the same run."""
    rows = table(spark, sf_dir, "instances").select("instance_id", F.concat("created_in", F.lit("/"), "vector_reference.shard_id").alias("run_spec"), F.col("vector_reference.row").alias("row"), "eligibility_status")
    return canonical.pending(rows.select("instance_id", "run_spec", "row").distinct(), rows.where("eligibility_status = 'withdrawn'"))


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("records/"), F.col("doc_id"), F.lit(".txt")).alias("path"), content.alias("content"), F.octet_length(content).cast("bigint").alias("size"), texts.digest(content).alias("digest"))


def _mutated(artifacts: DataFrame) -> DataFrame:
    part = F.col("doc_id") % 97
    path = F.when(part == 4, F.concat("path", F.lit(".new"))).otherwise(F.col("path"))
    return artifacts.where(part != 3).select("doc_id", path.alias("path"), (F.col("size") + (part == 1).cast("int")).alias("size"), F.when(part == 2, F.lit("sha256:0")).otherwise(F.col("digest")).alias("digest"))


ART_SQL = """art AS (SELECT doc_id, 'records/' || doc_id || '.txt' AS path, coalesce(text, '') AS content, octet_length(encode(coalesce(text, '')))::BIGINT AS size, 'sha256:' || sha256(coalesce(text, '')) AS digest FROM documents),
mut AS (SELECT doc_id, CASE WHEN doc_id % 97 = 4 THEN path || '.new' ELSE path END AS path, size + (doc_id % 97 = 1)::INT AS size, CASE WHEN doc_id % 97 = 2 THEN 'sha256:0' ELSE digest END AS digest FROM art WHERE doc_id % 97 <> 3)"""


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return release.descriptors(_artifacts(spark, sf_dir), {".txt": "text/plain"})


def inventory_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = _artifacts(spark, sf_dir)
    return accounting.inventory(_mutated(actual), actual)


def successor_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _artifacts(spark, sf_dir)
    return accounting.successor_diff(old, _mutated(old))


_PATHS = ("records/{}", "/records/{}", "../{}", "a/../{}", "a\\{}", "..a/{}", "records/{}/..", "./{}", "a..b/{}")


def path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of safe and unsafe forms, one for each document."""
    path = F.lit("")
    for i, form in enumerate(_PATHS):
        before, after = form.split("{}")
        path = F.when(F.col("doc_id") % 11 == i, F.concat(F.lit(before), F.col("doc_id").cast("string"), F.lit(after))).otherwise(path)
    path = F.when(F.col("doc_id") % 11 == 9, F.lit(".")).otherwise(path)
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path")).select("doc_id", "path", texts.is_safe_path(F.col("path")).alias("safe"))


_PATH_CASES = " ".join("WHEN {} THEN '{}' || doc_id || '{}'".format(i, *f.split("{}")) for i, f in enumerate(_PATHS))
PATH_SQL = f"""WITH p AS (SELECT doc_id, CASE doc_id % 11 {_PATH_CASES} WHEN 9 THEN '.' ELSE '' END AS path FROM documents)
SELECT doc_id, path, NOT (path IN ('', '.') OR starts_with(path, '/') OR contains(path, chr(92)) OR list_contains(string_split(path, '/'), '..')) AS safe FROM p"""


def credential_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, some of them given a forbidden name or a marker."""
    part = F.col("doc_id") % 83
    name = F.when(part == 5, F.lit("id_RSA")).when(part == 6, F.lit("notes.env")).otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    marker = F.when(part == 7, F.lit("x aws_secret_access_key=1")).when(part == 8, F.lit("-----BEGIN PRIVATE KEY-----")).otherwise(F.lit(""))
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), F.col("doc_id"), F.lit("/"), name).alias("path"), F.concat(F.coalesce("text", F.lit("")), marker).cast("binary").alias("content"))
    return accounting.credential_faults(files)


def logical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of a release graph made of the records: one version of each, entities of one version, rows by ordinal."""
    first = table(spark, sf_dir, "records").groupBy("record_id").agg(F.min(F.struct("ordinal", "entity_id", "sequence_digest")).alias("r")).select("record_id", F.col("r.entity_id").alias("entity_id"), F.col("r.sequence_digest").alias("sequence_digest"), F.col("r.ordinal").alias("ordinal"))
    entities = first.select(F.col("record_id").alias("entity_id"), F.array("record_id").alias("record_versions"))
    refs = first.select("record_id", F.lit("p").alias("profile_id"), F.struct(F.col("ordinal").alias("row"), F.lit("s").alias("shard_id"), F.lit("d").alias("shard_digest")).alias("vector_reference"))
    found = release.logical_digest("release", first, entities, refs, "v")
    return spark.createDataFrame([(found,)], "logical_release_digest string")


LOGICAL_SQL = """WITH r AS (SELECT record_id, arg_min(entity_id, ordinal) AS entity_id, arg_min(sequence_digest, ordinal) AS sequence_digest, min(ordinal) AS ordinal FROM records GROUP BY record_id),
e AS (SELECT string_agg('{"entity_id":"' || record_id || '","record_versions":["' || record_id || '"]}', ',' ORDER BY record_id) AS t FROM r),
i AS (SELECT string_agg('{"profile_id":"p","record_id":"' || record_id || '","vector_reference":{"row":' || ordinal || ',"shard_digest":"d","shard_id":"s"}}', ',' ORDER BY ordinal) AS t FROM r),
c AS (SELECT string_agg('{"entity_id":"' || entity_id || '","record_id":"' || record_id || '","sequence_digest":"' || sequence_digest || '"}', ',' ORDER BY record_id) AS t FROM r)
SELECT 'sha256:' || sha256('{"entities":[' || e.t || '],"instances":[' || i.t || '],"records":[' || c.t || '],"release_id":"release","vector_shard_digest":"v"}') AS logical_release_digest FROM e, i, c"""


def verify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record checks with the number of rows that fail each, in one pass."""
    r = table(spark, sf_dir, "records")
    checks = {
        "complete": F.count_if(F.col("source_provenance_id").isNull() | F.col("lifecycle_state").isNull() | (F.col("lifecycle_state") == "")),
        "eligible": F.count_if(~F.col("lifecycle_state").eqNullSafe("eligible")),
        "canonical": F.count_if(~F.col("canonicalization_id").eqNullSafe("asmcanon-v1")),
        "unique": F.count("*") - F.count_distinct("record_id"),
    }
    one = r.agg(*(c.alias(k) for k, c in checks.items()))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check_id"), F.col(k).alias("metric")) for k in checks))).alias("c"))
    return rows.select("c.check_id", F.when(F.col("c.metric") == 0, "passed").otherwise("failed").alias("status"), "c.metric")


VERIFY_SQL = """WITH m AS (
  SELECT 'complete' AS check_id, count(*) FILTER (source_provenance_id IS NULL OR lifecycle_state IS NULL OR lifecycle_state = '') AS metric FROM records
  UNION ALL SELECT 'eligible', count(*) FILTER (lifecycle_state IS DISTINCT FROM 'eligible') FROM records
  UNION ALL SELECT 'canonical', count(*) FILTER (canonicalization_id IS DISTINCT FROM 'asmcanon-v1') FROM records
  UNION ALL SELECT 'unique', count(*) - count(DISTINCT record_id) FROM records)
SELECT check_id, CASE WHEN metric = 0 THEN 'passed' ELSE 'failed' END AS status, metric FROM m"""


def _replicates(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.sha2(F.concat_ws("|", "event_type", "props"), 256).alias("digest"))
    second = e.select("request_id", F.when(F.col("request_id") % 101 == 0, F.lit("other")).otherwise(F.col("digest")).alias("digest"))
    return [e, second, e.where("request_id % 103 <> 0")]


def replicate_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.replicate_compare(*_replicates(spark, sf_dir))


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields in which two runs of the events differ."""
    part = F.col("event_id") % 60
    pairs = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("a_event_type"), F.when(part == 1, F.lit(None)).otherwise(F.col("event_type")).alias("b_event_type"),
        F.col("user_id").alias("a_user_id"), F.when(part < 3, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("b_user_id"),
        F.col("value").alias("a_value"), F.when(part == 2, F.col("value") * 2 + 1).otherwise(F.col("value")).alias("b_value"),
    )
    return accounting.diagnostics(pairs, "event_id", ["event_type", "user_id", "value"]).select("event_id", F.array_join("differs", ",").alias("differs"))


def stream_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrived as a stream, landed exactly once and counted by kind."""
    work = Workspace(spark, "landed")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table(spark, sf_dir, "events").schema.fields)
    stream = ingest.deliveries(spark, f"{sf_dir}/event*.parquet", schema)
    ingest.land(stream, work.path("table"), work.path("checkpoint")).awaitTermination()
    return spark.read.schema(schema).parquet(work.path("table")).groupBy("event_type").agg(F.count("*").alias("n"))


QUERIES = {
    **{f"account_{k}": _account(k) for k in KINDS}, "canon_sequence": canon_sequence, "quarantine": quarantine, "pair_mismatch": pair_mismatch, "canon_digest": canon_digest, "dup_content": dup_content, "identity": identity,
    "profile_windows": profile_windows, "eligible": eligible, "row_mapping": row_mapping, "instances": instances, "shard_rows": shard_rows, "resume_pending": resume_pending, "descriptors": descriptors, "inventory_check": inventory_check,
    "path_safety": path_safety, "credential_scan": credential_scan, "successor_diff": successor_diff, "logical_digest": logical_digest, "verify_report": verify_report, "replicate_compare": replicate_compare, "diagnostics": diagnostics, "stream_landed": stream_landed,
}

_ROWS_SQL = "SELECT ordinal, record_id, row_number() OVER (ORDER BY ordinal) - 1 AS row FROM records WHERE lifecycle_state = 'eligible'"
ORACLES = {
    **{f"account_{k}": ACCOUNT_SQL + sql for k, sql in KINDS.items()},
    "canon_sequence": f"WITH {_SEQ_SQL} SELECT doc_id, sha256(bases) AS bases_digest, coalesce(regexp_full_match(bases, '[{texts.ALPHABET}]+'), false) AS ok FROM canon",
    "quarantine": f"""WITH {_SEQ_SQL} SELECT * FROM (SELECT doc_id::VARCHAR AS accession, CASE WHEN NOT regexp_full_match(bases, '[{texts.ALPHABET}]+') THEN 'an empty sequence or an unknown base'
        WHEN doc_id % 9 = 0 THEN 'sequences and report rows disagree' END AS reason FROM canon WHERE text IS NOT NULL) WHERE reason IS NOT NULL""",
    "pair_mismatch": """WITH d AS (SELECT DISTINCT record_id FROM documents WHERE record_id IS NOT NULL), r AS (SELECT DISTINCT record_id FROM records)
        SELECT record_id, 'unreported' AS status FROM d WHERE record_id NOT IN (SELECT record_id FROM r) UNION ALL SELECT record_id, 'missing' FROM r WHERE record_id NOT IN (SELECT record_id FROM d)""",
    "canon_digest": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS b, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS n FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, 'sha256:' || sha256(string_agg(lpad(n::VARCHAR, 6, '0') || chr(9) || b || chr(10), '' ORDER BY n)) AS digest FROM l GROUP BY doc_id""",
    "dup_content": "SELECT 'sha256:' || sha256(text) AS digest, n, doc_id FROM (SELECT *, count(*) OVER (PARTITION BY text) AS n FROM documents WHERE text IS NOT NULL) WHERE n > 1",
    "identity": "SELECT DISTINCT accession, 'asm:' || regexp_replace(accession, '\\.[^.]*$', '') AS entity_id, 'asm:' || accession || ':asmcanon-v1' AS record_id FROM assemblies",
    "profile_windows": """WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), 512)) AS start FROM documents WHERE length(text) > 0)
        SELECT doc_id, start // 512 AS window_no, start, sha256(substring(text, (start + 1)::INT, 512)) AS digest FROM s""",
    "eligible": """SELECT ordinal, record_id FROM records r WHERE lifecycle_state = 'eligible' AND canonicalization_id = 'asmcanon-v1'
        AND EXISTS (SELECT 1 FROM records d WHERE d.source_provenance_id IS NOT NULL AND d.record_id = r.record_id AND d.sequence_digest = r.sequence_digest)""",
    "row_mapping": _ROWS_SQL,
    "instances": f"SELECT 'embedding:' || record_id || ':p' AS instance_id, record_id, 'p' AS profile_id, 'shard-0' AS shard_id, row FROM ({_ROWS_SQL})",
    "shard_rows": """SELECT DISTINCT shard_id, n_rows, n_mapped, n_rows = n_mapped AND len(list_filter(range(0, n_rows), lambda i: NOT list_contains(keys, i::VARCHAR))) = 0 AS complete
        FROM (SELECT shard_id, octet_length(payload) // (dimension * 4) AS n_rows, cardinality(row_mapping)::BIGINT AS n_mapped, map_keys(row_mapping) AS keys FROM vector_shards)""",
    "resume_pending": """WITH r AS (SELECT instance_id, created_in || '/' || vector_reference.shard_id AS run_spec, vector_reference.row AS row, eligibility_status AS e FROM instances)
        SELECT DISTINCT instance_id, run_spec, row FROM r WHERE NOT EXISTS (SELECT 1 FROM r d WHERE d.e = 'withdrawn' AND d.run_spec = r.run_spec AND d.row = r.row)""",
    "descriptors": f"WITH {ART_SQL} SELECT path, 'text/plain' AS media_type, digest, size, '0.1.0' AS contract_version FROM art",
    "inventory_check": f"""WITH {ART_SQL} SELECT coalesce(m.path, a.path) AS path, CASE WHEN m.path IS NULL THEN 'undeclared' WHEN a.path IS NULL THEN 'missing' WHEN m.size <> a.size THEN 'size' ELSE 'digest' END AS fault
        FROM mut m FULL JOIN art a ON m.path = a.path WHERE m.path IS NULL OR a.path IS NULL OR m.size <> a.size OR m.digest <> a.digest""",
    "successor_diff": f"""WITH {ART_SQL} SELECT coalesce(m.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN m.path IS NULL THEN 'removed' WHEN m.size = a.size AND m.digest = a.digest THEN 'preserved' ELSE 'changed' END AS change
        FROM mut m FULL JOIN art a ON m.path = a.path""",
    "path_safety": PATH_SQL,
    "credential_scan": """WITH f AS (SELECT 'd/' || doc_id || '/' || CASE doc_id % 83 WHEN 5 THEN 'id_RSA' WHEN 6 THEN 'notes.env' ELSE doc_id || '.txt' END AS path,
        coalesce(text, '') || CASE doc_id % 83 WHEN 7 THEN 'x aws_secret_access_key=1' WHEN 8 THEN '-----BEGIN PRIVATE KEY-----' ELSE '' END AS content FROM documents)
        SELECT * FROM (SELECT path, CASE WHEN lower(string_split(path, '/')[-1]) IN ('.env', 'id_rsa', 'credentials.json') THEN 'name'
        WHEN contains(content, '-----BEGIN PRIVATE KEY-----') OR contains(content, 'aws_secret_access_key') OR contains(content, 'OPENAI_API_KEY=') THEN 'marker' END AS fault FROM f) WHERE fault IS NOT NULL""",
    "logical_digest": LOGICAL_SQL,
    "verify_report": VERIFY_SQL,
    "replicate_compare": """WITH e AS (SELECT event_id AS request_id, sha256(concat_ws('|', event_type, props)) AS digest FROM events),
        u AS (SELECT *, 0 AS r FROM e UNION ALL SELECT request_id, CASE WHEN request_id % 101 = 0 THEN 'other' ELSE digest END, 1 FROM e UNION ALL SELECT *, 2 FROM e WHERE request_id % 103 <> 0)
        SELECT request_id, count(DISTINCT r) AS n, count(*) = 3 AND count(DISTINCT r) = 3 AND count(DISTINCT digest) = 1 AS agrees FROM u GROUP BY request_id""",
    "diagnostics": """WITH p AS (SELECT event_id, event_type AS a1, CASE WHEN event_id % 60 = 1 THEN NULL ELSE event_type END AS b1, user_id AS a2, CASE WHEN event_id % 60 < 3 THEN user_id + 1 ELSE user_id END AS b2,
        value AS a3, CASE WHEN event_id % 60 = 2 THEN value * 2 + 1 ELSE value END AS b3 FROM events),
        d AS (SELECT event_id, concat_ws(',', CASE WHEN a1 IS DISTINCT FROM b1 THEN 'event_type' END, CASE WHEN a2 IS DISTINCT FROM b2 THEN 'user_id' END, CASE WHEN a3 IS DISTINCT FROM b3 THEN 'value' END) AS differs FROM p)
        SELECT event_id, differs FROM d WHERE differs <> ''""",
    "stream_landed": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
}
