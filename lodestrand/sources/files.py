"""Reading and writing JSON lines, artifacts and archives."""

from __future__ import annotations

import io
import json
import os
import zipfile
from collections.abc import Iterator, Mapping

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import texts


def read_lines(spark: SparkSession, path: str, fields: Mapping[str, str]) -> DataFrame:
    """A JSON-lines table as the given fields (name to type) and raw, the line as VARIANT, which keeps absent and null apart.

    Blank lines are skipped; lines end at LF, CR or both. A line that is no JSON object has a null raw: see faulty_lines().
    """
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    parsed = lines.select(F.try_parse_json("value").alias("raw"))
    parsed = parsed.select(F.when(F.schema_of_variant("raw").startswith("OBJECT"), F.col("raw")).alias("raw"))
    return parsed.select("raw", *(F.try_variant_get("raw", f"$.{name}", kind).alias(name) for name, kind in fields.items()))


def faulty_lines(table: DataFrame) -> DataFrame:
    """The rows of read_lines() that were no JSON objects."""
    return table.where(F.col("raw").isNull())


def read_artifacts(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """path (relative), size and digest of every file below root, with its bytes if asked for.

    Files are hashed where they are read. Spark takes each file as one value, so files over 2 GB need stream_digest().
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    prefix = fs.makeQualified(base).toUri().getPath().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    relative = F.substr(at, F.length(F.lit(prefix)) + 1)
    found = files.select(relative.alias("path"), F.col("content"))
    # Spark's file scans leave out empty files
    store, name = pfs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pfs.LocalFileSystem(), os.path.abspath(root))
    empty = [f.path[len(name.rstrip("/")) + 1 :] for f in store.get_file_info(pfs.FileSelector(name, recursive=True)) if f.type == pfs.FileType.File and f.size == 0]
    if empty:
        found = found.unionByName(spark.createDataFrame([(p, bytearray()) for p in empty], "path string, content binary"))
    kept = [F.col("content")] if content else []
    return found.select("path", F.octet_length("content").cast("bigint").alias("size"), texts.digest(F.col("content")).alias("digest"), *kept)


def _place(path: str) -> tuple[pfs.FileSystem, str]:
    """The file system of a path and the path in it; a path without scheme is local."""
    return pfs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pfs.LocalFileSystem(), os.path.abspath(path))


def copy_tree(spark: SparkSession, root: str, target: str, block: int = 8 << 20) -> DataFrame:
    """Copies every file below root and gives path (relative), size and digest of the bytes that were written.

    Each file is read once, in blocks, in a task of its own, so it may be of any size and what is hashed is what the copy
    holds, whatever happens to the original meanwhile. Use the frame's rows from a written table: each computation copies.
    """
    store, name = _place(root)
    name = name.rstrip("/")
    found = [f for f in store.get_file_info(pfs.FileSelector(name, recursive=True)) if f.type == pfs.FileType.File]
    paths = spark.createDataFrame([(f.path[len(name) + 1 :],) for f in found], "path string")

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        source, base = _place(root)
        sink, to = _place(target)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                own, size, place = hashlib.sha256(), 0, f"{to}/{path}"
                sink.create_dir(place.rpartition("/")[0], recursive=True)
                part = f"{place}.{os.getpid()}.part"  # a task that is run again writes its own
                with source.open_input_stream(f"{base.rstrip('/')}/{path}") as f, sink.open_output_stream(part) as out:
                    while data := f.read(block):
                        own.update(data)
                        out.write(data)
                        size += len(data)
                sink.move(part, place)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([f"sha256:{own.hexdigest()}"])], names=["path", "size", "digest"])

    return paths.repartition(max(1, min(len(found), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(copy, "path string, size bigint, digest string")


def stream_digest(path: str, block: int = 1 << 20) -> str:
    """The digest of a file of any size, block by block."""
    import hashlib

    own = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(block):
            own.update(part)
    return f"sha256:{own.hexdigest()}"


def read_members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """archive, member and content of the members whose name is or ends in suffix, of every ZIP file at path.

    A file that is no archive gives one row with null member.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        found = [(name, m, z.read(m)) for m in z.namelist() if m.endswith(suffix) and not m.endswith("/")]
                except zipfile.BadZipFile:
                    found = [(name, None, None)]
                for row in found:
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.string(), pa.binary()))], names=["archive", "member", "content"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(unpack, "archive string, member string, content binary")


def member_faults(members: DataFrame, names: list[str]) -> DataFrame:
    """archive, member and fault (missing, unexpected, repeated) against the exact set of names."""
    archives = members.select("archive").distinct()
    wanted = archives.withColumn("member", F.explode(F.array(*map(F.lit, names)))).withColumn("e", F.lit(1))
    there = members.where("member is not null").groupBy("archive", "member").agg(F.count("*").alias("n"))
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.col("n") > 1, "repeated")
    return wanted.join(there, ["archive", "member"], "full_outer").select("archive", "member", fault.alias("fault")).where(F.col("fault").isNotNull())


def load_inventory(spark: SparkSession, rows: object) -> DataFrame:
    """A source inventory: a non-empty list of objects with accession, domain and organism_name, accessions unique."""
    names = ("accession", "domain", "organism_name")
    if not isinstance(rows, list) or not rows:
        raise ValueError("the inventory must be a non-empty array")
    if not all(isinstance(r, dict) and all(isinstance(r.get(n), str) and r[n] for n in names) for r in rows):
        raise ValueError("inventory rows need accession, domain and organism_name")
    if len({r["accession"] for r in rows}) < len(rows):
        raise ValueError("an accession stands twice in the inventory")
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], "accession string, domain string, organism_name string")


def read_document(path: str) -> dict:
    """A JSON file that holds one object."""
    store, name = _place(path)
    with store.open_input_stream(name) as f:
        value = json.loads(f.read().decode("utf-8"))
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no JSON object")
    return value


def write_document(value: object, path: str, once: bool = False) -> None:
    """A JSON document, by a temporary file that takes the target's place; once refuses a target that exists."""
    part = f"{path}.{os.getpid()}.part"
    with open(part, "w", encoding="utf-8", newline="\n") as f:
        json.dump(value, f, indent=2, sort_keys=True)
        f.write("\n")
    try:
        if once:
            os.link(part, path)  # fails where the target is there, in one step
        else:
            os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.unlink(part)


def write_lines(df: DataFrame, path: str, order: str, compact: bool = True) -> int:
    """Rows in order as JSON lines with sorted members, null members included; refuses a target that exists.

    Lines are made on the executors and streamed through the driver partition by partition. Parquet is the sink for
    tables; this one is for the packaged form.
    """
    names = sorted(df.columns)
    comma, colon = (",", ":") if compact else (", ", ": ")
    member = lambda n: F.concat(F.lit(json.dumps(n) + colon), F.coalesce(F.regexp_replace(F.to_json(F.struct(F.col(n).alias("v"))), r'^\{"v":|\}$', ""), F.lit("null")))
    value = lambda n: F.when(F.col(n).isNull(), F.lit(json.dumps(n) + colon + "null")).otherwise(member(n))
    line = F.concat(F.lit("{"), F.concat_ws(comma, *map(value, names)), F.lit("}"))
    lines = df.orderBy(order).select(line.alias("line"))
    n = 0
    with open(path, "x", encoding="utf-8", newline="\n") as f:
        for r in lines.toLocalIterator():
            f.write(r["line"] + "\n")
            n += 1
    return n


def write_accessions(df: DataFrame, path: str, key: str = "accession") -> int:
    """One accession a line, in order, LF only; an empty list is refused."""
    if not df.take(1):
        raise ValueError("the accession list is empty")
    n = 0
    with open(path, "x", encoding="ascii", newline="\n") as f:
        for r in df.orderBy(key).toLocalIterator():
            f.write(f"{r[key]}\n")
            n += 1
    return n


def catalogue_digests(members: DataFrame) -> DataFrame:
    """archive and digest of the catalogue member, from read_members(): null where it isn't the only one or no JSON object."""
    text = F.decode("content", "UTF-8")
    good = F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))
    one = members.groupBy("archive").agg(F.count("member").alias("n"), F.max(F.when(good, texts.digest(F.col("content")))).alias("digest"))
    return one.select("archive", F.when(F.col("n") == 1, F.col("digest")).alias("digest"))
