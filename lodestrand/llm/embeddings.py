"""The valid vectors of the records, from vector shards through their row mappings or from reference vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.session import broadcast_if_small, table

TOLERANCE = 1e-5
SCHEMA = "record_id string, profile_id string, vector binary"


def _valid(rows: np.ndarray) -> np.ndarray:
    """Finite in every component and of length 1 within the tolerance."""
    with np.errstate(all="ignore"):
        length = np.sqrt((rows.astype(np.float64) ** 2).sum(1))
        return np.isfinite(rows).all(1) & (np.abs(length - 1) <= TOLERANCE)


def _blobs(rows: np.ndarray, valid: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() if ok else None for r, ok in zip(np.ascontiguousarray(rows, "<f4"), valid)], pa.binary())


def shard_rows(shards: DataFrame) -> DataFrame:
    """One row for each row of a payload that the mapping names: shard_id, digest, profile_id, row, instance_id, vector.

    vector is null where the gate fails. Mapping entries whose row isn't a number or lies outside the payload give none,
    so does a shard without payload, mapping or dimension, or of another dtype.
    """
    source = shards.where((F.col("dtype") == "float32le") & (F.col("dimension") > 0)).select("shard_id", "digest", "profile_id", "dimension", "payload", F.map_entries("row_mapping").alias("entries")).where(F.col("payload").isNotNull() & F.col("entries").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, digest, profile, dimension, payload, entries in zip(*(c.to_pylist() for c in batch.columns)):
                rows = np.frombuffer(payload, "<f4", len(payload) // (4 * dimension) * dimension).reshape(-1, dimension)
                named = [(int(e["key"]), e["value"]) for e in entries if e["key"].isascii() and e["key"].isdigit() and int(e["key"]) < len(rows)]
                if not named:
                    continue
                at, instances = zip(*named)
                taken = rows[list(at)]
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.string()), pa.array([digest] * n, pa.string()), pa.array([profile] * n, pa.string()), pa.array(at, pa.int64()), pa.array(instances, pa.string()), _blobs(taken, _valid(taken))], names=["shard_id", "digest", "profile_id", "row", "instance_id", "vector"])

    return source.mapInArrow(run, "shard_id string, digest string, profile_id string, row bigint, instance_id string, vector binary")


def reference_rows(references: DataFrame) -> DataFrame:
    """record_id, profile_id and the vector as bytes; null where the gate fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, blobs = batch.column(2), np.full(batch.num_rows, None, object)
            offsets, flat = held.offsets.to_numpy(), held.values.to_numpy(zero_copy_only=False).astype(np.float32)  # null components are NaN
            lengths = np.where(held.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
            for n in np.unique(lengths[lengths > 0]).tolist():
                at = np.flatnonzero(lengths == n)
                rows = flat[offsets[at][:, None] + np.arange(n)]
                blobs[at] = _blobs(rows, _valid(rows)).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], names=["record_id", "profile_id", "vector"])

    return references.select("record_id", "profile_id", "vector").mapInArrow(run, SCHEMA)


def valid_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, profile_id, vector (float32 little-endian bytes): one row for each record with a valid vector.

    A record with an eligible instance has that instance's payload row, valid or not; only one without has its reference
    vector. Of several eligible instances the one of the least instance_id counts, of several reference rows or
    deliveries of a shard the first in the files. Null record ids take no part.
    """
    eligible = table(spark, sf_dir, "instances").where((F.col("eligibility_status") == "eligible") & F.col("record_id").isNotNull())
    chosen = eligible.groupBy("record_id").agg(F.min(F.struct("instance_id", "profile_id", "vector_reference")).alias("i"))
    # the place that an instance names, as 128 bits of hash: the side that may be broadcast stays narrow
    ref = F.col("i.vector_reference")
    chosen = chosen.select("record_id", *_place(ref.shard_id, ref.shard_digest, F.col("i.profile_id"), ref.row, F.col("i.instance_id")))
    # deliveries are told apart by their place in the files, so that only narrow rows are compared and no payload is shuffled
    shards = _first(table(spark, sf_dir, "vector_shards"), ["shard_id", "digest", "profile_id"])
    named = shard_rows(shards).where("vector is not null").select("profile_id", "vector", *_place(*(F.col(c) for c in ("shard_id", "digest", "profile_id", "row", "instance_id"))))
    held = named.join(broadcast_if_small(chosen), ["place_a", "place_b"]).select("record_id", "profile_id", "vector")
    # a record whose instance names no row has no vector, yet its reference vector doesn't count
    references = _first(table(spark, sf_dir, "reference_vectors").where(F.col("record_id").isNotNull()), ["record_id"])
    others = reference_rows(references).join(broadcast_if_small(eligible.select("record_id").distinct()), "record_id", "left_anti")
    return held.unionByName(others.where("vector is not null"))


def _place(*parts: Column) -> tuple[Column, Column]:
    """Two hashes of the parts, null where any is null, as null parts equal nothing."""
    known = parts[0].isNotNull()
    for part in parts[1:]:
        known = known & part.isNotNull()
    return F.when(known, F.xxhash64(*parts)).alias("place_a"), F.when(known, F.xxhash64(F.lit("b"), *parts)).alias("place_b")


def _first(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a Parquet table that come first among those of equal keys, by file and row number."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("nth"))
    first = df.select(*keys, place.alias("place")).groupBy(*keys).agg(F.min("place").alias("place")).select("place.file", "place.nth")
    placed = df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("nth"))
    return placed.join(broadcast_if_small(first), ["file", "nth"], "left_semi").drop("file", "nth")
