"""Exact float32 cosine search: binding of vectors to records, ranking, pages, and many queries in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import floats
from lodestrand.session import broadcast_if_small


def total_order() -> list[Column]:
    """Score descending, then record_id ascending in code points; -0.0 ties with 0.0."""
    return [F.desc("score"), F.asc("record_id")]


def bind(records: DataFrame, instances: DataFrame, mapping: DataFrame, profile_id: str, shard_id: str, digest: str) -> DataFrame:
    """record_id, entity_id and row: instances of the shard that the mapping names with an equal row, joined to records."""
    ref = F.col("vector_reference")
    own = instances.where((F.col("profile_id") == profile_id) & (ref.shard_id == shard_id) & (ref.shard_digest == digest))
    own = own.select("instance_id", "record_id", ref.row.alias("row"))
    return own.join(mapping.select("instance_id", "row"), ["instance_id", "row"]).join(records, "record_id").select("record_id", "entity_id", "row")


def binding_faults(records: DataFrame, instances: DataFrame, mapping: DataFrame) -> DataFrame:
    """subject and fault, for what keeps a release from being bound: mapping entries without an instance of their row,
    rows of unknown records, records that several rows name, and records that none names."""
    ref = F.col("vector_reference")
    own = instances.select("instance_id", "record_id", ref.row.alias("row"))
    matched = mapping.join(own, ["instance_id", "row"], "left")
    unbound = matched.where(F.col("record_id").isNull()).select(F.col("instance_id").alias("subject"), F.lit("unbound_row").alias("fault"))
    bound = matched.where(F.col("record_id").isNotNull())
    unknown = bound.join(records.select("record_id"), "record_id", "left_anti").select(F.col("record_id").alias("subject"), F.lit("unknown_record").alias("fault"))
    several = bound.groupBy("record_id").count().where("count > 1").select(F.col("record_id").alias("subject"), F.lit("several_rows").alias("fault"))
    uncovered = records.join(bound.select("record_id"), "record_id", "left_anti").select(F.col("record_id").alias("subject"), F.lit("uncovered_record").alias("fault"))
    return unbound.unionByName(unknown).unionByName(several).unionByName(uncovered)


def scores(candidates: DataFrame, query: list[float] | DataFrame, *more: Column) -> DataFrame:
    """Every candidate (record_id, entity_id, vector) with its score against one query vector, itself included, and more columns.

    A query given as values is a literal, so nothing is joined; one given as a frame must have one row and is broadcast.
    """
    if isinstance(query, DataFrame):
        joined = candidates.crossJoin(F.broadcast(query.select(F.col("vector").alias("__q")).limit(1)))
        return joined.select("record_id", "entity_id", floats.dot(F.col("vector"), F.col("__q")).cast("double").alias("score"), *more)
    q = F.array(*(floats.f32(x) for x in query))
    return candidates.select("record_id", "entity_id", floats.dot(F.col("vector"), q).cast("double").alias("score"), *more)


def page(ranked: DataFrame, limit: int, after: tuple[float, str] | None = None) -> DataFrame:
    """The next rows in the total order; a keyset predicate below the top-k, so earlier pages aren't sorted again."""
    if after is not None:
        ranked = ranked.where((F.col("score") < after[0]) | ((F.col("score") == after[0]) & (F.col("record_id") > after[1])))
    return ranked.orderBy(*total_order()).limit(limit)


def has_key(ranked: DataFrame, score: float, record_id: str) -> bool:
    """Whether the row that a cursor names is in the ranking, by exact equality."""
    return bool(ranked.where((F.col("record_id") == record_id) & (F.col("score") == score)).take(1))


QUERY_BLOCK, ROW_BLOCK = 256, 4096


def _blocks(df: DataFrame, rows: int) -> DataFrame:
    """id and vector packed into rows of bounded size, over the bounds of Arrow batches."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(held)
        ids = pa.array([part.column(0).to_pylist()], pa.list_(pa.string()))
        kept = np.concatenate([np.asarray(c.flatten(), np.float32) for c in part.column(1).chunks])
        return pa.RecordBatch.from_arrays([ids, pa.array([kept.tobytes()], pa.binary())], names=["ids", "data"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                taken = batch.slice(0, rows - sum(b.num_rows for b in held))
                held.append(taken)
                batch = batch.slice(taken.num_rows)
                if sum(b.num_rows for b in held) == rows:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)

    return df.select("record_id", "vector").mapInArrow(pack, "ids array<string>, data binary")


def top_of_many(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """query_id, record_id, score, rn: the k best candidates of each query, in the total order, by exact scores.

    Blocks of queries meet blocks of candidates; each meeting folds one dimension after the other over all its pairs,
    which keeps every score's bits, and passes on k rows a query. Vectors must be of one length. The work is queries x
    candidates, as an exact search of a stated query set is; memory is bounded by the blocks.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_data, ids, data in zip(*(c.to_pylist() for c in batch.columns)):
                q, c = np.frombuffer(q_data, np.float32).reshape(len(q_ids), -1), np.frombuffer(data, np.float32).reshape(len(ids), -1)
                got = np.zeros((len(q), len(c)), np.float32)
                columns = np.ascontiguousarray(c.T)
                for d in range(q.shape[1]):
                    got += q[:, d, None] * columns[d]
                order = np.array(sorted(range(len(ids)), key=ids.__getitem__))  # code points, for ties
                best = order[np.argsort(-got[:, order], axis=1, kind="stable")[:, :k]]
                n = best.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(q_ids, object), n), pa.string()), pa.array(np.array(ids, object)[best.ravel()], pa.string()), pa.array(np.take_along_axis(got, best, 1).ravel().astype(np.float64))], names=["query_id", "record_id", "score"])

    # queries that fit are sent to the candidates once; else every two blocks meet in a task
    pairs = broadcast_if_small(_blocks(queries, QUERY_BLOCK)).toDF("q_ids", "q_data").crossJoin(_blocks(candidates, ROW_BLOCK))
    best = pairs.mapInArrow(meet, "query_id string, record_id string, score double")
    by = Window.partitionBy("query_id").orderBy(*total_order())
    return best.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= k)
