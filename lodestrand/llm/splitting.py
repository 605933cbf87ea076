"""Splitting oversized items at natural boundaries, with an overlap between consecutive pieces.

Boundaries have a strength: a line feed is the strongest, then the end of a run of ambiguous bases, then any place. Two
placements share them:

- balanced: the least piece count for the limit, equal-length targets, each snapped to the strongest boundary near it; the
  rest's targets are placed anew after each cut, with a piece more where the rest would break the limit;
- full: targets as far as the limit allows, each snapped back to the last of the strongest boundaries in reach. This is
  the rule that p3_found prescribes.

Items are cut where they are read; only offsets are shuffled, never bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.session import table

LIMIT, OVERLAP, GAP = 6000, 200, 20


def boundaries(data: bytes, gap: int = GAP) -> list[np.ndarray]:
    """Offsets where an item may be cut, strongest kind first: after line feeds, and after whole runs of N or n."""
    lines = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    runs = np.fromiter((m.end() for m in re.finditer(rb"[Nn]{%d,}" % gap, data)), np.int64)
    return [lines.astype(np.int64), runs]


def full(data: bytes, limit: int = LIMIT, overlap: int = OVERLAP, gap: int = GAP) -> list[tuple[int, int]]:
    """Pieces of at most limit bytes: each ends at the last strongest boundary more than overlap and at most limit after its start."""
    kinds, size, start, pieces = boundaries(data, gap), len(data), 0, []
    while size - start > limit:
        for at in kinds:
            i = int(np.searchsorted(at, start + limit, "right")) - 1
            if i >= 0 and at[i] > start + overlap:
                end = int(at[i])
                break
        else:
            end = start + limit
        pieces.append((start, end))
        start = end - overlap
    pieces.append((start, size))
    return pieces


def balanced(data: bytes, limit: int = LIMIT, overlap: int = OVERLAP, gap: int = GAP) -> list[tuple[int, int]]:
    """Pieces of about equal length, each at most limit bytes, cut at the strongest boundary near its target.

    Near is within a quarter of the target length. From each cut on, the rest has the least piece count that keeps the
    limit and equal targets anew, so a piece is added as soon as a cut before its target leaves too much for the count so
    far. One pass: the time is linear in the pieces, and no piece can break the limit.
    """
    kinds, size, start, pieces = boundaries(data, gap), len(data), 0, []
    while size - start > limit:
        count = -(-(size - start - overlap) // (limit - overlap))
        step = (size - start - overlap) / count
        target = start + min(round(step) + overlap, limit)
        low, high = max(start + overlap + 1, target - int(step / 4)), min(target + int(step / 4), start + limit)
        cut = target
        for at in kinds:
            a, b = np.searchsorted(at, [low, high + 1])
            if a < b:
                near = at[a:b]
                cut = int(near[np.abs(near - target).argmin()])
                break
        pieces.append((start, cut))
        start = cut - overlap
    pieces.append((start, size))
    return pieces


PLACEMENTS = {"full": full, "balanced": balanced}


def split(df: DataFrame, key: str, data: str, delivered: str, placement: str = "full", limit: int = LIMIT, overlap: int = OVERLAP, gap: int = GAP) -> DataFrame:
    """The pieces of every item longer than limit bytes: key, piece_no from 0, start_at and end_at (without end_at).

    An item is a value of key, null included as one value; of its deliveries the earliest counts (null times last; of
    equal times the one with the least digest). Null, empty and short items give no piece. Bytes are never decoded, so
    any encoding will do. Other columns of df are left out, so their names can't clash.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be below the limit")
    place = PLACEMENTS[placement]
    # short items go without their bytes; they still take part in the choice of a delivery
    source = df.select(df[key].alias("key"), F.coalesce(df[delivered].cast("timestamp"), F.lit("9999-12-31").cast("timestamp")).alias("at"), F.xxhash64(df[data]).alias("digest"), F.when(F.octet_length(df[data]) > limit, df[data]).alias("data"))
    kind = source.schema["key"].dataType.simpleString()
    spans = pa.list_(pa.int64())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, starts = [], []
            for value in batch.column(3):
                pieces = place(value.as_buffer().to_pybytes(), limit, overlap, gap) if value.is_valid else []
                starts.append([s for s, _ in pieces])
                ends.append([e for _, e in pieces])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(starts, spans), pa.array(ends, spans)], names=["key", "at", "digest", "starts", "ends"])

    pieces = source.mapInArrow(cut, f"key {kind}, at timestamp, digest bigint, starts array<bigint>, ends array<bigint>")
    once = pieces.groupBy("key").agg(F.min_by(F.struct("starts", "ends"), F.struct("at", "digest")).alias("p"))
    return once.select(F.col("key").alias(key), F.posexplode(F.arrays_zip("p.starts", "p.ends")).alias("piece_no", "p")).select(key, "piece_no", F.col("p.starts").alias("start_at"), F.col("p.ends").alias("end_at"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(table(spark, sf_dir, "assemblies"), "canonical_path", "canonical_bytes", "ingested_at")


def p3_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same items in pieces of about equal length."""
    return split(table(spark, sf_dir, "assemblies"), "canonical_path", "canonical_bytes", "ingested_at", "balanced")


#: The rule of p3_found, piece after piece. The text of a blob spells bytes outside printable ASCII as \xHH: one sign for each
#: makes offsets of signs those of bytes; line feeds come back before the rest becomes "?".
P3_SQL = rf"""WITH RECURSIVE items AS (SELECT canonical_path, regexp_replace(replace(arg_min(canonical_bytes, ingested_at)::VARCHAR, '\x0A', chr(10)), '\\x[0-9A-F][0-9A-F]', '?', 'g') AS t FROM assemblies WHERE canonical_bytes IS NOT NULL AND octet_length(canonical_bytes) > {LIMIT} GROUP BY 1),
line_parts AS (SELECT canonical_path, unnest(string_split(t, chr(10))) AS part, unnest(range(len(string_split(t, chr(10))))) AS nth, len(string_split(t, chr(10))) AS parts FROM items),
run_parts AS (SELECT canonical_path, unnest(string_split_regex(t, '[Nn]{{{GAP},}}')) AS part, unnest(list_concat(regexp_extract_all(t, '[Nn]{{{GAP},}}'), [NULL])) AS run, unnest(range(len(string_split_regex(t, '[Nn]{{{GAP},}}')))) AS nth FROM items),
line_ends AS (SELECT canonical_path, nth, parts, sum(length(part) + 1) OVER (PARTITION BY canonical_path ORDER BY nth)::BIGINT AS e FROM line_parts),
run_ends AS (SELECT canonical_path, run, sum(length(part) + coalesce(length(run), 0)) OVER (PARTITION BY canonical_path ORDER BY nth)::BIGINT AS e FROM run_parts),
lines AS (SELECT canonical_path, list(e ORDER BY e) AS ends FROM line_ends WHERE nth < parts - 1 GROUP BY 1),
runs AS (SELECT canonical_path, list(e ORDER BY e) AS ends FROM run_ends WHERE run IS NOT NULL GROUP BY 1),
known AS (SELECT canonical_path, length(t)::BIGINT AS n, coalesce(l.ends, []) AS lines, coalesce(r.ends, []) AS runs FROM items LEFT JOIN lines l USING (canonical_path) LEFT JOIN runs r USING (canonical_path)),
pieces AS (
  SELECT canonical_path, -1 AS piece_no, 0::BIGINT AS start_at, {OVERLAP}::BIGINT AS end_at, n, lines, runs FROM known
  UNION ALL
  SELECT canonical_path, piece_no + 1, s, CASE WHEN n - s <= {LIMIT} THEN n ELSE coalesce(list_max(list_filter(lines, lambda x: x > s + {OVERLAP} AND x <= s + {LIMIT})), list_max(list_filter(runs, lambda x: x > s + {OVERLAP} AND x <= s + {LIMIT})), s + {LIMIT}) END, n, lines, runs
  FROM (SELECT *, end_at - {OVERLAP} AS s FROM pieces WHERE end_at < n))
SELECT canonical_path, piece_no, start_at, end_at FROM pieces WHERE piece_no >= 0"""

#: The same boundaries; each piece ends at the strongest one within a quarter of the target length of its target, if any.
_NEAREST = "list_sort(list_transform(list_filter({0}, lambda x: x >= greatest(s + {1} + 1, target - reach) AND x <= least(target + reach, s + {2})), lambda x: {{'off': abs(x - target), 'x': x}}))[1].x"
P3_BALANCED_SQL = P3_SQL[: P3_SQL.index("pieces AS (")] + f"""pieces AS (
  SELECT canonical_path, -1 AS piece_no, 0::BIGINT AS start_at, {OVERLAP}::BIGINT AS end_at, n, lines, runs FROM known
  UNION ALL
  SELECT canonical_path, piece_no + 1, s, CASE WHEN n - s <= {LIMIT} THEN n ELSE coalesce({_NEAREST.format("lines", OVERLAP, LIMIT)}, {_NEAREST.format("runs", OVERLAP, LIMIT)}, target) END, n, lines, runs
  FROM (SELECT *, s + least(round_even(step, 0)::BIGINT + {OVERLAP}, {LIMIT}) AS target, floor(step / 4)::BIGINT AS reach
    FROM (SELECT *, (n - s - {OVERLAP}) / ceil((n - s - {OVERLAP}) / {LIMIT - OVERLAP}.0)::DOUBLE AS step FROM (SELECT *, end_at - {OVERLAP} AS s FROM pieces WHERE end_at < n))))
SELECT canonical_path, piece_no, start_at, end_at FROM pieces WHERE piece_no >= 0"""
