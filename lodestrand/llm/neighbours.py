"""The most similar vectors of every vector: an HNSW graph for each shard, with shard results merged.

Vectors go to the shard of the centroid nearest to them; a query also visits the shards of other centroids that are
about as near, so the work grows with the vectors, not with their square. Centroids are a tree of two levels: the upper
ones are fitted on the driver, the lower ones in tasks, one for each upper centroid. A shard's own rows are answered by
their insertion into its graph (what they met, and what met them) or by a search of the finished graph; queries from
other shards are searched for in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.llm.embeddings import valid_vectors
from lodestrand.llm.hnsw import BEAM, Hnsw
from lodestrand.session import Workspace

#: Rows of a shard as planned; rows from which a shard is cut by id (only where centroids can't part them).
SHARD_ROWS, MOST_ROWS = 8192, 65_536
#: Vectors sampled for the upper centroids and, for each lower one, in the tasks; upper centroids and all centroids at
#: most (8 MB of 128 dimensions); kinds at most. Beyond CELLS x SHARD_ROWS vectors (134 million) shards grow instead.
SAMPLE, LOWER_SAMPLE, UPPER_CELLS, CELLS, KINDS = 16_384, 64, 64, 16_384, 1024
#: Shards that a query visits at most, and how much less similar than the nearest centroid theirs may be: for a partner of
#: similarity s the difference to be expected is some sqrt(1 - s^2) / sqrt(dimension), so this is four times that at 0.97.
VISITS, MARGIN = 4, 0.1
#: Where all neighbours are asked for, near or not: those that are hardly similar lie in many cells, the more of them the
#: more there are. Visits at least, share of the cells that is visited, rows of a shard, beam.
WIDE_VISITS, WIDE_SHARE, WIDE_ROWS, WIDE_BEAM = 6, 0.4, 16_384, 32
#: Vectors that may visit one shard; more are divided among copies of it.
VISITORS = 131_072


def _top(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of each row's k greatest, greatest first; equal ones by column."""
    k = min(k, sims.shape[1])
    at = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < sims.shape[1] else np.tile(np.arange(k), (len(sims), 1))
    at.sort(axis=1)
    values = np.take_along_axis(sims, at, 1)
    order = np.argsort(-values, axis=1, kind="stable")
    return np.take_along_axis(at, order, 1), np.take_along_axis(values, order, 1)


def centroids(sample: np.ndarray, cells: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids: sampled vectors moved by a few rounds of spherical k-means, so dense regions get more of them."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(rounds if len(c) > 1 else 0):
        own = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(sample), 4096)])
        order = np.argsort(own, kind="stable")
        there, first = np.unique(own[order], return_index=True)
        sums = np.add.reduceat(sample[order], first)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c[there] = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c[there])
    return c


def _matrix(blobs: pa.Array) -> np.ndarray:
    """Blobs of equal length as unit rows."""
    blobs = blobs.combine_chunks() if isinstance(blobs, pa.ChunkedArray) else blobs
    offsets = np.frombuffer(blobs.buffers()[1], np.int32, len(blobs) + 1, blobs.offset * 4)
    v = np.frombuffer(blobs.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view("<f4").reshape(len(blobs), -1)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v, dtype=np.float64)).astype(np.float32)[:, None]


class Tree:
    """The centroids of one kind: the cells, and for many of them upper centroids that lead to them."""

    REACH = 4  # upper centroids whose cells are looked at, for each one that would do if the tree were exact

    def __init__(self, upper: np.ndarray | None, cells: np.ndarray, of: np.ndarray | None) -> None:
        self.upper, self.cells, self.of = upper, cells, of  # of: the upper centroid of each cell, ascending

    def near(self, v: np.ndarray, visits: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest cells of each vector and their similarities, nearest first, -1 where the tree gave fewer."""
        if self.upper is None:
            parts = [_top(v[i : i + 4096] @ self.cells.T, visits) for i in range(0, len(v), 4096)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        k = min(visits, len(self.cells))
        out, sims = np.full((len(v), k), -1, np.int64), np.full((len(v), k), -2, np.float32)
        bounds = np.searchsorted(self.of, np.arange(len(self.upper) + 1))
        share = k / len(self.cells)
        ways = np.concatenate([_top(v[i : i + 4096] @ self.upper.T, max(self.REACH, math.ceil(2 * share * len(self.upper))))[0] for i in range(0, len(v), 4096)])
        for u in np.unique(ways):
            rows, (a, b) = np.flatnonzero((ways == u).any(1)), bounds[u : u + 2]
            if a == b:
                continue
            at, found = _top(v[rows] @ self.cells[a:b].T, k)
            at, found = np.concatenate([out[rows], at + a], 1), np.concatenate([sims[rows], found], 1)
            order = np.argsort(-found, axis=1, kind="stable")[:, :k]
            out[rows], sims[rows] = np.take_along_axis(at, order, 1), np.take_along_axis(found, order, 1)
        return out, sims


def _hashed(seed: int, share: float) -> F.Column:
    """Whether a row is in a sample of this share; it depends on its id alone."""
    return F.pmod(F.xxhash64(F.lit(seed).cast("long"), F.col("id")), F.lit(1 << 30)) < F.lit(math.ceil(min(1.0, share) * (1 << 30)))


def trees(vectors: DataFrame, sizes: dict[tuple[str, int], int], seed: int, shard_rows: int, sample: int) -> dict[tuple[str, int], Tree | None]:
    """The centroids of each kind and length, None where one cell is enough.

    The driver gets `sample` vectors of all kinds at most, and CELLS centroids at most. Where a kind has more than
    UPPER_CELLS cells, LOWER_SAMPLE vectors for each are gathered by upper centroid, and each group is parted in its task.
    """
    total = sum(sizes.values())
    wanted = {kind: min(math.ceil(n / shard_rows), max(1, CELLS * n // total)) for kind, n in sizes.items()}
    found: dict[tuple[str, int], Tree | None] = dict.fromkeys(sizes)
    if max(wanted.values(), default=1) == 1:
        return found
    taken = vectors.where(_hashed(seed, 1.2 * sample / total)).select("kind", "vector").limit(sample).toArrow()
    kinds, lengths = np.array(taken.column("kind").to_pylist(), object), np.array([len(x.as_buffer()) for x in taken.column("vector")], np.int64)
    deep = {}
    for kind, cells in wanted.items():
        at = np.flatnonzero((kinds == kind[0]) & (lengths == kind[1]))
        upper = min(cells if cells <= UPPER_CELLS else max(UPPER_CELLS, math.isqrt(cells)), len(at) // 8)
        if upper > 1:
            c = centroids(_matrix(taken.column("vector").take(pa.array(at))), upper, seed)
            if cells > UPPER_CELLS:
                deep[kind] = c
            else:
                found[kind] = Tree(None, c, None)
    if deep:
        numbers = {kind: i for i, kind in enumerate(sorted(deep, key=str))}
        shared = vectors.sparkSession.sparkContext.broadcast((deep, numbers))  # at most isqrt(CELLS) for each kind, KINDS kinds

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            deep, numbers = shared.value
            for batch in batches:
                for kind, rows in _by_kind(batch).items():
                    if kind in deep:
                        blobs = batch.column(1).take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays([pa.array(numbers[kind] * CELLS + (_matrix(blobs) @ deep[kind].T).argmax(1)), blobs], names=["upper", "vector"])

        def part(key: tuple, group: pa.Table) -> pa.Table:
            v = _matrix(group.column("vector"))
            c = centroids(v, math.ceil(len(v) / LOWER_SAMPLE), seed)
            return pa.table({"upper": pa.array(np.full(len(c), key[0].as_py()), pa.int64()), "vector": pa.array([x.tobytes() for x in c.astype("<f4")], pa.binary())})

        share = LOWER_SAMPLE * sum(wanted[k] for k in deep) / sum(sizes[k] for k in deep)
        lower = vectors.where(_hashed(seed + 1, share)).select("kind", "vector").mapInArrow(own, "upper bigint, vector binary").groupBy("upper").applyInArrow(part, "upper bigint, vector binary").toArrow()
        uppers = lower.column("upper").to_numpy()
        for kind, i in numbers.items():
            at = np.flatnonzero(uppers // CELLS == i)
            at = at[np.argsort(uppers[at], kind="stable")]
            found[kind] = Tree(deep[kind], _matrix(lower.column("vector").take(pa.array(at))), uppers[at] % CELLS)
    return found


def _by_kind(batch: pa.RecordBatch) -> dict[tuple[str, int], np.ndarray]:
    """Rows of a batch by kind and length of the vector; columns kind and vector."""
    kinds = batch.column("kind").dictionary_encode()
    blobs = batch.column("vector")
    lengths = np.diff(np.frombuffer(blobs.buffers()[1], np.int32, len(blobs) + 1, blobs.offset * 4)).astype(np.int64)
    code = kinds.indices.fill_null(len(kinds.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64) << 32 | lengths
    names = [*kinds.dictionary.to_pylist(), None]
    return {(names[c >> 32], int(c & 0xFFFFFFFF)): np.flatnonzero(code == c) for c in np.unique(code).tolist()}


def nearest(vectors: DataFrame, k: int = 10, floor: float = -1.0, seed: int = 0, visits: int = VISITS, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE, beam: int = BEAM, least_share: float = 0.0, margin: float = MARGIN, again: bool = False, hubs: bool = False, then: tuple | None = None) -> DataFrame:
    """src, dst, sim: for every vector about its k most similar others of the same kind, found in up to `visits` shards.

    least_share: share of a kind's cells that are visited at least, however many there are, whatever the margin. again:
    a shard's own rows are searched for in the finished graph, not only met on insertion. hubs: each own row comes with
    the node of the graph's highest layer that it met and that reaches the floor, beside its k best, and a column hub tells
    these rows from the others.

    visits: 0 keeps every row in its own shard. then: a function of a shard's src, dst and sim that gives the table to
    return instead, and its schema; for visits 0.

    vectors has id (bigint, unique), kind (string: vectors of one kind are of one length and compared) and vector
    (float32 little-endian bytes, valid). Similarities below floor are left out; sim is the cosine in double precision.
    An id comes out at most once for each shard and k; merge() keeps the best. Kinds of one vector give no row. Only the
    centroids are fitted on a sample, of a bounded size; every row is indexed and searched for.
    """
    spark = vectors.sparkSession
    schema = then[1] if then else "src bigint, dst bigint, sim double" + ", hub boolean" * hubs
    found = vectors.groupBy("kind", F.octet_length("vector").alias("bytes")).agg(F.count("*").alias("n")).limit(KINDS + 1).collect()
    if len(found) > KINDS:
        raise ValueError(f"more than {KINDS} kinds of vectors")
    sizes = {(r["kind"], r["bytes"]): r["n"] for r in found}
    if not sizes:
        return spark.createDataFrame([], schema)
    grown = trees(vectors, sizes, seed, shard_rows, sample)
    # how many rows each cell has and how many visit it, so that cells that stay too large are cut by id and those that many visit are copied
    numbers = {kind: i for i, kind in enumerate(sorted(sizes, key=str))}
    plans = {kind: (numbers[kind], tree, 1 if tree is None else max(visits, 1, math.ceil(least_share * len(tree.cells)))) for kind, tree in grown.items()}
    shared = spark.sparkContext.broadcast(plans)  # at most CELLS centroids in all

    def visited(kind: tuple[str, int], blobs: pa.Array) -> tuple[int, np.ndarray]:
        number, tree, most = shared.value[kind]
        if tree is None:
            return number, np.zeros((len(blobs), 1), np.int64)
        near, sims = tree.near(_matrix(blobs), most)
        sure = math.ceil(least_share * len(tree.cells))
        near[:, max(1, sure) :][(sims < sims[:, :1] - margin)[:, max(1, sure) :]] = -1
        return number, near

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, rows in _by_kind(batch).items():
                number, near = visited(kind, batch.column("vector").take(pa.array(rows)))
                own = np.zeros(near.shape, bool)
                own[:, 0] = True
                cells, n = np.unique((number << 33 | near << 1 | own)[near >= 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n)], names=["cell", "n"])

    many = [kind for kind, tree in grown.items() if tree is not None or sizes[kind] > MOST_ROWS]
    counts: dict[int, int] = {}
    if many:
        # of a bounded share of the rows: sizes of shards only have to be about right
        share = min(1.0, 64 * SAMPLE / sum(sizes.values()))
        for r in vectors.where(_hashed(seed + 2, share)).select("kind", "vector").mapInArrow(counted, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            counts[r["cell"]] = math.ceil(r["n"] / share)
    parted = {}
    for kind, (number, tree, _) in plans.items():
        cells = 1 if tree is None else len(tree.cells)
        own = np.array([counts.get(number << 33 | c << 1 | 1, 0) for c in range(cells)])
        coming = np.array([counts.get(number << 33 | c << 1, 0) for c in range(cells)])
        salts = np.maximum(1, -(-own // MOST_ROWS))
        coming = coming + np.where(salts > 1, own, 0) if visits else np.zeros(cells, np.int64)
        parted[kind] = salts, np.maximum(1, -(-coming // VISITORS))
    sent = spark.sparkContext.broadcast(parted)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids = batch.column("id").to_numpy()
            for kind, at in _by_kind(batch).items():
                number, near = visited(kind, batch.column("vector").take(pa.array(at)))
                salts, copies = sent.value[kind]
                ids = all_ids[at].astype(np.uint64)
                salt = (ids * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                turn = (ids * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(33)).astype(np.int64)
                rows, shards, owns = [], [], []
                for j in range(near.shape[1]):
                    there = np.flatnonzero(near[:, j] >= 0)
                    cell = near[there, j]
                    for s in range(int(salts[cell].max(initial=0))):
                        own = (j == 0) & (salt[there] % salts[cell] == s)
                        if not (visits or own.any()):
                            continue
                        for c in range(int(copies[cell].max(initial=0))):  # a shard's rows are in each of its copies
                            goes = (s < salts[cell]) & (c < copies[cell]) & (own | ((visits > 0) & (turn[there] % copies[cell] == c)))
                            rows.append(at[there[goes]]), shards.append((c << 44 | s << 32) + (cell[goes] << 10 | number)), owns.append(own[goes])
                rows = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shards)), pa.array(np.concatenate(owns)), batch.column("id").take(rows), batch.column("vector").take(rows)], names=["shard", "own", "id", "vector"])

    def look(key: tuple, group: pa.Table) -> pa.Table:
        found = _shard(group, k, floor, seed, beam, again, hubs, key[0].as_py() >> 44 == 0)
        return found if then is None else then[0](*(found.column(i).to_numpy() for i in range(3)))

    shards = sum(int((salts * copies).sum()) for salts, copies in parted.values())
    tasks = 4 * shards  # shards are few rows and much work: more places than shards keep them from meeting in one task
    spread = vectors.select("id", "kind", "vector").mapInArrow(place, "shard bigint, own boolean, id bigint, vector binary")
    return spread.repartition(tasks, "shard").groupBy("shard").applyInArrow(look, schema)


def _shard(group: pa.Table, k: int, floor: float, seed: int, beam: int, again: bool, hubs: bool, first: bool) -> pa.Table:
    """What a shard's graph answers; its own rows are answered in the first of its copies only."""
    own = group.column("own").to_numpy()
    ids = group.column("id").to_numpy()
    order = np.lexsort((ids, ~own))  # the graph doesn't depend on the order of arrival
    own, ids = own[order], ids[order]
    v = _matrix(group.column("vector").take(pa.array(order)))
    n = int(own.sum())
    if not n or (n == len(v) == 1):
        return _pairs(ids, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool) if hubs else None)
    graph = Hnsw(v[:n], seed, k)
    parts = []
    if first:
        src, dst, _ = graph.met()
        parts.append((src, dst))
        if again:
            there, _ = graph.search(v[:n], k + 1, beam)
            parts.append((np.repeat(np.arange(n), k + 1), there.ravel()))
    there, _ = graph.search(v[n:], k, beam)
    parts.append((np.repeat(np.arange(n, len(v)), k), there.ravel()))
    pair = np.unique(np.concatenate([src[dst >= 0] * n + dst[dst >= 0] for src, dst in parts]))
    if hubs:
        src, dst = graph.hubs(floor) if first else (pair[:0], pair[:0])
        named = src * n + dst
        pair = np.concatenate([np.setdiff1d(pair, named), named])
    src, dst = pair // n, pair % n
    exact = np.concatenate([np.einsum("ij,ij->i", v[src[i : i + 65536]].astype(np.float64), v[dst[i : i + 65536]].astype(np.float64)) for i in range(0, len(src), 65536)]) if len(src) else np.zeros(0)
    good = (exact >= floor) & (ids[src] != ids[dst])
    return _pairs(ids, src[good], dst[good], exact[good], (np.arange(len(pair)) >= len(pair) - len(named))[good] if hubs else None)


def _pairs(ids: np.ndarray, src: np.ndarray, dst: np.ndarray, sim: np.ndarray, hub: np.ndarray | None) -> pa.Table:
    return pa.table({"src": ids[src], "dst": ids[dst], "sim": sim} | ({} if hub is None else {"hub": hub}))


def merge(found: DataFrame, k: int = 10, both_ways: bool = False) -> DataFrame:
    """The shards' results as one: the k best of each src, with position from 1; equal similarities by dst.

    both_ways: similarity is symmetric, so what one vector found is a candidate for the other too, which may have
    visited other shards.
    """
    if both_ways:
        found = found.unionByName(found.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim"))
    once = found.groupBy("src", "dst").agg(F.max("sim").alias("sim"))
    by = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return once.repartition("src").withColumn("position", F.row_number().over(by)).where(F.col("position") <= k)


def numbered(vectors: DataFrame, work: Workspace) -> DataFrame:
    """The valid vectors, written, with id and kind."""
    return work.write(vectors.select(F.monotonically_increasing_id().alias("id"), "record_id", F.col("profile_id").alias("kind"), "vector"), "vectors")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of similarity 0.97 or more, each among the ten most similar of the other."""
    rows = numbered(valid_vectors(spark, sf_dir), Workspace(spark, "neighbours"))
    found = Workspace(spark, "found").write(nearest(rows, 10, 0.97), "near")  # read twice
    near = merge(found, 10, both_ways=True)
    both = near.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("n")).where("n = 2")
    names = rows.select("id", "record_id")
    pairs = both.join(names.toDF("a", "name_a"), "a").join(names.toDF("b", "name_b"), "b")
    return pairs.select(F.least("name_a", "name_b").alias("record_a"), F.greatest("name_a", "name_b").alias("record_b"))


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every record with a valid vector its ten most similar records of the same profile, best first."""
    rows = numbered(valid_vectors(spark, sf_dir), Workspace(spark, "neighbours"))
    names = rows.select("id", "record_id")
    found = Workspace(spark, "found").write(nearest(rows, 10, visits=WIDE_VISITS, shard_rows=WIDE_ROWS, beam=WIDE_BEAM, least_share=WIDE_SHARE, margin=2.0, again=True), "near")
    near = merge(found, 10, both_ways=True)
    return near.join(names.toDF("src", "record_id"), "src").join(names.toDF("dst", "neighbour_id"), "dst").select("record_id", "position", "neighbour_id", "sim")


#: The valid vectors in SQL: payload rows as lists of doubles, decoded from the bits of their float32 numbers.
VECTORS_SQL = """
once AS (SELECT shard_id, digest, profile_id, any_value(dimension) AS dimension, any_value(hex(payload)) AS bytes, any_value(row_mapping) AS mapping FROM vector_shards WHERE dtype = 'float32le' AND dimension > 0 GROUP BY 1, 2, 3),
named AS (SELECT shard_id, digest, profile_id, dimension, bytes, unnest(map_entries(mapping)) AS e FROM once),
held AS (SELECT * EXCLUDE (e), CAST(e.key AS BIGINT) AS nth, e.value AS instance_id FROM named WHERE regexp_full_match(e.key, '[0-9]+') AND (CAST(e.key AS BIGINT) + 1) * dimension * 8 <= length(bytes)),
chosen AS (SELECT record_id, min(instance_id) AS instance_id FROM instances WHERE eligibility_status = 'eligible' AND record_id IS NOT NULL GROUP BY 1),
placed AS (SELECT DISTINCT c.record_id, i.profile_id, i.vector_reference.shard_id AS shard_id, i.vector_reference.shard_digest AS digest, i.vector_reference.row AS nth, instance_id FROM chosen c JOIN instances i USING (record_id, instance_id) WHERE i.eligibility_status = 'eligible'),
words AS (SELECT p.record_id, p.profile_id, list_transform(range(dimension), lambda j: substr(bytes, ((h.nth * dimension + j) * 8 + 1)::INT, 8)) AS w FROM placed p JOIN held h USING (shard_id, digest, profile_id, nth, instance_id)),
bits AS (SELECT record_id, profile_id, list_transform(w, lambda x: CAST('0x' || x[7:8] || x[5:6] || x[3:4] || x[1:2] AS BIGINT)) AS b FROM words),
payload_vectors AS (SELECT record_id, profile_id, list_transform(b, lambda x: CASE WHEN (x >> 23) & 255 = 255 THEN 'nan'::DOUBLE
    ELSE (1 - 2 * (x >> 31)) * pow(2.0, greatest((x >> 23) & 255, 1) - 127) * ((CASE WHEN (x >> 23) & 255 > 0 THEN 1 ELSE 0 END) + (x & 8388607) / 8388608.0) END) AS v FROM bits),
reference_once AS (SELECT record_id, any_value(profile_id) AS profile_id, any_value(vector)::DOUBLE[] AS v FROM reference_vectors WHERE record_id IS NOT NULL AND record_id NOT IN (SELECT record_id FROM chosen) GROUP BY 1),
valid AS (SELECT record_id, profile_id, v, sqrt(list_dot_product(v, v)) AS norm FROM (SELECT * FROM payload_vectors UNION ALL SELECT * FROM reference_once)
    WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND abs(sqrt(list_dot_product(v, v)) - 1) <= 1e-5)"""
P1_SQL = f"""WITH {VECTORS_SQL},
pairs AS (SELECT a.record_id AS x, b.record_id AS y, list_dot_product(a.v, b.v) / (a.norm * b.norm) AS sim FROM valid a JOIN valid b ON a.profile_id = b.profile_id AND a.record_id <> b.record_id AND len(a.v) = len(b.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY sim DESC, y) AS nth FROM pairs),
near AS (SELECT x, y FROM ranked WHERE nth <= 10 AND sim >= 0.97)
SELECT a.x AS record_a, a.y AS record_b FROM near a JOIN near b ON a.x = b.y AND a.y = b.x WHERE a.x < a.y"""
