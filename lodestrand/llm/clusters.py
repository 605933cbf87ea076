"""Grouping records into similarity clusters by Markov clustering of a similarity graph.

The graph joins records of one kind whose similarity reaches the threshold: each with its nearest, and with the nodes of
the highest layer of its shard's neighbour graph that still are near enough, which records that lie together share. Its
column-stochastic matrix is kept as one row for each column. A round squares it (a join of the entries with the columns
they name), raises the entries to a power, prunes small ones and scales the columns again; columns that stand still are
left alone. Rounds go on until all do. A column's greatest entry names its attractor; attractors stand for
their clusters.

A neighbour list is short and lies in one shard, so a large cluster falls into parts first. The parts' attractors, which
are records, and the records without a link are clustered again by the same threshold, in shards placed anew; then the
attractors once more, and from there on those of them that have links, until a level merges nothing.

Neighbour lists don't hold all pairs, so what the levels found is completed in the end: every record is compared with all
clusters of its kind, and with the members of those that hold a partner of it or might. A cluster is passed by only where
its centre is further from the record than the threshold's angle and the cluster's radius together, hence no pair that
reaches the threshold is left out, and clusters between which there is one become one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.llm.embeddings import valid_vectors
from lodestrand.llm.neighbours import VECTORS_SQL, merge, nearest, numbered
from lodestrand.session import Workspace, broadcast_if_small, table

THRESHOLD = 0.68
#: Neighbours of a node beside its hub, entries kept in a column, and least entry.
NEAR, KEEP, LEAST = 3, 8, 0.01
#: Power of the first round and its growth from round to round, so that flow settles; part of the flow that stays where it
#: is in a round, so that it doesn't go round in circles.
POWER, GROWTH, STAY = 2.0, 1.5, 0.1
#: A column stands still when a round moves less than this of it, or when this much of it is in one place.
STILL, SURE = 1e-3, 0.8
#: Links up to which a matrix is one block.
BLOCK = 250_000
#: Rounds of a level and levels, beyond which the clustering is given up with an error, never cut short.
ROUNDS, LEVELS = 64, 32
#: Shards that a node visits in levels after the first, and how much less similar than the nearest centroid theirs may be.
#: In the first level, which gathers what lies close together, links stay within shards.
VISITS_LATER, MARGIN_LATER = 4, 0.25
#: Completion: rows of a kind that are one block (every two blocks meet in a task), queries and clusters of a tile, members
#: of a cluster that a query meets first, candidates that are gathered before they're compared.
ROWS, TILE, FIRST, GATHERED = 131_072, (1024, 8192), 64, 1 << 20
#: What rounding may take from an angle (of float32 products and of unit lengths) and from a float32 similarity.
SLACK, NEAR_ENOUGH = 2e-3, 1e-4

_COLUMNS = "col bigint, rows array<bigint>, vals array<float>, moves float"


def _columns(col: np.ndarray, row: np.ndarray, val: np.ndarray, was: np.ndarray | None, power: float, keep: int, least: float) -> tuple[np.ndarray, ...]:
    """Columns from entries (col, row, value): equal places summed, powered, pruned and scaled: names, offsets, rows, values, moves.

    was: the entries' part in the column before, by which its move is told: the sum of all differences, or 0 once it is
    decided. None: the entries are links, each column gets its loop, and all columns move.
    """
    if was is None:
        own, of = np.unique(col, return_inverse=True)
        loop = np.zeros(len(own))
        np.maximum.at(loop, of, val)  # as strong as the column's strongest link, so that no node holds on to itself for its loop
        loop[loop <= 0] = 1  # a node that only others name
        col, row, val = np.concatenate([col, own]), np.concatenate([row, own]), np.concatenate([val, loop])
    order = np.lexsort((row, col))
    col, row, val = col[order], row[order], val[order]
    at = np.flatnonzero(np.concatenate([[True], (col[1:] != col[:-1]) | (row[1:] != row[:-1])]))
    before = np.zeros(len(at)) if was is None else np.add.reduceat(was[order], at)
    val = (np.maximum if was is None else np.add).reduceat(val, at)
    col, row = col[at], row[at]
    first = np.flatnonzero(np.concatenate([[True], col[1:] != col[:-1]]))
    widths = np.diff(np.append(first, len(col)))
    val = (val / np.repeat(np.maximum.reduceat(val, first), widths)) ** power  # by the greatest, so that no power underflows
    val /= np.repeat(np.add.reduceat(val, first), widths)
    order = np.lexsort((-val, col))
    nth = np.empty(len(col), np.int64)
    nth[order] = np.arange(len(col)) - np.repeat(first, widths)
    kept = (nth == 0) | ((nth < keep) & (val >= least))
    val = np.where(kept, val, 0)
    val /= np.repeat(np.add.reduceat(val, first), widths)
    decided = np.maximum.reduceat(val, first) >= SURE
    moves = np.where(decided, 0, np.add.reduceat(np.abs(val - before), first)) if was is not None else np.ones(len(first))
    names = col[first]
    col, row, val = col[kept], row[kept], val[kept]
    offsets = np.append(np.flatnonzero(np.concatenate([[True], col[1:] != col[:-1]])), len(col))
    return names, offsets, row, val.astype(np.float32), moves.astype(np.float32)


def _square(power: float, keep: int, least: float, first: bool = False):
    """Sums the products of rows (col, weight, rows, vals) that are sorted by col. A column may lie over batches.

    A weight below 0 marks the column itself. first: rows are links (col, row, val), and become the columns to begin with.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def parts(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            col, row, val, was = (np.concatenate(x) for x in zip(*held))
            cut = len(col) if last else int(np.searchsorted(col, col[-1]))  # the last column may go on
            if cut:
                names, offsets, rows, vals, moves = _columns(col[:cut], row[:cut], val[:cut], None if first else was[:cut], power, keep, least)
                at = pa.array(offsets.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.ListArray.from_arrays(at, pa.array(rows)), pa.ListArray.from_arrays(at, pa.array(vals)), pa.array(moves)], names=["col", "rows", "vals", "moves"])
            held = [(col[cut:], row[cut:], val[cut:], was[cut:])] if cut < len(col) else []
            size = len(col) - cut

        for batch in batches:
            if not batch.num_rows:
                continue
            if first:
                col, row, val = (c.to_numpy() for c in batch.columns)
                held.append((col, row, val, np.zeros(len(col))))
            else:
                rows, vals = batch.column(2), batch.column(3)
                lengths = np.diff(rows.offsets.to_numpy())
                weight = np.repeat(batch.column(1).to_numpy(), lengths)
                val = vals.flatten().to_numpy().astype(np.float64)
                held.append((np.repeat(batch.column(0).to_numpy(), lengths), rows.flatten().to_numpy(), val * np.abs(weight), np.where(weight < 0, val, 0)))
            size += len(held[-1][0])
            if size > 1_000_000:
                yield from parts(False)
        if held:
            yield from parts(True)

    return run


_LABELS = "node bigint, label bigint, flow double"


def _spread(offsets: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of some columns: for each the place of its column in `columns`, and its own place in the matrix."""
    widths = offsets[columns + 1] - offsets[columns]
    of = np.repeat(np.arange(len(columns)), widths)
    return of, np.arange(int(widths.sum())) - np.repeat(np.cumsum(widths) - widths, widths) + offsets[columns][of]


def markov_block(src: np.ndarray, dst: np.ndarray, sim: np.ndarray, power: float = POWER, keep: int = KEEP, least: float = LEAST, rounds: int = ROUNDS) -> pa.Table:
    """node, label and flow of one block of the matrix, as markov() gives them: all its links, whose nodes have no others.

    The rounds of markov() on arrays. A matrix whose links stay within shards consists of such blocks, so it is squared
    where it lies.
    """
    if not len(src):
        return pa.table({"node": pa.array([], pa.int64()), "label": pa.array([], pa.int64()), "flow": pa.array([], pa.float64())})
    ids, number = np.unique(np.concatenate([src, dst]), return_inverse=True)
    n = len(ids)
    col, row = number[: len(src)], number[len(src) :]
    alone = np.setdiff1d(row, col)  # named by others only: their column is a loop
    names, offsets, rows, vals, moves = _columns(np.concatenate([col, alone]), np.concatenate([row, alone]), np.concatenate([sim, np.ones(len(alone))]), None, 1.0, keep, 0.0)
    of, at = _spread(offsets, np.arange(n))
    flow = np.bincount(rows, np.where(of == rows, 0, vals), n)
    for turn in range(rounds + 1):
        moving = np.flatnonzero(moves > STILL)
        if not len(moving):
            break
        if turn == rounds:
            raise RuntimeError(f"the flow of a block still moves after {rounds} rounds")
        of, at = _spread(offsets, moving)
        by, entry = _spread(offsets, rows[at])
        col = np.concatenate([moving[of][by], moving[of]])
        row = np.concatenate([rows[entry], rows[at]])
        own = vals[at].astype(np.float64)
        val = np.concatenate([vals[entry] * own[by] * (1 - STAY), own * STAY])
        was = np.concatenate([np.zeros(len(entry)), own])
        _, new_offsets, new_rows, new_vals, moves[moving] = _columns(col, row, val, was, power * GROWTH**turn, keep, least)
        rest = np.flatnonzero(~np.isin(np.arange(n), moving))
        of, at = _spread(offsets, rest)
        widths = np.zeros(n, np.int64)
        widths[moving], widths[rest] = np.diff(new_offsets), offsets[rest + 1] - offsets[rest]
        joined = np.append(0, np.cumsum(widths))
        next_rows, next_vals = np.empty(joined[-1], rows.dtype), np.empty(joined[-1], np.float32)
        _, there = _spread(joined, rest)
        next_rows[there], next_vals[there] = rows[at], vals[at]
        _, there = _spread(joined, moving)
        next_rows[there], next_vals[there] = new_rows, new_vals
        offsets, rows, vals = joined, next_rows, next_vals
    most = np.maximum.reduceat(vals, offsets[:-1])
    at = np.repeat(np.arange(n), np.diff(offsets))
    to = np.minimum.reduceat(np.where(vals >= most[at] * np.float32(0.8), rows, n), offsets[:-1])
    ahead, least_of = to, np.minimum(np.arange(n), to)
    while True:  # paths twice as long each time; in a circle nodes only agree on its least
        label, ahead, least_of = least_of[ahead], ahead[ahead], np.minimum(least_of, least_of[ahead])
        if (label == label[to]).all():
            break
    return pa.table({"node": ids, "label": ids[label], "flow": flow})


def markov(edges: DataFrame, work: Workspace, name: str, power: float = POWER, keep: int = KEEP, least: float = LEAST, rounds: int = ROUNDS) -> DataFrame:
    """node, label (its attractor) and flow (what comes in to it in the first matrix) for every node of the edges (src, dst, sim).

    Each node's column holds the links that it is the src of. Rounds end when every column stands still; RuntimeError if
    they don't end by `rounds`. A matrix of up to BLOCK links is one block and goes through its rounds in one task; a
    larger one is squared by joins, with the same result.
    """
    if edges.limit(BLOCK + 1).count() <= BLOCK:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if held:
                src, dst, sim = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
                yield from markov_block(src, dst, sim, power, keep, least, rounds).to_batches()

        return work.write(edges.select("src", "dst", "sim").coalesce(1).mapInArrow(run, _LABELS), f"{name}-labels")
    links = edges.select(F.col("src").alias("col"), F.col("dst").alias("row"), F.col("sim").cast("double").alias("val"))
    loops = edges.select(F.col("dst").alias("col")).distinct().select("col", F.col("col").alias("row"), F.lit(0.0).alias("val"))  # so that nodes that only others name have a column too
    started = links.unionByName(loops).repartition("col").sortWithinPartitions("col").mapInArrow(_square(1.0, keep, 0.0, first=True), _COLUMNS)
    columns = work.write(started, f"{name}-0")
    entry = columns.select("col", F.explode(F.arrays_zip("rows", "vals")).alias("e")).where(F.col("col") != F.col("e.rows"))
    flow = entry.groupBy(F.col("e.rows").alias("node")).agg(F.sum(F.col("e.vals").cast("double")).alias("flow"))
    still = []  # columns at rest, by the round in which they came to it: they're read, but not computed or written again
    moving = columns.where(F.col("moves") > STILL)
    for turn in range(rounds + 1):
        still.append(columns.where(F.col("moves") <= STILL))
        if not moving.take(1):
            break
        if turn == rounds:
            raise RuntimeError(f"the flow of {name} still moves after {rounds} rounds")
        known = moving
        for rest in still:
            known = known.unionByName(rest)
        ways = moving.select("col", F.explode(F.arrays_zip("rows", "vals")).alias("e")).select("col", F.col("e.rows").alias("k"), F.col("e.vals").cast("double").alias("weight"))
        products = ways.join(known.select(F.col("col").alias("k"), "rows", "vals"), "k").select("col", (F.col("weight") * (1 - STAY)).alias("weight"), "rows", "vals")
        products = products.unionByName(moving.select("col", F.lit(-STAY).alias("weight"), "rows", "vals"))
        squared = products.repartition("col").sortWithinPartitions("col").mapInArrow(_square(power * GROWTH**turn, keep, least), _COLUMNS)
        columns = work.write(squared, f"{name}-{turn + 1}")
        moving = columns.where(F.col("moves") > STILL)
    ended = still[0]
    for rest in still[1:]:
        ended = ended.unionByName(rest)
    # of about equal entries the least row: the columns of a clique are about even and agree on it
    label = F.array_min(F.transform(F.filter(F.arrays_zip("rows", "vals"), lambda e: e.vals >= F.array_max("vals") * F.lit(0.8).cast("float")), lambda e: e.rows))
    named = work.write(ended.select(F.col("col").alias("node"), label.alias("to")), f"{name}-to")
    labels = _roots(named, work, name).join(flow, "node", "left").select("node", "label", F.coalesce("flow", F.lit(0.0)).alias("flow"))
    return work.write(labels, f"{name}-labels")


def _roots(parents: DataFrame, work: Workspace, name: str, doublings: int = 40) -> DataFrame:
    """node, label: the least node of the circle that following `to` ends in; an attractor is a circle of itself.

    Paths are doubled until every node and the one it leads to agree on the label; in a circle they only do so on its least.
    """
    first = parents.select(F.col("node").alias("to"), F.col("to").alias("after"))
    if not parents.join(first, "to").where("after <> to").take(1):
        return parents.select("node", F.col("to").alias("label"))
    at = parents.select("node", "to", F.least("node", "to").alias("least"))
    for i in range(doublings):
        ahead = at.select(F.col("node").alias("to"), F.col("to").alias("after"), F.col("least").alias("label"))
        at = work.write(at.join(ahead, "to").select("node", F.col("after").alias("to"), F.least("least", "label").alias("least"), "label"), f"{name}-roots-{i}")
        agreed = at.select("node", "label").join(parents, "node").join(at.select(F.col("node").alias("to"), F.col("label").alias("other")), "to")
        if not agreed.where("label <> other").take(1):
            return at.select("node", "label")
        at = at.drop("label")
    raise RuntimeError(f"the paths of {name} don't end")


def flowed(vectors: DataFrame, work: Workspace, threshold: float = THRESHOLD, levels: int = LEVELS, with_flow: bool = False) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The clusters that the levels give, before they're completed: id and cluster; the flow of the first matrix; with_flow: the masses of each level.

    RuntimeError if a level still merges after `levels` of them.
    """
    nodes = vectors.select("id", "kind", "vector", F.lit(False).alias("several"))
    found, flow, masses = None, None, []
    for level in range(levels + 1):
        if level == levels:
            raise RuntimeError(f"clusters still merge after {levels} levels")
        if level == 0:
            # shards keep their links to themselves, so the matrix is one of blocks and each is squared where it lies
            labels = work.write(nearest(nodes, NEAR, threshold, visits=0, hubs=True, then=(markov_block, _LABELS)), "level-0-labels")
            flow = labels.select(F.col("node").alias("id"), "flow")
        else:
            near = work.write(nearest(nodes, NEAR, threshold, seed=level, visits=VISITS_LATER, margin=MARGIN_LATER, hubs=True), f"near-{level}")
            edges = merge(near.where("not hub"), NEAR).select("src", "dst", "sim").unionByName(near.where("hub").select("src", "dst", "sim"))
            labels = markov(work.write(edges, f"edges-{level}"), work, f"level-{level}")
        gone = labels.where("node <> label").select("node", "label")
        if found is None:
            moved = vectors.select("id").join(labels.select(F.col("node").alias("id"), "label"), "id", "left")
            found = moved.select("id", F.coalesce("label", "id").alias("cluster"))
        else:
            if not gone.take(1):
                break
            moved = found.join(broadcast_if_small(gone.select(F.col("node").alias("cluster"), "label")), "cluster", "left")
            found = moved.select("id", F.coalesce("label", "cluster").alias("cluster"))
        found = work.write(found, f"found-{level}")
        if with_flow:
            masses.append(found.groupBy("cluster").agg(F.count("*").alias("mass")).where("mass > 1"))
        # what was merged is left to its attractor. After the second level records that neither placement linked are done,
        # after the third all that it didn't link
        stays = nodes.join(broadcast_if_small(gone.select(F.col("node").alias("id"))), "id", "left_anti")
        if level < 2:
            grown = (gone.select(F.col("label").alias("id")) if level == 0 else labels.select(F.col("node").alias("id"))).distinct().withColumn("grown", F.lit(True))
            stays = stays.join(broadcast_if_small(grown), "id", "left").select("id", "kind", "vector", (F.col("several") | F.coalesce("grown", F.lit(False))).alias("several"))
            stays = stays if level == 0 else stays.where("several")
        else:
            stays = stays.join(broadcast_if_small(labels.select(F.col("node").alias("id"))), "id", "left_semi")
        nodes = work.write(stays, f"nodes-{level}")
    return found, flow, masses


def _least_partners(names: np.ndarray, side: np.ndarray, cluster: np.ndarray, v: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in the order of their names: rows with a partner before them and the first such; and all pairs of clusters that hold partners.

    Partners are rows whose cosine, in double precision, reaches the threshold. Where there are two sides, only rows of
    different sides are compared. Rows of one cluster and side are a chunk, with its centre and radius.
    """
    n = len(v)
    norm = np.sqrt(np.einsum("ij,ij->i", v, v, dtype=np.float64))
    by_chunk = np.lexsort((np.arange(n), cluster, side))  # rows of a chunk stay in order
    begins = np.flatnonzero(np.concatenate([[True], (np.diff(cluster[by_chunk]) != 0) | (np.diff(side[by_chunk]) != 0)]))
    by_chunk = by_chunk[np.argsort(np.repeat(by_chunk[begins], np.diff(np.append(begins, n))), kind="stable")]  # chunks by their first row
    begins = np.flatnonzero(np.concatenate([[True], (np.diff(cluster[by_chunk]) != 0) | (np.diff(side[by_chunk]) != 0)]))
    ends = np.append(begins[1:], n)
    leads, sizes = by_chunk[begins], ends - begins
    chunk = np.empty(n, np.int64)
    chunk[by_chunk] = np.repeat(np.arange(len(begins)), sizes)
    centres = v[leads]
    for c in np.flatnonzero(sizes > 1).tolist():
        total = v[by_chunk[begins[c] : ends[c]]].sum(0, dtype=np.float64)
        length = np.sqrt(total @ total)
        if length > 1e-3:  # else any direction is as good
            centres[c] = total / length
    reach = np.concatenate([np.einsum("ij,ij->i", v[by_chunk[i : i + 16384]], centres[chunk[by_chunk[i : i + 16384]]], dtype=np.float64) for i in range(0, n, 16384)])
    radius = np.where(sizes > 1, np.arccos(np.clip(np.minimum.reduceat(reach, begins), -1, 1)), 0)
    angle = np.arccos(np.clip(threshold, -1, 1)) + radius + SLACK
    bound = np.where(angle < np.pi, np.cos(np.minimum(angle, np.pi)), -2).astype(np.float32)
    first, links = np.arange(n), []

    def meet(x: np.ndarray, c: int) -> None:
        """Compares rows with a chunk, member after member in their order, until each row has met a partner."""
        at, own = int(begins[c]), bool(len(x)) and chunk[x[0]] == c
        while at < ends[c] and len(x):
            to = min(int(ends[c]), at + (FIRST if at == begins[c] else TILE[1]))
            left, members = [], v[by_chunk[at:to]].T
            for i in range(0, len(x), TILE[0]):
                rows = x[i : i + TILE[0]]
                sims = v[rows] @ members
                hit = sims >= threshold + NEAR_ENOUGH
                r, m = np.nonzero((sims >= threshold - NEAR_ENOUGH) & ~hit)
                for j in range(0, len(r), 65536):
                    p, q = r[j : j + 65536], m[j : j + 65536]
                    a, b = rows[p], by_chunk[at + q]
                    hit[p, q] = np.einsum("ij,ij->i", v[a].astype(np.float64), v[b].astype(np.float64)) / (norm[a] * norm[b]) >= threshold
                if own:
                    hit &= by_chunk[at:to] < rows[:, None]
                met = hit.any(1)
                np.minimum.at(first, rows[met], by_chunk[at + hit[met].argmax(1)])
                if not own and met.any():
                    links.append(np.unique(cluster[rows[met]]))
                    links.append(np.full(len(links[-1]), cluster[leads[c]]))
                left.append(rows[~met])
            x, at = np.concatenate(left), to
            if own and len(x):
                x = x[x > by_chunk[min(at, n - 1)]] if at < ends[c] else x[:0]

    def compare(found: list[tuple[np.ndarray, np.ndarray]]) -> None:
        x, c = (np.concatenate(p) for p in zip(*found))
        alone = sizes[c] == 1
        a, b = x[alone], leads[c[alone]]
        near = np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", v[a[i : i + 16384]].astype(np.float64), v[b[i : i + 16384]].astype(np.float64)) / (norm[a[i : i + 16384]] * norm[b[i : i + 16384]]) >= threshold for i in range(0, len(a), 16384))])
        np.minimum.at(first, a[near], b[near])
        links.extend(np.unique(np.stack([cluster[a[near]], cluster[b[near]]]), axis=1))
        x, c = x[~alone], c[~alone]
        if not len(x):
            return
        order = np.argsort(c, kind="stable")
        x, c = x[order], c[order]
        edges = np.append(np.flatnonzero(np.concatenate([[True], np.diff(c) != 0])), len(c))
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
            meet(x[i:j], int(c[i]))

    both = bool(side.any()) and not bool(side.all())
    if not both:
        for c in np.flatnonzero(sizes > 1).tolist():
            meet(by_chunk[begins[c] : ends[c]], c)
    for s in (0, 1) if both else (side[0],):
        queries, targets, waiting = np.flatnonzero(side == s), np.flatnonzero(side[leads] == (1 - s if both else s)), []
        for i in range(0, len(queries), TILE[0]):
            rows = queries[i : i + TILE[0]]
            before = int(np.searchsorted(leads[targets], rows[-1]))  # of two rows the later one asks
            for j in range(0, before, TILE[1]):
                k = min(before, j + TILE[1])
                r, m = np.nonzero(v[rows] @ centres[targets[j:k]].T >= bound[targets[j:k]])
                r, m = rows[r], targets[j + m]
                good = (leads[m] < r) & (chunk[r] != m)
                if good.any():
                    waiting.append((r[good], m[good]))
            if sum(len(x) for x, _ in waiting) > GATHERED:
                compare(waiting)
                waiting = []
        if waiting:
            compare(waiting)
    later = np.flatnonzero(first < np.arange(n))
    pairs = np.stack([np.concatenate(links[::2]), np.concatenate(links[1::2])], 1) if links else np.zeros((0, 2), np.int64)
    pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], 1), axis=0)
    return names[later], names[first[later]], pairs[:, 0], pairs[:, 1]


def partners(vectors: DataFrame, found: DataFrame, threshold: float = THRESHOLD, rows: int | None = None) -> DataFrame:
    """name and least, a name before it; or cluster and other, two clusters of `found`: both hold records that reach the threshold.

    vectors has id, name (string, unique), kind and vector, and found has id and cluster. For each name that has a partner
    before it the least of all partners is among its rows. Every two records of a kind are compared, or known to be too
    far apart by the bounds of _least_partners(). The result doesn't depend on what `found` groups, the work does.
    """
    rows = rows or ROWS
    bytes_of = F.octet_length("vector")
    sizes = vectors.groupBy("kind", bytes_of.alias("bytes")).agg(F.count("*").alias("n")).where(F.col("n") > rows).collect()  # each has more than `rows`, so they are few
    blocks, tasks = F.lit(1), vectors.sparkSession.sparkContext.defaultParallelism
    for r in sizes:
        parts = -(-r["n"] // rows)
        tasks += 2 * parts * (parts + 1)
        blocks = F.when(F.col("kind").eqNullSafe(F.lit(r["kind"])) & (bytes_of == r["bytes"]), parts).otherwise(blocks)
    # a cluster lies in one block, so that it is one chunk; one that would fill a block is spread over all
    large = found.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") > rows // 8).select("cluster", F.lit(True).alias("large"))
    if sizes:
        found = found.join(F.broadcast(large), "cluster", "left")  # eight for each block at most
        key = F.when(F.coalesce("large", F.lit(False)), F.col("id")).otherwise(F.col("cluster"))
    else:
        key = F.col("cluster")
    placed = vectors.join(broadcast_if_small(found.select("id", "cluster", F.xxhash64(key).alias("key"))), "id").withColumn("blocks", blocks)
    placed = placed.withColumn("block", F.pmod("key", F.col("blocks").cast("bigint")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = [F.col("kind"), bytes_of.alias("bytes"), F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")]
    spread = placed.select(*group, (F.col("block") > F.col("other")).cast("int").alias("side"), "cluster", "name", "vector").repartition(tasks, "kind", "bytes", "a", "b")

    def look(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group.column("name").cast(pa.binary())))
        blobs = group.column("vector").combine_chunks()
        offsets = np.frombuffer(blobs.buffers()[1], np.int32, len(blobs) + 1, blobs.offset * 4)
        v = np.frombuffer(blobs.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view("<f4").reshape(len(blobs), -1)
        side, cluster = group.column("side").to_numpy(), group.column("cluster").to_numpy()
        if group.column("a")[0] != group.column("b")[0] and (side == side[0]).all():
            later = least = one = other = np.zeros(0, np.int64)  # two blocks of which one is empty
        else:
            later, least, one, other = _least_partners(np.arange(len(v)), side, cluster, v, threshold)
        none = [pa.nulls(len(one), pa.string())], [pa.nulls(len(later), pa.int64())]
        text = group.column("name")
        columns = [[*text.take(pa.array(later)).chunks, *none[0]], [*text.take(pa.array(least)).chunks, *none[0]], [*none[1], pa.array(one)], [*none[1], pa.array(other)]]
        return pa.table([pa.chunked_array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["name", "least", "cluster", "other"])

    return spread.groupBy("kind", "bytes", "a", "b").applyInArrow(look, "name string, least string, cluster bigint, other bigint")


def _joined(links: DataFrame, work: Workspace) -> DataFrame | None:
    """node and label (the least node that it is linked with, directly or not) for the nodes of links (cluster, other) that have a lesser one; None without links."""
    label = None
    for turn in range(64):  # of linked nodes half at least are gone after a turn
        if not links.take(1):
            return label if label is None else label.where("node <> label")
        ends = links.select(F.col("cluster").alias("node"), F.col("other").alias("to")).unionByName(links.select(F.col("other").alias("node"), F.col("cluster").alias("to")))
        least = ends.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to"))
        roots = work.write(_roots(work.write(least, f"joined-{turn}-to"), work, f"joined-{turn}"), f"joined-{turn}-roots")
        after = lambda df, c: df.join(roots.select(F.col("node").alias(c), F.col("label").alias("after")), c, "left").withColumn(c, F.coalesce("after", c)).drop("after")
        label = roots if label is None else work.write(after(label, "label"), f"joined-{turn}-labels")
        links = work.write(after(after(links, "cluster"), "other").where("cluster <> other").distinct(), f"joined-{turn}-links")
    raise RuntimeError("linked clusters don't end")


def cluster(vectors: DataFrame, work: Workspace, threshold: float = THRESHOLD, levels: int = LEVELS, with_flow: bool = False) -> DataFrame:
    """id and cluster (the id that stands for it), and with_flow: mass and flow, for every vector.

    vectors has id, kind and vector as nearest() takes them. Vectors without a partner are clusters of themselves; two that
    reach the threshold are in one cluster always. mass is how many records' flow ends in the record, on the last level on
    which it is an attractor (0: on none), what the completion joins included; flow is what comes in to it in the first
    matrix. RuntimeError if a level still merges after `levels` of them.
    """
    found, flow, masses = flowed(vectors, work, threshold, levels, with_flow)
    met = partners(vectors.select("id", F.col("id").cast("string").alias("name"), "kind", "vector"), found, threshold)
    joined = _joined(work.write(met.where("cluster is not null").select("cluster", "other").distinct(), "links"), work)
    if joined is not None:
        moved = found.join(broadcast_if_small(joined.select(F.col("node").alias("cluster"), "label")), "cluster", "left")
        found = work.write(moved.select("id", F.coalesce("label", "cluster").alias("cluster")), "found-joined")
        if with_flow:
            masses.append(found.groupBy("cluster").agg(F.count("*").alias("mass")).where("mass > 1"))
    if not with_flow:
        return found
    union = masses[0]
    for m in masses[1:]:
        union = union.unionByName(m)
    out = found.join(union.groupBy(F.col("cluster").alias("id")).agg(F.max("mass").alias("mass")), "id", "left").join(flow, "id", "left")
    return out.select("id", "cluster", F.coalesce("mass", F.lit(0)).alias("mass"), F.coalesce("flow", F.lit(0.0)).alias("flow"))


def record_clusters(spark: SparkSession, sf_dir: str, with_flow: bool = False) -> DataFrame:
    """record_id, cluster_id (the least record_id of the cluster), size, and with_flow: mass and flow, for every record with a valid vector."""
    work = Workspace(spark, "clusters")
    vectors = numbered(valid_vectors(spark, sf_dir), work)
    members = work.write(cluster(vectors, work, with_flow=with_flow).join(vectors.select("id", "record_id"), "id"), "members")
    least = members.groupBy("cluster").agg(F.min("record_id").alias("cluster_id"), F.count("*").alias("size")).where("size > 1")
    # a cluster may hold a third of all records: only its one row is sent to them, or the join is split by size at run time
    rows = members.join(broadcast_if_small(work.write(least, "clusters")), "cluster", "left")
    return rows.select("record_id", F.coalesce("cluster_id", "record_id").alias("cluster_id"), F.coalesce("size", F.lit(1)).alias("size"), *(["mass", "flow"] if with_flow else []))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least record that each record belongs together with, where that is another one.

    Where clusters are as stated, every two records of one belonging together, it is the least of the cluster.
    """
    work = Workspace(spark, "clusters")
    vectors = numbered(valid_vectors(spark, sf_dir).where("profile_id is not null"), work)
    met = partners(vectors.withColumnRenamed("record_id", "name"), flowed(vectors, work)[0])
    least = met.where("name is not null").groupBy("name").agg(F.min("least").alias("cluster_id"))
    return least.select("cluster_id", F.col("name").alias("record_id"))


def p2_clusters(spark: SparkSession, sf_dir: str, typical: int = 3) -> DataFrame:
    """Each cluster with its size, the number of its entities and its most typical records, those with the strongest flow first.

    Flow is counted in the final cluster: what the converged matrices bring to a record, level by level (mass); records
    that hold none of it are ranked by what comes in to them in the first matrix; equal ones by record_id.
    """
    members = record_clusters(spark, sf_dir, with_flow=True)
    entities = table(spark, sf_dir, "records").select("record_id", "entity_id").groupBy("record_id").agg(F.min("entity_id").alias("entity_id"))
    counted = members.select("record_id", "cluster_id").join(entities, "record_id", "left").groupBy("cluster_id", "entity_id").agg(F.count("*").alias("n")).groupBy("cluster_id").agg(F.sum("n").alias("size"), F.count("entity_id").alias("n_entities"))
    by = Window.partitionBy("cluster_id").orderBy(F.desc("mass"), F.desc("flow"), "record_id")
    best = members.select("record_id", "cluster_id", "mass", "flow").withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= typical)
    named = best.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "record_id"))), lambda x: x.record_id).alias("typical_records"))
    return counted.join(named, "cluster_id").select("cluster_id", "size", "n_entities", "typical_records")


P2_SQL = f"""WITH {VECTORS_SQL},
linked AS (SELECT b.record_id, min(a.record_id) AS cluster_id FROM valid a JOIN valid b ON a.profile_id = b.profile_id AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.68 GROUP BY 1)
SELECT cluster_id, record_id FROM linked WHERE cluster_id < record_id"""
