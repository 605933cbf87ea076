"""A hierarchical navigable small-world graph over unit vectors, kept as flat neighbour arrays.

Rows are inserted batch by batch into the graph of those before them: from the entry node down through all upper layers,
then with a beam in each layer that the row belongs to; what the beam holds becomes links, thinned by the diversity rule,
with links back that are thinned when a node's row of the array is full. Searches go the same way down.

Queries that stand at the same place walk together. A group shares what it has visited, so one matrix product scores
the links of all its open nodes for all its queries; it ends when every node in any query's beam has been followed, which
is the ending rule of the walk of one query. Nothing is scanned: only links lead to a node.
"""

from __future__ import annotations

import math

import numpy as np

#: Links of a node in the base and in upper layers, and places of a neighbour row beyond them that links back may fill.
LINKS, UPPER, SLACK = 24, 12, 8
#: Beam of a search and of an insertion, beam in layers that are only passed, and candidates that links are chosen from.
BEAM, BUILD, PASSING, CANDIDATES = 24, 32, 4, 20
#: Queries that walk together, and most rows that are inserted at once.
GROUP, BATCH = 64, 512


class Hnsw:
    """The graph of `vectors` (n unit rows, float32). `near` holds what each row's insertion met, best first, -1 where fewer."""

    def __init__(self, vectors: np.ndarray, seed: int, keep: int = 10, links: int = LINKS, upper: int = UPPER, build: int = BUILD) -> None:
        n = len(vectors)
        rng = np.random.default_rng(seed)
        self.vectors, self.caps = vectors, (links, upper)
        self.height = np.floor(rng.exponential(1 / math.log(max(upper, 2)), n)).astype(np.int64)
        self.layers, self._sims, self._used = [], [], []
        for level in range(int(self.height.max(initial=0)) + 1):
            self.layers.append(np.full((n, self._cap(level) + SLACK), -1, np.int32))
            self._sims.append(np.full(self.layers[-1].shape, -2, np.float32))
            self._used.append(np.zeros(n, np.int64))
        self.keep, build = keep, max(build, keep)
        self.near, self.near_sims = np.full((n, build), -1, np.int64), np.full((n, build), -2, np.float32)
        self._seen, self._mark = np.zeros(n + 1, bool), np.zeros(n, np.int64)
        self._seen[n] = True  # where -1 points
        self.entry, self.top, self.visited = -1, -1, 0
        order, at = rng.permutation(n), 0
        while at < n:
            batch = order[at : at + min(BATCH, max(GROUP, at // 2))]
            self._insert(batch, build)
            at += len(batch)
            best = batch[self.height[batch].argmax()]
            if self.height[best] > self.top:
                self.entry, self.top = int(best), int(self.height[best])

    def _cap(self, level: int) -> int:
        return self.caps[min(level, 1)]

    def _walk(self, queries: np.ndarray, level: int, starts: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes that stand in the beam of any of the queries, and all their similarities to all queries."""
        links, v, seen, mark = self.layers[level], self.vectors, self._seen, self._mark
        new = np.unique(starts[starts >= 0])
        seen[new] = True
        visited = [new]
        ids, sims, done = np.zeros(0, np.int64), np.zeros((len(queries), 0), np.float32), np.zeros(0, bool)
        least = None
        while len(new):
            found = queries @ v[new].T
            if least is not None:
                worth = np.flatnonzero((found > least).any(0))
                new, found = new[worth], found[:, worth]
            if len(new):
                ids, sims, done = np.concatenate([ids, new]), np.concatenate([sims, found], 1), np.concatenate([done, np.zeros(len(new), bool)])
                if len(ids) > beam:
                    least = np.partition(sims, len(ids) - beam, axis=1)[:, len(ids) - beam, None]
                    inside = np.flatnonzero((sims >= least).any(0))
                    if len(inside) < len(ids):
                        ids, sims, done = ids[inside], sims[:, inside], done[inside]
            held = links[ids[~done]].ravel()
            done[:] = True
            new = held[~seen[held]].astype(np.int64)
            mark[new] = np.arange(len(new))
            new = new[mark[new] == np.arange(len(new))]  # each once
            seen[new] = True
            visited.append(new)
        for x in visited:
            seen[x] = False
        self.visited += sum(map(len, visited))
        return ids, sims

    @staticmethod
    def _best(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Each row's k greatest, greatest first, -1 where there are fewer; ids is one row for all or a row for each."""
        n, c = sims.shape
        at = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < c else np.broadcast_to(np.arange(c), (n, c))
        values = np.take_along_axis(sims, at, 1)
        order = np.argsort(-values, axis=1, kind="stable")
        at, values = np.take_along_axis(at, order, 1), np.take_along_axis(values, order, 1)
        got = ids[at] if ids.ndim == 1 else np.take_along_axis(ids, at, 1)
        if c < k:
            got, values = (np.concatenate([x, np.full((n, k - c), fill, x.dtype)], 1) for x, fill in ((got, -1), (values, -2)))
        return np.where(values > -2, got, -1), values

    def _passes(self, queries: np.ndarray, near: np.ndarray, keys: list[np.ndarray], level: int, beam: int):
        """Walks one layer group by group, in the order of where the queries stand: the group, and what its walk found."""
        order = np.lexsort(keys)
        for i in range(0, len(order), GROUP):
            g = order[i : i + GROUP]
            yield g, *self._walk(queries[g], level, near[g], beam)

    def search(self, queries: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and similarities of about the k most similar vectors of each query, best first, -1 where fewer are."""
        m = len(queries)
        out, out_sims = np.full((m, k), -1, np.int64), np.full((m, k), -2, np.float32)
        if self.entry < 0 or not m:
            return out, out_sims
        near, keys = self._down(queries, 0)
        for g, ids, sims in self._passes(queries, near, keys, 0, max(beam, k)):
            out[g], out_sims[g] = self._best(ids, sims, k)
        return out, out_sims

    def _down(self, queries: np.ndarray, to: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Where the queries stand once they have passed all layers above `to`, and the keys of that place."""
        near = np.full((len(queries), 3), self.entry)
        keys = [near[:, 0]]
        for level in range(self.top, to, -1):
            held, near = near, np.empty_like(near)
            for g, ids, sims in self._passes(queries, held, keys, level, PASSING):
                near[g], _ = self._best(ids, sims, 3)
            keys = [near[:, 0], *keys][:3]
        return near, keys

    def hubs(self, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """src, dst: for each row the node of the highest layer among all that it met, or that met it, at floor or more.

        Of several in that layer the least number counts, so rows near to each other name the same node; rows that are
        such a node themselves name none. Upper layers are sparse, hence many rows share one hub.
        """
        src, dst, sim = self._links_met()
        near = sim >= floor
        src, dst = src[near], dst[near]
        order = np.lexsort((dst, -self.height[dst], src))
        src, dst = src[order], dst[order]
        first = np.concatenate([[True], src[1:] != src[:-1]]) if len(src) else np.zeros(0, bool)
        src, dst = src[first], dst[first]
        up = (self.height[dst] > self.height[src]) | ((self.height[dst] == self.height[src]) & (dst < src))
        return src[up], dst[up]

    def _links_met(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, width = self.near.shape
        src, dst, sim = np.repeat(np.arange(n), width), self.near.ravel(), self.near_sims.ravel()
        there = dst >= 0
        src, dst, sim = src[there], dst[there], sim[there]
        return np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([sim, sim])

    def met(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """src, dst, sim: for each row the best `keep` of what its insertion met and of those whose insertion met it."""
        src, dst, sim = self._links_met()
        order = np.lexsort((dst, -sim, src))
        src, dst, sim = src[order], dst[order], sim[order]
        _, once = np.unique(src * max(len(self.near), 1) + dst, return_index=True)
        once.sort()
        src, dst, sim = src[once], dst[once], sim[once]
        kept = np.arange(len(src)) - np.searchsorted(src, src) < self.keep
        return src[kept], dst[kept], sim[kept]

    def _insert(self, batch: np.ndarray, build: int) -> None:
        q, m, height = self.vectors[batch], len(batch), self.height[batch]
        near = np.full((m, 3), self.entry)
        keys = [near[:, 0]]
        for level in range(max(self.top, int(height.max())), -1, -1):
            cap, belongs = self._cap(level), height >= level
            rows, values = np.full((m, build), -1, np.int64), np.full((m, build), -2, np.float32)
            held, near = near, near.copy()
            mates = np.flatnonzero(belongs)
            for g, ids, sims in self._passes(q, held if level <= self.top else np.full_like(held, -1), keys, level, build if level == 0 else cap):
                own = g[belongs[g]]
                got, found = self._best(ids, sims, build)
                if level <= self.top:
                    near[g] = got[:, :3]
                if len(own):  # rows inserted at once meet each other, as they would have one after the other
                    met = q[own] @ q[mates].T
                    met[own[:, None] == mates] = -2
                    ids = np.concatenate([got[belongs[g]], np.broadcast_to(batch[mates], met.shape)], 1)
                    rows[own], values[own] = self._best(ids, np.concatenate([found[belongs[g]], met], 1), build)
            keys = [near[:, 0], *keys][:3]
            if level == 0:
                self.near[batch], self.near_sims[batch] = rows, values
            if len(mates):
                chosen, found = self._diverse(rows[mates, :CANDIDATES], values[mates, :CANDIDATES], cap // 2)
                self._link(level, batch[mates], chosen, found)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each row's candidates, best first, those nearer to it than to any chosen one, then the best others; `most` in all."""
        good = sims > -2
        near = self.vectors[np.maximum(ids, 0)]
        among = near @ near.transpose(0, 2, 1)
        shaded, taken = ~good, np.zeros(good.shape, bool)
        count = np.zeros(len(ids), np.int64)
        for j in range(ids.shape[1]):
            free = ~shaded[:, j] & (count < most)
            taken[:, j] = free
            count += free
            shaded |= free[:, None] & (among[:, j] >= sims - 1e-6)  # copies shade each other
        order = np.argsort(np.where(taken, 0, np.where(good, 1, 2)), axis=1, kind="stable")[:, :most]
        ok = np.take_along_axis(good, order, 1)
        return np.where(ok, np.take_along_axis(ids, order, 1), -1), np.where(ok, np.take_along_axis(sims, order, 1), np.float32(-2))

    def _link(self, level: int, own: np.ndarray, chosen: np.ndarray, values: np.ndarray) -> None:
        """Writes the new nodes' links and the links back; full rows of the array are thinned to the cap."""
        links, sims, used = self.layers[level], self._sims[level], self._used[level]
        links[own, : chosen.shape[1]], sims[own, : chosen.shape[1]] = chosen, values
        used[own] = (chosen >= 0).sum(1)
        r, c = np.nonzero(chosen >= 0)
        target, source, value = chosen[r, c], own[r], values[r, c]
        order = np.lexsort((source, -value, target))
        target, source, value = target[order], source[order], value[order]
        new = ~(links[target] == source[:, None]).any(1)  # two new nodes may have chosen each other
        target, source, value = target[new], source[new], value[new]
        cap, width = self._cap(level), links.shape[1]
        while len(target):
            slot = used[target] + np.arange(len(target)) - np.searchsorted(target, target)
            fits = slot < width
            links[target[fits], slot[fits]], sims[target[fits], slot[fits]] = source[fits], value[fits]
            np.add.at(used, target[fits], 1)
            target, source, value = target[~fits], source[~fits], value[~fits]
            full = np.unique(target)
            if len(full):
                order = np.argsort(-sims[full], axis=1, kind="stable")
                kept, found = self._diverse(np.take_along_axis(links[full], order, 1).astype(np.int64), np.take_along_axis(sims[full], order, 1), cap)
                links[full], sims[full] = -1, -2
                links[full, :cap], sims[full, :cap] = kept, found
                used[full] = (kept >= 0).sum(1)
