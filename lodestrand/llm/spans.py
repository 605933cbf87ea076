"""Long exact spans that records share: an FM-index for each shard, searched backwards over wavelet matrices.

Whole texts against whole shards would cost texts x shards. So texts are first marked with anchors, windows' least
hashes, of which each span of the threshold's length holds one; only stretches around anchors that several texts share
are streamed. Stretches whose anchors lie in the same set of texts go to one shard, so each is indexed about once. The
stretches of a set that is too long for one are cut into parts, and each two parts have a shard: every pair of stretches
meets in one. No shared span is lost: its anchor is in both texts, with the whole span in both stretches.

In a shard the FM-index of the distinct stretches gives, for each position of each stretch, the interval of suffixes
that begin with the same span; matches are held at the threshold by the LCP bits kept with the index (the parent
operation of matching statistics). An interval with suffixes of several texts is a shared span.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.session import Workspace, broadcast_if_small, table

#: Least length of a shared span, length of an anchor, characters of a shard, of a set of stretches that still has one
#: shard, of the overlapping pieces that a long stretch is indexed in, and of those in which one is streamed.
LEAST, ANCHOR, SHARD, MOST, PIECE, CHUNK = 160, 64, 1 << 20, 1 << 21, 1 << 17, 1024
_MASK = (1 << 64) - 1


def gram_hashes(codes: np.ndarray, k: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hashes of all k-grams: a polynomial over mixed code points, by doubling, mixed again."""
    if len(codes) < k:
        return np.zeros(0, np.uint64)
    power = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    power ^= power >> np.uint64(29)
    power *= np.uint64(0xBF58476D1CE4E5B9)
    power ^= power >> np.uint64(32)
    out, length, n, p = None, 0, 1, base
    while k:
        if k & 1:
            out = power if out is None else out[: len(power) - length] * np.uint64(p) + power[length:]
            length += n
        k >>= 1
        if k:
            power = power[:-n] * np.uint64(p) + power[n:]
            p, n = p * p & _MASK, 2 * n
    out = out ^ (out >> np.uint64(31))
    out *= np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(30))


def anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions such that every window holds one whose hash is the window's least: an equal span has an equal anchor."""
    n = len(hashes)
    if n < window:
        return np.zeros(0, np.int64)
    least, s = hashes, 1
    while 2 * s <= window:
        least, s = np.minimum(least[:-s], least[s:]), 2 * s
    if s < window:
        least = np.minimum(least[: n - window + 1], least[window - s :])
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    ends = np.concatenate([starts[1:], [len(least)]])
    new = hashes[starts + window - 1] == least[starts]
    places = starts + window - 1
    out = []
    for i in np.flatnonzero(~new):
        places[i] = starts[i] + window - 1 - int(np.argmin(hashes[starts[i] : starts[i] + window][::-1]))
    # a least value may return before it leaves: windows after its place need the next one
    for i in np.flatnonzero(ends > places + 1):
        j = int(places[i]) + 1
        while j < ends[i]:
            out.append(j := j + window - 1 - int(np.argmin(hashes[j : j + window][::-1])))
            j += 1
    return np.unique(np.concatenate([places, np.array(out, np.int64)]))


def suffix_array(symbols: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and whether each agrees with the one before it in its first `least` symbols; by prefix doubling.

    symbols must end with one that occurs nowhere else, and separators must be distinct.
    """
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length())
    h = 1 << max(0, min(least.bit_length() - 1, (62 // bits).bit_length() - 1))
    key = np.zeros(n, np.int64)
    for i in range(h):
        key <<= bits
        key[: n - i] |= symbols[i:]
    same = None
    while True:
        order = np.argsort(key, kind="stable")
        key = key[order]
        step = np.concatenate([[False], key[1:] != key[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if 2 * h > least and same is None:
            same = (rank.astype(np.int32), h)
        if step[1:].all():
            break
        key = rank * (n + 1)
        key[: n - h] += rank[h:] + 1
        h *= 2
    held, h = same if same is not None else (rank, h)
    far = np.zeros(n, np.int64)
    far[: n - (least - h)] = held[least - h :]
    agrees = np.concatenate([[False], (held[order[1:]] == held[order[:-1]]) & (far[order[1:]] == far[order[:-1]])])
    return order, agrees


class WaveletMatrix:
    """Rank of any symbol in a sequence: for each bit of the symbols, packed bits with counts for each word of 64."""

    def __init__(self, sequence: np.ndarray, symbols: int) -> None:
        self.levels = []
        n = len(sequence)
        for level in range(max(1, (symbols - 1).bit_length()) - 1, -1, -1):
            bit = ((sequence >> level) & 1).astype(bool)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            held = np.packbits(bit, bitorder="little")
            packed[: len(held)] = held
            words = packed.view("<u8")
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(words))])[:-1].astype(np.int64)
            self.levels.append((level, words, counts, n - int(bit.sum())))
            sequence = np.concatenate([sequence[~bit], sequence[bit]])
        self.first = self._map(np.arange(symbols), np.zeros(symbols, np.int64))

    def _map(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, words, counts, zeros in self.levels:
            word = at >> 6
            ones = counts[word] + np.bitwise_count(words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbols >> level) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._map(symbols, at) - self.first[symbols]


class FmIndex:
    """FM-index of several texts: backward steps by rank, and the LCP bits that hold matches at the threshold.

    Kept: the wavelet matrix of packed bits, the texts in the narrowest type of their alphabet, and for each suffix the
    number of its text and of its interval (32 bits each). The suffix array itself is dropped after construction.
    """

    def __init__(self, texts: list[str], least: int) -> None:
        self.least = least
        lengths = np.array([len(t) for t in texts], np.int64)
        codes = np.frombuffer("".join(t + "\0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        self.lengths = lengths
        ends = self.starts + lengths
        inside = np.ones(len(codes), bool)
        inside[ends] = False
        alphabet, dense = np.unique(codes[inside], return_inverse=True)
        self.symbols = np.zeros(len(codes), np.min_scalar_type(len(alphabet)))  # 0: end of a text
        self.symbols[inside] = dense + 1
        distinct = np.where(inside, self.symbols.astype(np.int64) + len(texts) - 1, 0)
        distinct[ends] = np.arange(len(texts))
        order, agrees = suffix_array(distinct, least)
        del distinct, dense, codes, inside
        self.before = np.concatenate([[0], np.cumsum(np.bincount(self.symbols, minlength=len(alphabet) + 1))])
        self.matrix = WaveletMatrix(self.symbols[order - 1], len(alphabet) + 1)
        self.of = self.text_at(order).astype(np.int32)  # the text of each suffix
        cuts = np.flatnonzero(~agrees).astype(np.int32)
        self.block = (np.cumsum(~agrees) - 1).astype(np.int32)  # the interval of suffixes that agree in the first `least` symbols
        self.low, self.high = cuts, np.append(cuts[1:], np.int32(len(self.symbols)))

    def text_at(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1

    def step(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of suffixes that begin with the symbol before what the intervals hold."""
        m = len(symbols)
        ranks = self.matrix.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        return self.before[symbols] + ranks[:m], self.before[symbols] + ranks[m:]

    def stream(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each position of the given texts, held at the threshold, its interval's number; -1 where less is left.

        The texts are streamed from their ends, many at once; long ones in chunks that overlap by the threshold.
        """
        hits = np.full(len(self.symbols), -1, np.int32)
        found = lengths - self.least + 1  # places where a span can begin
        pieces = [(s + i, min(CHUNK, f - i) + self.least - 1) for s, f in zip(starts.tolist(), found.tolist()) for i in range(0, f, CHUNK)]
        if not pieces:
            return hits
        pieces.sort(key=lambda p: -p[1])
        start, size = (np.array(x, np.int64) for x in zip(*pieces))
        low, high, end = np.zeros(len(start), np.int64), np.full(len(start), len(self.symbols), np.int64), start + size
        going = len(start)
        for t in range(int(size[0])):
            while going and size[going - 1] <= t:
                going -= 1
            at = end[:going] - 1 - t
            low, high = self.step(self.symbols[at], low[:going], high[:going])
            if t >= self.least - 1:
                block = self.block[low]
                hits[at] = block
                low, high = self.low[block].astype(np.int64), self.high[block].astype(np.int64)
        return hits


def shard_spans(docs: np.ndarray, offsets: np.ndarray, stretches: list[str], least: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Pairs of texts that share a span, and the shared intervals (text, start, end), of one shard's stretches."""
    numbers: dict[str, int] = {}
    number = np.array([numbers.setdefault(s, len(numbers)) for s in stretches], np.int64)
    index = FmIndex(list(numbers), least)
    hits = index.stream(index.starts, index.lengths)
    order = np.argsort(number, kind="stable")
    bounds = np.searchsorted(number[order], np.arange(len(numbers) + 1))
    least_doc = np.minimum.reduceat(docs[order], bounds[:-1])
    most_doc = np.maximum.reduceat(docs[order], bounds[:-1])
    of = index.of
    first, last = np.minimum.reduceat(least_doc[of], index.low), np.maximum.reduceat(most_doc[of], index.low)
    shared = np.concatenate([first != last, [False]])  # the last stands for -1
    common = shared[hits]
    intervals, pairs = [], set()
    edge = np.flatnonzero(np.diff(np.concatenate([[0], common.astype(np.int8), [0]])))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        text = int(index.text_at(np.array([a]))[0])
        for own in order[bounds[text] : bounds[text + 1]]:
            at = int(offsets[own]) - int(index.starts[text])
            intervals.append((int(docs[own]), at + a, at + b + least - 1))
    # intervals with the same texts give the same pairs: one of each kind is enough
    blocks = np.unique(hits[common])
    if len(blocks):
        sizes = (index.high[blocks] - index.low[blocks]).astype(np.int64)
        owner = np.repeat(np.arange(len(blocks)), sizes)
        suffix = np.repeat(index.low[blocks] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
        member = np.unique(owner * len(numbers) + of[suffix].astype(np.int64))
        owner, text = member // len(numbers), member % len(numbers)
        mark = np.random.default_rng(0).integers(0, 1 << 62, (2, len(numbers)), dtype=np.uint64)
        cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        kind = np.stack([np.add.reduceat(m[text], cut) for m in mark], 1)
        _, once = np.unique(kind, axis=0, return_index=True)
        ends = np.concatenate([cut[1:], [len(owner)]])
        for i in once.tolist():
            own = np.unique(np.concatenate([docs[order[bounds[t] : bounds[t + 1]]] for t in text[cut[i] : ends[i]]]))
            a, b = np.triu_indices(len(own), 1)
            pairs.add((own[a].tobytes(), own[b].tobytes()))
    both = np.array([np.concatenate([np.frombuffer(x[i], np.int64) for x in pairs]) for i in (0, 1)]) if pairs else np.zeros((2, 0), np.int64)
    return np.unique(both, axis=1), intervals


class SharedSpans:
    """The shared spans of a table of texts, found once: pairs() and amounts() are read from what was written.

    Texts that are null or shorter than the threshold share nothing. Exact copies are searched once, as the copy of the
    least key; key must be an integer, unique and not null (rows of null key take no part).
    """

    def __init__(self, df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, anchor: int = ANCHOR) -> None:
        self.spark, self.least, self.anchor = df.sparkSession, least, anchor
        self.work = Workspace(self.spark, "spans")
        self.texts = df.select(df[key].cast("bigint").alias("doc"), df[text].alias("text")).where(F.col("doc").isNotNull())
        self.marks = self.work.write(self._marked(), "marks")
        self.copies = self.work.write(self._copied(), "copies")
        stretches = self.work.write(self._stretches(), "stretches")
        sizes = self.work.write(stretches.groupBy("kind").agg(F.sum(F.length("text")).alias("chars")), "sizes")
        summed = sizes.agg(F.sum("chars"), F.sum(F.when(F.col("chars") > MOST, F.pow(F.ceil(2 * F.col("chars") / MOST), 2) / 2)).cast("bigint")).first()
        shards = max(1, math.ceil((summed[0] or 0) / SHARD))
        hot = sizes.where(F.col("chars") > MOST).select("kind", F.ceil(2 * F.col("chars") / MOST).cast("int").alias("parts"))
        # a set too long for a shard: part p is in the shards of all pairs (p, q), so any two of its stretches meet
        part = F.pmod(F.xxhash64("text"), F.col("parts")).cast("int")  # equal pieces are indexed once, in one part
        other = F.explode(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: q != F.col("part")))
        cut = stretches.join(broadcast_if_small(hot), "kind").withColumn("part", part).withColumn("other", other)
        cut = cut.select("doc", "at", "text", F.xxhash64("kind", F.least("part", "other"), F.greatest("part", "other")).alias("shard"))
        plain = stretches.join(broadcast_if_small(hot.select("kind")), "kind", "left_anti").select("doc", "at", "text", F.pmod(F.xxhash64("kind"), F.lit(shards)).alias("shard"))
        placed = plain if not summed[1] else plain.unionByName(cut)
        tasks = 4 * (shards + (summed[1] or 0))  # a given number: shards are few rows and much work, so they must not be coalesced nor meet in one task
        self.shards = shards + (summed[1] or 0)
        self.found = self.work.write(placed.repartition(tasks, "shard").groupBy("shard").applyInPandas(self._searched(), "doc bigint, other bigint, low bigint, high bigint"), "found")

    def _marked(self) -> DataFrame:
        """Each text's length, digest and anchors."""
        least, anchor = self.least, self.anchor

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes, digests, hashes, places = [], [], [], []
                for value in batch.column(1).to_pylist():
                    sizes.append(len(value or ""))
                    if sizes[-1] < least:
                        digests.append(None), hashes.append(None), places.append(None)
                        continue
                    codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
                    grams = gram_hashes(codes, anchor)
                    at = anchors(grams, least - anchor + 1)
                    digests.append(hashlib.blake2b(codes.tobytes(), digest_size=16).digest())
                    hashes.append(grams[at].view(np.int64)), places.append(at.astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(hashes, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))], names=["doc", "chars", "digest", "hashes", "places"])

        return self.texts.mapInArrow(run, "doc bigint, chars bigint, digest binary, hashes array<bigint>, places array<int>")

    def _copied(self) -> DataFrame:
        """The texts that have exact copies, each with its representative."""
        long = self.marks.where("digest is not null").select("doc", "digest")
        several = long.groupBy("digest").agg(F.min("doc").alias("rep"), F.count("*").alias("n")).where("n > 1").select("digest", "rep")
        return long.join(several, "digest").select("doc", "rep")

    def _stretches(self) -> DataFrame:
        """The stretches around shared anchors: kind (the set of texts), doc, place, text."""
        least, anchor = self.least, self.anchor
        others = self.copies.where("doc <> rep").select("doc")
        own = self.marks.where("digest is not null").join(broadcast_if_small(others), "doc", "left_anti")
        once = own.select("doc", F.explode(F.array_distinct("hashes")).alias("hash"))
        shared = once.groupBy("hash").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc")).alias("set")).where("n > 1").select("hash", F.xxhash64("n", "set").alias("kind"))
        places = own.select("doc", F.explode(F.arrays_zip("hashes", "places")).alias("a")).select("doc", F.col("a.hashes").alias("hash"), F.col("a.places").alias("place"))
        by_kind = places.join(shared, "hash").groupBy("doc", "kind").agg(F.array_sort(F.collect_list("place")).alias("places"))
        by_doc = by_kind.groupBy("doc").agg(F.collect_list(F.struct("kind", "places")).alias("kinds"))

        def pieces(kind: int, doc: int, start: int, end: int, text: str) -> list[tuple]:
            """A stretch in pieces that overlap by one less than the threshold, so that each span lies in one."""
            return [(kind, doc, i, text[i : min(end, i + PIECE + least - 1)]) for i in range(start, max(start + 1, end - least + 1), PIECE)]

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows: list[tuple] = []
                for doc, text, kinds in zip(*(c.to_pylist() for c in batch.columns)):
                    for kind in kinds:
                        start, end = None, -1
                        for place in kind["places"]:
                            a, b = max(0, place - (least - anchor)), min(len(text), place + least)
                            if a > end:
                                if start is not None:
                                    rows += pieces(kind["kind"], doc, start, end, text)
                                start = a
                            end = b
                        rows += pieces(kind["kind"], doc, start, end, text)
                columns = list(zip(*rows)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["kind", "doc", "at", "text"])

        by_doc = self.work.write(by_doc, "regions")  # else the check of its size would compute it once more
        return self.texts.join(broadcast_if_small(by_doc), "doc").select("doc", "text", "kinds").mapInArrow(cut, "kind bigint, doc bigint, at bigint, text string")

    def _searched(self):
        least = self.least

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pairs, intervals = shard_spans(pdf["doc"].to_numpy(np.int64), pdf["at"].to_numpy(np.int64), pdf["text"].tolist(), least)
            doc, low, high = (np.array(x, np.int64) for x in zip(*intervals)) if intervals else (np.zeros(0, np.int64),) * 3
            none = np.full(pairs.shape[1], -1, np.int64)  # pairs have no interval; intervals name their text twice
            return pd.DataFrame({"doc": np.concatenate([pairs[0], doc]), "other": np.concatenate([pairs[1], doc]), "low": np.concatenate([none, low]), "high": np.concatenate([none, high])})

        return run

    def links(self) -> DataFrame:
        """a < b, once each: pairs of texts that share a span, of exact copies only the one of the least key; members() has the rest."""
        return self.found.where("low < 0").select(F.col("doc").alias("a"), F.col("other").alias("b")).distinct()

    def members(self) -> DataFrame:
        """doc, rep: each text of the threshold's length or longer with the copy that stands for it, itself if it has none."""
        return self.marks.where("digest is not null").select("doc").join(self.copies, "doc", "left").select("doc", F.coalesce("rep", "doc").alias("rep"))

    def pairs(self) -> DataFrame:
        """doc_a < doc_b, once each: all pairs of texts that share a span, copies included."""
        known = self.links()
        copies = broadcast_if_small(self.copies.select("rep", F.col("doc").alias("copy")))
        for side in ("a", "b"):
            known = known.join(copies.withColumnRenamed("rep", side).withColumnRenamed("copy", f"copy_{side}"), side, "left").withColumn(side, F.coalesce(f"copy_{side}", side)).select("a", "b")
        alike = self.copies.alias("x").join(self.copies.alias("y"), "rep").where("x.doc < y.doc").select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"))
        return known.unionByName(alike).select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"))

    def amounts(self) -> DataFrame:
        """doc, chars, shared_chars: how much of each text stands in others too. Pairs of texts aren't needed for it."""
        spans = self.found.where("low >= 0").select("doc", "low", "high")
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
        merged = F.aggregate(F.array_sort(F.collect_set(F.struct("low", "high"))), start, lambda acc, x: F.struct((acc.n + F.greatest(x.high - F.greatest(x.low, acc.end), F.lit(0).cast("bigint"))).alias("n"), F.greatest(acc.end, x.high).alias("end")))
        by_doc = spans.groupBy("doc").agg(merged.n.alias("part"))
        whole = self.copies.select("doc", F.lit(True).alias("copied"))
        rows = self.marks.select("doc", "chars").join(by_doc, "doc", "left").join(whole, "doc", "left")
        return rows.select("doc", "chars", F.when(F.col("copied"), F.col("chars")).otherwise(F.coalesce("part", F.lit(0))).alias("shared_chars"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SharedSpans(table(spark, sf_dir, "documents")).pairs()


def p8_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document the number of its characters that stand in other documents too, in spans of the threshold or longer."""
    return SharedSpans(table(spark, sf_dir, "documents")).amounts().select(F.col("doc").alias("doc_id"), F.col("chars").alias("n_chars"), "shared_chars", F.when(F.col("chars") > 0, F.col("shared_chars") / F.col("chars")).otherwise(0.0).alias("shared_share"))


_GRAMS = """WITH places AS (SELECT doc_id, text, unnest(range(1, length(text) - 158)) AS i FROM documents WHERE length(text) >= 160),
grams AS (SELECT doc_id, i, substring(text, i::INT, 160) AS span FROM places),
shared AS (SELECT span FROM grams GROUP BY span HAVING min(doc_id) <> max(doc_id))"""
P8_SQL = f"""{_GRAMS}, own AS (SELECT DISTINCT doc_id, span FROM grams JOIN shared USING (span))
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM own a JOIN own b ON a.span = b.span AND a.doc_id < b.doc_id"""
P8_SHARED_SQL = f"""{_GRAMS}, starts AS (SELECT doc_id, i FROM grams JOIN shared USING (span)),
gaps AS (SELECT doc_id, least(coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 160), 160) AS n FROM starts),
amounts AS (SELECT doc_id, sum(n)::BIGINT AS n FROM gaps GROUP BY doc_id)
SELECT d.doc_id, coalesce(length(d.text), 0)::BIGINT AS n_chars, coalesce(a.n, 0) AS shared_chars, CASE WHEN length(d.text) > 0 THEN coalesce(a.n, 0) / length(d.text) ELSE 0.0 END::DOUBLE AS shared_share
FROM documents d LEFT JOIN amounts a ON a.doc_id = d.doc_id"""
