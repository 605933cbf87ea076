"""Encoding of a corpus with a public byte-level BPE tokenizer.

Each pre-token's bytes are the leaves of a segment tree whose nodes hold the least merge rank below them, leftmost among
equals. A merge takes the root's position, joins it with its live neighbour and updates three leaves and their
ancestors, so a pre-token of n bytes costs O(n log n) however long it is. Trees of about equal size advance together,
one merge a step each, as NumPy arrays; a pre-token that was met before keeps its ids.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.session import table

#: Known pre-tokens kept by a worker, the characters that are cut into pre-tokens at once, and cells of trees built at once.
KNOWN, CHARACTERS, CELLS = 400_000, 1 << 21, 1 << 22
_NONE = np.int64(1) << 62
_SHIFT = 40

# The pre-token pattern of the public vocabulary, and the same for texts that are ASCII only.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


def byte_letters() -> dict[str, int]:
    """The letter that spells each byte in the vocabulary: visible Latin-1 itself, others from U+0100 on in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """Rank and result of a merge by the ids of its two sides: an open hash table with vectorised look-ups."""

    def __init__(self, pairs: np.ndarray, results: np.ndarray) -> None:
        self.bits = max(10, int(len(pairs)).bit_length() + 2)
        size = 1 << self.bits
        self.keys, self.ranks = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        self.results = results
        at, todo, self.probes = self._slot(pairs), np.arange(len(pairs)), 0
        while len(todo):
            self.probes += 1
            free = self.keys[at[todo]] < 0
            slots, first = np.unique(at[todo[free]], return_index=True)
            put = todo[free][first]
            self.keys[slots], self.ranks[slots] = pairs[put], put
            todo = np.setdiff1d(todo, put, assume_unique=True)
            at[todo] = (at[todo] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, or -1 where the pair is no merge; a negative id is no token."""
        keys = (left << 20) | right
        at = self._slot(keys)
        found = self.keys[at]
        ranks = np.where(found == keys, self.ranks[at], -1)
        todo = np.flatnonzero((found != keys) & (found >= 0) & (left >= 0) & (right >= 0))
        for _ in range(self.probes):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            ranks[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        ranks[(left < 0) | (right < 0)] = -1
        return ranks


class ByteBpe:
    """The tokenizer of a vocabulary file in the public JSON form with model.vocab and model.merges; no special tokens."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, letters = model["vocab"], byte_letters()
        self.byte_ids = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.byte_ids[byte] = vocab[letter]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, both = (np.array([vocab[x] for x in side], np.int64) for side in (*zip(*merges), [a + b for a, b in merges]))
        self.pairs = PairTable((left << 20) | right, both)
        self.any, self.ascii = regex.compile(PATTERN), re.compile(ASCII_PATTERN)
        self._forget()

    def _forget(self) -> None:
        self.known: defaultdict[str, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def words(self, text: str) -> list[str]:
        return (self.ascii if text.isascii() else self.any).findall(text)

    def _indexed(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each pre-token of the texts, and the count of each text; new ones are encoded."""
        if len(self.known) > KNOWN:
            self._forget()
        parts, counts, held, size, before = [], np.zeros(len(texts), np.int64), [], 0, len(self.known)
        number = self.known.__getitem__

        def put() -> None:
            parts.append(np.fromiter(map(number, held), np.int32, len(held)))
            held.clear()

        for i, text in enumerate(texts):
            if text:
                words = self.words(text)
                counts[i] = len(words)
                held += words
                size += len(text)
                if size > CHARACTERS:
                    put()
                    size = 0
        put()
        if len(self.known) > before:
            import itertools

            self._learn([w.encode("utf-8", "surrogatepass") for w in itertools.islice(self.known, before, None)])
        return np.concatenate(parts), counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of the texts; an empty or null text has none."""
        index, counts = self._indexed(texts)
        lengths, offsets = self.lengths[index], np.zeros(len(texts) + 1, np.int64)
        ends = np.cumsum(lengths)
        np.cumsum(counts, out=offsets[1:])
        shift = self.starts[index] - (ends - lengths)
        ids = self.flat[np.repeat(shift, lengths) + np.arange(ends[-1] if len(ends) else 0)]
        return np.concatenate([[0], ends])[offsets], ids

    def count(self, texts: list[str | None]) -> np.ndarray:
        """The number of tokens of each text."""
        index, counts = self._indexed(texts)
        ends = np.concatenate([[0], np.cumsum(self.lengths[index])])
        return np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])

    def _learn(self, words: list[bytes]) -> None:
        """Encodes new pre-tokens, by classes of about equal length, and appends their ids."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        classes = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
        counts, places = np.zeros(len(words), np.int64), []
        for k in np.unique(classes):
            own = np.flatnonzero(classes == k)
            step = max(1, CELLS >> (k + 1))
            for i in range(0, len(own), step):
                some = own[i : i + step]
                if k > 9 and len(some) < 24:
                    results = [self._tree(words[w]) for w in some]
                    counts[some] = [len(r) for r in results]
                    places.append((some, np.concatenate(results)))
                else:
                    ids, counts[some] = self._trees([words[w] for w in some], lengths[some], k)
                    places.append((some, ids))
        starts = self.used + np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else counts
        total = self.used + int(counts.sum())
        if total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(total, 2 * len(self.flat)) - len(self.flat), np.int32)])
        for some, ids in places:
            n = counts[some]
            self.flat[np.repeat(starts[some] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        self.used = total
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, counts])

    def _trees(self, words: list[bytes], lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pre-tokens of at most 2**k bytes, one after the other, and their counts."""
        n, size = len(words), 1 << k
        ids = np.full((n, size), -1, np.int64)
        ids[np.arange(size) < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        if k == 0:
            return ids[:, 0], np.ones(n, np.int64)
        here = np.arange(size)
        follows, before = np.tile(here + 1, n), np.tile(here - 1, n)  # live neighbours
        tree = np.full((n, 2 * size), _NONE, np.int64)
        rank = self.pairs.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, size - 1)
        tree[:, size:-1] = np.where(rank >= 0, (rank << _SHIFT) | here[:-1], _NONE)
        for level in range(k - 1, -1, -1):
            m = 1 << level
            np.minimum(tree[:, 2 * m : 4 * m : 2], tree[:, 2 * m + 1 : 4 * m : 2], out=tree[:, m : 2 * m])
        roots = tree[:, 1].copy()
        ids, tree, live = ids.ravel(), tree.ravel(), (ids >= 0).ravel()
        rows = np.flatnonzero(roots < _NONE)
        while len(rows):
            root = tree[rows * (2 * size) + 1]
            going = root < _NONE
            if not going.all():
                rows, root = rows[going], root[going]
                if not len(rows):
                    break
            base = rows * size
            at, merged = root & ((1 << _SHIFT) - 1), self.pairs.results[root >> _SHIFT]
            right = follows[base + at]
            after = follows[base + right]
            ids[base + at] = merged
            follows[base + at] = after
            live[base + right] = False
            inside = after < size
            before[(base + after)[inside]] = at[inside]
            left = before[base + at]
            has = left >= 0
            # the leaf of the merged pair's right side goes; the pairs on both sides of the merged token are new
            nodes = np.stack([right, at, np.where(has, left, at)])
            next_id = np.where(inside, ids[base + np.where(inside, after, 0)], -1)
            last_id = np.where(has, ids[base + np.where(has, left, 0)], -1)
            rank = self.pairs.rank(np.concatenate([merged, last_id]), np.concatenate([next_id, merged])).reshape(2, -1)
            value = np.full(nodes.shape, _NONE, np.int64)
            value[1] = np.where(rank[0] >= 0, (rank[0] << _SHIFT) | at, _NONE)
            value[2] = np.where(has, np.where(rank[1] >= 0, (rank[1] << _SHIFT) | left, _NONE), value[1])
            tops = rows * (2 * size)
            nodes = nodes + size
            tree[(tops + nodes).ravel()] = value.ravel()
            for _ in range(k):
                nodes >>= 1
                below = tops + 2 * nodes
                tree[tops + nodes] = np.minimum(tree[below], tree[below + 1])
        live = live.reshape(n, size)
        return ids[live.ravel()], live.sum(1)

    def _tree(self, word: bytes) -> np.ndarray:
        """Ids of one long pre-token: the same tree in plain lists, which is faster where few trees could share a step."""
        n = len(word)
        size = 1 << max(1, (n - 1).bit_length())
        ids = self.byte_ids[np.frombuffer(word, np.uint8)]
        rank = self.pairs.rank(ids[:-1], ids[1:])
        level = np.full(size, _NONE, np.int64)
        level[: n - 1] = np.where(rank >= 0, (rank << _SHIFT) | np.arange(n - 1), _NONE)
        levels = [level]
        while len(level) > 1:
            level = np.minimum(level[::2], level[1::2])
            levels.append(level)
        tree = np.concatenate([np.zeros(1, np.int64), *levels[::-1]]).tolist()
        ids, none, mask = ids.tolist(), int(_NONE), (1 << _SHIFT) - 1
        follows, before = list(range(1, n + 1)), list(range(-1, n - 1))
        results, ranks = self.pairs.results, self._scalar
        while tree[1] < none:
            at, merged = tree[1] & mask, int(results[tree[1] >> _SHIFT])
            right = follows[at]
            after, left = follows[right], before[at]
            ids[at], ids[right], follows[at] = merged, -1, after
            changed = [(right, none)]
            if after < n:
                before[after] = at
                changed.append((at, ranks(merged, ids[after], at)))
            else:
                changed.append((at, none))
            if left >= 0:
                changed.append((left, ranks(ids[left], merged, left)))
            for leaf, value in changed:
                node = leaf + size
                tree[node] = value
                node >>= 1
                while node:
                    a, b = tree[2 * node], tree[2 * node + 1]
                    least = a if a < b else b
                    if tree[node] == least:
                        break
                    tree[node] = least
                    node >>= 1
        return np.array([i for i in ids if i >= 0], np.int64)

    def _scalar(self, left: int, right: int, at: int) -> int:
        rank = self._by_pair.get((left << 20) | right)
        return int(_NONE) if rank is None else (rank << _SHIFT) | at

    @property
    def _by_pair(self) -> dict[int, int]:
        if not hasattr(self, "_pairs"):
            used = self.pairs.keys >= 0
            self._pairs = dict(zip(self.pairs.keys[used].tolist(), self.pairs.ranks[used].tolist()))
        return self._pairs


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBpe:
    """One for each worker process and file; workers are used again."""
    return ByteBpe(path)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary file, as installed beside the interpreter."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encode(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """key and ids, one row for each row of df: the ids of the text, an empty list for an empty or null one.

    The spellings of special tokens are ordinary text. Every row counts by itself, repeated or not; other columns of df
    are left out, so their names can't clash. Texts are encoded whole, where they are read: no shuffle. path None takes
    the vocabulary installed at the worker.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path or vocabulary())
        for batch in batches:
            offsets, ids = own.encode(batch.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["key", "ids"])

    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").select(F.col("key").alias(key), "ids")


def count_tokens(df: DataFrame, keep: list[str], text: str, path: str | None = None) -> DataFrame:
    """The columns of keep and n_tokens, the number of tokens of the text: 0 for an empty or null one."""
    source = df.select(*(df[c] for c in keep), df[text].alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path or vocabulary())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(own.count(batch.column(len(keep)).to_pylist()), pa.int64())], names=[*keep, "n_tokens"])

    return source.mapInArrow(run, schema)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")
