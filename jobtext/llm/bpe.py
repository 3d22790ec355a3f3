"""Byte-level BPE by segment trees, and its decoding.

For each match of the split pattern a segment tree over byte positions holds,
at every node, the smallest (pair rank, position) below it. The root is the
leftmost pair of least rank; merging it is three point updates (the pair's own
place, its left neighbour's, and the swallowed place), each logarithmic. Short
matches are handled many at a time, one tree a row of an array; long ones by a
tree of their own. Equal matches are encoded once in a batch, and frequent
ones are remembered by each process.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtext.llm import tokens
from jobtext.llm.common import documents, slices

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Longest match, in bytes, that shares an array with others.
SHARED_LENGTH = 64
#: Places of an array of trees.
SHARED_PLACES = 1 << 17
#: Units (see tokens) that a process remembers, and characters encoded together.
CACHE_UNITS, TOGETHER = 200_000, 1 << 19
_NONE = np.int64(1) << 62


class Trees:
    """Encoder of byte strings by one rank file."""

    def __init__(self, ranks: dict[bytes, int]):
        import public_tokenizers

        self.ranks = ranks
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.pair_keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        order = np.argsort(self.pair_keys)
        self.pair_keys, self.pair_ranks = self.pair_keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]
        self.known: dict[str, bytes] = {}

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; _NONE where they do not merge."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def many(self, words: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of words of 2 to ``width`` bytes; ``width`` is a power of two."""
        return [np.frombuffer(ids, "<u4") for ids in self.many_bytes(words, width)]

    def many_bytes(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids of words as ``many``, as little-endian unsigned 32-bit bytes."""
        n = len(words)
        size = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        ids, place = self.byte_ids[raw], np.arange(width)
        alive = place < size[:, None]
        after = np.broadcast_to(place + 1, (n, width)).copy()
        before = np.broadcast_to(place - 1, (n, width)).copy()
        rank = np.full((n, width), _NONE)
        rank[:, :-1] = np.where(alive[:, 1:], self._pair(ids[:, :-1], ids[:, 1:]), _NONE)
        levels = [np.where(rank < _NONE, rank * width + place, _NONE)]
        while levels[-1].shape[1] > 1:
            levels.append(np.minimum(levels[-1][:, ::2], levels[-1][:, 1::2]))

        def update(rows: np.ndarray, at: np.ndarray, rank: np.ndarray) -> None:
            levels[0][rows, at] = np.where(rank < _NONE, rank * width + at, _NONE)
            for low, high in zip(levels, levels[1:]):
                at = at >> 1
                high[rows, at] = np.minimum(low[rows, 2 * at], low[rows, 2 * at + 1])

        rows = np.arange(n)
        while True:
            rows = rows[levels[-1][rows, 0] < _NONE]
            if not rows.size:
                break
            best, at = np.divmod(levels[-1][rows, 0], width)
            swallowed = after[rows, at]
            right = after[rows, swallowed]
            ids[rows, at], after[rows, at], alive[rows, swallowed] = best, right, False
            some = right < size[rows]
            before[rows[some], right[some]] = at[some]
            update(rows, swallowed, np.full(rows.size, _NONE))
            rank = np.full(rows.size, _NONE)
            rank[some] = self._pair(best[some], ids[rows[some], right[some]])
            update(rows, at, rank)
            left = before[rows, at]
            some = left >= 0
            update(rows[some], left[some], self._pair(ids[rows[some], left[some]], best[some]))
        # one conversion for all words, cut at their ends
        flat, ends = ids[alive].astype("<u4").tobytes(), (4 * np.cumsum(alive.sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    @cached_property
    def pair_rank(self) -> dict[int, int]:
        return dict(zip(self.pair_keys.tolist(), self.pair_ranks.tolist()))

    def one(self, word: bytes) -> list[int]:
        """Ids of a word of any length by a tree of its own."""
        n = len(word)
        width = 1 << (n - 1).bit_length()
        ids, after, before = self.byte_ids[np.frombuffer(word, np.uint8)].tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        get, none = self.pair_rank.get, (1 << 62, 0)
        tree = [none] * (2 * width)
        for i in range(n - 1):
            r = get(ids[i] << 20 | ids[i + 1])
            if r is not None:
                tree[width + i] = (r, i)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def update(i: int, value: tuple[int, int]) -> None:
            k = width + i
            tree[k] = value
            while k > 1:
                k >>= 1
                tree[k] = min(tree[2 * k], tree[2 * k + 1])

        while tree[1] is not none:
            rank, i = tree[1]
            j = after[i]
            k = after[j]
            ids[i], ids[j], after[i] = rank, -1, k
            update(j, none)
            r = None
            if k < n:
                before[k] = i
                r = get(rank << 20 | ids[k])
            update(i, none if r is None else (r, i))
            p = before[i]
            if p >= 0:
                r = get(ids[p] << 20 | rank)
                update(p, none if r is None else (r, p))
        return [i for i in ids if i >= 0]

    def matches(self, words: set[str]) -> dict[str, bytes]:
        """Each match's ids as little-endian unsigned 32-bit bytes. A match that
        is a token is that token."""
        out, groups = {}, {}
        for w in words:
            raw = w.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                out[w] = whole.to_bytes(4, "little")
            elif len(raw) > SHARED_LENGTH:
                out[w] = np.array(self.one(raw), "<u4").tobytes()
            else:
                groups.setdefault(1 << (len(raw) - 1).bit_length(), []).append((w, raw))
        for width, group in groups.items():
            step = max(1, SHARED_PLACES // width)
            for k in range(0, len(group), step):
                part = group[k : k + step]
                out.update(zip([w for w, _ in part], self.many_bytes([r for _, r in part], width)))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        known, whole = self.known, [tokens.INSIDE_RUN.search(t) is not None for t in texts]
        units = [[t] if w else t.split(" ") for t, w in zip(texts, whole)]
        # the first unit of a text has no space before it, nor has a text that is not cut
        heads = {u[0] for u in units}
        rest = {x for u in units for x in u[1:]}
        if len(known) > CACHE_UNITS:
            known.clear()
        new = [(None, h) for h in heads] + [(x, " " + x) for x in rest if x not in known]
        cut = [self.split(u) for _, u in new]
        ids = self.matches({m for c in cut for m in c})
        first, fresh = {}, {}
        for (key, unit), c in zip(new, cut):
            joined = b"".join([ids[m] for m in c])
            if key is None:
                first[unit] = joined
            else:
                fresh[key] = joined
        known.update(fresh)
        return [first[u[0]] + b"".join([known[x] for x in u[1:]]) for u in units]


def decoded(ids: bytes, table: dict[int, bytes]) -> bytes:
    """The bytes that ids stand for."""
    return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def trees(ranks: str = RANKS) -> Trees:
    return Trees(tokens.ranks_of(ranks))


@cache
def token_bytes(ranks: str = RANKS) -> dict[int, bytes]:
    return {i: t for t, i in tokens.ranks_of(ranks).items()}


def encode(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, text, ...) to (doc_id, ids binary: little-endian unsigned 32-bit),
    a row for each row. Null text is empty and has no ids; special tokens'
    strings are ordinary text; null ids and repeated rows are kept; other
    columns are ignored. Memory is bounded by a batch's texts and the cache."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = trees(ranks)
        for batch in batches:
            for b in slices(batch, "text", TOGETHER):
                ids = coder.encode([t or "" for t in b.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, ids binary")


def decode(rows: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, ids) to (doc_id, ids, decoded binary)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(ranks)
        for batch in batches:
            for b in slices(batch, "ids", TOGETHER):
                out = pa.array([decoded(x, table) for x in b.column("ids").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), out], ["doc_id", "ids", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(work, "doc_id long, ids binary, decoded binary")


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode(encode(documents(spark, sf_dir)))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
