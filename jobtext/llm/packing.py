"""Order-preserving packing of documents into windows by dynamic programming.

Documents follow each other by id. Cuts may lie at document ends, at sentence
ends and, inside longer stretches without either, at a grid of tokens. The
dynamic program chooses the cuts that minimise padding plus penalties for
cutting a document; a sliding minimum kept in a monotone queue serves windows
of any length, and windows whose length is a power of two need no padding.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobtext.llm import tokens
from jobtext.llm.common import ROW, documents, row_name, staged

WINDOW = 2048
#: The tokenizer, the ranks of its vocabulary, and the id that ends a document.
TOKENIZER, RANKS, END_ID = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", 1
#: Costs in tokens of padding: of a window, of a cut at a sentence end, of a cut elsewhere in a document.
PER_WINDOW, AT_SENTENCE, INSIDE = 1, 4, 64
#: Tokens gathered before their windows are settled; the last, open window is carried on.
GATHER = 1 << 18
#: Step of the grid of cuts in stretches without a sentence end.
GRID = 128

PIECES = "doc_id long, id_key long, text_key long, start long, length long, ids_crc32 long, doc_tokens long, block int, local_id long, offset long"


def best_cuts(places: list[int], penalty: list[int], window: int) -> list[int]:
    """Indexes into ``places`` (ascending, from 0; no step over ``window``) of
    the cuts of least cost, the first and last included."""
    n = len(places)
    pos = np.array(places, np.int64)
    exact: dict[int, list[int]] = {}
    power = 1
    while power < window:
        at = np.searchsorted(pos, pos - power)
        for j in np.flatnonzero(pos[np.minimum(at, n - 1)] == pos - power).tolist():
            exact.setdefault(j, []).append(int(at[j]))
        power *= 2
    cost, key, back = [0] * n, [0] * n, [0] * n
    queue, none = deque([0]), ()
    for j in range(1, n):
        p = places[j]
        while places[queue[0]] < p - window:
            queue.popleft()
        i = queue[0]
        best = key[i] + window - p
        for e in exact.get(j, none):
            if cost[e] < best:
                best, i = cost[e], e
        cost[j], back[j] = best + penalty[j] + PER_WINDOW, i
        key[j] = cost[j] + p
        while queue and key[queue[-1]] >= key[j]:
            queue.pop()
        queue.append(j)
    out = [n - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return out[::-1]


def _cut_places(parts: list[tuple], ends: np.ndarray, window: int) -> tuple[list[int], list[int]]:
    """Allowed cuts of the parts (name, start, ids, doc_tokens) laid end to end, with penalties."""
    where, cost, base = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 0
    for _, _, ids, _ in parts:
        stops = np.flatnonzero(ends[ids]) + 1
        stops = np.append(stops[stops < len(ids)], len(ids))
        gaps = np.diff(stops, prepend=0)
        pens = np.full(len(stops), AT_SENTENCE)
        pens[-1] = 0
        for g in np.flatnonzero(gaps > min(GRID, window)).tolist():
            inner = np.arange(stops[g] - gaps[g] + min(GRID, window), stops[g], min(GRID, window))
            where.append(base + inner)
            cost.append(np.full(len(inner), INSIDE))
        where.append(base + stops)
        cost.append(pens)
        base += len(ids)
    w, c = np.concatenate(where), np.concatenate(cost)
    order = np.argsort(w, kind="stable")
    return w[order].tolist(), c[order].tolist()


def _windows(parts: list[tuple], ends: np.ndarray, window: int, last: bool) -> tuple[list[list[tuple]], list[tuple]]:
    """Windows (lists of pieces: name, start, ids, doc_tokens, offset) and, unless
    ``last``, the parts of the open last window."""
    places, penalty = _cut_places(parts, ends, window)
    cuts = [places[k] for k in best_cuts(places, penalty, window)]
    out, k, used = [], 0, 0
    for a, b in zip(cuts, cuts[1:]):
        rows, at = [], 0
        while at < b - a:
            name, start, ids, total = parts[k]
            n = min(len(ids) - used, b - a - at)
            rows.append((name, start + used, ids[used : used + n], total, at))
            at, used = at + n, used + n
            if used == len(ids):
                k, used = k + 1, 0
        out.append(rows)
    if last:
        return out, []
    return out[:-1], [r[:4] for r in out[-1]]


def pack(docs: DataFrame, window: int = WINDOW, ranks: str = RANKS, tokenizer: str = TOKENIZER, end_id: int = END_ID, blocks: int | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, text, ...) to one row per piece: doc_id, id_key, text_key, start, length,
    ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    Every id of every document lies in exactly one piece; a document's ids are
    its tokens and ``end_id``. Null and empty texts are the end id alone; null
    doc_ids come last, ties by text digest; repeated rows are packed each for
    itself; other columns are ignored; an empty table gives no piece. Sequences
    run through ranges of doc_id (as many as shuffle partitions unless given),
    each packed by one task in bounded memory: about GATHER tokens and the
    texts of one batch. A range's last sequence is the only one that is open."""
    spark = docs.sparkSession
    n = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = PIECES + (", ids array<long>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.byte_bpe(ranks, tokenizer)
        ends = tokens.sentence_ends(ranks, tokenizer)
        block, seq, parts, held = TaskContext.get().partitionId(), 0, [], 0
        rows: list[tuple] = []

        def settle(last: bool) -> None:
            nonlocal seq, parts, held
            done, parts = _windows(parts, ends, window, last)
            held = sum(len(p[2]) for p in parts)
            for pieces in done:
                for (doc, i, t), start, ids, total, at in pieces:
                    row = (doc, i, t, start, len(ids), zlib.crc32(ids.tobytes()), total, block, seq, at)
                    rows.append(row + ((ids.tolist(),) if with_ids else ()))
                seq += 1

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows)) or [()] * len(names)
            kinds = [{"int": pa.int32(), "array<long>": pa.list_(pa.int64())}.get(c.split()[1], pa.int64()) for c in schema.split(", ")]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
            rows.clear()
            return out

        for b in batches:
            keys = zip(*(b.column(c).to_pylist() for c in ("doc_id", *ROW)))
            for name, text in zip(keys, b.column("text").to_pylist()):
                ids = np.append(coder.whole(text or ""), np.uint32(end_id)).astype("<u4")
                parts.append((name, 0, ids, len(ids)))
                held += len(ids)
                if held >= GATHER:
                    settle(False)
            yield batch()
        if parts:
            settle(True)
            yield batch()

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row_name("doc_id", "text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text_key")]
    laid = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order)
    pieces = staged(laid.mapInArrow(work, schema), "pieces")
    sizes = pieces.groupBy("block").agg((F.max("local_id") + 1).alias("n"))
    before = sizes.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
    out = pieces.join(before, "block").withColumn("sequence_id", F.col("before") + F.col("local_id"))
    return out.drop("block", "before", "local_id")


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(documents(spark, sf_dir))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
