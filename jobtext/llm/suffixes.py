"""Removal of repeated passages by bucket-pointer refinement behind a minimiser.

Only suffixes that can repeat are refined. Every place has a digest of its
first 25 bytes, mixed with the one 25 bytes on to that of 50. A 200-byte window
belongs to the least such digest inside it, equal windows to the same one. A
run is a maximal stretch of windows of one digest; its context is the text they
cover. Runs whose digest no other run shares are done, and equal contexts are
repeated whole.

The unequal contexts of a shared digest are refined together: their places
start in buckets of equal 5 bytes, and the members of each bucket are sorted by
the bucket pointers of the places 5, 10, 20 ... bytes on, which tell 10, 20, 40
... bytes. A pointer is the rank of its bucket's first member, so a bucket that
is split leaves all others as they are; those with one member are not sorted
again, and every later round reads the pointers of the rounds before. Windows
that share a bucket at 200 bytes are equal, byte for byte. Digests with very
many contexts, or long ones, are settled window by window over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtext.llm.common import ROW, documents, member, row_name, slices, staged, texts_of

LENGTH, FIRST, GRAM = 200, 25, 50
#: Windows whose arrays are held at once; a run may be cut there, which the refinement mends.
BLOCK = 1 << 18
#: Contexts with one digest, and their bytes, that one task refines together; beyond, they are shuffled by window.
TOGETHER, MOST_BYTES = 4096, 1 << 21
#: Bytes of contexts, those of a digest together, that are refined at once.
TOGETHER_BYTES = 1 << 18
#: Bytes of the first buckets of the refinement.
Q = 5
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= _K[0]
    x ^= x >> np.uint64(29)
    x *= _K[3]
    x ^= x >> np.uint64(32)
    return x


def _fives(data: np.ndarray) -> np.ndarray:
    """The five bytes at each place as one number."""
    y = data.astype(np.uint64)
    five = y[:-4].copy()
    for k in range(1, 5):
        five |= y[k : len(y) - 4 + k] << np.uint64(8 * k)
    return five


def first_buckets(data: np.ndarray) -> np.ndarray:
    """Digests of the first 25 bytes at each place."""
    five = _fives(data)
    n = len(five) - 20
    out = five[:n].copy()
    for k in range(1, 5):
        part = five[5 * k : 5 * k + n] * _K[k % 3 + 1]
        part ^= part >> np.uint64(23 + 2 * k)
        out = out * _K[0] + part
    return _mixed(out)


def refined(buckets: np.ndarray, length: int) -> np.ndarray:
    """Digests of twice ``length`` bytes from those at a place and ``length`` later."""
    later = buckets[length:]
    out = buckets[: len(later)] * _K[1]
    out += later ^ (later >> np.uint64(17))
    return _mixed(out)


def _sorted_buckets(pointers: np.ndarray, later: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Splits the buckets of ``members`` by the pointers ``later`` on: writes their
    new pointers and returns the members of buckets that still have several."""
    order = np.argsort((pointers[members] << 32) | later[members], kind="stable")
    members = members[order]
    bucket, key = pointers[members], later[members]
    old = np.concatenate(([True], bucket[1:] != bucket[:-1]))
    new = old | np.concatenate(([True], key[1:] != key[:-1]))
    at = np.arange(len(members))
    first = lambda edge: np.maximum.accumulate(np.where(edge, at, 0))
    pointers[members] = bucket + first(new) - first(old)
    return members[~(new & np.append(new[1:], True))]


def refinement(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bucket pointers by the first ``length`` bytes (5, 10, 20, ... or a sum of
    such) at each place that has as many; equal pointers mean equal bytes."""
    five = _fives(data)
    order = np.argsort(five, kind="stable")
    edge = np.concatenate(([True], five[order][1:] != five[order][:-1]))
    pointers = np.empty(len(five), np.int64)
    pointers[order] = np.maximum.accumulate(np.where(edge, np.arange(len(five)), 0))
    members = order[~(edge & np.append(edge[1:], True))]
    depth, rest = Q, length
    while rest - depth >= depth:
        depth *= 2
    depth, rest, kept = Q, length - depth, None
    while depth < length and len(members):
        if depth == rest:
            kept = pointers.copy()
        # what a round reads tells as many bytes as are missing, no more: 200 are 160 and 40
        told, step = (pointers, depth) if 2 * depth <= length else (kept, rest)
        later = np.append(told[depth:], np.zeros(min(depth, len(five)), np.int64))
        members = _sorted_buckets(pointers, later, members)
        depth += step
    return pointers


def _sliding(x: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = least(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return least(x[: len(x) - rest], x[rest:]) if rest else x


def runs(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]]:
    """Blocks of runs: first windows, window counts, buckets, whether the bucket
    lies at two places of the run, and digests of the contexts."""
    width = LENGTH - GRAM + 1
    for base in range(0, len(text) - LENGTH + 1, BLOCK):
        part = text[base : base + BLOCK + LENGTH - 1]
        grams = refined(first_buckets(np.frombuffer(part, np.uint8)), FIRST)
        low = _sliding(grams, width, np.minimum)
        starts = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1))
        counts = np.diff(starts, append=len(low))
        buckets = low[starts]
        pad = np.zeros(width - 1, np.uint64)
        chosen = np.flatnonzero(_sliding(np.concatenate((pad, low, pad)), width, np.maximum) == grams)
        twice = np.zeros(len(starts), bool)
        if len(chosen) != len(starts):
            names, which = np.unique(grams[chosen], return_inverse=True)
            scale = len(grams) + 1
            places = np.sort(which * scale + chosen)
            of = np.searchsorted(names, buckets) * scale
            twice = np.searchsorted(places, of + starts + counts - 1 + width - 1, "right") - np.searchsorted(places, of + starts) > 1
        digest = xxhash.xxh3_64_intdigest
        contexts = [digest(part[a : a + n + LENGTH - 1]) for a, n in zip(starts.tolist(), counts.tolist())]
        yield starts + base, counts, buckets, twice, contexts


def _run_table(docs: DataFrame) -> DataFrame:
    """(bucket, context, id_key, text_key, start, n, twice) of every run."""
    names = ["bucket", "context", *ROW, "start", "n", "twice"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in slices(batch)):
            held, size = [], 0
            for i, k, t in zip(b.column("id_key").to_pylist(), b.column("text_key").to_pylist(), texts_of(b)):
                for starts, counts, buckets, twice, contexts in runs(t):
                    n = len(starts)
                    held.append([buckets.view(np.int64), np.array(contexts, np.uint64).view(np.int64), np.full(n, i), np.full(n, k), starts.astype(np.int64), counts.astype(np.int32), twice])
                    size += n
                    if size > 1 << 18:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)

    return docs.mapInArrow(work, "bucket long, context long, id_key long, text_key long, start long, n int, twice boolean")


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(bucket, id_key, text_key, start, n, alone, bytes) of the wanted runs."""
    schema = "bucket long, id_key long, text_key long, start long, n int, alone boolean, bytes binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in slices(batch)):
            rows = []
            for i, k, t, runs_ in zip(b.column("id_key").to_pylist(), b.column("text_key").to_pylist(), texts_of(b), b.column("runs").to_pylist()):
                rows += [(r["bucket"], i, k, r["start"], r["n"], r["alone"], t[r["start"] : r["start"] + r["n"] + LENGTH - 1]) for r in runs_]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
            for at in range(0, len(rows), 4000):
                cols = zip(*rows[at : at + 4000])
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds)], names)

    lists = wanted.groupBy(*ROW).agg(F.collect_list(F.struct("bucket", "start", "n", "alone")).alias("runs"))
    return docs.join(lists, ROW).select(*ROW, "text", "runs").mapInArrow(work, schema)


def _digests(data: np.ndarray) -> np.ndarray:
    """Digests of the 200 bytes at each place."""
    return refined(refined(refined(first_buckets(data), FIRST), 2 * FIRST), 4 * FIRST)


def _windows(parts: list[bytes], counts: list[int], buckets: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket at 200 bytes of every window of the contexts laid end to end, and each window's context."""
    whole = buckets(np.frombuffer(b"".join(parts), np.uint8))
    n = np.array(counts)
    begin = np.cumsum([0, *map(len, parts[:-1])])
    of = np.repeat(np.arange(len(n)), n)
    return whole[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[of]], of


def _spans(doc: list[tuple[int, int]], start: np.ndarray, of: np.ndarray, hit: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(id_key, text_key, start, n) of stretches of marked windows; ``start`` is each window's place in its document."""
    at = np.flatnonzero(hit)
    if not at.size:
        return []
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(of[at]) != 0))
    first, last = at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))]
    return [(*doc[of[a]], int(start[a]), int(b - a + 1)) for a, b in zip(first.tolist(), last.tolist())]


_SPAN_NAMES = [*ROW, "start", "n"]
_SPAN = "id_key long, text_key long, start long, n int"


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32()))], _SPAN_NAMES)


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by digest: spans of the lone ones' windows that lie elsewhere among them."""
    bucket, doc, begin, counts, alone, parts, size = [], [], [], [], [], [], 0

    def settle(upto: int) -> list[tuple]:
        key, of = _windows(parts[:upto], counts[:upto], refinement)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        hit = np.zeros(len(key), bool)
        hit[order[1:][same]] = hit[order[:-1][same]] = True
        hit &= np.array(alone[:upto])[of]
        n = np.array(counts[:upto])
        start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.array(begin[:upto])[of]
        return _spans(doc, start, of, hit)

    for b in (s for batch in batches for s in slices(batch, "bytes")):
        out = []
        for row in zip(*(b.column(c).to_pylist() for c in ("bucket", *ROW, "start", "n", "alone", "bytes"))):
            if size >= TOGETHER_BYTES and row[0] != bucket[-1]:
                out += settle(len(parts))
                for x in (bucket, doc, begin, counts, alone, parts):
                    x.clear()
                size = 0
            bucket.append(row[0])
            doc.append(row[1:3])
            begin.append(row[3])
            counts.append(row[4])
            alone.append(row[5])
            parts.append(row[6])
            size += len(row[6])
        yield _span_batch(out)
    if parts:
        yield _span_batch(settle(len(parts)))


def _slices_of(sizes: list[int]) -> Iterator[slice]:
    """Slices of 500 items, or fewer whose sizes come to TOGETHER_BYTES."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        total += n + LENGTH
        if i + 1 - start == 500 or total >= TOGETHER_BYTES or i + 1 == len(sizes):
            yield slice(start, i + 1)
            start, total = i + 1, 0


def _by_window(many: DataFrame) -> DataFrame:
    """The same for buckets of many contexts: every window is a row, counted by its identifier."""
    names = ["bucket", "window", *ROW, "start", "alone"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in slices(batch, "bytes")):
            cols = {c: b.column(c).to_pylist() for c in ("bucket", *ROW, "start", "n", "alone", "bytes")}
            for at in _slices_of(cols["n"]):
                own, of = _windows(cols["bytes"][at], cols["n"][at], _digests)
                n = np.array(cols["n"][at])
                start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.array(cols["start"][at])[of]
                take = [np.array(cols[c][at])[of] for c in ("bucket", *ROW, "alone")]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (take[0], own.view(np.int64), take[1], take[2], start, take[3])], names)

    rows = many.mapInArrow(work, "bucket long, window long, id_key long, text_key long, start long, alone boolean")
    again = rows.groupBy("bucket", "window").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("bucket", "window")
    return rows.where("alone").join(again, ["bucket", "window"]).select(*ROW, "start", F.lit(1).cast("int").alias("n"))


def repeated(docs: DataFrame) -> DataFrame:
    """(id_key, text_key, text) to (id_key, text_key, start, n): stretches of
    ``n`` windows from byte ``start`` on whose 200 bytes also start elsewhere."""
    table = staged(_run_table(docs), "runs")
    shared = table.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.min("context").alias("a"), F.max("context").alias("b"), F.max("twice").alias("twice")).where("k > 1 or twice")
    shared = staged(shared.select("bucket", (F.col("twice") | (F.col("a") != F.col("b"))).alias("mixed")), "shared")
    rows = staged(table.where(member(shared, "bucket")(F.col("bucket"))).join(shared, "bucket"), "again")
    kinds = rows.where("mixed").groupBy("bucket", "context").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct(*ROW, "start", "n")).alias("r"))
    kinds = staged(kinds.select("bucket", "context", "k", "r.*"), "contexts")
    crowd = kinds.groupBy("bucket").agg(((F.count(F.lit(1)) > TOGETHER) | (F.sum(F.col("n").cast("long") + LENGTH - 1) > MOST_BYTES)).alias("many"))
    wanted = staged(kinds.join(crowd, "bucket").select("bucket", *ROW, "start", "n", (F.col("k") == 1).alias("alone"), "many"), "wanted")
    few, many = (_contexts(docs, wanted.where(c).drop("many")) for c in ("not many", "many"))
    few = few.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_refine, _SPAN)
    whole = rows.where("not mixed").select(*_SPAN_NAMES)
    copies = rows.join(kinds.where("k > 1").select("bucket", "context"), ["bucket", "context"]).select(*_SPAN_NAMES)
    return whole.unionAll(copies).unionAll(few).unionAll(_by_window(many))


def remove(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) to a row for each row: doc_id, n_bytes, spans (removed
    byte ranges, start and end exclusive, maximal) and kept (the other bytes).

    A byte goes if a 200-byte string over it also starts anywhere else in the
    input, the same document included. Texts are judged as UTF-8 on the input;
    null is empty; ids may be null; repeated rows repeat each other's texts;
    other columns are ignored; empty in, empty out. Cut texts may end inside a
    character, so ``kept`` is binary."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in slices(batch)):
            sizes, spans, kept = [], [], []
            for t, found in zip(texts_of(b), b.column("found")):
                sizes.append(len(t))
                if not found.is_valid:
                    spans.append([])
                    kept.append(t)
                    continue
                packed = np.sort(found.values.to_numpy())
                first, last = packed >> 32, (packed >> 32) + (packed & 0xFFFFFFFF) + LENGTH - 1
                upto = np.maximum.accumulate(last)
                new = np.concatenate(([True], first[1:] > upto[:-1]))
                begin, end = first[new].tolist(), upto[np.concatenate((new[1:], [True]))].tolist()
                spans.append([{"start": x, "end": y} for x, y in zip(begin, end)])
                kept.append(b"".join(t[x:y] for x, y in zip([0, *end], [*begin, len(t)])))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row_name("doc_id", "text"))
    found = repeated(rows.select(*ROW, "text")).groupBy(*ROW).agg(F.collect_list(F.shiftleft(F.col("start"), 32).bitwiseOR(F.col("n").cast("long"))).alias("found"))
    return rows.join(found, ROW, "left").select("doc_id", "text", "found").mapInArrow(work, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.end - s.start)
    return remove(documents(spark, sf_dir)).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
