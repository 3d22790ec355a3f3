"""SimHash near-duplicates by a segment-popcount grid.

A 64-bit fingerprint is mapped to the bit counts of its segments: each half has
16 segments of one bit and 8 of two bits. The Manhattan distance of two such
vectors never exceeds the number of differing bits, and of the two halves one
carries at most half of it. Two vectors within distance 2 on a half have a grid point within 1
of both, so every fingerprint enters the grid cells within distance 1 of each
of its halves and fingerprints that share a cell are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtext.llm.common import ROW, documents, member, row_name, slices, staged, texts_of
from jobtext.llm.components import components

SHINGLE, MAX_BITS = 4, 4
#: Cells with more members than this are linked through Hamming midpoints.
CELL = 16_384
_LOW = 0x5555
_BLOCK = 16_384


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of lower-cased (A-Z) words in shingles; fewer
    words are one shingle, no words give zero."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(line)]
    last = max(1, len(words) - shingle + 1)
    step = min(shingle, len(words)) - 1
    digest, votes = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for i in range(0, last, _BLOCK):
        j = min(last, i + _BLOCK)
        found = b"".join([digest(line[a:b], 42) for a, b in zip(starts[i:j], ends[i + step : j + step])])
        votes += np.unpackbits(np.frombuffer(found, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(votes * 2 > last).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text) to (doc_id, id_key, text_key, fp), a row for each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in slices(batch)):
            fp = pa.array([fingerprint(t, shingle) for t in texts_of(b)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", *ROW)] + [fp], ["doc_id", *ROW, "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row_name("doc_id", "text"))
    return rows.mapInArrow(work, "doc_id long, id_key long, text_key long, fp long")


def _cells(fp: Column, radius: int) -> Column:
    """Grid cells within ``radius`` (0 or 1) of both halves' bit counts."""
    out = []
    for half in (0, 1):
        bits = F.shiftrightunsigned(fp, 32 * half)
        narrow, wide = bits.bitwiseAND(0xFFFF), F.shiftrightunsigned(bits, 16).bitwiseAND(0xFFFF)
        counts = wide.bitwiseAND(_LOW) + F.shiftrightunsigned(wide, 1).bitwiseAND(_LOW)
        base = F.lit(half << 32) + F.shiftleft(counts, 16) + narrow
        out.append(base)
        out += [base.bitwiseXOR(F.lit(1 << i)) for i in range(16 * radius)]
        for i in range(8 * radius):
            digit, unit = F.shiftrightunsigned(counts, 2 * i).bitwiseAND(3), F.lit(1 << 16 + 2 * i)
            out += [F.when(digit < 2, base + unit), F.when(digit > 0, base - unit)]
    return F.explode(F.array_compact(F.array(*out)))


def forest(members: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that span each group of members joined by ``max_bits`` or fewer
    differing bits; every member is compared with all that are not yet placed."""
    rest, links = members, []
    while rest.size:
        todo, rest = [rest[0]], rest[1:]
        while todo and rest.size:
            u = todo.pop()
            near = np.bitwise_count((rest ^ u).view(np.uint64)) <= max_bits
            if near.any():
                found = rest[near]
                links += [(int(u), int(v)) for v in found]
                todo += list(found)
                rest = rest[~near]
    return links


def _cell_links(cells: DataFrame, max_bits: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple[int, int]] = []
            for fps in b.column("fps"):
                found += forest(fps.values.to_numpy(), max_bits)
            a = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

    return cells.mapInArrow(work, "a long, b long")


def _midpoint_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Exact links for crowded cells, linear in the members: two fingerprints
    within ``max_bits`` share a 64-bit point halfway, and all that lie within
    half of it around one point are linked to its smallest inner member."""
    inner, outer = max_bits // 2, (max_bits + 1) // 2
    masks = [sum(1 << i for i in c) for r in range(outer + 1) for c in combinations(range(64), r)]
    signed = ",".join(str(m - (1 << 64) if m >> 63 else m) for m in masks)
    points = fps.select("fp", F.explode(F.split(F.lit(signed), ",").cast("array<long>")).alias("mask")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("point"), (F.bit_count("mask") <= inner).alias("inner"))
    heads = points.groupBy("point").agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1 and head is not null")
    return points.join(heads.select("point", "head"), "point").where("fp <> head").select(F.col("fp").alias("a"), F.col("head").alias("b")).distinct()


def links(fps: DataFrame, max_bits: int = MAX_BITS, cell: int = CELL) -> DataFrame:
    """(fp) distinct to (a, b): links that connect exactly the fingerprints
    which chains of ``max_bits`` or fewer differing bits connect."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the grid covers 0 to 4 differing bits")
    slots = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grid = fps.repartition(slots, "fp").select("fp", _cells(F.col("fp"), min(1, max_bits // 2)).alias("cell"))
    full = staged(grid.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "cells")
    twos = full.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b")
    several = full.where("n > 2").select("cell", "n")
    more = grid.where(member(several, "cell")(F.col("cell"))).join(several, "cell")
    lists = more.where(F.col("n") <= cell).groupBy("cell").agg(F.collect_list("fp").alias("fps")).select("fps")
    out = twos.unionAll(_cell_links(lists, max_bits))
    crowded = more.where(F.col("n") > cell).select("fp").distinct()
    return out.unionAll(_midpoint_links(crowded, max_bits))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, cell: int = CELL) -> DataFrame:
    """(doc_id, text, ...) to (doc_id, id_key, text_key, fp, root, component_id),
    a row for each input row; ``root`` is a fingerprint that names the component.

    Null or wordless text has fingerprint zero and is linked like any other.
    Equal texts share a fingerprint, so copies are one member of the grid.
    ``component_id`` is the smallest non-null doc_id of the component, null if
    there is none. Repeated rows are kept; other columns are ignored; an empty
    table gives an empty result."""
    own = staged(fingerprints(docs, shingle), "fingerprints")
    fps = staged(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(links(fps.select("fp"), max_bits, cell))
    placed = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = placed.join(least, "root").select("fp", "root", "component_id")
    return own.join(named, "fp").select("doc_id", *ROW, "fp", "root", "component_id")


def survivors(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` without near-duplicates, all columns: of each
    component the row with the smallest doc_id (then the smallest text digest;
    null ids last); of rows equal in id and text, one."""
    found = near_duplicates(docs, shingle, max_bits)
    order = F.struct(F.col("doc_id").isNull().alias("none"), *ROW)
    keep = found.groupBy("root").agg(F.min(order).alias("k")).select("k.id_key", "k.text_key").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row")).select("row", *row_name("row.doc_id", "row.text"))
    return rows.join(keep, ROW, "left_semi").dropDuplicates(ROW).select("row.*")


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
