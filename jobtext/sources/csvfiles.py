"""S1 — CSV files with quoted line breaks, read by many tasks.

The multi-line reader of the engine gives a whole file to one task, as only
the text before a place tells whether it lies between quotes. Here a file is
read in blocks, and one sum for each block settles that:

1. Quotes are counted by block. Their running sum over the blocks of a file, a
   table as long as there are blocks, tells each block how it begins.
2. Each block joins its lines to records. Lines before its first record belong
   to a record of an earlier block, and its last record may go on.
3. These few pieces, two for each block at most, are joined by the block in
   which their record began.

Records are parsed by ``from_csv`` with the reader's options. Quotes must be
paired, as they are in quoted fields; one inside an unquoted field is not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPTIONS = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}

_NAMES = ["file", "block", "own", "place", "record"]
_PIECES = "file string, block long, own boolean, place long, record string"


class _Block:
    """Lines of one block to its pieces: ``own`` marks a record that begins in
    the block, the others continue one of an earlier block; ``place`` 0 names
    the block's first own record."""

    def __init__(self, file: str, start: int, inside: bool):
        self.name, self.inside, self.began = (file, start), inside, not inside
        self.parts: list[str] = []
        self.place = 0

    def lines(self, lines: list[str], quotes: np.ndarray) -> Iterator[tuple]:
        # between quotes after each line
        after = (np.cumsum(quotes) + self.inside) % 2 == 1
        for line, open_ in zip(lines, after.tolist()):
            self.parts.append(line)
            if not open_:
                yield self._piece()
        self.inside = bool(after[-1]) if len(lines) else self.inside

    def _piece(self) -> tuple:
        out = (*self.name, self.began, self.place, "\n".join(self.parts))
        self.place += self.began
        self.began, self.parts = True, []
        return out

    def rest(self) -> Iterator[tuple]:
        if self.parts:
            yield self._piece()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Block | None = None
    for b in batches:
        out: list[tuple] = []
        line = b.column("value")
        quotes = pc.count_substring(line, '"').to_numpy(zero_copy_only=False)
        lines, files, starts, inside = line.to_pylist(), b.column("file").to_pylist(), b.column("block").to_numpy(zero_copy_only=False), b.column("inside").to_pylist()
        edges = [0, *(i for i in range(1, len(lines)) if starts[i] != starts[i - 1] or files[i] != files[i - 1]), len(lines)]
        for a, z in zip(edges, edges[1:]):
            if a == z:
                continue
            if now is None or now.name != (files[a], starts[a]):
                out += now.rest() if now else ()
                now = _Block(files[a], int(starts[a]), inside[a])
            out += now.lines(lines[a:z], quotes[a:z])
        yield _batch(out)
    if now:
        yield _batch(list(now.rest()))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(_NAMES)
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], _NAMES)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, record): the records of the CSV files under ``path``,
    without their last line break; ``first`` marks a file's header. Blocks are
    those of the session's ``spark.sql.files.maxPartitionBytes``."""
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                         F.monotonically_increasing_id().alias("place"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    # a file whose first line ends in CR LF has these breaks, which become LF between quotes too
    ends = F.endswith("value", F.lit("\r"))
    sums = lines.groupBy("file", "block").agg(F.sum(quotes).alias("n"), F.min_by(ends, "place").alias("cr"))
    crlf = F.max(F.when(F.col("block") == 0, F.col("cr"))).over(Window.partitionBy("file"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("file", "block", (before % 2 == 1).alias("inside"), crlf.alias("crlf"))
    # block-sized table; the lines stay where they were read, in order
    line = F.when(F.col("crlf") & ends, F.left("value", F.length("value") - 1)).otherwise(F.col("value"))
    pieces = lines.join(F.broadcast(starts), ["file", "block"]).select(line.alias("value"), "file", "block", "inside").mapInArrow(_pieces, _PIECES)
    odd = F.length("record") - F.length(F.replace("record", F.lit('"'), F.lit("")))
    whole = F.col("own") & (odd % 2 == 0)
    done = pieces.where(whole).select("file", ((F.col("block") == 0) & (F.col("place") == 0)).alias("first"), "record")
    # a record that goes on, and the pieces that continue it, by the block where it began
    loose = pieces.where(~whole)
    began = F.last(F.when(F.col("own"), F.col("block")), ignorenulls=True).over(Window.partitionBy("file").orderBy("block", "own"))
    joined = loose.withColumn("began", began).groupBy("file", "began").agg(
        F.sort_array(F.collect_list(F.struct("block", "own", "place", "record"))).alias("p"))
    joined = joined.select("file", ((F.col("began") == 0) & (F.filter("p", lambda x: x.own)[0].place == 0)).alias("first"), F.array_join("p.record", "\n").alias("record"))
    return done.unionByName(joined)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as a string, named by the header of the first file, as the
    multi-line reader gives them. Empty lines are skipped."""
    names = spark.read.option("header", True).options(**OPTIONS).csv(path).columns
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    rows = records(spark, path).where(~F.col("first"))
    return rows.where("record <> ''").select(F.from_csv("record", schema, OPTIONS).alias("r")).select("r.*").toDF(*names)
