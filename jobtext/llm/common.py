"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtext.session import scratch_path, table_path

#: The six white space characters that separate words, and all others.
BLANK_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
#: Bits of the map that spares most rows a shuffle; its size does not depend on the data.
MAP_BITS = 1 << 22


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, "documents"))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the
    lineage, survives lost executors and is read column by column."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_name(id_col: str | Column, text: str | Column) -> list[Column]:
    """Two non-null longs that name a row: ``id_key`` (the id, 0 for null) and
    ``text_key`` (64-bit digest of the text and of whether the id is null).
    Rows equal in id and text share a name; every operator treats them alike."""
    i = (F.col(id_col) if isinstance(id_col, str) else id_col).cast("long")
    return [F.coalesce(i, F.lit(0)).alias("id_key"), F.xxhash64(text, i.isNull()).alias("text_key")]


ROW = ["id_key", "text_key"]


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A batch's texts as UTF-8 bytes; null is empty."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of ``column``, a row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def id_edges(df: DataFrame, id_col: str, pieces: int) -> list[int]:
    """Up to ``pieces - 1`` ids that cut the table into ranges of about equal
    row counts. Bounded by ``pieces``, not by the table."""
    if pieces < 2:
        return []
    got = df.agg(F.percentile_approx(id_col, [i / pieces for i in range(1, pieces)], 10_000)).first()[0]
    return sorted(set(got or []))


def id_range(id_col: str, edges: list[int]) -> Column:
    """Number of the range that an id falls in: how many edges lie below it;
    null ids are a range of their own, the last."""
    table = np.array(edges, np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(table, ids.to_numpy(), side="left").astype("int32"))

    known = F.coalesce(F.col(id_col).cast("long"), F.lit(0))
    return F.when(F.col(id_col).isNull(), F.lit(len(edges) + 1)).otherwise(place(known))


def member(df: DataFrame, name: str) -> Callable[[Column], Column]:
    """Test of longs against column ``name`` by a bit map of MAP_BITS bits:
    true for every value of the column and, the fuller the map, for others.
    The map is a scalar subquery of one array, of the same size for any data."""
    slot = F.pmod(F.col(name), F.lit(MAP_BITS))
    bits = F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({name}, {MAP_BITS}) & 63 as int))"))
    words = df.groupBy(F.shiftright(slot, 6).alias("id")).agg(bits.alias("bits"))
    dense = df.sparkSession.range(MAP_BITS // 64).join(words, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    table = dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "bits"))), lambda w: w.bits)).scalar()

    def test(x: Column) -> Column:
        at = F.pmod(x, F.lit(MAP_BITS))
        word = F.get(table, F.shiftright(at, 6).cast("int"))
        return F.call_function("shiftright", word, at.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1

    return test
