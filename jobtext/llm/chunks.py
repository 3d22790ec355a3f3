"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes marks places in the text. A chunk ends at a
place of a strict mark while it is shorter than the normal size and of a loose
one beyond it, at the latest at the largest size, so lengths gather around the
normal size and an insertion moves only the chunks around it. A fingerprint is
the set of chunk digests with their lengths; likeness is the length-weighted
share of one text's chunks that the other has.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtext.llm.common import documents, id_edges, id_range, row_name

#: Chunk sizes in bytes; marks are 1 in 256 places below the normal size, 1 in 32 above.
LEAST, NORMAL, MOST = 24, 64, 256
STRICT, LOOSE = 0xFF000000, 0xF8000000
#: A random 32-bit number for each byte, from a digest of the byte.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 1) for b in range(256)], np.uint32)
_WINDOW = 32
_BLOCK = 1 << 20


def _marks(text: bytes) -> tuple[list[int], list[int]]:
    """Ends of chunks (exclusive) that the strict and the loose mask allow."""
    strict, loose = [], []
    for at in range(0, len(text), _BLOCK):
        lead = min(at, _WINDOW - 1)
        h = GEAR[np.frombuffer(text, np.uint8, min(_BLOCK, len(text) - at) + lead, at - lead)]
        span = 1
        while span < _WINDOW:
            h[span:] += h[:-span] << np.uint32(span)
            span *= 2
        h = h[lead:]
        some = np.flatnonzero((h & np.uint32(LOOSE)) == 0)
        loose += (some + at + 1).tolist()
        strict += (some[(h[some] & np.uint32(STRICT)) == 0] + at + 1).tolist()
    return strict, loose


def chunks(text: bytes) -> Iterator[bytes]:
    """The text cut into chunks, in order."""
    strict, loose = _marks(text)
    start, n = 0, len(text)
    while start < n:
        end = n
        if n - start > LEAST:
            i = bisect_left(strict, start + LEAST)
            if i < len(strict) and strict[i] < start + NORMAL:
                end = strict[i]
            else:
                i = bisect_left(loose, start + NORMAL)
                end = min(n, start + MOST, loose[i] if i < len(loose) else n)
        yield text[start:end]
        start = end


def digests(text: bytes) -> dict[str, int]:
    """Chunk digest -> length."""
    return {xxhash.xxh3_64_hexdigest(c): len(c) for c in chunks(text)}


def written(found: dict[str, int]) -> str:
    """The fingerprint as a string: ``digest:length`` by digest, comma-joined."""
    return ",".join([f"{d}:{n}" for d, n in sorted(found.items())])


def containment(a: dict[str, int], b: dict[str, int]) -> float:
    """Share of a's length in chunks that b has; 1 for equal sets, 0 for an empty one otherwise."""
    if a == b:
        return 1.0
    whole = sum(a.values())
    return sum(n for d, n in a.items() if d in b) / whole if whole else 0.0


def edited(text: str, after: str) -> str:
    """The last half of ``text`` (rounded down) replaced by as many first characters of ``after``."""
    n = len(text) // 2
    return text[: len(text) - n] + after[:n]


def _beside(docs: DataFrame, pieces: int) -> DataFrame:
    """The rows dealt into ranges of doc_id, with a copy of each range's first
    row (by descending id) behind the range before it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *row_name("doc_id", "text"))
    edges = id_edges(rows, "doc_id", pieces)
    rows = rows.withColumn("part", id_range("doc_id", edges))
    first = F.max(F.struct("doc_id", F.bitwise_not("text_key").alias("key"))).alias("first")
    # one row per range, highest ids first, null ids last
    heads = sorted(rows.groupBy("part").agg(first).collect(), key=lambda r: (r.first.doc_id is None, -r.part))
    table = [(h.part, h.first.doc_id or 0, ~h.first.key, heads[k - 1].part) for k, h in enumerate(heads)]
    heads_df = docs.sparkSession.createDataFrame(table, "part int, id_key long, text_key long, before int")
    placed = rows.join(F.broadcast(heads_df), ["part", "id_key", "text_key"], "left")
    copies = F.array_compact(F.array(F.struct("part", F.lit(False).alias("copy")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("part"), F.lit(True).alias("copy")))))
    dealt = placed.select("doc_id", "text", "text_key", F.explode(copies).alias("to")).select("doc_id", "text", "text_key", "to.part", "to.copy")
    order = ["copy", F.col("doc_id").desc_nulls_last(), "text_key"]
    return dealt.repartitionById(len(edges) + 2, "part").sortWithinPartitions(*order)


def fingerprints(docs: DataFrame, pieces: int | None = None) -> DataFrame:
    """(doc_id, text, ...) to a row for each row: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one that follows by descending doc_id (null ids
    last, ties by text digest), after the last the first; a single row follows
    itself. Null text is empty; repeated rows are kept and follow each other;
    other columns are ignored; empty in, empty out. A task reads one range of
    ids (as many as shuffle partitions unless given) and holds two documents
    beside a batch; the driver holds one id per range. All null ids are one range."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            out = []
            for i, text, copy in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("copy").to_pylist()):
                own = digests(text.encode())
                if held:
                    of, before, had = held
                    new = edited(before, text).encode()
                    got = digests(new)
                    out.append((of, len(before), hashlib.sha256(new).hexdigest(), written(had), written(got), containment(had, got), containment(had, own)))
                if copy:
                    held = None
                    break
                held = (i, text, own)
            cols = list(zip(*out)) or [()] * len(names)
            kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    n = pieces or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _beside(docs, n).select("doc_id", "text", "copy").mapInArrow(work, schema)


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
