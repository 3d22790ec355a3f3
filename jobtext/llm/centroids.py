"""Centroid clustering over a VA-file.

Every vector has a compressed twin, a cell of BITS bits for each dimension.
For a centroid, tables give the least and the largest squared difference of
each cell, so a vector's cells bound its distance to every centroid. Only
centroids whose interval reaches below the least upper bound can be nearest;
a vector is unpacked and measured only where there are two or more of them.
All arithmetic is on integers, so the assignment is exact, ties included.

The file is one Parquet table of cells and packed vectors side by side. A round
reads it once, shuffles no vector, and gives a row of counts and sums for each
task and cluster, which the new centroids need from every vector anyhow.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtext.llm.common import staged
from jobtext.session import table_path

DIMS, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
#: Bits of a cell; two dimensions share a byte, which indexes the tables.
BITS = 4
CELLS = 1 << BITS
#: Components are held to this size, so that squared distances fit a long.
LARGEST = 1 << 27


def _kept(dims: int) -> Column:
    """Exactly ``dims`` components, all finite."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.col("embedding").isNotNull() & (F.size("embedding") == dims) & finite


def _whole(values: np.ndarray, dims: int, scale: int) -> np.ndarray:
    """Integer vectors floor(scale * x)."""
    return np.clip(np.floor(values.astype(np.float64) * scale), -LARGEST, LARGEST).astype(np.int32).reshape(-1, dims)


def _flat(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("embedding").flatten().to_numpy(zero_copy_only=False)


def _seeds(kept: DataFrame, k: int, dims: int, scale: int) -> np.ndarray:
    """The ``k`` vectors with the smallest digests of their ids; a null id comes
    last, rows equal in id go by their components. At most ``k`` rows reach the driver."""
    name = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(name.alias("name"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    top = rows.orderBy(F.col("name").asc_nulls_last(), "embedding").limit(k).collect()
    return _whole(np.array([r.embedding for r in top], np.float64), dims, scale).astype(np.int64)


def _marks(kept: DataFrame, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inner cell bounds (dims, CELLS - 1), least and largest component of each
    dimension: normal quantiles of its mean and spread over all vectors. They
    decide how sharp the intervals are, not the result."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(dims), np.zeros(dims)
        low, high = np.full(dims, LARGEST, np.int64), np.full(dims, -LARGEST, np.int64)
        for b in batches:
            x = _whole(_flat(b), dims, scale)
            if len(x):
                n, s, q = n + len(x), s + x.sum(0, dtype=np.int64), q + (x.astype(np.float64) ** 2).sum(0)
                low, high = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
        if n:
            cols = [pa.array(np.arange(dims, dtype=np.int32)), pa.array(np.full(dims, n, np.int64)), pa.array(s), pa.array(q), pa.array(low), pa.array(high)]
            yield pa.RecordBatch.from_arrays(cols, ["d", "n", "s", "q", "low", "high"])

    parts = kept.select("embedding").mapInArrow(work, "d int, n long, s double, q double, low long, high long")
    rows = parts.groupBy("d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").collect()
    steps = np.array([NormalDist().inv_cdf(i / CELLS) for i in range(1, CELLS)])
    mean = np.array([r.s / r.n for r in rows])
    spread = np.sqrt(np.maximum([r.q / r.n for r in rows] - mean * mean, 1e-9))
    inner = np.floor(mean[:, None] + spread[:, None] * steps).astype(np.int64)
    return inner, np.array([r.low for r in rows]), np.array([r.high for r in rows])


class Bounds:
    """Tables of one set of centroids: for each byte of cells, the least and
    the largest squared difference to every centroid."""

    def __init__(self, marks: tuple[np.ndarray, np.ndarray, np.ndarray], centroids: np.ndarray):
        inner, low, high = marks
        left = np.concatenate([np.minimum(low, inner[:, 0])[:, None], inner], axis=1)
        right = np.concatenate([inner - 1, np.maximum(high, inner[:, -1])[:, None]], axis=1)
        c = centroids.T[:, None, :]
        below, above = left[:, :, None] - c, c - right[:, :, None]
        least = np.maximum(np.maximum(below, above), 0) ** 2
        most = np.maximum(np.abs(below), np.abs(above)) ** 2
        # the first of two dimensions is the high half of their byte
        pair = lambda t: (t[0::2, :, None, :] + t[1::2, None, :, :]).reshape(len(t) // 2, CELLS * CELLS, -1)
        self.least, self.most, self.centroids = pair(least), pair(most), centroids

    def nearest(self, cells: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, int]:
        """Number of the nearest centroid (the smaller of two) of each vector,
        and how many vectors were measured."""
        shape = (len(cells), len(self.centroids))
        least, most = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        for i, column in enumerate(np.ascontiguousarray(cells.T)):
            least += self.least[i][column]
            most += self.most[i][column]
        able = least <= most.min(1)[:, None]
        out = able.argmax(1).astype(np.int32)
        open_ = np.flatnonzero(able.sum(1) > 1)
        row, centroid = np.nonzero(able[open_])
        found = np.full((len(open_), shape[1]), np.iinfo(np.int64).max)
        found[row, centroid] = _squares(vectors[open_[row]], self.centroids[centroid])
        if len(open_):
            out[open_] = found.argmin(1)
        return out, len(open_)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a.astype(np.int64) - b
    return np.einsum("ij,ij->i", gap, gap)


def cells_of(vectors: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Bytes of two cells each."""
    cells = np.stack([np.searchsorted(m, vectors[:, d], "right") for d, m in enumerate(inner)], axis=1).astype(np.uint8)
    return cells[:, 0::2] << BITS | cells[:, 1::2]


def _packed(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _opened(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells, and the packed vectors as a view."""
    column = lambda name, kind: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind)
    return column("cells", np.uint8).reshape(-1, dims // 2), column("x", "<i4").reshape(-1, dims)


def va_file(vectors: DataFrame, marks: tuple[np.ndarray, np.ndarray, np.ndarray], dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, cells, x): cells of each kept vector beside its packed integers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _whole(_flat(b), dims, scale)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), _packed(cells_of(x, marks[0])), _packed(x.astype("<i4"))], ["vec_id", "cells", "x"])

    return staged(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(work, "vec_id long, cells binary, x binary"), "va_file")


def _sums(file: DataFrame, bounds: Bounds, dims: int) -> dict[int, tuple[int, list[int], int]]:
    """Cluster to its count, component sums and number of vectors measured.
    A task gives a row for each cluster and dimension; the driver gets as many in all."""
    k = len(bounds.centroids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, seen = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), 0
        for b in batches:
            cells, x = _opened(b, dims)
            own, measured = bounds.nearest(cells, x)
            seen += measured
            order = np.argsort(own, kind="stable")
            found, at = np.unique(own[order], return_index=True)
            n[found] += np.diff(np.append(at, len(own)))
            s[found] += np.add.reduceat(x[order].astype(np.int64), at, axis=0) if len(own) else 0
        which, d = np.divmod(np.arange(k * dims, dtype=np.int32), dims)
        cols = [pa.array(which), pa.array(d), pa.array(np.repeat(n, dims)), pa.array(s.ravel()), pa.array(np.full(k * dims, seen))]
        yield pa.RecordBatch.from_arrays(cols, ["cluster", "d", "n", "s", "measured"])

    parts = file.select("cells", "x").mapInArrow(work, "cluster int, d int, n long, s long, measured long")
    rows = parts.groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("measured").alias("measured")).orderBy("cluster", "d").collect()
    return {c: (rows[c * dims].n, [int(r.s) for r in rows[c * dims : (c + 1) * dims]], rows[c * dims].measured) for c in range(k)}


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(vec_id, embedding, ...) to (vec_id, cluster, distance) for each kept
    vector, the final centroids, and how many vectors each round measured.

    Kept are vectors of exactly ``dims`` components, none null, NaN or infinite
    (``dims`` is even). Components beyond LARGEST after scaling are held there.
    With fewer than ``k`` vectors there are as many centroids; without any, no
    rows. Null ids are kept and never precede others as seeds; repeated rows
    each have a row; copies of one vector go to one cluster but are spread over
    tasks as they lie; other columns are ignored."""
    kept = vectors.select("vec_id", "embedding").where(_kept(dims))
    centroids = _seeds(kept, k, dims, scale)
    if not len(centroids):
        return kept.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids, []
    marks = _marks(kept, dims, scale)
    file = va_file(kept, marks, dims, scale)
    measured = []
    for _ in range(rounds):
        sums = _sums(file, Bounds(marks, centroids), dims)
        measured.append(sums[0][2])
        centroids = np.array([[s // n for s in total] if n else old.tolist() for old, (n, total, _) in zip(centroids, sums.values())], np.int64)
    bounds = Bounds(marks, centroids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, x = _opened(b, dims)
            own, _ = bounds.nearest(cells, x)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(own), pa.array(_squares(x, centroids[own]))], ["vec_id", "cluster", "distance"])

    return staged(file.mapInArrow(work, "vec_id long, cluster int, distance long"), "clusters"), centroids, measured


def op13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector its cluster and distance; inertia of the cluster and of all
    (null if it does not fit a long), digest of the final centroid."""
    out, centroids, _ = cluster(spark.read.parquet(table_path(sf_dir, "embeddings")))
    totals = {r.cluster: int(r.s) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    long = lambda v: v if v < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    # a row for each centroid
    told = [(c, long(s), long(sum(totals.values())), digest[c]) for c, s in sorted(totals.items())]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    def assign(r: int) -> str:
        gap = "list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
        return (f"a{r} AS MATERIALIZED (SELECT r, vec_id, q, min(struct_pack(d := d, k := k)) AS best FROM "
                f"(SELECT v.r, v.vec_id, v.q, c.k, {gap} AS d FROM v, c{r} c) GROUP BY r, vec_id, q)")

    def move(r: int) -> str:
        part = f"SELECT best.k AS k, q, unnest(range(1, {DIMS + 1})) AS i FROM a{r}"
        mean = "((s - ((s % n) + n) % n) // n)::BIGINT"
        sums = f"SELECT k, i, sum(q[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM ({part}) GROUP BY k, i"
        new = f"SELECT k, list({mean} ORDER BY i) AS q FROM ({sums}) GROUP BY k"
        return f"c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN ({new}) m ON m.k = c.k)"

    steps = ",\n".join(x for r in range(ROUNDS) for x in (assign(r), move(r)))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, q FROM v QUALIFY k < {CENTROIDS}),
{steps},
{assign(ROUNDS)}
SELECT vec_id, best.k::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.k))::BIGINT AS cluster_inertia,
  (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} c ON c.k = best.k"""


OP13_SQL = _oracle()
