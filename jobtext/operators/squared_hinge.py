"""M5 — linear support vector machine, one class against the rest, squared hinge loss.

For every class c it minimises

    ½ |w_c|² + C Σ_i s_i max(0, 1 - y_ic (w_c · x_i))²

with y_ic = 1 if row i is of class c, else -1, s_i the row's weight and the
intercept as the weight of one more feature that is always 1. The classes share
no weights, but each pass over the rows serves all of them.

Newton steps with halving (``newton``); a step's products with the Hessian see
only the rows inside the margin of some class. These are picked exactly from all
rows at each step and kept for its products, with values of four bytes: products
shape the steps, while the objective and its gradient, which settle the result,
are of the rows as they are. In a pass every task adds up its rows' part, an array of classes ×
features, and the driver adds the tasks' parts, or those of a few groups of them
if they are large. Rows are packed, thousands to a row of a few byte strings, and
stay where they were written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtext.operators.evaluate import MAX_CLASSES
from jobtext.operators.newton import Newton
from jobtext.session import materialize

#: Groups in which the tasks' parts are added; weights (classes × features) at most, some 80 MB.
GROUPS, MAX_WEIGHTS = 16, 10_000_000
#: A gradient this much smaller than the first ends the search; steps at most.
TOLERANCE, MAX_STEPS = 1e-5, 500
#: A step's system is solved to this share of the gradient.
FORCING = 0.3
#: Entries of a packed block; bytes of all tasks' parts that go to the driver ungrouped.
BLOCK_ENTRIES, UNGROUPED = 1 << 20, 64 << 20

_PACKED = ["y", "s", "sizes", "indices", "values"]
_TYPES = dict(zip([*_PACKED, "curve", "indices2", "values4"], [np.int32, np.float64, np.int32, np.int32, np.float64, np.float64, np.uint16, np.float32]))


class SquaredHinge:
    """``labels``: the classes, sorted; ``weights``: a row for each, the intercept last."""

    def __init__(self, labels: list[str], weights: np.ndarray):
        self.labels, self.weights = labels, weights

    def decide(self, rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """(id, scores, predicted_label): the decision values by class, and the class of the largest (the first of equal ones)."""
        w, labels = self.weights, self.labels

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                scores = decisions(b.column("indices"), b.column("values"), w)
                best = pa.array([labels[k] for k in scores.argmax(0)], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(scores.T.tolist(), pa.list_(pa.float64())), best], [id_col, "scores", "predicted_label"])

        kind = rows.schema[id_col].dataType.simpleString()
        return rows.select(id_col, "indices", "values").mapInArrow(work, f"{id_col} {kind}, scores array<double>, predicted_label string")


def entries(vector: str) -> list[Column]:
    """(indices, values) of an unwrapped ML vector."""
    # a dense vector has no indices
    indices = F.coalesce(F.col(f"{vector}.indices"), F.sequence(F.lit(0), F.size(f"{vector}.values") - 1))
    return [indices.alias("indices"), F.col(f"{vector}.values").alias("values")]


def decisions(indices: pa.Array, values: pa.Array, w: np.ndarray) -> np.ndarray:
    """The decision values of rows, by class."""
    sizes, *flat = _flat(indices, values)
    return _Block(None, None, sizes, *flat).scores(w)


def _flat(indices: pa.Array, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of entries of each row, and the entries; a null array has none."""
    sizes = pc.fill_null(pc.list_value_length(indices), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lambda x, kind: x.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return sizes, flat(indices, np.int32), flat(values, np.float64)


class _Block:
    """Rows as flat arrays: class, weight and number of entries of each row, then the entries."""

    def __init__(self, y: np.ndarray | None, s: np.ndarray | None, sizes: np.ndarray, indices: np.ndarray, values: np.ndarray, curve: np.ndarray | None = None):
        self.y, self.s, self.sizes, self.indices, self.values, self.curve = y, s, sizes, indices.astype(np.int64), values, curve
        self.full = np.flatnonzero(sizes)
        self.starts = (np.cumsum(sizes) - sizes)[self.full]

    def scores(self, w: np.ndarray) -> np.ndarray:
        out = np.repeat(w[:, -1:], len(self.sizes), axis=1)
        if len(self.full):
            for k, wk in enumerate(w):
                out[k, self.full] += np.add.reduceat(wk[self.indices] * self.values, self.starts)
        return out

    def summed(self, pull: np.ndarray, n_features: int) -> np.ndarray:
        """Σ pull_i x_i for each row of ``pull``."""
        return np.stack([np.append(np.bincount(self.indices, np.repeat(p, self.sizes) * self.values, n_features), p.sum()) for p in pull])

    def squares(self) -> "_Block":
        """The rows with the squares of their values."""
        return _Block(self.y, self.s, self.sizes, self.indices, self.values * self.values)

    def gaps(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sign = np.where(np.arange(len(w))[:, None] == self.y, 1.0, -1.0)
        return sign, np.maximum(0.0, 1.0 - sign * self.scores(w))

    def inside(self, w: np.ndarray, c: float) -> "_Block | None":
        """The rows inside the margin of some class, with the loss's curvature 2 c s there and zero elsewhere, by class."""
        curve = 2.0 * c * self.s * (self.gaps(w)[1] > 0)
        some = curve.any(axis=0)
        if not some.any():
            return None
        entries = np.repeat(some, self.sizes)
        return _Block(self.y[some], self.s[some], self.sizes[some], self.indices[entries], self.values[entries], curve[:, some])


def short(n_features: int) -> list[str]:
    """The columns of packed entries for products: values of four bytes, indices of two if they fit."""
    return ["sizes", "indices2" if n_features <= 1 << 16 else "indices", "values4"]


def _packed(blocks: list[_Block], names: list[str]) -> pa.RecordBatch:
    cells = [pa.array([np.ascontiguousarray(getattr(b, x.rstrip("24")), _TYPES[x]).tobytes() for b in blocks], pa.binary()) for x in names]
    return pa.RecordBatch.from_arrays(cells, names)


def _blocks(batch: pa.RecordBatch) -> Iterator[_Block]:
    """The blocks of a batch of packed rows, or of plain ones (y, s, indices, values)."""
    if "sizes" in batch.schema.names:
        for cells in zip(*[batch.column(x) for x in batch.schema.names]):
            found = {"y": None, "s": None} | {x.rstrip("24"): np.frombuffer(v.as_buffer(), _TYPES[x]) for x, v in zip(batch.schema.names, cells)}
            if "curve" in found:
                found["curve"] = found["curve"].reshape(-1, len(found["sizes"]))
            yield _Block(**found)
        return
    sizes, *flat = _flat(batch.column("indices"), batch.column("values"))
    y, s, end = batch.column("y").to_numpy(), batch.column("s").to_numpy(), np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        low = end[first] - sizes[first]
        last = max(first + 1, int(np.searchsorted(end, low + BLOCK_ENTRIES, "right")))
        yield _Block(y[first:last], s[first:last], sizes[first:last], *[x[low : end[last - 1]] for x in flat])
        first = last


def _each(rows: DataFrame, names: list[str], change: Callable[[_Block], "_Block | None"] = lambda block: block) -> DataFrame:
    """Packed rows: each block after ``change``, none for None."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in _blocks(b):
                new = change(block)
                if new is not None:
                    yield _packed([new], names)

    return rows.mapInArrow(work, ", ".join(f"{x} binary" for x in names))


def _added(rows: DataFrame, shape: tuple[int, int], add: Callable[[_Block, np.ndarray], None], ungrouped: bool = False) -> np.ndarray:
    """An array to which ``add`` has added every block's part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(shape)
        for b in batches:
            for block in _blocks(b):
                add(block, out)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["part", "out"])

    def total(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        return pd.DataFrame({"part": [group["part"].iloc[0]], "out": [np.sum([np.frombuffer(x) for x in group["out"]], axis=0).tobytes()]})

    kind = "part int, out binary"
    parts = rows.mapInArrow(work, kind)
    if not ungrouped:
        parts = parts.groupBy(F.col("part") % GROUPS).applyInPandas(total, kind)
    # in one order, so that the sum does not depend on which part came first
    return sum((np.frombuffer(r.out).reshape(shape) for r in sorted(parts.collect(), key=lambda r: r.part)), np.zeros(shape))


def _by_class(rows: DataFrame, w: np.ndarray, c: float, ungrouped: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The objective of each class, its gradient and the diagonal of its Hessian at ``w``."""
    n = w.shape[1]

    def add(block: _Block, out: np.ndarray) -> None:
        sign, gap = block.gaps(w)
        out[:, 0] += c * (block.s * gap * gap).sum(axis=1)
        out[:, 1 : n + 1] += block.summed(-2.0 * c * block.s * sign * gap, n - 1)
        out[:, n + 1 :] += block.squares().summed(2.0 * c * block.s * (gap > 0), n - 1)

    out = _added(rows, (len(w), 2 * n + 1), add, ungrouped)
    return 0.5 * (w * w).sum(axis=1) + out[:, 0], w + out[:, 1 : n + 1], 1.0 + out[:, n + 1 :]


def _evaluate(rows: DataFrame, w: np.ndarray, c: float) -> tuple[float, np.ndarray]:
    """The objective of all classes and its gradient at ``w``."""
    loss, grad, _ = _by_class(rows, w, c)
    return float(loss.sum()), grad


def _products(inside: DataFrame, v: np.ndarray, which: np.ndarray, ungrouped: bool = False) -> np.ndarray:
    """The Hessian of each class of ``which`` times its row of ``v``."""
    n_features = v.shape[1] - 1

    def add(block: _Block, out: np.ndarray) -> None:
        out += block.summed(block.curve[which] * block.scores(v), n_features)

    return v + _added(inside, v.shape, add, ungrouped)


def packed_rows(rows: DataFrame, n_features: int, label_col: str, weight_col: str | None) -> tuple[list[str], DataFrame]:
    """The classes, sorted, and the rows with a label, packed and written."""
    known = rows.where(F.col(label_col).isNotNull())
    labels = sorted(r[0] for r in known.select(label_col).distinct().limit(MAX_CLASSES + 1).collect())
    if not labels or len(labels) > MAX_CLASSES or len(labels) * (n_features + 1) > MAX_WEIGHTS:
        raise ValueError(f"{len(labels)} classes and {n_features} features")
    places = known.sparkSession.createDataFrame(list(zip(labels, range(len(labels)))), "_label string, y int")
    s = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    data = known.join(F.broadcast(places), F.col(label_col) == F.col("_label"))  # at most MAX_CLASSES rows
    return labels, materialize(_each(data.select("y", s.alias("s"), "indices", "values"), _PACKED))


def sums_ungrouped(data: DataFrame, size: int) -> bool:
    """Whether the tasks' parts of ``size`` bytes go to the driver as they are."""
    return data.rdd.getNumPartitions() * size <= UNGROUPED


def fit(rows: DataFrame, n_features: int, c: float = 1.0, label_col: str = "label", weight_col: str | None = None) -> SquaredHinge:
    """``rows``: (label, indices, values) with ascending indices below
    ``n_features``; null labels are left out, null arrays have no entries. Each
    class needs a weight for each feature: more than MAX_WEIGHTS are an error."""
    labels, data = packed_rows(rows, n_features, label_col, weight_col)
    w = np.zeros((len(labels), n_features + 1))
    ungrouped, newton = sums_ungrouped(data, 2 * w.nbytes), Newton(FORCING, keep=0)  # rows enter and leave the margin at each step
    loss, grad, diagonal = _by_class(data, w, c, ungrouped)
    enough = TOLERANCE * max(np.abs(grad).max(), 1e-300)
    for _ in range(MAX_STEPS):
        open_ = np.abs(grad).max(axis=1) > enough
        if not open_.any():
            break
        inside = _each(data, [*short(n_features), "curve"], lambda block, w=w: block.inside(w, c)).persist()
        step = newton.step(lambda v, which, inside=inside: _products(inside, v, which, ungrouped), np.where(open_[:, None], grad, 0.0), diagonal, 0.3 * enough)
        inside.unpersist()
        slope, size = (step * grad).sum(axis=1), np.ones(len(labels))
        while True:
            new = w + size[:, None] * step
            new_loss, new_grad, new_diagonal = _by_class(data, new, c, ungrouped)
            far = (new_loss > loss + 1e-4 * size * slope) & (size >= 1e-12) & open_
            if not far.any():
                break
            size[far] /= 2
        w, loss, grad, diagonal = new, new_loss, new_grad, new_diagonal
    return SquaredHinge(labels, w)
