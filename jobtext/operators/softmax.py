"""M3, M4, M7 — multinomial logistic regression on packed rows.

It minimises

    ½ |W|² + C Σ_i s_i (log Σ_c exp(w_c · x_i + b_c) - (w_y · x_i + b_y))

with y the row's class and s_i its weight; the intercepts b are free and add up to
zero. Newton steps with halving (``newton``), over the rows as ``squared_hinge``
packs them; the features are not scaled, which for terms of very different
frequency takes far fewer passes than Spark ML's search over scaled ones. A
product makes the rows' probabilities again from the weights, so that nothing is
kept for each row but a copy with values of four bytes, which products read: they
shape the steps, while the objective and its gradient are of the rows as they are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from jobtext.operators.newton import Newton
from jobtext.operators.squared_hinge import _added, _Block, _each, packed_rows, short, sums_ungrouped

#: The search ends when no entry of the gradient of the mean loss is larger (the reference's is 1e-4); steps at most.
TOLERANCE, MAX_STEPS = 1e-5, 200


class Softmax:
    """``labels``: the classes, sorted; ``weights``: a row for each, the intercept last."""

    def __init__(self, labels: list[str], weights: np.ndarray):
        self.labels, self.weights = labels, weights


def _chances(scores: np.ndarray) -> np.ndarray:
    out = np.exp(scores - scores.max(axis=0))
    return out / out.sum(axis=0)


def _evaluate(rows: DataFrame, w: np.ndarray, c: float, ungrouped: bool) -> tuple[float, np.ndarray, np.ndarray]:
    """The objective at ``w``, its gradient and the diagonal of its Hessian."""
    n = w.shape[1]

    def add(block: _Block, out: np.ndarray) -> None:
        scores, at = block.scores(w), (block.y, np.arange(len(block.y)))
        scores -= scores.max(axis=0)
        out[0, 0] += c * (block.s * (np.log(np.exp(scores).sum(axis=0)) - scores[at])).sum()
        chance = _chances(scores)
        out[:, n + 1 :] += block.squares().summed(c * block.s * chance * (1.0 - chance), n - 1)
        chance[at] -= 1.0
        out[:, 1 : n + 1] += block.summed(c * block.s * chance, n - 1)

    out, held = _added(rows, (len(w), 2 * n + 1), add, ungrouped), _held(w)
    return float(0.5 * (w * held).sum() + out[0, 0]), held + out[:, 1 : n + 1], _held(np.ones_like(w)) + out[:, n + 1 :]


def _held(w: np.ndarray) -> np.ndarray:
    """What the penalty sees: all but the intercepts."""
    return np.hstack([w[:, :-1], np.zeros((len(w), 1))])


def _product(rows: DataFrame, w: np.ndarray, v: np.ndarray, c: float, ungrouped: bool) -> np.ndarray:
    """The Hessian at ``w`` times ``v``."""
    n_features = w.shape[1] - 1

    def add(block: _Block, out: np.ndarray) -> None:
        chance, way = _chances(block.scores(w)), block.scores(v)
        out += block.summed(c * block.s * chance * (way - (chance * way).sum(axis=0)), n_features)

    return _held(v) + _added(rows, w.shape, add, ungrouped)


def fit(rows: DataFrame, n_features: int, c: float = 1.0, label_col: str = "label", weight_col: str | None = None) -> Softmax:
    """``rows`` as for ``squared_hinge.fit``."""
    labels, data = packed_rows(rows, n_features, label_col, weight_col)
    w = np.zeros((len(labels), n_features + 1))
    ungrouped = sums_ungrouped(data, 2 * w.nbytes)
    total = float(_added(data, (1, 1), lambda block, out: np.add(out, block.s.sum(), out=out), True)[0, 0])
    enough, newton = TOLERANCE * c * total, Newton()
    small = _each(data, ["s", *short(n_features)]).persist()
    loss, grad, diagonal = _evaluate(data, w, c, ungrouped)
    for _ in range(MAX_STEPS):
        if np.abs(grad).max() <= enough:
            break
        flat = newton.step(lambda v, _, w=w: _product(small, w, v.reshape(w.shape), c, ungrouped).reshape(1, -1),
                           grad.reshape(1, -1), diagonal.reshape(1, -1), 0.3 * enough)
        step, size = flat.reshape(w.shape), 1.0
        slope = float((step * grad).sum())
        while True:
            new = w + size * step
            new_loss, new_grad, new_diagonal = _evaluate(data, new, c, ungrouped)
            # the last term: what rounding may add to a sum
            if new_loss <= loss + 1e-4 * size * slope + 1e-12 * abs(loss) or size < 1e-12:
                break
            size /= 2
        w, loss, grad, diagonal = new, new_loss, new_grad, new_diagonal
    small.unpersist()
    w[:, -1] -= w[:, -1].mean()
    return Softmax(labels, w)
