"""M5 against a dense Newton solver."""

import numpy as np
import pytest

from jobtext.operators import squared_hinge as SH


def dense(x, y, s, c):
    """Newton steps on ½|w|² + c Σ s max(0, 1 - y x·w)², with halving."""
    w = np.zeros(x.shape[1])
    value = lambda w: 0.5 * w @ w + c * (s * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
    for _ in range(200):
        gap = np.maximum(0, 1 - y * (x @ w))
        grad = w - 2 * c * x.T @ (s * y * gap)
        on = gap > 0
        step = np.linalg.solve(np.eye(len(w)) + 2 * c * (x[on].T * s[on]) @ x[on], grad)
        t = 1.0
        while value(w - t * step) > value(w) - 1e-4 * t * grad @ step and t > 1e-10:
            t /= 2
        w = w - t * step
        if np.abs(grad).max() < 1e-12:
            break
    return w


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    n, d = 240, 18
    x = rng.normal(size=(n, d)) * (rng.random((n, d)) < 0.4)
    x[7] = 0
    label = np.array(["a", "b", "c"])[(x @ rng.normal(size=(d, 3)) + rng.normal(size=(n, 3)) * 0.5).argmax(1)]
    return x, label, np.where(label == "a", 2.0, 0.5)


def frame(spark, x, label, s):
    rows = [(i, str(c), [int(j) for j in np.flatnonzero(v)], [float(t) for t in v[np.flatnonzero(v)]], float(w)) for i, (v, c, w) in enumerate(zip(x, label, s))]
    rows = [(*r[:2], None, None, r[4]) if not r[2] else r for r in rows] + [(900, None, [0], [1.0], 1.0)]
    return spark.createDataFrame(rows, "doc_id long, label string, indices array<int>, values array<double>, s double").repartition(4)


@pytest.mark.parametrize("c,weighed", [(1.0, True), (0.05, False)])
def test_equals_dense_solver(spark, data, c, weighed):
    x, label, s = data
    s = s if weighed else np.ones(len(x))
    df = frame(spark, x, label, s)
    model = SH.fit(df, x.shape[1], c, weight_col="s" if weighed else None)
    full = np.hstack([x, np.ones((len(x), 1))])
    want = np.stack([dense(full, np.where(label == k, 1.0, -1.0), s, c) for k in ("a", "b", "c")])
    assert model.labels == ["a", "b", "c"] and np.abs(model.weights - want).max() < 1e-3
    start = max(np.abs(SH._evaluate(_rows(df, s), np.zeros_like(want), c)[1]).max(), 1)
    assert np.abs(SH._evaluate(_rows(df, s), model.weights, c)[1]).max() <= 2 * SH.TOLERANCE * start
    got = {r.doc_id: (r.scores, r.predicted_label) for r in model.decide(df).collect()}
    for i, v in enumerate(full):
        assert np.abs(np.array(got[i][0]) - want @ v).max() < 1e-2
    assert len(got) == len(x) + 1


def _rows(df, s):
    y = "case label when 'a' then 0 when 'b' then 1 else 2 end"
    return df.where("label is not null").selectExpr(f"cast({y} as int) as y", "s" if s.min() != s.max() else "1.0D as s", "indices", "values")


def test_bounds(spark, data):
    x, label, s = data
    with pytest.raises(ValueError):
        SH.fit(frame(spark, x, label, s).limit(0), 18)
    with pytest.raises(ValueError):
        SH.fit(frame(spark, x, label, s), SH.MAX_WEIGHTS)
