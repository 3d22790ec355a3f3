"""M3, M7: multinomial logistic regression by Newton steps, against a dense solver and Spark ML's objective; the steps' systems."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from jobtext.operators import models as MD
from jobtext.operators import newton as NT
from jobtext.operators import softmax as LR
from jobtext.session import scratch_path


def dense(x, y, s, c, k):
    """Newton steps on ½|W|² + C Σ s (log Σ exp - own); x without the intercept's column."""
    full, (n, d) = np.hstack([x, np.ones((len(x), 1))]), x.shape
    held = np.tile(np.append(np.ones(d), 0.0), k)
    w = np.zeros((k, d + 1))
    for _ in range(100):
        z = full @ w.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        grad = held * w.ravel() + c * ((p - np.eye(k)[y]) * s[:, None]).T.dot(full).ravel()
        bend = np.diag(held)
        for a in range(k):
            for b in range(k):
                q = c * s * p[:, a] * ((a == b) - p[:, b])
                bend[a * (d + 1) : (a + 1) * (d + 1), b * (d + 1) : (b + 1) * (d + 1)] += full.T @ (full * q[:, None])
        w -= np.linalg.lstsq(bend, grad, rcond=None)[0].reshape(w.shape)
        if np.abs(grad).max() < 1e-10:
            break
    w[:, -1] -= w[:, -1].mean()
    return w


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    n, d = 260, 16
    x = np.abs(rng.normal(size=(n, d))) * (rng.random((n, d)) < np.geomspace(0.9, 0.01, d))
    x[5] = 0
    label = np.array(["a", "b", "c"])[(x @ rng.normal(size=(d, 3)) * 2 + rng.normal(size=(n, 3))).argmax(1)]
    return x, label


def frame(spark, x, label):
    rows = [(str(k), Vectors.sparse(x.shape[1], np.flatnonzero(v).tolist(), v[np.flatnonzero(v)].tolist()) if i % 5 else Vectors.dense(v)) for i, (k, v) in enumerate(zip(label, x))]
    return spark.createDataFrame(rows, ["label", "features"]).repartition(3)


def weights(label):
    return np.array([len(label) / (len(set(label)) * (label == k).sum()) for k in label])


def test_candidate_equals_dense_solver(spark, data, monkeypatch):
    monkeypatch.setattr(LR, "TOLERANCE", 1e-8)
    x, label = data
    names = sorted(set(label))
    model, path = MD.fit_classifier(frame(spark, x, label), "label", "logistic_regression", newton=True), scratch_path(spark, "softmax")
    model.write().overwrite().save(path)
    got = PipelineModel.load(path).transform(frame(spark, x, label)).select("features", vector_to_array("rawPrediction").alias("s"), "predicted_label").collect()
    want = dense(x, np.searchsorted(names, label), weights(label), 1.0, 3)
    for r in got:
        scores = want @ np.append(r.features.toArray(), 1.0)
        assert np.abs(np.array(r.s) - scores).max() < 1e-4 and r.predicted_label == names[scores.argmax()]


def test_few_passes_with_rare_terms(spark, data, monkeypatch):
    x, label = data
    x = np.hstack([x, (np.arange(len(x))[:, None] == np.arange(0, len(x), 2)) * 1.0])  # 130 terms of one row each
    passes = []
    added = LR._added
    monkeypatch.setattr(LR, "_added", lambda *a: passes.append(1) or added(*a))
    found = MD.fit_classifier(frame(spark, x, label), "label", "logistic_regression", newton=True)
    assert len(passes) < 60
    spark_ml = MD.fit_classifier(frame(spark, x, label), "label", "logistic_regression").stages[0]
    names, s = sorted(set(label)), weights(label)

    def objective(w):
        z = np.hstack([x, np.ones((len(x), 1))]) @ w.T
        return 0.5 * (w[:, :-1] ** 2).sum() + (s * (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(x)), np.searchsorted(names, label)])).sum()

    ours = objective(np.array(found.stages[0].getOrDefault("weights")).reshape(3, -1))
    theirs = objective(np.hstack([spark_ml.coefficientMatrix.toArray(), spark_ml.interceptVector.toArray()[:, None]]))
    best = objective(dense(x, np.searchsorted(names, label), s, 1.0, 3))
    assert best <= ours * (1 + 1e-9) and ours - best < 1e-4 * best and ours <= theirs + 1e-9


def test_one_class(spark):
    df = spark.createDataFrame([("a", Vectors.dense([1.0, 2.0])), ("a", Vectors.dense([0.0, 1.0]))], ["label", "features"])
    model = MD.fit_classifier(df, "label", "logistic_regression", newton=True)
    assert {r.predicted_label for r in model.transform(df).collect()} == {"a"}


def test_steps_solve_their_systems(monkeypatch):
    monkeypatch.setattr(NT, "FORCING", 1e-8)
    rng = np.random.default_rng(1)
    search, count = NT.Newton(), []
    half = rng.normal(size=(2, 40, 40)) * np.geomspace(1, 30, 40)
    for _ in range(2):
        half += 0.001 * rng.normal(size=half.shape)
        bend = np.einsum("kij,kil->kjl", half, half) + np.eye(40)
        grad = np.vstack([rng.normal(size=(2, 40)), np.zeros(40)])
        grad[1] *= 1e-6
        bend = np.concatenate([bend, np.eye(40)[None]])
        before = len(count)
        step = search.step(lambda v, which: count.append(len(which)) or np.einsum("kij,kj->ki", bend[which], v), grad, np.stack([np.diag(b) for b in bend]), 1e-5)
        assert np.abs(np.einsum("kij,kj->ki", bend[:1], step[:1]) + grad[:1]).max() < 1e-4
        assert not step[1:].any() and set(count) == {1}  # small already, or zero
        assert search.pairs and len(search.pairs) <= NT.PAIRS
    assert len(count) - before < before  # the pairs of the first step help the second
