"""M5 and M7: the compared SVM has the squared hinge, is saved and loaded; class weights deal no rows by label."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from jobtext.operators import models as MD
from jobtext.session import scratch_path
from test_squared_hinge import dense


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 9)) * (rng.random((150, 9)) < 0.5)
    label = np.where(rng.random(150) < 0.2, "c", np.where(x @ rng.normal(size=9) > 0, "a", "b"))
    data = [(str(k), Vectors.sparse(9, np.flatnonzero(v).tolist(), v[np.flatnonzero(v)].tolist()) if i % 7 else Vectors.dense(v)) for i, (k, v) in enumerate(zip(label, x))]
    return x, label, spark.createDataFrame(data, ["label", "features"]).coalesce(1)


def test_linear_svc_is_squared_hinge(spark, rows):
    x, label, df = rows
    path = scratch_path(spark, "svc")
    MD.fit_classifier(df, "label", "linear_svc").write().overwrite().save(path)
    got = PipelineModel.load(path).transform(df).select(vector_to_array("rawPrediction").alias("s"), "_pred", "predicted_label").collect()
    full, names = np.hstack([x, np.ones((150, 1))]), sorted(set(label))
    s = np.array([150 / (3 * (label == k).sum()) for k in label])
    want = full @ np.stack([dense(full, np.where(label == k, 1.0, -1.0), s, 1.0) for k in names]).T
    found = np.array([r.s for r in got])
    assert np.abs(found - want).max() < 1e-2
    assert [r.predicted_label for r in got] == [names[k] for k in found.argmax(1)] and [r._pred for r in got] == found.argmax(1).tolist()


def test_weights_without_shuffle_of_rows(rows):
    plan = MD.with_class_weights(rows[2], "label")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
