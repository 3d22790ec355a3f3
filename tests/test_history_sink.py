"""History table: only touched days are read and rewritten, writing again changes nothing."""

import datetime as dt
from pathlib import Path

from jobtext.sources import sinks

SCHEMA = "id string, user_id string, created_at timestamp_ntz, dt_text string"


def rows(days, users="ab", copies=2):
    out = [(f"{d}-{u}-{i}", u, dt.datetime(2024, 3, d, 5, i), "x") for d in days for u in users for i in range(copies)]
    return out + [(f"none-{u}", u, None, "x") for u in users]


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_again_changes_nothing(spark, tmp_path):
    p, every = str(tmp_path / "h"), rows([1, 2, 3])
    for part in (every[:4], every[2:], every):
        sinks.append_history(spark.createDataFrame(part, SCHEMA), p)
    got = sinks.read_history(spark, p)
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame(every, SCHEMA).collect()))


def test_only_touched_days_are_read(spark, tmp_path):
    p = str(tmp_path / "h")
    sinks.append_history(spark.createDataFrame(rows(range(1, 21)), SCHEMA), p)
    for days, want in (([dt.date(2024, 3, 4)], 1), ([dt.date(2024, 3, 4), None], 2), ([], 0)):
        df = sinks.read_days(spark, p, days)
        plan = df.select("id")._jdf.queryExecution().executedPlan().toString()
        assert not days or "PartitionFilters: [" in plan and "user_id" not in plan.split("ReadSchema")[1]
        assert len(df.select("_metadata.file_path").distinct().selectExpr("regexp_extract(file_path, 'dt=([^/]*)', 1) as d").distinct().collect()) == want
    assert sinks.read_days(spark, str(tmp_path / "none"), []) is None


def test_delete_rewrites_touched_days(spark, tmp_path):
    p, every = str(tmp_path / "h"), rows([1, 2]) + rows([3], users="b")[:2] + [("4", "c", dt.datetime(2024, 3, 4), "x")]
    sinks.append_history(spark.createDataFrame(every, SCHEMA), p)
    before = files(p)
    gone = spark.createDataFrame([("a",), ("c",), ("a",), ("zz",)], "user_id string")
    sinks.delete_history(spark, p, gone, "user_id")
    assert sorted(r.id for r in sinks.read_history(spark, p).collect()) == sorted(r[0] for r in every if r[1] == "b")
    after = files(p)
    assert {f for f in before if "dt=2024-03-03" in f} == {f for f in after if "dt=2024-03-03" in f}
    assert not {f for f in before if "dt=2024-03-01" in f} & set(after)
    again = files(p)
    sinks.delete_history(spark, p, gone, "user_id")
    assert files(p) == again
    sinks.append_history(spark.createDataFrame(every, SCHEMA), p)
    assert sinks.read_history(spark, p).count() == len(every)
