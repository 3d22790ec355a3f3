"""Behaviours the reference's own API tests assert, as table tests."""

import datetime as dt

from pyspark.sql import functions as F

from jobtext import taxonomy as tx
from jobtext.functions.text import fingerprint
from jobtext.operators import history as H
from jobtext.operators import validate as V
from jobtext.operators import windows as W

T0 = dt.datetime(2024, 1, 1, 12)


def test_same_text_twice_is_cached(spark):
    df = spark.createDataFrame([(1, "Python developer with FastAPI", T0),
                                (2, "Python developer with FastAPI", T0 + dt.timedelta(seconds=5))],
                               "seq long, text string, ts timestamp_ntz")
    df = df.withColumn("fp", fingerprint("text", tx.MODEL_VERSION))
    out = W.cache_flags(df, "fp", "ts", "seq", tx.CACHE_TTL_SECONDS).orderBy("seq").collect()
    assert [r["cached"] for r in out] == [False, True]


def test_short_text_rejected_and_batch_of_two(spark):
    df = spark.createDataFrame([(1, "short"), (2, "x" * 12), (3, "y" * 20)], "seq long, text string")
    out = {r["seq"]: (r["accepted"], r["reason"]) for r in V.validate_predict(df).collect()}
    assert out[1] == (False, "too_short") and out[2] == (True, None) and out[3] == (True, None)


def test_match_length_before_strip(spark):
    df = spark.createDataFrame([(1, " " * 10 + "x", "a vacancy text"), (2, " " * 12, "a vacancy text")],
                               "pair_id long, resume_text string, vacancy_text string")
    out = {r["pair_id"]: r for r in V.validate_match(df).collect()}
    assert out[1]["accepted"] and out[1]["resume_clean"] == "x"
    assert not out[2]["accepted"] and out[2]["reason"] == "resume_blank"


def _history(spark):
    rows = [(f"p{i}", "u1" if i < 3 else "u2", "backend", "junior", T0 + dt.timedelta(minutes=i)) for i in range(4)]
    return spark.createDataFrame(rows, "id string, user_id string, category string, level string, created_at timestamp_ntz")


def test_paging_and_totals(spark):
    h = _history(spark)
    totals = {r["user_id"]: r["total"] for r in H.counts_per_user(h).collect()}
    assert totals == {"u1": 3, "u2": 1}
    page = H.pages(h, limit=2, offset=0).filter(F.col("user_id") == "u1").orderBy("rn").collect()
    assert [r["id"] for r in page] == ["p2", "p1"]
    assert [r["id"] for r in H.user_page(h, "u1", 2, 0).collect()] == ["p2", "p1"]


def test_other_users_items_invisible(spark):
    h = _history(spark)
    req = spark.createDataFrame([("p0", "u1"), ("p0", "u2"), ("p9", "u1")], "id string, user_id string")
    got = [(r["id"], r["user_id"]) for r in H.owned(req, h).collect()]
    assert got == [("p0", "u1")]


def test_feedback_unknown_rejected(spark):
    h = _history(spark)
    fb = spark.createDataFrame([(1, "p0", "u1", "frontend", None, None, T0), (2, "nope", "u1", None, None, None, T0),
                                (3, "p3", "u1", None, None, None, T0)],
                               "seq long, prediction_id string, user_id string, correct_category string, "
                               "correct_level string, comment string, ts timestamp_ntz")
    acc, rej = H.split_feedback(fb, h)
    assert [r["seq"] for r in acc.collect()] == [1]
    assert sorted(r["seq"] for r in rej.collect()) == [2, 3]


def test_second_registration_conflicts(spark):
    df = spark.createDataFrame([(1, "a@x", "u1", T0), (2, "a@x", "u1", T0), (3, "a@x", "u2", T0 + dt.timedelta(seconds=1)), (4, "b@x", "u3", T0)],
                               "attempt_id long, email string, user_id string, ts timestamp_ntz")
    out = {r["attempt_id"]: r["status"] for r in H.register(df).collect()}
    assert out == {1: "created", 2: "conflict", 3: "conflict", 4: "created"}


def test_sinks_roundtrip(spark, tmp_path):
    from jobtext.sources import sinks

    h = _history(spark).withColumn("x", F.lit(1))
    p = str(tmp_path / "hist")
    sinks.append_history(h, p)
    sinks.append_history(h, p)  # a re-run appends the same ids again
    assert sinks.read_history(spark, p).count() == 4
    rep = spark.createDataFrame([("summary", 1, "raw_rows", "3"), ("drop_funnel", 1, "short_text", "-2"), ("drop_funnel", 0, "zz_rows", "-1"), ("missing_categories", 0, "analytics", ""),
                                 ("level_fallback", -9, "B", "9 rows"), ("level_fallback", -1, "A", "1 rows")], "section string, pos long, key string, value string")
    lines = [r["line"] for r in sinks.report_lines(rep).collect()]
    assert lines == ["## summary", "- raw_rows: 3", "## drop_funnel", "- zz_rows: -1", "- short_text: -2", "## missing_categories", "- analytics",
                     "## level_fallback", "- B: 9 rows", "- A: 1 rows"]
