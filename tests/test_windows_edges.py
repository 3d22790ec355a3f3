"""Anchored windows: string ids, rows without key or time, long sessions."""

import datetime as dt
import random

from jobtext.operators import windows as W
from test_windows_bruteforce import fold

T0 = dt.datetime(2024, 1, 1)


def test_string_ids_and_null_keys(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [("u", at(0), "a1"), ("u", at(59), "b"), ("u", at(60), "c"), (None, at(1), "n1"), ("u", None, "n2"), ("u", at(119), "d"), ("u", at(0), "a0")]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, id string")
    out = {r.id: (r.window_id, r.n) for r in W.anchored_windows(df, "key", "ts", "id", 60).collect()}
    assert out == {"a0": ("a0", 1), "a1": ("a0", 2), "b": ("a0", 3), "c": ("c", 1), "d": ("c", 2), "n1": (None, None), "n2": (None, None)}


def test_one_long_session_across_partitions(spark):
    rng = random.Random(1)
    rows = [("k", T0 + dt.timedelta(seconds=7 * i + rng.randrange(5)), i) for i in range(500)]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, id long").repartition(6)
    got = {r.id: (r.window_start, r.n) for r in W.anchored_windows(df, "key", "ts", "id", 60).collect()}
    assert got == fold(rows, 60)
    assert W.anchored_windows(df.limit(0), "key", "ts", "id", 60).count() == 0
