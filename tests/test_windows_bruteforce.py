"""Anchored windows against a plain sequential fold, with a hot key."""

import datetime as dt
import random

from jobtext.operators import windows as W


def fold(events, length_s):
    out, state = {}, {}
    for key, t, i in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        a, n = state.get(key, (None, 0))
        if a is None or t >= a + dt.timedelta(seconds=length_s):
            a, n = t, 0
        n += 1
        state[key] = (a, n)
        out[i] = (a, n)
    return out


def test_random_with_hot_key(spark):
    rnd = random.Random(7)
    t0 = dt.datetime(2024, 1, 1)
    events = []
    for i in range(3000):
        key = "hot" if rnd.random() < 0.4 else f"k{rnd.randrange(40)}"
        events.append((key, t0 + dt.timedelta(seconds=rnd.randrange(0, 4000), microseconds=rnd.randrange(0, 3) * 10), i))
    df = spark.createDataFrame(events, "key string, ts timestamp_ntz, id long")
    got = {r["id"]: (r["window_start"], r["n"]) for r in W.anchored_windows(df, "key", "ts", "id", 60).collect()}
    assert got == fold(events, 60)


def test_ties_and_single_events(spark):
    t0 = dt.datetime(2024, 1, 1)
    events = [("a", t0, 3), ("a", t0, 1), ("a", t0 + dt.timedelta(seconds=60), 2), ("b", t0, 9)]
    df = spark.createDataFrame(events, "key string, ts timestamp_ntz, id long")
    got = {r["id"]: (r["window_start"], r["n"]) for r in W.anchored_windows(df, "key", "ts", "id", 60).collect()}
    assert got == fold(events, 60)
