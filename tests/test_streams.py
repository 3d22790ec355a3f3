"""Window streams on engine state: stop and resume, failed micro-batches, late rows, cache and scoring in one stream."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from jobtext.operators import windows as W
from jobtext.streaming import stream as ST

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "key string, ts timestamp_ntz, id long, t int"


def events(seed, n=400, keys=5, span=3000):
    rng = random.Random(seed)
    return sorted(((rng.choice("abcde"[:keys]), T0 + dt.timedelta(seconds=t), i, t) for i, t in enumerate(rng.randrange(span) for _ in range(n))), key=lambda r: r[3])


def as_batch(spark, rows):
    out = W.anchored_windows(spark.createDataFrame(rows, SCHEMA), "key", "ts", "id", 60).select("id", "window_start", "n")
    return sorted(map(tuple, out.collect()))


def parts_of(spark, rows, n):
    """``n`` parts whose rows reach up to 100 s into the next."""
    size = len(rows) // n + 1
    rng = random.Random(1)
    late = [r for r in sorted(rows, key=lambda r: r[3] + rng.randrange(100))]
    return [spark.createDataFrame(late[i : i + size], SCHEMA).repartition(2) for i in range(0, len(late), size)]


def test_stop_and_resume(spark, tmp_path):
    """Every part is processed by a stream of its own that goes on from the checkpoint."""
    rows = events(1)
    arriving = ST.Arriving(spark, parts_of(spark, rows, 4), str(tmp_path / "in"))
    jobs = []

    def step():
        jobs.append(ST.AnchoredStream(spark, str(tmp_path / "job"), "key", "ts", "id", 60, 120))
        jobs[-1].advance(arriving.stream)

    arriving.each(step)
    assert len(jobs) == 4
    before = jobs[-1].read()[0].count()
    jobs[-1].finish(arriving.stream)
    out, late = jobs[-1].read()
    assert before < out.count() == len(rows) and late.count() == 0
    assert sorted(map(tuple, out.select("id", "window_start", "n").collect())) == as_batch(spark, rows)


def test_failed_batch_is_done_again(spark, tmp_path):
    rows = events(2, n=200)
    arriving = ST.Arriving(spark, parts_of(spark, rows, 3), str(tmp_path / "in"))
    job = ST.AnchoredStream(spark, str(tmp_path / "job"), "key", "ts", "id", 60, 120)
    write, calls = ST._batch_writer(str(tmp_path / "out")), []

    def fails_once(batch, batch_id):
        calls.append(batch_id)
        write(batch, batch_id)
        if calls.count(batch_id) == 1 and batch_id % 2:
            raise RuntimeError("lost")

    def step(run):
        for _ in range(9):
            try:
                return run(arriving.stream, fails_once)
            except Exception as e:  # the stream ends with the micro-batch
                assert "lost" in str(e)
        raise AssertionError("no progress")

    arriving.each(lambda: step(job.advance))
    step(job.finish)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert len(calls) > len(set(calls))
    assert sorted(map(tuple, out.select("id", "window_start", "n").collect())) == as_batch(spark, rows)


def test_state_is_cleared(spark, tmp_path):
    """Once the watermark has passed everything, no key has state."""
    arriving = ST.Arriving(spark, parts_of(spark, events(3), 2), str(tmp_path / "in"))
    job = ST.AnchoredStream(spark, str(tmp_path / "job"), "key", "ts", "id", 60, 120)
    arriving.each(lambda: job.advance(arriving.stream))
    job.finish(arriving.stream)
    for name in ("window", "waiting"):
        state = spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "job" / "checkpoint"))
        assert state.count() == 0


def test_predictions_from_cache(spark, tmp_path):
    """Hits carry the result of the request that opened their window, across micro-batches; a batch done twice adds nothing."""
    rows = events(4, n=150, keys=3, span=1200)
    arriving = ST.Arriving(spark, parts_of(spark, rows, 3), str(tmp_path / "in"))
    job = ST.AnchoredStream(spark, str(tmp_path / "job"), "key", "ts", "id", 60, 120)
    scored = []

    def score(df):
        scored.append(df.count())
        return df.select("*", F.concat("key", F.lit("-"), "id").alias("category"), F.lit("x").alias("level"), F.lit(0.5).alias("confidence"))

    ST.predict_stream(job, arriving, score, str(tmp_path / "history"))
    got = {r.id: r for r in spark.read.parquet(str(tmp_path / "history")).collect()}
    want = {i: (w, n) for i, w, n in as_batch(spark, rows)}
    opener = {(r[0], want[r[2]][0]): r[2] for r in rows if want[r[2]][1] == 1}
    assert len(got) == len(rows) and sum(scored) == sum(n == 1 for _, n in want.values())
    for key, _, i, _ in rows:
        assert got[i].cached == (want[i][1] > 1) and got[i].category == f"{key}-{opener[key, want[i][0]]}"


def test_late_rows_come_back(spark, tmp_path):
    parts = [spark.createDataFrame([("a", T0 + dt.timedelta(seconds=t), i, t)], SCHEMA) for i, t in enumerate((0, 1000, 500, 2000))]
    arriving = ST.Arriving(spark, parts, str(tmp_path / "in"))
    job = ST.AnchoredStream(spark, str(tmp_path / "job"), "key", "ts", "id", 60, 120)
    arriving.each(lambda: job.advance(arriving.stream))
    job.finish(arriving.stream)
    out, late = job.read()
    assert [r.t for r in late.collect()] == [500] and sorted(r.t for r in out.collect()) == [0, 1000, 2000]


@pytest.mark.parametrize("size", [1, None])
def test_micro_batches_by_bytes(spark, tmp_path, size):
    """A byte limit splits what is there into micro-batches; the result stays."""
    spark.createDataFrame(events(5, n=60), SCHEMA).repartition(3).write.parquet(str(tmp_path / "in"))
    src = ST.file_stream(spark, str(tmp_path / "in"), "*.parquet", SCHEMA, size)
    ST.run_available(src, str(tmp_path / "out"), str(tmp_path / "ckpt"), "append")
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 60 and (out.select("batch_id").distinct().count() > 1) == (size is not None)


def test_state_of_many_keys_is_kept_by_group(spark, tmp_path):
    """More keys than groups: Python is called and state is kept for each group, not for each key."""
    rows = [(f"k{i % 3000}", T0 + dt.timedelta(seconds=i // 3000 * 40), i, 0) for i in range(9000)]
    arriving = ST.Arriving(spark, [spark.createDataFrame(rows[:6000], SCHEMA), spark.createDataFrame(rows[6000:], SCHEMA)], str(tmp_path / "in"))
    job = ST.AnchoredStream(spark, str(tmp_path / "job"), "key", "ts", "id", 60, 120)
    groups = []

    def step():
        job.advance(arriving.stream)
        state = spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "job" / "checkpoint"))
        groups.append(state.select("key").distinct().count())

    arriving.each(step)
    job.finish(arriving.stream)
    assert all(0 < n < 2500 for n in groups)
    out, late = job.read()
    assert late.isEmpty() and sorted(map(tuple, out.select("id", "window_start", "n").collect())) == as_batch(spark, rows)


def test_rows_far_behind_the_last_do_not_wait(spark, tmp_path):
    """Rows that the next watermark is sure to pass are counted in their own micro-batch."""
    rows = [("a", T0 + dt.timedelta(seconds=t), i, t) for i, t in enumerate((0, 30, 70, 500, 600))]
    arriving = ST.Arriving(spark, [spark.createDataFrame(rows, SCHEMA)], str(tmp_path / "in"))
    job = ST.AnchoredStream(spark, str(tmp_path / "job"), "key", "ts", "id", 60, 120)
    first = []
    arriving.each(lambda: job.advance(arriving.stream, lambda batch, number: first.append([(r.t, r.n) for r in batch.orderBy("t").collect()])))
    assert [r for batch in first for r in batch][:3] == [(0, 1), (30, 2), (70, 1)] and first[0] == [(0, 1), (30, 2), (70, 1)]
