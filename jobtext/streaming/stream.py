"""T1–T4, S8, S9, S11 — Structured Streaming jobs.

Sources are file streams over request tables; sinks are Parquet folders in the
shared checkpoint location, written from ``foreachBatch`` so every micro-batch
lands in its own ``batch_id=`` folder (overwritten on replay, hence idempotent
after a failure).  Aggregates run in update mode with a watermark, so state
holds only windows still open; the final value of a window is its latest
update.
"""

from __future__ import annotations

from collections.abc import Callable
from fnmatch import fnmatch

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from jobtext.operators.windows import EPOCH, micros
from jobtext.session import materialize, scratch_path
from jobtext.sources.sinks import append_history, read_days, read_history

#: A time that no row reaches (the year 9000), in microseconds.
LAST_TICK = 221_845_392_000_000_000


def _batch_writer(path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite") \
            .parquet(f"{path}/batch_id={batch_id}")
    return write


def run_available(stream: DataFrame, sink: str | Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Process everything available now, then stop (a bounded run of a stream)."""
    q = (stream.writeStream.outputMode(mode).foreachBatch(_batch_writer(sink) if isinstance(sink, str) else sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def latest_per_key(sink_df: DataFrame, keys: list[str]) -> DataFrame:
    """Final value of each key of an update-mode sink: its row from the last batch."""
    w = Window.partitionBy(*keys).orderBy(F.col("batch_id").desc())
    return sink_df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "batch_id")


def file_stream(spark: SparkSession, folder: str, file_glob: str, schema: str, max_bytes: int | None = None) -> DataFrame:
    """A file stream over what matches ``file_glob`` in ``folder``: files, or
    tables that are folders of part files; ``max_bytes`` (64 GiB, say) is what a
    micro-batch takes in, all by default."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxBytesPerTrigger", max_bytes) if max_bytes else reader
    files = spark.read.schema(schema).parquet(f"{folder}/{file_glob}").inputFiles()
    if files and fnmatch(files[0].rsplit("/", 2)[-2], file_glob):
        return reader.parquet(f"{folder}/{file_glob}")
    return reader.option("pathGlobFilter", file_glob).parquet(folder)


class Arriving:
    """Rows that arrive part by part in a folder, each part as the files its
    tasks write; ``step`` runs a stream job on what is there after each part."""

    def __init__(self, spark: SparkSession, parts: list[DataFrame], folder: str):
        self.spark, self.parts, self.folder = spark, parts, folder
        parts[0].limit(0).write.parquet(folder)
        self.stream = spark.readStream.schema(parts[0].schema).parquet(folder)

    def each(self, step: Callable[[], None]) -> None:
        for part in self.parts:
            part.write.mode("append").parquet(self.folder)
            step()


def tumbling_metrics(spark: SparkSession, folder: str, file_glob: str, schema: str, width: str = "5 seconds",
                     watermark: str = "1 minute") -> DataFrame:
    """Per tumbling window and event type: events and summed value."""
    src = file_stream(spark, folder, file_glob, schema)
    ev = src.withColumn("ts_l", F.col("ts").cast("timestamp")).withWatermark("ts_l", watermark)
    agg = ev.groupBy(F.window("ts_l", width).alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("events"), F.sum("value").alias("value_sum"))
    out = agg.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", "value_sum")
    sink, ckpt = scratch_path(spark, "metrics-sink"), scratch_path(spark, "metrics-ckpt")
    run_available(out, sink, ckpt, "update")
    return latest_per_key(spark.read.parquet(sink), ["window_start", "event_type"])


def service_metrics(history: DataFrame, bounds: list[float], width: str = "5 seconds", watermark: str = "1 minute") -> DataFrame:
    """Per tumbling window and (category, level) of a prediction-history
    stream: cache hits, misses (= predictions) and, over the predictions, the
    cumulative confidence buckets and the sum of confidences."""
    ev = history.withColumn("ts_l", F.col("created_at").cast("timestamp")).withWatermark("ts_l", watermark)
    fresh = F.when(~F.col("cached"), F.col("confidence"))
    agg = ev.groupBy(F.window("ts_l", width).alias("w"), "category", "level").agg(
        F.count_if("cached").alias("hits"), F.count_if(~F.col("cached")).alias("misses"),
        F.array(*[F.count_if(fresh <= b) for b in bounds]).alias("buckets"), F.sum(fresh).alias("confidence_sum"))
    return agg.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "category", "level", "hits", "misses", "buckets", "confidence_sum")


def continuous_scoring(spark: SparkSession, folder: str, file_glob: str, schema: str, score_batch) -> DataFrame:
    """T4 + S8 + S11: a request stream scored batch by batch into the history
    table; ``score_batch(df) -> df`` is the batch scorer (models loaded once)."""
    src = file_stream(spark, folder, file_glob, schema)
    history, ckpt = scratch_path(spark, "history"), scratch_path(spark, "history-ckpt")
    q = (src.writeStream.foreachBatch(lambda batch, _: append_history(score_batch(batch), history))
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return read_history(spark, history)


#: Groups that keys are dealt into by their digest. The engine calls Python for each group, not for
#: each key, and a group's state goes over once a micro-batch. The number is part of a checkpoint.
GROUPS = 2048


class _Anchored(StatefulProcessor):
    """State of a group of keys: their open windows (start, count), the rows
    that must wait, and the next timer. A timer at the earliest row settles all
    that have become complete; one at the first window's end clears it.

    Rows are (_key, _t, the events' columns)."""

    def __init__(self, schema: StructType, id_at: int, length_us: int, delay_us: int):
        self.schema, self.id_at, self.length, self.delay = schema, id_at, length_us, delay_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.row = handle, Row(*self.schema.names[2:], "_w", "n", "late")
        self.window = handle.getListState("window", "key string, start long, n long")
        self.waiting = handle.getListState("waiting", self.schema)
        self.timer = handle.getValueState("timer", "due long")

    def handleInputRows(self, key, rows, timerValues):
        mark, fresh = timerValues.getCurrentWatermarkInMs(), []
        for row in rows:
            tick, *row = tuple(row)[-len(self.schema) - 1 :]
            if tick:
                continue
            if row[0] is None:
                yield self.row(*row[2:], None, None, False)
            elif row[1] < mark * 1000:
                yield self.row(*row[2:], None, None, True)
            else:
                fresh.append(tuple(row))
        if fresh:
            # the next watermark is at least the delay behind the last of these rows (to the millisecond), so
            # a later row that precedes what lies behind that is late: it can be settled in this micro-batch
            passed = max(r[1] for r in fresh) // 1000 * 1000 - self.delay
            yield from self._settle(max(mark * 1000, passed), mark, fresh)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs()
        yield from self._settle(mark * 1000, mark, [])

    def _settle(self, until: int, mark: int, fresh: list):
        """Count the rows before ``until``; keep the others, the windows that are open then, and a timer."""
        held, windows = [tuple(r) for r in self.waiting.get()], [tuple(w) for w in self.window.get()]
        rows, open_ = held + fresh, {k: (start, n) for k, start, n in windows}
        for row in sorted((r for r in rows if r[1] < until), key=lambda r: (r[1], r[self.id_at] is not None, r[self.id_at])):
            start, n = open_.get(row[0], (None, 0))
            start, n = (start, n + 1) if start is not None and row[1] < start + self.length else (row[1], 1)
            open_[row[0]] = start, n
            yield self.row(*row[2:], start, n, False)
        rest = [r for r in rows if r[1] >= until]
        still = [(k, start, n) for k, (start, n) in open_.items() if start + self.length > until]
        for state, before, now in ((self.waiting, held, rest), (self.window, windows, still)):
            if now != before:
                state.put(now) if now else state.clear()
        timer = self.timer.get()
        timer = timer[0] if timer and timer[0] > mark else None  # one that the watermark has passed is gone
        due = min([r[1] for r in rest] + [start + self.length for _, start, _ in still], default=None)
        if due is None:
            self.timer.clear()
        elif timer is None or due // 1000 + 1 < timer:
            self.handle.registerTimer(due // 1000 + 1)
            self.timer.update((due // 1000 + 1,))

    def close(self) -> None:
        pass


class AnchoredStream:
    """T1/T2 on a stream, on the engine's watermark, state store and timers.

    A row waits until the watermark (the greatest time seen less the delay) has
    passed it, or is sure to when the micro-batch ends, and is then counted in
    order of time and id, so the result does not depend on how rows are dealt
    into files and equals the batch operator's. A row that comes behind the
    watermark of an earlier micro-batch would change results that are already
    written: it is returned as late. Rows without key or time are returned at
    once with null windows. Keys are told apart as strings. State is the keys'
    open windows and the rows of the delay; both go when the watermark has
    passed them.

    ``root`` holds the checkpoint, the output and ``ticks``, a second source of
    rows that carry a time alone: one far ahead settles what still waits."""

    #: The store that the stateful operator needs; a micro-batch uploads what it changed, not the whole
    #: state, and executors soon drop the local copies of runs that have ended.
    STORE = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
    }

    def __init__(self, spark: SparkSession, root: str, key_col: str, ts_col: str, id_col: str, length_seconds: int, delay_seconds: int):
        self.spark, self.root, self.length_us, self.delay = spark, root, length_seconds * 1_000_000, delay_seconds
        self.key, self.ts, self.id = key_col, ts_col, id_col

    def windows(self, events: DataFrame) -> DataFrame:
        """The streaming DataFrame: the rows with window_start, n and late."""
        rows = events.withColumn("_t", micros(self.ts)).withColumn("_tick", F.lit(False))
        tick = StructType([StructField("_t", LongType())])
        try:
            ticks = self.spark.readStream.schema(tick).parquet(f"{self.root}/ticks")
        except AnalysisException:  # the first start
            self.spark.createDataFrame([], tick).write.mode("ignore").parquet(f"{self.root}/ticks")
            ticks = self.spark.readStream.schema(tick).parquet(f"{self.root}/ticks")
        rows = rows.unionByName(ticks.withColumn("_tick", F.lit(True)), allowMissingColumns=True)
        rows = rows.withColumn("_ts", F.timestamp_micros("_t")).withWatermark("_ts", f"{self.delay} seconds")
        # the watermark's column ends here, so the engine keeps late rows; rows without key or time are dealt out by id.
        # ticks are left out by the processor: a filter on them would be pushed below the watermark
        known = F.col(self.key).isNotNull() & F.col("_t").isNotNull()
        rows = rows.withColumn("_key", F.when(known, F.col(self.key).cast("string")))
        digest = F.when(known, F.xxhash64("_key")).otherwise(F.xxhash64(F.col(self.id)))
        rows = rows.withColumn("_group", F.pmod(digest, F.lit(GROUPS))).select("_group", "_tick", "_key", "_t", *events.columns)
        kept = StructType([f for f in rows.schema if f.name not in ("_group", "_tick")])
        out = StructType([*kept.fields[2:], StructField("_w", LongType()), StructField("n", LongType()), StructField("late", BooleanType())])
        work = _Anchored(kept, 2 + events.columns.index(self.id), self.length_us, self.delay * 1_000_000)
        done = rows.groupBy("_group").transformWithState(work, out, "Append", "EventTime")
        return done.select(*events.columns, F.expr(f"timestampadd(MICROSECOND, _w, {EPOCH})").alias("window_start"), "n", "late")

    def advance(self, events: DataFrame, write: Callable[[DataFrame, int], None] | None = None) -> None:
        """Process everything that is available; a later call, also of another
        process after a failure, goes on from the checkpoint. ``write`` gets each
        micro-batch's rows and number in place of the output folder, and must
        bear a repeated batch."""
        conf = self.spark.conf
        before = {name: conf.get(name, None) for name in self.STORE}
        for name, value in self.STORE.items():
            conf.set(name, value)
        try:
            run_available(self.windows(events), write or f"{self.root}/out", f"{self.root}/checkpoint", "append")
        finally:
            for name, value in before.items():
                conf.unset(name) if value is None else conf.set(name, value)

    def finish(self, events: DataFrame, write: Callable[[DataFrame, int], None] | None = None) -> None:
        """Settle what still waits; every row that comes after this is late."""
        self.spark.createDataFrame([(LAST_TICK,)], "_t long").coalesce(1).write.mode("append").parquet(f"{self.root}/ticks")
        self.advance(events, write)

    def read(self) -> tuple[DataFrame, DataFrame]:
        """(rows with window_start and n, late rows) written so far."""
        out = self.spark.read.parquet(f"{self.root}/out").drop("batch_id")
        return out.where(~F.col("late")).drop("late"), out.where("late").drop("late", "window_start", "n")

    def run(self, events: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Process everything available and settle it; see ``read``."""
        self.advance(events)
        self.finish(events)
        return self.read()


def predict_stream(job: AnchoredStream, requests: Arriving, score: Callable[[DataFrame], DataFrame], history: str) -> None:
    """T1 + T4 + S8: requests with their fingerprint (the job's key) become rows
    of the prediction history. The request that opens a cache window is scored;
    the others of the window take its result from the same micro-batch or from
    the history of the day on which the window opened.

    ``score`` adds category, level and confidence; late requests are scored and
    open no window. The history's key is the job's id column."""
    result = ["category", "level", "confidence"]

    def write(batch: DataFrame, _: int) -> None:
        batch = materialize(batch.withColumn("cached", F.coalesce(F.col("n") > 1, F.lit(False))))
        fresh = materialize(score(batch.where(~F.col("cached"))).drop("n"))
        append_history(fresh, history, job.ts, job.id)
        hits = batch.where("cached").drop("n")
        days = [r.dt for r in hits.select(F.to_date("window_start").alias("dt")).distinct().collect()]
        if days:  # the opening requests, those of this batch among them, are in the history now
            opened = read_days(batch.sparkSession, history, days).where(~F.col("cached") & F.col("window_start").isNotNull())
            opened = opened.select(job.key, "window_start", *result)
            append_history(hits.join(opened, [job.key, "window_start"]).select(*fresh.columns), history, job.ts, job.id)

    requests.each(lambda: job.advance(requests.stream, write))
    job.finish(requests.stream, write)
