"""Streaming queries: T1, T2 (windows), T3 (interval metrics), T4 (continuous scoring and matching)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtext import taxonomy as tx
from jobtext.functions.text import fingerprint
from jobtext.operators import match as M
from jobtext.operators.history import with_row_ids
from jobtext.operators.skills import extract_skills
from jobtext.operators.validate import validate_predict
from jobtext.plans import standin_sql as S
from jobtext.plans.match_queries import _MATCH_COLS, _MATCH_SQL_BODY, _out, _sql_out
from jobtext.plans.registry import query
from jobtext.plans.window_queries import _FP_SQL, _VALID, _fold_sql
from jobtext.session import materialize, scratch_path
from jobtext.sources import standins
from jobtext.sources.sinks import append_history, read_history
from jobtext.streaming import stream as ST

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
DOCS_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@query("metrics_tumbling", sql="""SELECT make_timestamp(epoch_us(ts) // 5000000 * 5000000) AS window_start, event_type,
  count(*) AS events, round(sum(value), 6) AS value_sum FROM events GROUP BY 1, 2""")
def q_metrics_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a stream, 5 s tumbling windows per event type under a watermark."""
    out = ST.tumbling_metrics(spark, sf_dir, "events.parquet", EVENTS_SCHEMA)
    return out.select("window_start", "event_type", "events", F.round("value_sum", 6).alias("value_sum"))


@query("stream_score")
def q_stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 + S8 + S10 + S11: documents arrive as a request stream; each
    micro-batch is scored with the trained models and appended to history
    with deterministic ids."""
    from jobtext.plans.ml_queries import trained

    models = trained(spark, sf_dir)

    def score_batch(batch: DataFrame) -> DataFrame:
        req = batch.select(F.col("doc_id").alias("seq"), F.col("source").alias("user_id"), "text",
                           F.expr("timestampadd(SECOND, doc_id, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("ts"))
        scored = extract_skills(models.score(req), "text", "skills")
        return with_row_ids(scored).select(
            "id", "user_id", F.col("text").alias("input_text"), "category", "level", "skills", "confidence",
            F.lit(False).alias("cached"), "model_version", F.col("ts").alias("created_at"))

    return ST.continuous_scoring(spark, sf_dir, "documents.parquet", DOCS_SCHEMA, score_batch)


#: Rows may arrive this much out of order.
DELAY_SECONDS = 600


def _day_cuts(col: str) -> list:
    """The stand-in log arrives in four parts, by time."""
    return [F.col(col) < F.expr(f"TIMESTAMP_NTZ'2024-01-{d:02d} 00:00:00'") for d in (8, 15, 22)]


def _arriving(spark: SparkSession, rows: DataFrame, cuts: list) -> ST.Arriving:
    """``rows`` as a stream that arrives in parts."""
    return ST.Arriving(spark, standins.arrivals(rows, cuts), scratch_path(spark, "requests"))


def _run(job: ST.AnchoredStream, requests: ST.Arriving, prepare=lambda rows: rows) -> tuple[DataFrame, DataFrame]:
    """The windows of all parts, and the late rows."""
    rows = prepare(requests.stream)
    requests.each(lambda: job.advance(rows))
    job.finish(rows)
    return job.read()


@query("rate_limit_stream", sql=_fold_sql("user_id", tx.RATE_LIMIT_WINDOW_SECONDS) + f"""SELECT e.seq, e.user_id,
  make_timestamp(r.a) AS window_start, CAST(r.n AS BIGINT) AS n, r.n <= {tx.RATE_LIMIT_REQUESTS} AS allowed
FROM r JOIN ev e ON e.key = r.key AND e.rn = r.rn""")
def q_rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 as a stream that arrives in parts: windows carried across micro-batches, late requests (none here) beside."""
    req = standins.predict_requests(spark, sf_dir).select("seq", "user_id", "ts")
    job = ST.AnchoredStream(spark, scratch_path(spark, "rate-limit"), "user_id", "ts", "seq", tx.RATE_LIMIT_WINDOW_SECONDS, DELAY_SECONDS)
    out, late = _run(job, _arriving(spark, req, _day_cuts("ts")))
    rows = out.select("seq", "user_id", "window_start", "n").unionByName(late.select("seq", "user_id"), allowMissingColumns=True)
    return rows.withColumn("allowed", F.col("n") <= tx.RATE_LIMIT_REQUESTS)


@query("cache_flags_stream", sql=_fold_sql(_FP_SQL, tx.CACHE_TTL_SECONDS).replace(
    "FROM predict_requests))", f"FROM predict_requests WHERE {_VALID}))", 1) + """SELECT e.seq, e.key AS fingerprint,
  make_timestamp(r.a) AS window_start, CAST(r.n AS BIGINT) AS n, r.n > 1 AS cached
FROM r JOIN ev e ON e.key = r.key AND e.rn = r.rn""")
def q_cache_flags_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 as a stream that arrives in parts: requests are validated and
    fingerprinted as they arrive, cache windows carried across micro-batches,
    late requests (none here) beside."""
    req = _arriving(spark, standins.predict_requests(spark, sf_dir).select("seq", "text", "ts"), _day_cuts("ts"))
    job = ST.AnchoredStream(spark, scratch_path(spark, "cache-flags"), "fingerprint", "ts", "seq", tx.CACHE_TTL_SECONDS, DELAY_SECONDS)
    out, late = _run(job, req, lambda rows: _valid(rows).drop("text"))
    rows = out.select("seq", "fingerprint", "window_start", "n").unionByName(late.select("seq", "fingerprint"), allowMissingColumns=True)
    return rows.withColumn("cached", F.col("n") > 1)


def _valid(requests: DataFrame) -> DataFrame:
    """Accepted requests with their fingerprint."""
    ok = validate_predict(requests).filter("accepted")
    return ok.select(*requests.columns, fingerprint("text", tx.MODEL_VERSION).alias("fingerprint"))


@query("predict_stream", sql=_fold_sql(_FP_SQL, tx.CACHE_TTL_SECONDS).replace(
    "FROM predict_requests))", f"FROM predict_requests WHERE {_VALID}))", 1) + f""",
labels AS (SELECT doc_id, lang AS category, {S.LEVEL_OF_LENGTH} AS level, {S.DEC_CONFIDENCE} AS confidence FROM documents)
SELECT e.seq, e.user_id, e.key AS fingerprint, l.category, l.level, CAST(l.confidence AS DOUBLE) AS confidence, r.n > 1 AS cached, e.ts AS created_at
FROM r JOIN ev e ON e.key = r.key AND e.rn = r.rn JOIN r o ON o.key = r.key AND o.a = r.a AND o.n = 1
JOIN labels l ON l.doc_id = o.seq % (SELECT max(doc_id) + 1 FROM documents)""")
def q_predict_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2 (T1 + T4 + S8) as one stream: validate, fingerprint, cache hit or
    score, history; the scorer is the given labels of the request's document."""
    given = standins.labelled_texts(spark, sf_dir).drop("text")

    def score(rows: DataFrame) -> DataFrame:
        return rows.join(given, "text_id").drop("text_id").withColumn("confidence", F.col("confidence").cast("double"))

    req = standins.predict_requests(spark, sf_dir).withColumn("text_id", F.pmod("seq", standins.doc_count(spark, sf_dir).scalar()))
    req = _valid(req).drop("text").withColumnRenamed("ts", "created_at")
    history = scratch_path(spark, "prediction-history")
    job = ST.AnchoredStream(spark, scratch_path(spark, "predict"), "fingerprint", "created_at", "seq", tx.CACHE_TTL_SECONDS, DELAY_SECONDS)
    ST.predict_stream(job, _arriving(spark, req, _day_cuts("created_at")), score, history)
    return read_history(spark, history).select("seq", "user_id", "fingerprint", "category", "level", "confidence", "cached", "created_at")


_BUCKET_SQL = ", ".join(f"count(*) FILTER (WHERE NOT cached AND confidence <= {b})" for b in tx.HISTOGRAM_BOUNDS)


@query("service_metrics_stream", sql=S.with_(S.PREDICTION_HISTORY) + f"""SELECT make_timestamp(epoch_us(created_at) // 5000000 * 5000000) AS window_start,
  category, level, count(*) FILTER (WHERE cached) AS hits, count(*) FILTER (WHERE NOT cached) AS misses,
  array_to_string([{_BUCKET_SQL}], ',') AS buckets, round(sum(confidence) FILTER (WHERE NOT cached), 6) AS confidence_sum
FROM prediction_history GROUP BY 1, 2, 3""")
def q_service_metrics_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prediction history as a stream: hits, misses, predictions per
    class and confidence buckets of every 5 s interval."""
    rows = standins.prediction_history(spark, sf_dir)
    arriving = _arriving(spark, rows, _day_cuts("created_at"))
    agg = ST.service_metrics(arriving.stream, tx.HISTOGRAM_BOUNDS)
    sink, checkpoint = scratch_path(spark, "service-metrics"), scratch_path(spark, "service-metrics-ckpt")
    arriving.each(lambda: ST.run_available(agg, sink, checkpoint, "update"))
    out = ST.latest_per_key(spark.read.parquet(sink), ["window_start", "category", "level"])
    return out.select("window_start", "category", "level", "hits", "misses",
                      F.array_join(F.transform("buckets", lambda n: n.cast("string")), ",").alias("buckets"), F.round("confidence_sum", 6).alias("confidence_sum"))


@query("match_stream", sql=_MATCH_SQL_BODY + f"SELECT {_sql_out(_MATCH_COLS)} FROM x")
def q_match_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 + S9 + S11: match requests arrive as a stream in parts; each
    micro-batch is analysed, scored and written to the match history, which is
    read back."""
    texts = standins.labelled_texts(spark, sf_dir).select("text_id", "category", "level", "confidence")
    req = standins.match_requests(spark, sf_dir)
    rows = _arriving(spark, req, [F.col("pair_id") % 3 == 0, F.col("pair_id") % 3 == 1])
    history = scratch_path(spark, "match-history")

    def score(batch: DataFrame, batch_id: int) -> None:
        sides = [batch.select(F.col(f"{s}_id").alias("text_id"), F.col(f"{s}_text").alias("text")) for s in ("resume", "vacancy")]
        given = sides[0].unionByName(sides[1]).dropDuplicates(["text_id"]).join(texts, "text_id")
        pairs = batch.select("pair_id", "user_id", "resume_id", "vacancy_id", "created_at")
        scored = M.match_pairs(pairs, materialize(M.analyse_texts(given, standins.CORPUS_SKILLS)))
        append_history(scored, history)

    checkpoint = scratch_path(spark, "match-ckpt")
    rows.each(lambda: ST.run_available(rows.stream, score, checkpoint, "append"))
    return _out(read_history(spark, history), _MATCH_COLS)
