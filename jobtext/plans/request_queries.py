"""Request-side queries: P1–P3, F18, F20, F21, A14–A16."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtext import taxonomy as tx
from jobtext.functions.scoring import argmax_index, softmax, top_confidence
from jobtext.functions.text import fingerprint
from jobtext.operators import metrics as MX
from jobtext.operators import validate as V
from jobtext.operators import windows as W
from jobtext.plans import standin_sql as S
from jobtext.plans.registry import query
from jobtext.plans.window_queries import _FP_SQL, _fold_sql
from jobtext.sources import standins
from jobtext.sources.tables import read

SPACE = S.SPACE_CHARS


def _len_reason_sql(x: str, prefix: str = "") -> str:
    return (f"CASE WHEN {x} IS NULL THEN '{prefix}missing' WHEN length({x}) < {tx.MIN_REQUEST_LENGTH} THEN '{prefix}too_short' "
            f"WHEN length({x}) > {tx.MAX_REQUEST_LENGTH} THEN '{prefix}too_long' END")


@query("validate_predict", sql=S.with_(S.PREDICT_REQUESTS) + f"""SELECT seq, {_len_reason_sql('text')} AS reason,
  ({_len_reason_sql('text')}) IS NULL AS accepted FROM predict_requests""")
def q_validate_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction requests accepted (10..10,000 characters) or rejected with a reason."""
    return V.validate_predict(standins.predict_requests(spark, sf_dir)).select("seq", "reason", "accepted")


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


_MATCH_REASON = (f"coalesce({_len_reason_sql('resume_text', 'resume_')}, CASE WHEN {_strip_sql('resume_text')} = '' THEN 'resume_blank' END, "
                 f"{_len_reason_sql('vacancy_text', 'vacancy_')}, CASE WHEN {_strip_sql('vacancy_text')} = '' THEN 'vacancy_blank' END)")


@query("validate_match", sql=S.with_(S.MATCH_REQUESTS) + f"""SELECT pair_id, length({_strip_sql('resume_text')}) AS resume_len,
  length({_strip_sql('vacancy_text')}) AS vacancy_len, {_MATCH_REASON} AS reason, ({_MATCH_REASON}) IS NULL AS accepted
FROM match_requests""")
def q_validate_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match requests: raw length 10..10,000 per side, then stripped and non-empty."""
    v = V.validate_match(standins.match_requests(spark, sf_dir))
    return v.select("pair_id", F.length("resume_clean").alias("resume_len"), F.length("vacancy_clean").alias("vacancy_len"),
                    "reason", "accepted")


FEEDBACK_INPUT_SQL = """fb_in AS (
  SELECT event_id AS seq,
         CASE WHEN event_id % 10 = 0 THEN 'not-a-uuid-' || CAST(event_id AS VARCHAR)
              ELSE substr(md5(CAST(event_id AS VARCHAR)), 1, 8) || '-' || substr(md5(CAST(event_id AS VARCHAR)), 9, 4) || '-'
                || substr(md5(CAST(event_id AS VARCHAR)), 13, 4) || '-' || substr(md5(CAST(event_id AS VARCHAR)), 17, 4) || '-'
                || substr(md5(CAST(event_id AS VARCHAR)), 21, 12) END AS prediction_id,
         (['backend', 'frontend', 'data_science', 'analytics', 'marketing'])[event_id % 5 + 1] AS correct_category,
         CASE WHEN event_id % 3 <> 0 THEN (['intern', 'junior', 'middle', 'senior', 'lead'])[event_id % 5 + 1] END AS correct_level,
         CASE WHEN event_id % 4 <> 0 THEN repeat('x', CAST(floor(value * 30) AS INTEGER)) END AS comment
  FROM events WHERE event_type = 'click')"""


def feedback_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in feedback payloads (some ids malformed, some values outside the domains)."""
    e = read(spark, sf_dir, "events", "event_id", "event_type", "value").filter(F.col("event_type") == "click")
    i = F.col("event_id")
    h = F.md5(i.cast("string"))
    uuid_like = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                            F.substring(h, 17, 4), F.substring(h, 21, 12))
    cats = F.array(*[F.lit(c) for c in ["backend", "frontend", "data_science", "analytics", "marketing"]])
    lvls = F.array(*[F.lit(c) for c in ["intern", "junior", "middle", "senior", "lead"]])
    return e.select(
        i.alias("seq"),
        F.when(i % 10 == 0, F.concat(F.lit("not-a-uuid-"), i.cast("string"))).otherwise(uuid_like).alias("prediction_id"),
        F.element_at(cats, (i % 5 + 1).cast("int")).alias("correct_category"),
        F.when(i % 3 != 0, F.element_at(lvls, (i % 5 + 1).cast("int"))).alias("correct_level"),
        F.when(i % 4 != 0, F.repeat(F.lit("x"), F.floor(F.col("value") * 30).cast("int"))).alias("comment"),
    )


_FB_REASON = f"""CASE WHEN NOT regexp_matches(regexp_replace(regexp_replace(regexp_replace(prediction_id, 'urn:|uuid:', '', 'g'),
      '^\\{{+|\\}}+$', '', 'g'), '-', '', 'g'), '^[0-9a-fA-F]{{32}}$') THEN 'bad_prediction_id'
  WHEN correct_category IS NOT NULL AND correct_category NOT IN ({', '.join(f"'{c}'" for c in tx.CATEGORIES)}) THEN 'bad_category'
  WHEN correct_level IS NOT NULL AND correct_level NOT IN ({', '.join(f"'{c}'" for c in tx.LEVELS)}) THEN 'bad_level'
  WHEN length(comment) > {tx.MAX_COMMENT_LENGTH} THEN 'comment_too_long' END"""


@query("validate_feedback", sql=S.with_(FEEDBACK_INPUT_SQL) + f"SELECT seq, {_FB_REASON} AS reason, ({_FB_REASON}) IS NULL AS accepted FROM fb_in")
def q_validate_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3 + F21: feedback payload checks (UUID id, category/level domains, comment length)."""
    return V.validate_feedback(feedback_input(spark, sf_dir)).select("seq", "reason", "accepted")


@query("fingerprint", sql=S.with_(S.PREDICT_REQUESTS) + f"SELECT seq, {_FP_SQL} AS fingerprint FROM predict_requests")
def q_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cache fingerprint (sha-256 of version and normalised text) per request."""
    req = standins.predict_requests(spark, sf_dir)
    return req.select("seq", fingerprint("text", tx.MODEL_VERSION).alias("fingerprint"))


@query("softmax_scores", sql="""SELECT vec_id, list_position(e, list_max(e)) - 1 AS best_index,
  round(1.0 / list_reduce(list_transform(e, lambda v: exp(v - list_max(e))), lambda a, b: a + b), 4) AS confidence
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)""")
def q_softmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F20 + O6: softmax of decision-score vectors; first arg-max and its probability."""
    e = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    x = F.transform("embedding", lambda v: v.cast("double"))
    return e.select("vec_id", argmax_index(x).cast("int").alias("best_index"), top_confidence(x).alias("confidence"))


@query("softmax_vectors", sql="""SELECT vec_id, CAST(i AS INTEGER) AS class_index, round(exp(e[i + 1] - list_max(e)) / list_sum(list_transform(e, lambda v: exp(v - list_max(e)))), 6) AS probability
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, unnest(range(len(embedding))) AS i FROM embeddings)""")
def q_softmax_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the whole softmax vector of every score vector."""
    e = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return e.select("vec_id", F.posexplode(softmax(F.col("embedding"))).alias("class_index", "p")).select("vec_id", "class_index", F.round("p", 6).alias("probability"))


@query("validate_scores", sql="""SELECT event_id, CASE WHEN value IS NULL THEN 'confidence_missing' WHEN NOT (value / 50 BETWEEN 0 AND 1) THEN 'confidence_out_of_range' END AS reason,
  coalesce(value / 50 BETWEEN 0 AND 1, false) AS accepted FROM events""")
def q_validate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores outside [0, 1] are rejected."""
    e = read(spark, sf_dir, "events", "event_id", "value").withColumn("confidence", F.col("value") / 50)
    return V.validate_scores(e, "confidence").select("event_id", "reason", "accepted")


@query("prediction_counts", sql=S.with_(S.PREDICTION_HISTORY) + """SELECT category, level, count(*) AS n
FROM prediction_history WHERE NOT cached GROUP BY category, level""")
def q_prediction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions per (category, level), cache hits excluded."""
    return MX.prediction_counts(standins.prediction_history(spark, sf_dir))


_CACHE_SQL = _fold_sql(_FP_SQL, tx.CACHE_TTL_SECONDS).replace(
    "FROM predict_requests))", f"FROM predict_requests WHERE ({_len_reason_sql('text')}) IS NULL))", 1)


@query("cache_stats", sql=_CACHE_SQL + f"""SELECT count(*) FILTER (WHERE n > 1) AS hits, count(*) FILTER (WHERE n = 1) AS misses,
  round(count(*) FILTER (WHERE n > 1) / count(*), 4) AS hit_ratio,
  (SELECT count(*) FROM predict_requests WHERE ({_len_reason_sql('text')}) IS NOT NULL) AS rejected FROM r""")
def q_cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache hits, misses and hit ratio of the accepted requests; rejected requests counted."""
    v = V.validate_predict(standins.predict_requests(spark, sf_dir))
    ok = v.filter("accepted").withColumn("fingerprint", fingerprint("text", tx.MODEL_VERSION))
    flagged = W.cache_flags(ok.select("seq", "fingerprint", "ts"), "fingerprint", "ts", "seq", tx.CACHE_TTL_SECONDS)
    return MX.cache_stats(flagged, v.filter(~F.col("accepted")))


_BUCKETS_SQL = " UNION ALL ".join(
    f"SELECT '{MX.bound_label(b)}' AS le, count(*) FILTER (WHERE confidence <= {b}) AS cumulative FROM h"
    for b in tx.HISTOGRAM_BOUNDS) + " UNION ALL SELECT '+Inf', count(confidence) FROM h"


@query("confidence_histogram", sql=S.with_(S.PREDICTION_HISTORY, "h AS (SELECT confidence FROM prediction_history WHERE NOT cached)")
       + f"""SELECT le, CAST(cumulative AS BIGINT) AS cumulative, (SELECT count(confidence) FROM h) AS total_count,
  round((SELECT sum(confidence) FROM h), 6) AS total_sum FROM ({_BUCKETS_SQL})""")
def q_confidence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative confidence histogram of predictions (library-default bounds)."""
    h = standins.prediction_history(spark, sf_dir).filter(~F.col("cached"))
    return MX.histogram(h, "confidence")
