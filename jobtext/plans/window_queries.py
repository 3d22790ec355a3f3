"""Anchored-window queries: T1 (cache flags), T2 (request limits)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobtext import taxonomy as tx
from jobtext.functions.text import fingerprint
from jobtext.operators import windows as W
from jobtext.plans import standin_sql as S
from jobtext.plans.registry import query
from jobtext.sources import standins

SPACE = S.SPACE_CHARS


def _fold_sql(key_expr: str, length_s: int) -> str:
    """Brute-force oracle: the sequential per-key fold as a recursive CTE."""
    L = length_s * 1_000_000
    return S.with_(S.PREDICT_REQUESTS).replace("WITH ", "WITH RECURSIVE ", 1) + f""",
ev AS (SELECT seq, user_id, key, ts, t, row_number() OVER (PARTITION BY key ORDER BY t, seq) AS rn FROM (
  SELECT seq, user_id, {key_expr} AS key, ts, epoch_us(ts) AS t FROM predict_requests)),
r AS (SELECT key, rn, seq, t AS a, 1 AS n FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.key, e.rn, e.seq, CASE WHEN e.t >= r.a + {L} THEN e.t ELSE r.a END,
         CASE WHEN e.t >= r.a + {L} THEN 1 ELSE r.n + 1 END
  FROM r JOIN ev e ON e.key = r.key AND e.rn = r.rn + 1)
"""


_FP_SQL = f"sha256('{tx.MODEL_VERSION}:' || regexp_replace(lower(text), '^[{SPACE}]+|[{SPACE}]+$', '', 'g'))"


_VALID = f"length(text) BETWEEN {tx.MIN_REQUEST_LENGTH} AND {tx.MAX_REQUEST_LENGTH}"


@query("cache_flags", sql=_fold_sql(_FP_SQL, tx.CACHE_TTL_SECONDS).replace(
    "FROM predict_requests))", f"FROM predict_requests WHERE {_VALID}))", 1) + """SELECT e.seq, e.key AS fingerprint,
  make_timestamp(r.a) AS window_start, CAST(r.n AS BIGINT) AS n, r.n > 1 AS cached
FROM r JOIN ev e ON e.key = r.key AND e.rn = r.rn""")
def q_cache_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An accepted request is a cache hit when an earlier miss of the
    same fingerprint opened a 24 h validity window that still covers it."""
    from jobtext.operators.validate import validate_predict

    req = validate_predict(standins.predict_requests(spark, sf_dir)).filter("accepted")
    req = req.withColumn("fingerprint", fingerprint("text", tx.MODEL_VERSION)).select("seq", "fingerprint", "ts")
    out = W.cache_flags(req, "fingerprint", "ts", "seq", tx.CACHE_TTL_SECONDS)
    return out.select("seq", "fingerprint", "window_start", "n", "cached")


@query("rate_limit", sql=_fold_sql("user_id", tx.RATE_LIMIT_WINDOW_SECONDS) + f"""SELECT e.seq, e.user_id,
  make_timestamp(r.a) AS window_start, CAST(r.n AS BIGINT) AS n, r.n <= {tx.RATE_LIMIT_REQUESTS} AS allowed
FROM r JOIN ev e ON e.key = r.key AND e.rn = r.rn""")
def q_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 requests per user in a 60 s window anchored at the user's first request."""
    req = standins.predict_requests(spark, sf_dir).select("seq", "user_id", "ts")
    out = W.rate_limit(req, "user_id", "ts", "seq", tx.RATE_LIMIT_WINDOW_SECONDS, tx.RATE_LIMIT_REQUESTS)
    return out.select("seq", "user_id", "window_start", "n", "allowed")
