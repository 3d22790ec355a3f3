"""History queries: S10, A1, W1–W3, O1, P13, P14, J4–J6, M10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtext.operators import history as H
from jobtext.plans import standin_sql as S
from jobtext.plans.registry import query
from jobtext.session import scratch_path
from jobtext.sources import standins
from jobtext.sources.sinks import append_history, delete_history, read_history
from jobtext.sources.tables import read

PAGE_LIMIT, PAGE_OFFSET = 5, 2
PAGE_USER = "u1"

LOOKUPS_SQL = """lookups AS (
  SELECT 'p' || CAST(CASE WHEN event_id % 2 = 0 THEN event_id ELSE event_id - 1 END AS VARCHAR) AS id,
         'u' || CAST(user_id AS VARCHAR) AS user_id
  FROM events WHERE event_type = 'purchase')"""


def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in: item requests (id, user_id) from purchase events; odd events
    ask for the previous event's prediction, which may be another user's."""
    e = read(spark, sf_dir, "events", "event_id", "user_id", "event_type").filter(F.col("event_type") == "purchase")
    i = F.col("event_id")
    return e.select(
        F.concat(F.lit("p"), F.when(i % 2 == 0, i).otherwise(i - 1).cast("string")).alias("id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
    )


ACCEPTED_SQL = S.with_(S.PREDICTION_HISTORY, S.FEEDBACK_EVENTS, """accepted AS (
  SELECT f.* FROM feedback_events f
  WHERE EXISTS (SELECT 1 FROM prediction_history p WHERE p.id = f.prediction_id AND p.user_id = f.user_id))""",
                   """upserted AS (
  SELECT prediction_id, correct_category, correct_level, comment, created_at FROM (
    SELECT *, row_number() OVER (PARTITION BY prediction_id ORDER BY ts DESC, seq DESC) AS rn,
           min(ts) OVER (PARTITION BY prediction_id) AS created_at
    FROM accepted) WHERE rn = 1)""")

# read several times below: one evaluation each
ACCEPTED_SQL = ACCEPTED_SQL.replace(" AS (\n", " AS MATERIALIZED (\n")


def _accepted(spark, sf_dir):
    hist = standins.prediction_history(spark, sf_dir)
    acc, rej = H.split_feedback(standins.feedback_events(spark, sf_dir), hist)
    return hist, acc, rej


@query("history_ids", sql=S.with_(S.PREDICT_REQUESTS) + """SELECT seq,
  sha256(concat_ws('|', user_id, text, CAST(epoch_us(ts) AS VARCHAR))) AS id FROM predict_requests""")
def q_history_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic row ids of prediction requests."""
    return H.with_row_ids(standins.predict_requests(spark, sf_dir)).select("seq", "id")


@query("history_counts", sql=S.with_(S.PREDICTION_HISTORY, S.MATCH_REQUESTS) + """
SELECT 'prediction' AS kind, user_id, count(*) AS total FROM prediction_history GROUP BY user_id
UNION ALL SELECT 'match', user_id, count(*) FROM match_requests GROUP BY user_id""")
def q_history_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: predictions and matches per user."""
    p = H.counts_per_user(standins.prediction_history(spark, sf_dir)).withColumn("kind", F.lit("prediction"))
    m = H.counts_per_user(standins.match_requests(spark, sf_dir)).withColumn("kind", F.lit("match"))
    return p.unionByName(m).select("kind", "user_id", "total")


@query("history_page", sql=S.with_(S.PREDICTION_HISTORY) + f"""SELECT user_id, id, created_at, rn FROM (
  SELECT user_id, id, created_at, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn
  FROM prediction_history) WHERE rn > {PAGE_OFFSET} AND rn <= {PAGE_OFFSET + PAGE_LIMIT}""")
def q_history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest-first history page of every user (limit 5, offset 2)."""
    h = standins.prediction_history(spark, sf_dir).select("user_id", "id", "created_at")
    return H.pages(h, PAGE_LIMIT, PAGE_OFFSET).select("user_id", "id", "created_at", F.col("rn").cast("long").alias("rn"))


@query("user_page", sql=S.with_(S.PREDICTION_HISTORY) + f"""SELECT id, user_id, created_at, category FROM prediction_history
WHERE user_id = '{PAGE_USER}' ORDER BY created_at DESC, id DESC LIMIT {PAGE_LIMIT} OFFSET {PAGE_OFFSET}""")
def q_user_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: one user's history page, newest first."""
    h = standins.prediction_history(spark, sf_dir).select("id", "user_id", "created_at", "category")
    return H.user_page(h, PAGE_USER, PAGE_LIMIT, PAGE_OFFSET)


@query("owner_lookup", sql=S.with_(S.PREDICTION_HISTORY, LOOKUPS_SQL) + """SELECT p.id, p.user_id, p.category, p.level
FROM prediction_history p WHERE EXISTS (SELECT 1 FROM lookups l WHERE l.id = p.id AND l.user_id = p.user_id)""")
def q_owner_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items found by (id, owner); another user's items are not returned."""
    h = standins.prediction_history(spark, sf_dir).select("id", "user_id", "category", "level")
    return H.owned(lookups(spark, sf_dir), h)


@query("active_requests", sql=S.with_(S.PREDICT_REQUESTS, S.USERS) + """SELECT seq, user_id FROM predict_requests r
WHERE EXISTS (SELECT 1 FROM users u WHERE u.id = r.user_id AND u.is_active)""")
def q_active_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of active users."""
    req = standins.predict_requests(spark, sf_dir).select("seq", "user_id")
    return H.active_only(req, standins.users(spark, sf_dir))


@query("feedback_apply", sql=ACCEPTED_SQL + "SELECT seq, prediction_id, user_id, correct_category, correct_level, comment FROM accepted")
def q_feedback_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback events addressed to the sender's own predictions."""
    _, acc, _ = _accepted(spark, sf_dir)
    return acc.select("seq", "prediction_id", "user_id", "correct_category", "correct_level", "comment")


@query("feedback_rejects", sql=S.with_(S.PREDICTION_HISTORY, S.FEEDBACK_EVENTS) + """SELECT seq, prediction_id, user_id
FROM feedback_events f WHERE NOT EXISTS (SELECT 1 FROM prediction_history p WHERE p.id = f.prediction_id AND p.user_id = f.user_id)""")
def q_feedback_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback for unknown or foreign predictions (rejected)."""
    _, _, rej = _accepted(spark, sf_dir)
    return rej.select("seq", "prediction_id", "user_id")


@query("feedback_upsert", sql=ACCEPTED_SQL + "SELECT * FROM upserted")
def q_feedback_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feedback row per prediction, last write wins, first time kept."""
    _, acc, _ = _accepted(spark, sf_dir)
    return H.upsert_feedback(acc)


@query("register_dedup", sql=S.with_(S.REGISTRATIONS) + """SELECT attempt_id, email, user_id, ts,
  CASE WHEN row_number() OVER (PARTITION BY email ORDER BY ts, attempt_id) = 1 THEN 'created' ELSE 'conflict' END AS status
FROM registrations""")
def q_register_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First registration per e-mail creates the user, later ones conflict."""
    return H.register(standins.registrations(spark, sf_dir))


# the same over whole-number keys: hash joins of the log with itself, the last write by arg_max
_FEEDBACK_SQL = f"""WITH h AS MATERIALIZED (
  SELECT e.event_id, e.user_id, d.lang, {S.LEVEL_OF_LENGTH} AS level
  FROM events e JOIN documents d ON d.doc_id = e.event_id % (SELECT max(doc_id) + 1 FROM documents)),
a AS MATERIALIZED (
  SELECT c.event_id AS seq, c.event_id - c.event_id % 3 AS pid, c.ts,
    CASE WHEN c.event_id % 5 <> 0 THEN (['backend', 'frontend', 'data_science', 'analytics'])[c.event_id % 4 + 1] END AS correct_category,
    CASE WHEN c.event_id % 7 <> 0 THEN (['intern', 'junior', 'middle', 'senior'])[c.event_id % 4 + 1] END AS correct_level,
    CASE WHEN c.value > 40 THEN 'comment ' || CAST(c.event_id AS VARCHAR) END AS comment
  FROM events c SEMI JOIN h ON h.event_id = c.event_id - c.event_id % 3 AND h.user_id = c.user_id WHERE c.event_type = 'click'),
u AS MATERIALIZED (
  SELECT pid, arg_max(struct_pack(c := correct_category, l := correct_level, m := comment), struct_pack(t := ts, s := seq)) AS v FROM a GROUP BY pid)
"""


@query("history_feedback", sql=_FEEDBACK_SQL + """SELECT 'p' || CAST(event_id AS VARCHAR) AS id, 'u' || CAST(user_id AS VARCHAR) AS user_id, lang AS category,
  u.v.c AS correct_category, u.v.l AS correct_level, u.v.m AS comment FROM h LEFT JOIN u ON u.pid = h.event_id""")
def q_history_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with their feedback (left join)."""
    hist, acc, _ = _accepted(spark, sf_dir)
    j = H.with_feedback(hist.select("id", "user_id", "category"), H.upsert_feedback(acc))
    return j.select("id", "user_id", "category", "correct_category", "correct_level", "comment")


@query("retrain_set", sql=_FEEDBACK_SQL + """SELECT 'p' || CAST(event_id AS VARCHAR) AS id, coalesce(u.v.c, lang) AS category, coalesce(u.v.l, level) AS level,
  (u.v.c IS NOT NULL OR u.v.l IS NOT NULL) AS corrected FROM h LEFT JOIN u ON u.pid = h.event_id""")
def q_retrain_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels corrected by feedback for retraining."""
    hist, acc, _ = _accepted(spark, sf_dir)
    return H.retrain_rows(hist.select("id", "category", "level"), H.upsert_feedback(acc))


@query("cascade_delete", sql=ACCEPTED_SQL.replace("WITH ", "WITH " + S.USERS + ",\n" + S.MATCH_REQUESTS + ",\n", 1) + """,
gone AS (SELECT id FROM users WHERE NOT is_active),
pl AS (SELECT id FROM prediction_history WHERE user_id NOT IN (SELECT id FROM gone))
SELECT 'users' AS table_name, id AS key FROM users WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'predictions', id FROM pl
UNION ALL SELECT 'feedback', prediction_id FROM upserted WHERE prediction_id IN (SELECT id FROM pl)
UNION ALL SELECT 'matches', CAST(pair_id AS VARCHAR) FROM match_requests WHERE 'u' || substr(user_id, 4) NOT IN (SELECT id FROM gone)""")
def q_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleting inactive users removes their predictions, feedback and matches."""
    users = standins.users(spark, sf_dir)
    hist, acc, _ = _accepted(spark, sf_dir)
    fb = H.upsert_feedback(acc)
    m = standins.match_requests(spark, sf_dir).select(
        "pair_id", F.concat(F.lit("u"), F.substring("user_id", 4, 10)).alias("user_id"))
    gone = users.filter(~F.col("is_active")).select("id")
    u, p, f, mm = H.cascade_delete(users, gone, hist.select("id", "user_id"), fb, m)
    return (u.select(F.lit("users").alias("table_name"), F.col("id").alias("key"))
            .unionByName(p.select(F.lit("predictions").alias("table_name"), F.col("id").alias("key")))
            .unionByName(f.select(F.lit("feedback").alias("table_name"), F.col("prediction_id").alias("key")))
            .unionByName(mm.select(F.lit("matches").alias("table_name"), F.col("pair_id").cast("string").alias("key"))))


@query("history_sink", sql=S.with_(S.PREDICTION_HISTORY, S.USERS) + """SELECT id, user_id, category, level, confidence, cached, model_version, created_at
FROM prediction_history WHERE user_id NOT IN (SELECT id FROM users WHERE NOT is_active)""")
def q_history_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions are appended to the history table day by day, one
    batch of them a second time; inactive users' rows are then deleted from it."""
    rows, path = standins.prediction_history(spark, sf_dir), scratch_path(spark, "predictions")
    cut = F.col("created_at") < F.expr("TIMESTAMP_NTZ'2024-01-15 00:00:00'")
    for batch in (*standins.arrivals(rows, [cut]), rows.filter(cut)):
        append_history(batch, path)
    gone = standins.users(spark, sf_dir).filter(~F.col("is_active")).select(F.col("id").alias("user_id"))
    delete_history(spark, path, gone, "user_id")
    return read_history(spark, path)
