"""History, feedback and user tables: W1–W3, O1, P13, P14, J4–J6, A1, M10, S8–S10.

Per-user operations are expressed for all users at once.  Pages use
``row_number`` with a bounded rank filter, which Spark plans as a
WindowGroupLimit *before* the shuffle (each map task keeps only the top
rows per user), so a user with a huge history is not one huge sort.
"Latest write wins" is a ``max_by`` aggregate (partial aggregation, so a
hot key is pre-combined map-side); first-writer-wins is ``min_by``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_micros(col: str) -> F.Column:
    """Microseconds since the epoch of a timestamp without zone (zone-independent)."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {col})")


def with_row_ids(requests: DataFrame, user_col: str = "user_id", text_col: str = "text", ts_col: str = "ts") -> DataFrame:
    """A deterministic id per request (sha-256 of user, text and time),
    so re-running a job appends the same ids (idempotent sinks)."""
    key = F.concat_ws("|", F.col(user_col), F.col(text_col), epoch_micros(ts_col).cast("string"))
    return requests.withColumn("id", F.sha2(key, 256))


def counts_per_user(history: DataFrame, user_col: str = "user_id") -> DataFrame:
    """A1: rows per user."""
    return history.groupBy(user_col).agg(F.count(F.lit(1)).alias("total"))


def pages(history: DataFrame, limit: int, offset: int = 0, user_col: str = "user_id",
          ts_col: str = "created_at", id_col: str = "id") -> DataFrame:
    """Newest-first page (offset, limit) of every user; ties broken by id."""
    w = Window.partitionBy(user_col).orderBy(F.col(ts_col).desc(), F.col(id_col).desc())
    ranked = history.withColumn("rn", F.row_number().over(w))
    return ranked.filter((F.col("rn") > offset) & (F.col("rn") <= offset + limit))


def user_page(history: DataFrame, user_id: str, limit: int, offset: int = 0, user_col: str = "user_id",
              ts_col: str = "created_at", id_col: str = "id") -> DataFrame:
    """O1: one user's page, newest first (plans as a top-k with offset)."""
    h = history.filter(F.col(user_col) == user_id)
    return h.orderBy(F.col(ts_col).desc(), F.col(id_col).desc()).offset(offset).limit(limit)


def owned(requests: DataFrame, history: DataFrame, id_col: str = "id", user_col: str = "user_id") -> DataFrame:
    """Rows of ``history`` addressed by (id, user) in ``requests``; other users' rows stay hidden."""
    return history.join(requests.select(id_col, user_col).distinct(), [id_col, user_col], "left_semi")


def active_only(requests: DataFrame, users: DataFrame, user_col: str = "user_id") -> DataFrame:
    """Requests of active users only."""
    act = users.filter(F.col("is_active")).select(F.col("id").alias(user_col))
    return requests.join(act, user_col, "left_semi")


def split_feedback(feedback: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feedback whose (prediction_id, user_id) names the sender's own
    prediction is accepted; the rest (unknown or foreign ids) is rejected."""
    keys = history.select(F.col("id").alias("prediction_id"), "user_id")
    accepted = feedback.join(keys, ["prediction_id", "user_id"], "left_semi")
    rejected = feedback.join(keys, ["prediction_id", "user_id"], "left_anti")
    return accepted, rejected


def upsert_feedback(accepted: DataFrame) -> DataFrame:
    """One row per prediction; the last write (by ts, then seq) replaces
    all three fields, nulls included; the first write's time is kept."""
    order = F.struct("ts", "seq")
    last = F.max_by(F.struct("correct_category", "correct_level", "comment"), order)
    g = accepted.groupBy("prediction_id").agg(last.alias("v"), F.min("ts").alias("created_at"))
    return g.select("prediction_id", "v.correct_category", "v.correct_level", "v.comment", "created_at")


def register(attempts: DataFrame) -> DataFrame:
    """Insert-if-absent on e-mail; the earliest attempt creates the user,
    later attempts for the same e-mail are conflicts. ``attempt_id`` is unique
    and orders attempts of one instant."""
    first = attempts.groupBy("email").agg(F.min(F.struct("ts", "attempt_id")).alias("w"))
    j = attempts.join(first, "email")
    created = F.col("attempt_id") == F.col("w.attempt_id")
    return j.select("attempt_id", "email", "user_id", "ts", F.when(created, "created").otherwise("conflict").alias("status"))


def with_feedback(history: DataFrame, feedback_rows: DataFrame) -> DataFrame:
    """Predictions with their (at most one) feedback row."""
    fb = feedback_rows.withColumnRenamed("prediction_id", "id").withColumnRenamed("created_at", "feedback_at")
    return history.join(fb, "id", "left")


def cascade_delete(users: DataFrame, deleted_user_ids: DataFrame, predictions: DataFrame,
                   feedback_rows: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Removing users removes their predictions, those predictions'
    feedback, and their matches (anti joins; the result tables are rewritten)."""
    gone = deleted_user_ids.select(F.col("id").alias("user_id")).distinct()
    users_left = users.join(gone.withColumnRenamed("user_id", "id"), "id", "left_anti")
    preds_left = predictions.join(gone, "user_id", "left_anti")
    fb_left = feedback_rows.join(preds_left.select(F.col("id").alias("prediction_id")), "prediction_id", "left_semi")
    matches_left = matches.join(gone, "user_id", "left_anti")
    return users_left, preds_left, fb_left, matches_left


def retrain_rows(history: DataFrame, feedback_rows: DataFrame) -> DataFrame:
    """Corrected labels — the feedback value where given, else the prediction."""
    j = with_feedback(history, feedback_rows)
    return j.select(
        "id",
        F.coalesce("correct_category", "category").alias("category"),
        F.coalesce("correct_level", "level").alias("level"),
        (F.col("correct_category").isNotNull() | F.col("correct_level").isNotNull()).alias("corrected"),
    )
