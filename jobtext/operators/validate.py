"""P1–P3, F21 — request validation as accepted/rejected outputs with a reason.

The first failing rule (in field order) is the reason; accepted rows have a
null reason.  All checks are row-local projections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtext import taxonomy as tx
from jobtext.functions.text import is_uuid, strip_unicode


def _length_reason(text: Column, prefix: str = "") -> Column:
    n = F.length(text)
    return (F.when(text.isNull(), F.lit(prefix + "missing"))
            .when(n < tx.MIN_REQUEST_LENGTH, F.lit(prefix + "too_short"))
            .when(n > tx.MAX_REQUEST_LENGTH, F.lit(prefix + "too_long")))


def validate_predict(requests: DataFrame, text_col: str = "text") -> DataFrame:
    """Text of 10..10,000 characters (not stripped)."""
    reason = _length_reason(F.col(text_col))
    return requests.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def validate_match(pairs: DataFrame) -> DataFrame:
    """Per side, the length check runs on the raw text, then the text is
    stripped and must not be empty; stripped texts are returned."""
    out = pairs
    reasons = []
    for side in ("resume", "vacancy"):
        raw = F.col(f"{side}_text")
        stripped = strip_unicode(raw)
        out = out.withColumn(f"{side}_clean", stripped)
        reasons.append(F.coalesce(_length_reason(raw, f"{side}_"),
                                  F.when(F.col(f"{side}_clean") == "", F.lit(f"{side}_blank"))))
    return out.withColumn("reason", F.coalesce(*reasons)).withColumn("accepted", F.col("reason").isNull())


def validate_scores(rows: DataFrame, *score_cols: str) -> DataFrame:
    """Scores (confidence, match_score) must be there and lie in [0, 1]."""
    reasons = [F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.lit(f"{c}_missing"))
               .when(~F.col(c).between(0, 1), F.lit(f"{c}_out_of_range")) for c in score_cols]
    return rows.withColumn("reason", F.coalesce(*reasons)).withColumn("accepted", F.col("reason").isNull())


def validate_feedback(fb: DataFrame) -> DataFrame:
    """P3 + F21: id must be a UUID; category and level in their domains or
    null; comment at most 1,000 characters or null."""
    reason = (
        F.when(~is_uuid(F.col("prediction_id")), F.lit("bad_prediction_id"))
        .when(F.col("correct_category").isNotNull() & ~F.col("correct_category").isin(*tx.CATEGORIES),
              F.lit("bad_category"))
        .when(F.col("correct_level").isNotNull() & ~F.col("correct_level").isin(*tx.LEVELS), F.lit("bad_level"))
        .when(F.length("comment") > tx.MAX_COMMENT_LENGTH, F.lit("comment_too_long"))
    )
    return fb.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
