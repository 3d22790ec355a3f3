"""Skill comparison, match score and explanation as Spark columns.

Scores are computed exactly: the skill share is rounded half-up on the
exact fraction with integer arithmetic, and the blended score uses decimal
arithmetic, so results do not depend on binary floating point.  (The
original rounds binary doubles half-even; the two differ only on exact ties
at the fifth decimal.)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobtext import taxonomy as tx
from jobtext.functions.text import strip_unicode

DEC4 = "decimal(12,4)"


def normalize_skills(col: Column | str) -> Column:
    """strip, lower, drop blanks, distinct (an empty array for null)."""
    c = F.col(col) if isinstance(col, str) else col
    cleaned = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda s: F.lower(strip_unicode(s)))
    return F.array_distinct(F.filter(cleaned, lambda s: s != ""))


def skill_match_cols(resume_skills: Column, vacancy_skills: Column) -> dict[str, Column]:
    """U4 + F5: matched / missing / extra (sorted) and skill_score (decimal 4)."""
    r = normalize_skills(resume_skills)
    v = normalize_skills(vacancy_skills)
    empty = F.array().cast("array<string>")
    has_req = F.size(v) > 0
    matched = F.array_sort(F.array_intersect(r, v))
    missing = F.array_sort(F.array_except(v, r))
    extra = F.array_sort(F.array_except(r, v))
    k = F.size(matched).cast("long")
    n = F.size(v).cast("long")
    return {
        "matched_skills": F.when(has_req, matched).otherwise(empty),
        "missing_skills": F.when(has_req, missing).otherwise(empty),
        "extra_resume_skills": F.when(has_req, extra).otherwise(F.array_sort(r)),
        "skill_score": skill_share(k, n),
    }


def skill_share(common: Column, required: Column) -> Column:
    """share of the required skills, 4 decimals; zero if none is required."""
    k, n = common.cast("long"), required.cast("long")
    # half-up of k/n at 4 decimals == floor((20000k + n) / 2n) / 10^4, exact in integers
    q = F.when(n > 0, _int_div(k * 20000 + n, n * 2)).otherwise(F.lit(0).cast("long"))
    return (q.cast("decimal(20,0)") / F.lit(10000).cast("decimal(20,0)")).cast(DEC4)


def _int_div(a: Column, b: Column) -> Column:
    """Exact integer division of non-negative longs."""
    return ((a - F.pmod(a, b)) / b).cast("long")  # exact: numerator is a multiple of b


def match_score(skill_score: Column, category_match: Column, level_match: Column,
                resume_conf: Column, vacancy_conf: Column) -> Column:
    """F6 + A18: (0.6*skill + 0.3*category + 0.1*level) * mean confidence, 4 decimals.

    Confidences are 4-decimal values (they are rounded when produced).
    Returns decimal(12,4).
    """
    s = skill_score.cast(DEC4)
    c = F.when(category_match, F.lit(1)).otherwise(F.lit(0)).cast("decimal(1,0)")
    lv = F.when(level_match, F.lit(1)).otherwise(F.lit(0)).cast("decimal(1,0)")
    base = F.lit(0.6).cast("decimal(2,1)") * s + F.lit(0.3).cast("decimal(2,1)") * c + F.lit(0.1).cast("decimal(2,1)") * lv
    conf = (resume_conf.cast(DEC4) + vacancy_conf.cast(DEC4)) * F.lit(0.5).cast("decimal(2,1)")
    return F.round(base * conf, 4).cast(DEC4)


def explanation(score: Column, category_match: Column, level_match: Column,
                matched: Column, missing: Column) -> Column:
    """F8: band sentence, category and level sentences, then matched and
    missing lists when non-empty, joined by a space."""
    band = (
        F.when(score >= tx.MATCH_GOOD, F.lit(tx.EXPLAIN_GOOD))
        .when(score >= tx.MATCH_PARTIAL, F.lit(tx.EXPLAIN_PARTIAL))
        .otherwise(F.lit(tx.EXPLAIN_WEAK))
    )
    cat = F.when(category_match, F.lit(tx.EXPLAIN_CATEGORY_SAME)).otherwise(F.lit(tx.EXPLAIN_CATEGORY_DIFF))
    lvl = F.when(level_match, F.lit(tx.EXPLAIN_LEVEL_SAME)).otherwise(F.lit(tx.EXPLAIN_LEVEL_DIFF))
    m = F.when(F.size(matched) > 0, F.concat(F.lit(tx.EXPLAIN_MATCHED), F.array_join(matched, ", "), F.lit(".")))
    s = F.when(F.size(missing) > 0, F.concat(F.lit(tx.EXPLAIN_MISSING), F.array_join(missing, ", "), F.lit(".")))
    return F.concat_ws(" ", band, cat, lvl, m, s)


def score_percent(score: Column) -> Column:
    """JavaScript Math.round(score*100) (half toward +inf) on the 4-decimal score."""
    return F.floor(score.cast(DEC4) * 100 + F.lit(0.5).cast("decimal(2,1)")).cast("int")
