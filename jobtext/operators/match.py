"""J1 — resume/vacancy matching over a table of pairs.

Each distinct text is analysed once (skills are extracted per text, not per
pair), then the pair table is joined twice with the analysis table.  At
scale both joins are shuffle joins on the text id (AQE may turn either into
a broadcast when a side is small at run time); the analysis rows are small
(labels, a short skill array, a confidence).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtext.functions.match import explanation, match_score, score_percent, skill_match_cols
from jobtext.operators.skills import extract_skills


def analyse_texts(texts: DataFrame, dictionary: dict[str, list[str]] | None = None) -> DataFrame:
    """Analysis table (text_id, category, level, skills, confidence).

    ``texts`` carries (text_id, text, category, level, confidence) — the
    category/level/confidence come from a classifier (``score.score_texts``)
    or from given labels; skills are extracted here.
    """
    a = extract_skills(texts.select("text_id", "category", "level", "text", "confidence"), "text", "skills", dictionary)
    return a.select("text_id", "category", "level", "skills",
                    F.col("confidence").cast("decimal(12,4)").alias("confidence"))


def match_pairs(pairs: DataFrame, analysis: DataFrame) -> DataFrame:
    """Score every (resume, vacancy) pair.

    ``pairs``: pair_id, user_id, resume_id, vacancy_id (extra columns kept).
    ``analysis``: text_id, category, level, skills, confidence.
    """
    r = analysis.select(
        F.col("text_id").alias("resume_id"),
        F.col("category").alias("resume_category"), F.col("level").alias("resume_level"),
        F.col("skills").alias("resume_skills"), F.col("confidence").alias("resume_confidence"),
    )
    v = analysis.select(
        F.col("text_id").alias("vacancy_id"),
        F.col("category").alias("vacancy_category"), F.col("level").alias("vacancy_level"),
        F.col("skills").alias("vacancy_skills"), F.col("confidence").alias("vacancy_confidence"),
    )
    j = pairs.join(r, "resume_id").join(v, "vacancy_id")
    sm = skill_match_cols(F.col("resume_skills"), F.col("vacancy_skills"))
    j = j.select(
        "*",
        *[c.alias(n) for n, c in sm.items()],
        (F.col("resume_category") == F.col("vacancy_category")).alias("category_match"),
        (F.col("resume_level") == F.col("vacancy_level")).alias("level_match"),
    )
    j = j.withColumn(
        "match_score",
        match_score(F.col("skill_score"), F.col("category_match"), F.col("level_match"),
                    F.col("resume_confidence"), F.col("vacancy_confidence")),
    )
    return j.withColumn(
        "explanation",
        explanation(F.col("match_score"), F.col("category_match"), F.col("level_match"),
                    F.col("matched_skills"), F.col("missing_skills")),
    )


def analysis_struct(prefix: str):
    """the analysis object of one side, as a struct column."""
    return F.struct(
        F.col(f"{prefix}_category").alias("category"),
        F.col(f"{prefix}_level").alias("level"),
        F.col(f"{prefix}_skills").alias("skills"),
        F.col(f"{prefix}_confidence").cast("double").alias("confidence"),
    )


def match_report(matches: DataFrame) -> DataFrame:
    """The history-table projection of a match row.

    percent = Math.round(score*100); band at 75 / 45 on that percent; the
    first five matched skills, with '... (+n)' when there are more, '—' when
    none; 'RESUME / VACANCY' levels; upper-cased category; dd.mm.yyyy, hh:mm.
    """
    pct = score_percent(F.col("match_score"))
    n = F.size("matched_skills")
    short = F.array_join(F.slice("matched_skills", 1, 5), ", ")
    shown = F.when(n > 5, F.concat(short, F.lit("... (+"), (n - 5).cast("string"), F.lit(")"))) \
        .when(short == "", F.lit("—")).otherwise(short)
    return matches.select(
        "pair_id",
        F.date_format("created_at", "dd.MM.yyyy, HH:mm").alias("date_text"),
        F.upper("resume_category").alias("category_text"),
        F.concat(F.upper("resume_level"), F.lit(" / "), F.upper("vacancy_level")).alias("levels_text"),
        shown.alias("skills_text"),
        pct.alias("score_percent"),
        F.when(pct >= 75, "score-high").when(pct >= 45, "score-mid").otherwise("score-low").alias("score_band"),
    )
