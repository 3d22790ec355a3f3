"""Matching and skill queries: J1, J3, U4, F1, F4–F9, P4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtext import taxonomy as tx
from jobtext.functions.text import clean_text
from jobtext.operators import match as M
from jobtext.operators import rank as R
from jobtext.operators.skills import extract_skills, extract_skills_by_table
from jobtext.plans import standin_sql as S
from jobtext.plans.registry import query
from jobtext.sources import standins
from jobtext.session import materialize
from jobtext.sources.tables import read

SPACE = S.SPACE_CHARS
WORD_CLASS = f"[{S.WORD_CHARS}]"
WORD = S.WORD_CHARS


def matched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of the match request table, scored (J1 with F4–F9)."""
    texts = standins.labelled_texts(spark, sf_dir)
    # both joins read the analysis: materialise its small rows once instead of extracting skills twice
    analysis = materialize(M.analyse_texts(texts, standins.CORPUS_SKILLS))
    pairs = standins.match_requests(spark, sf_dir).select("pair_id", "user_id", "resume_id", "vacancy_id", "created_at")
    return M.match_pairs(pairs, analysis)


_MATCH_COLS = [
    "pair_id", "user_id", "resume_id", "vacancy_id",
    "resume_category", "resume_level", "resume_skills", "resume_confidence",
    "vacancy_category", "vacancy_level", "vacancy_skills", "vacancy_confidence",
    "skill_score", "matched_skills", "missing_skills", "extra_resume_skills",
    "category_match", "level_match", "match_score", "explanation",
]
_DOUBLE_COLS = {"resume_confidence", "vacancy_confidence", "skill_score", "match_score"}


def _out(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if c in _DOUBLE_COLS else F.col(c) for c in cols])


_MATCH_SQL_BODY = S.with_(
    S.LABELLED_TEXTS,
    S.MATCH_REQUESTS,
    f"""analysis AS (
  SELECT text_id, category, level, {S.skills_sql('text', standins.CORPUS_SKILLS)} AS skills, confidence
  FROM labelled_texts)""",
    f"""j AS (
  SELECT p.pair_id, p.user_id, p.resume_id, p.vacancy_id, p.created_at,
         r.category AS resume_category, r.level AS resume_level, r.skills AS resume_skills, r.confidence AS resume_confidence,
         v.category AS vacancy_category, v.level AS vacancy_level, v.skills AS vacancy_skills, v.confidence AS vacancy_confidence,
         list_distinct(list_filter(list_transform(r.skills, lambda s: lower(regexp_replace(s, '^[{SPACE}]+|[{SPACE}]+$', '', 'g'))), lambda s: s <> '')) AS rn,
         list_distinct(list_filter(list_transform(v.skills, lambda s: lower(regexp_replace(s, '^[{SPACE}]+|[{SPACE}]+$', '', 'g'))), lambda s: s <> '')) AS vn
  FROM match_requests p JOIN analysis r ON r.text_id = p.resume_id JOIN analysis v ON v.text_id = p.vacancy_id)""",
    """k AS (
  SELECT *,
    CASE WHEN len(vn) = 0 THEN []::VARCHAR[] ELSE list_sort(list_filter(vn, lambda s: list_contains(rn, s))) END AS matched_skills,
    CASE WHEN len(vn) = 0 THEN []::VARCHAR[] ELSE list_sort(list_filter(vn, lambda s: NOT list_contains(rn, s))) END AS missing_skills,
    CASE WHEN len(vn) = 0 THEN list_sort(rn) ELSE list_sort(list_filter(rn, lambda s: NOT list_contains(vn, s))) END AS extra_resume_skills,
    resume_category = vacancy_category AS category_match,
    resume_level = vacancy_level AS level_match
  FROM j)""",
    """s AS (
  SELECT *, CAST(CAST(CASE WHEN len(vn) = 0 THEN 0 ELSE (20000 * len(matched_skills) + len(vn)) // (2 * len(vn)) END AS DECIMAL(12,0)) * 0.0001 AS DECIMAL(12,4)) AS skill_score
  FROM k)""",
    """m AS (
  SELECT *, CAST(round((0.6 * skill_score + 0.3 * CAST(CASE WHEN category_match THEN 1 ELSE 0 END AS DECIMAL(1,0))
                        + 0.1 * CAST(CASE WHEN level_match THEN 1 ELSE 0 END AS DECIMAL(1,0)))
                       * ((resume_confidence + vacancy_confidence) * 0.5), 4) AS DECIMAL(12,4)) AS match_score
  FROM s)""",
    f"""x AS (
  SELECT *, concat_ws(' ',
      CASE WHEN match_score >= 0.75 THEN '{tx.EXPLAIN_GOOD}' WHEN match_score >= 0.45 THEN '{tx.EXPLAIN_PARTIAL}' ELSE '{tx.EXPLAIN_WEAK}' END,
      CASE WHEN category_match THEN '{tx.EXPLAIN_CATEGORY_SAME}' ELSE '{tx.EXPLAIN_CATEGORY_DIFF}' END,
      CASE WHEN level_match THEN '{tx.EXPLAIN_LEVEL_SAME}' ELSE '{tx.EXPLAIN_LEVEL_DIFF}' END,
      CASE WHEN len(matched_skills) > 0 THEN '{tx.EXPLAIN_MATCHED}' || array_to_string(matched_skills, ', ') || '.' END,
      CASE WHEN len(missing_skills) > 0 THEN '{tx.EXPLAIN_MISSING}' || array_to_string(missing_skills, ', ') || '.' END) AS explanation
  FROM m)""",
)


def _sql_out(cols: list[str]) -> str:
    return ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c in _DOUBLE_COLS else c for c in cols)


@query("match_pairs", sql=_MATCH_SQL_BODY + f"SELECT {_sql_out(_MATCH_COLS)} FROM x")
def q_match_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of the match request table scored with skills, labels and confidences."""
    return _out(matched_pairs(spark, sf_dir), _MATCH_COLS)


_SKILL_COLS = ["pair_id", "matched_skills", "missing_skills", "extra_resume_skills", "skill_score"]


@query("skill_match", sql=_MATCH_SQL_BODY + f"SELECT {_sql_out(_SKILL_COLS)} FROM x")
def q_skill_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4 + F4 + F5: normalised skill sets compared per pair."""
    return _out(matched_pairs(spark, sf_dir), _SKILL_COLS)


_EXPLAIN_COLS = ["pair_id", "match_score", "category_match", "level_match", "explanation"]


@query("match_explain", sql=_MATCH_SQL_BODY + f"SELECT {_sql_out(_EXPLAIN_COLS)} FROM x")
def q_match_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and explanation text per pair."""
    return _out(matched_pairs(spark, sf_dir), _EXPLAIN_COLS)


@query("match_struct", sql=_MATCH_SQL_BODY + """SELECT pair_id,
  to_json({'category': resume_category, 'level': resume_level, 'skills': resume_skills}) AS resume_analysis,
  to_json({'category': vacancy_category, 'level': vacancy_level, 'skills': vacancy_skills}) AS vacancy_analysis,
  CAST(resume_confidence AS DOUBLE) AS resume_confidence, CAST(vacancy_confidence AS DOUBLE) AS vacancy_confidence
FROM x""")
def q_match_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """analysis objects packed as structs and written as JSON text."""
    m = matched_pairs(spark, sf_dir)
    packed = m.select("pair_id", M.analysis_struct("resume").alias("ra"), M.analysis_struct("vacancy").alias("va"))
    return packed.select(
        "pair_id",
        F.to_json(F.col("ra").dropFields("confidence")).alias("resume_analysis"),
        F.to_json(F.col("va").dropFields("confidence")).alias("vacancy_analysis"),
        F.col("ra.confidence").alias("resume_confidence"),
        F.col("va.confidence").alias("vacancy_confidence"),
    )


@query("match_report", sql=_MATCH_SQL_BODY + """, r AS (
  SELECT pair_id, created_at, resume_category, resume_level, vacancy_level, matched_skills,
         CAST(floor(match_score * 100 + 0.5) AS INTEGER) AS pct,
         array_to_string(matched_skills[1:5], ', ') AS short
  FROM x)
SELECT pair_id, strftime(created_at, '%d.%m.%Y, %H:%M') AS date_text, upper(resume_category) AS category_text,
       upper(resume_level) || ' / ' || upper(vacancy_level) AS levels_text,
       CASE WHEN len(matched_skills) > 5 THEN short || '... (+' || CAST(len(matched_skills) - 5 AS VARCHAR) || ')'
            WHEN short = '' THEN '—' ELSE short END AS skills_text,
       pct AS score_percent,
       CASE WHEN pct >= 75 THEN 'score-high' WHEN pct >= 45 THEN 'score-mid' ELSE 'score-low' END AS score_band
FROM r""")
def q_match_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The match history table as the report shows it."""
    return M.match_report(matched_pairs(spark, sf_dir))


#: Vacancies listed for each resume.
TOP_VACANCIES = 10

_RANK_SQL = S.with_(S.LABELLED_TEXTS, f"""a AS MATERIALIZED (
  SELECT text_id, category, level, confidence, list_distinct(list_transform({S.skills_sql('text', standins.CORPUS_SKILLS)}, lambda s: lower(s))) AS s
  FROM labelled_texts)""", """p AS (
  SELECT r.text_id AS resume_id, v.text_id AS vacancy_id, v.confidence AS vc, r.confidence AS rc, r.category = v.category AS cm, r.level = v.level AS lm,
    len(v.s) AS n, len(list_intersect(r.s, v.s)) AS m FROM a r, a v)""", """q AS (
  SELECT *, CAST(CAST(CASE WHEN n = 0 THEN 0 ELSE (20000 * m + n) // (2 * n) END AS DECIMAL(12,0)) * 0.0001 AS DECIMAL(12,4)) AS skill_score FROM p)""", """x AS (
  SELECT *, CAST(round((0.6 * skill_score + 0.3 * CAST(CASE WHEN cm THEN 1 ELSE 0 END AS DECIMAL(1,0)) + 0.1 * CAST(CASE WHEN lm THEN 1 ELSE 0 END AS DECIMAL(1,0)))
    * ((rc + vc) * 0.5), 4) AS DECIMAL(12,4)) AS score FROM q)""")


@query("rank_candidates", sql=_RANK_SQL + f"""SELECT resume_id, (row_number() OVER w)::INTEGER AS rank, vacancy_id,
  skill_score::DOUBLE AS skill_score, score::DOUBLE AS match_score FROM x
WINDOW w AS (PARTITION BY resume_id ORDER BY score DESC, vc DESC, vacancy_id) QUALIFY rank <= {TOP_VACANCIES}""")
def q_rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best vacancies for every resume; each document is both."""
    analysis = materialize(M.analyse_texts(standins.labelled_texts(spark, sf_dir), standins.CORPUS_SKILLS))
    out = R.rank_vacancies(analysis, analysis, TOP_VACANCIES)
    return out.select("resume_id", "rank", "vacancy_id", F.col("skill_score").cast("double").alias("skill_score"), F.col("match_score").cast("double").alias("match_score"))


@query("extract_skills", sql=f"SELECT doc_id, {S.skills_sql('text', tx.SKILLS_DICTIONARY)} AS skills FROM documents")
def q_extract_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 with the built-in skill dictionary over every document."""
    d = read(spark, sf_dir, "documents", "doc_id", "text")
    return extract_skills(d).select("doc_id", "skills")


@query("extract_corpus_skills", sql=f"SELECT doc_id, {S.skills_sql('text', standins.CORPUS_SKILLS)} AS skills FROM documents")
def q_extract_corpus_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 with a dictionary of words frequent in the test corpus (phrase and token paths)."""
    d = read(spark, sf_dir, "documents", "doc_id", "text")
    return extract_skills(d, dictionary=standins.CORPUS_SKILLS).select("doc_id", "skills")


_PAIR = f"^({WORD_CLASS}+) ({WORD_CLASS}+) "


@query("extract_skills_by_table", sql=f"""WITH d AS MATERIALIZED (
  SELECT DISTINCT 'item ' || CAST(item_id AS VARCHAR) AS name, regexp_extract(lower(text), '{_PAIR}', 1) || ' ' || regexp_extract(lower(text), '{_PAIR}', 2) AS spelling
  FROM benchmark WHERE regexp_matches(lower(text), '{_PAIR}')),
t AS MATERIALIZED (SELECT doc_id, '|' || regexp_replace(lower(text), '[^{WORD} ]', '|', 'g') || '|' AS t FROM documents),
m AS (SELECT doc_id, name FROM t, d WHERE contains(t, '|' || spelling || '|') OR contains(t, '|' || spelling || ' ') OR contains(t, ' ' || spelling || '|') OR contains(t, ' ' || spelling || ' '))
SELECT doc_id, coalesce(list_sort(list(name) FILTER (name IS NOT NULL)), []::VARCHAR[]) AS skills FROM documents LEFT JOIN m USING (doc_id) GROUP BY doc_id""")
def q_extract_skills_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 with a dictionary table: the first two words of each benchmark item as a phrase."""
    low = F.lower("text")
    items = read(spark, sf_dir, "benchmark", "item_id", "text").where(F.rlike(low, F.lit(_PAIR)))
    spelling = F.concat_ws(" ", F.regexp_extract(low, _PAIR, 1), F.regexp_extract(low, _PAIR, 2))
    dictionary = items.select(F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("name"), spelling.alias("spelling"))
    return extract_skills_by_table(read(spark, sf_dir, "documents", "doc_id", "text"), dictionary)


@query("clean_text", sql=f"""SELECT doc_id,
  trim(regexp_replace(regexp_replace(lower(text), '[^{WORD}{SPACE}+#./\\\\-]', ' ', 'g'), '[{SPACE}]+', ' ', 'g')) AS cleaned
FROM documents""")
def q_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 over every document."""
    d = read(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", clean_text("text").alias("cleaned"))
