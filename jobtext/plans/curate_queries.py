"""Curation and quality-report queries: S1–S3, S6, P5–P9, U1–U3, U5, F10–F17, A2–A9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtext import taxonomy as tx
from jobtext.functions.text import (
    bucket_by_years, clean_value, detect_level, normalize_title, parse_list_literal, parse_min_years,
)
from jobtext.operators import curate as C
from jobtext.operators import quality as Q
from jobtext.plans import standin_sql as S
from jobtext.plans.registry import query
from jobtext.session import materialize, scratch_path
from jobtext.sources import standins
from jobtext.sources.sinks import write_report, write_table
from jobtext.sources.tables import read

SPACE = S.SPACE_CHARS
WORD = S.WORD_CHARS

# ---------------------------------------------------------------- SQL pieces


def _items_sql(v: str) -> str:
    return f"list_filter(regexp_extract_all({v}, '''([^'']*)''', 1), lambda x: x IS NOT NULL)"


def _is_list_sql(v: str) -> str:
    return f"regexp_matches({v}, '^[ \\t]*\\[[\\s\\S]*\\][{SPACE}]*$')"


def clean_value_sql(v: str) -> str:
    listed = f"CASE WHEN {_is_list_sql(v)} THEN array_to_string({_items_sql(v)}, ', ') ELSE {v} END"
    nl = f"replace(replace({listed}, '\\n', ' '), chr(10), ' ')"
    return f"coalesce({S.collapse_sql(nl)}, '')"


def assemble_sql(cols: list[str]) -> str:
    return "concat_ws(' ', " + ", ".join(f"nullif({clean_value_sql(c)}, '')" for c in cols) + ")"


def _bounded_ci(expr: str, word: str) -> str:
    return f"regexp_matches({expr}, '(?i)(^|[^{WORD}]){S.re2_escape(word)}($|[^{WORD}])')"


def title_override_sql(t: str) -> str:
    e = f"coalesce({t}, '')"
    whens = " ".join(f"WHEN {_bounded_ci(e, w)} THEN '{lvl}'" for w, lvl in tx.TITLE_LEVEL_RULES)
    return f"CASE {whens} END"


_AT_LEAST = f"(?i)at least[{SPACE}]+([0-9]+)[{SPACE}]*year"
_RANGE = f"(?i)([0-9]+)[{SPACE}]*to[{SPACE}]*([0-9]+)[{SPACE}]*years?"


def min_years_sql(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL OR {x} = '' THEN NULL "
            f"WHEN regexp_matches({x}, '{_AT_LEAST}') THEN CAST(regexp_extract({x}, '{_AT_LEAST}', 1) AS DOUBLE) "
            f"WHEN regexp_matches({x}, '{_RANGE}') THEN CAST(regexp_extract({x}, '{_RANGE}', 1) AS DOUBLE) END")


def bucket_sql(y: str) -> str:
    return (f"CASE WHEN {y} IS NULL THEN NULL WHEN {y} < 1 THEN 'intern' WHEN {y} <= 2 THEN 'junior' "
            f"WHEN {y} <= 5 THEN 'middle' ELSE 'senior' END")


def level_sql(t: str, x: str) -> str:
    return f"coalesce({title_override_sql(t)}, {bucket_sql(min_years_sql(x))}, 'middle')"


_TITLE_VALUES = "title_category(title_key, category) AS (VALUES " + ", ".join(
    f"('{k}', '{v}')" for k, v in sorted(tx.TITLE_CATEGORY.items())) + ")"

_TEXT_COLS = tx.RAW_TEXT_COLUMNS

TAGGED_SQL = S.with_(
    S.RAW_RESUME,
    _TITLE_VALUES,
    "d AS (SELECT DISTINCT * FROM raw_resume)",
    f"""t AS (
  SELECT d.*, {assemble_sql(_TEXT_COLS)} AS text, tc.category
  FROM d LEFT JOIN title_category tc ON tc.title_key = {S.normalize_title_sql('d.job_position_name')})""",
    f"""tagged AS (
  SELECT *,
    CASE WHEN length(text) < {tx.MIN_TEXT_LENGTH} THEN 'short_text'
         WHEN category IS NULL THEN 'title_outside_taxonomy'
         WHEN NOT coalesce(matched_score >= {tx.MIN_MATCHED_SCORE}, false) THEN 'low_matched_score' END AS step,
    {level_sql('job_position_name', 'experiencere_requirement')} AS level,
    ({title_override_sql('job_position_name')}) IS NULL AND ({min_years_sql('experiencere_requirement')}) IS NULL AS level_fallback
  FROM t)""",
    "ds AS (SELECT DISTINCT text, category, level FROM tagged WHERE step IS NULL)",
)

# ------------------------------------------------------------- Spark inputs


def _raw(spark, sf_dir):
    return standins.raw_resume(spark, sf_dir)


def _tagged(spark, sf_dir):
    return C.tag_rows(_raw(spark, sf_dir))


_RAW_COLS = ["career_objective", "skills", "major_field_of_studies", "positions", "responsibilities",
             "job_position_name", "experiencere_requirement", "matched_score"]


@query("scan_raw", sql=S.with_(S.RAW_RESUME) + "SELECT * FROM raw_resume")
def q_scan_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows written as a quoted multi-line CSV with other columns among
    them, in another order and with a BOM on one name, then read back by name."""
    path = scratch_path(spark, "raw_resume_csv")
    raw = _raw(spark, sf_dir)
    mixed = raw.select(F.lit("x, y").alias("address"), *reversed(_RAW_COLS), F.lit("N/A").alias("passing_years"))
    C.write_raw_csv(mixed.withColumnRenamed("job_position_name", "\ufeffjob_position_name"), path)
    return C.read_raw_csv(spark, path).select(*_RAW_COLS)


@query("dedup_rows", sql=S.with_(S.RAW_RESUME) + "SELECT DISTINCT * FROM raw_resume")
def q_dedup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct over all raw columns."""
    return _raw(spark, sf_dir).dropDuplicates()


@query("parse_list", sql=S.with_(S.RAW_RESUME) + f"""SELECT skills AS value,
  CASE WHEN {_is_list_sql('skills')} THEN {_items_sql('skills')} END AS items FROM raw_resume
UNION ALL SELECT positions, CASE WHEN {_is_list_sql('positions')} THEN {_items_sql('positions')} END FROM raw_resume
UNION ALL SELECT responsibilities, CASE WHEN {_is_list_sql('responsibilities')} THEN {_items_sql('responsibilities')} END FROM raw_resume""")
def q_parse_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """list literals of the list-valued raw columns parsed to arrays (null when not a list)."""
    raw = _raw(spark, sf_dir)
    parts = [raw.select(F.col(c).alias("value"), parse_list_literal(c).alias("items"))
             for c in ("skills", "positions", "responsibilities")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _edge_lists_sql() -> str:
    """Values and, built beside them, the items that they spell."""
    lang, src, n = "lang", "source", "CAST(n_chars AS VARCHAR)"
    shapes = [
        (f"concat('[''', {lang}, ', None'', ''', {src}, ''']')", f"[concat({lang}, ', None'), {src}]"),
        (f"concat('[''', {lang}, ''',]')", f"[{lang}]"),
        (f"concat('[\"', {lang}, '''s\", ''', {src}, ''']')", f"[concat({lang}, '''s'), {src}]"),
        (f"concat('[''', {lang}, '''] tail]')", "NULL"),
        (f"concat('[True, ', {n}, ', None]')", f"['True', {n}]"),
        (f"concat('[''', {lang}, ''' ''', {src}, ''']')", f"[concat({lang}, {src})]"),
        (f"concat('[[''', {lang}, '''], ''', {src}, ''']')", f"[concat('[''', {lang}, ''']'), {src}]"),
        ("'[]'", "[]::VARCHAR[]"),
    ]
    case = lambda k: "CASE n_chars % 8 " + " ".join(f"WHEN {i} THEN {s[k]}" for i, s in enumerate(shapes)) + " END"
    return f"SELECT doc_id, {case(0)} AS value, {case(1)} AS items FROM documents"


@query("parse_list_edge", sql=_edge_lists_sql())
def q_parse_list_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F15 on unusual literals: commas and None inside quotes, trailing commas,
    other quotes, tails, other values, adjacent strings, nested and empty lists."""
    d = read(spark, sf_dir, "documents", "doc_id", "lang", "source", "n_chars")
    lang, src, n = F.col("lang"), F.col("source"), F.col("n_chars")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    shapes = [text("['", lang, ", None', '", src, "']"), text("['", lang, "',]"), text('["', lang, "'s\", '", src, "']"), text("['", lang, "'] tail]"),
              text("[True, ", n.cast("string"), ", None]"), text("['", lang, "' '", src, "']"), text("[['", lang, "'], '", src, "']"), F.lit("[]")]
    value = F.element_at(F.array(*shapes), (n % 8 + 1).cast("int"))
    return d.select("doc_id", value.alias("value")).select("doc_id", "value", parse_list_literal("value").alias("items"))


@query("report_text")
def q_report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 + A6: the report as markdown lines, written as text and read back."""
    raw = _raw(spark, sf_dir)
    tagged = materialize(C.tag_rows(raw))
    path = scratch_path(spark, "report")
    write_report(Q.report(raw, tagged, C.dataset(tagged)), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("assemble_text", sql=S.with_(S.RAW_RESUME) + f"""SELECT {clean_value_sql('skills')} AS skills_clean,
  {clean_value_sql('responsibilities')} AS responsibilities_clean, {assemble_sql(_TEXT_COLS)} AS text FROM raw_resume""")
def q_assemble_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16 + F17: cleaned values and the assembled text of every raw row."""
    raw = _raw(spark, sf_dir)
    return C.with_text(raw).select(clean_value("skills").alias("skills_clean"),
                                   clean_value("responsibilities").alias("responsibilities_clean"), "text")


@query("filter_short", sql=S.with_(S.RAW_RESUME) + f"""SELECT text FROM (SELECT {assemble_sql(_TEXT_COLS)} AS text FROM raw_resume)
WHERE length(text) >= {tx.MIN_TEXT_LENGTH}""")
def q_filter_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: assembled texts of at least 20 characters."""
    return C.with_text(_raw(spark, sf_dir)).filter(F.length("text") >= tx.MIN_TEXT_LENGTH).select("text")


@query("detect_category", sql=S.with_(S.RAW_RESUME, _TITLE_VALUES) + f"""SELECT r.job_position_name,
  {S.normalize_title_sql('r.job_position_name')} AS title_key, tc.category
FROM raw_resume r LEFT JOIN title_category tc ON tc.title_key = {S.normalize_title_sql('r.job_position_name')}""")
def q_detect_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 + F10: category of every raw title (null outside the taxonomy)."""
    raw = _raw(spark, sf_dir).select("job_position_name")
    return C.detect_category(raw).select("job_position_name", normalize_title("job_position_name").alias("title_key"),
                                         "category")


@query("parse_years", sql=S.with_(S.RAW_RESUME) + f"""SELECT experiencere_requirement,
  {min_years_sql('experiencere_requirement')} AS min_years,
  {bucket_sql(min_years_sql('experiencere_requirement'))} AS years_level FROM raw_resume""")
def q_parse_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11 + F12: minimum years of every experience requirement and its level bucket."""
    raw = _raw(spark, sf_dir).select("experiencere_requirement")
    y = parse_min_years("experiencere_requirement")
    return raw.select("experiencere_requirement", y.alias("min_years"), bucket_by_years(y).alias("years_level"))


@query("detect_level", sql=S.with_(S.RAW_RESUME) + f"""SELECT job_position_name, experiencere_requirement,
  {title_override_sql('job_position_name')} AS title_level,
  {level_sql('job_position_name', 'experiencere_requirement')} AS level FROM raw_resume""")
def q_detect_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13 + F14: title-word override, else years bucket, else 'middle'."""
    from jobtext.functions.text import title_override

    raw = _raw(spark, sf_dir).select("job_position_name", "experiencere_requirement")
    return raw.select("job_position_name", "experiencere_requirement",
                      title_override("job_position_name").alias("title_level"),
                      detect_level("job_position_name", "experiencere_requirement").alias("level"))


@query("curate_dataset", sql=TAGGED_SQL + "SELECT * FROM ds")
def q_curate_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3 (P6, P7, P9, U3) + S3: the curated (text, category, level) set, written and read back."""
    path = scratch_path(spark, "curated")
    write_table(C.dataset(_tagged(spark, sf_dir)), path)
    return spark.read.parquet(path)


@query("missing_values", sql=S.with_(S.RAW_RESUME) + "SELECT column_name, missing, "
       "CASE WHEN n > 0 THEN floor((missing * 2000 + n) / (2 * n)) / 10.0 ELSE 0.0 END AS missing_pct FROM ("
       + " UNION ALL ".join(
           f"SELECT '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS missing, count(*) AS n FROM raw_resume"
           for c in Q.REPORT_COLUMNS) + ")")
def q_missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: nulls per key raw column and their percentage."""
    return Q.missing_values(_raw(spark, sf_dir))


@query("score_stats", sql=S.with_(S.RAW_RESUME) + """SELECT round(avg(matched_score), 4) AS mean,
  round(stddev_samp(matched_score), 4) AS std, round(min(matched_score), 4) AS min, round(max(matched_score), 4) AS max
FROM raw_resume""")
def q_score_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: matched_score statistics of the raw table."""
    return Q.score_stats(_raw(spark, sf_dir))


@query("class_distribution", sql=TAGGED_SQL + """SELECT 'category' AS kind, category AS value, count(*) AS n FROM ds GROUP BY category
UNION ALL SELECT 'level', level, count(*) FROM ds GROUP BY level""")
def q_class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: category and level counts of the curated set."""
    return Q.class_distribution(C.dataset(_tagged(spark, sf_dir)))


_CATS = "cats(category) AS (VALUES " + ", ".join(f"('{c}')" for c in tx.CATEGORIES) + ")"


@query("missing_categories", sql=TAGGED_SQL.replace("WITH ", f"WITH {_CATS},\n", 1)
       + "SELECT category FROM cats WHERE category NOT IN (SELECT category FROM ds)")
def q_missing_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 + U5: taxonomy categories absent from the curated set."""
    return Q.missing_categories(C.dataset(_tagged(spark, sf_dir)))


@query("level_fallback", sql=TAGGED_SQL + """SELECT job_position_name, count(*) AS n FROM tagged
WHERE step IS NULL AND level_fallback AND job_position_name IS NOT NULL GROUP BY job_position_name""")
def q_level_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles whose level fell back to 'middle', with row counts."""
    return Q.level_fallback(_tagged(spark, sf_dir))


_FUNNEL_SQL = TAGGED_SQL + """, c AS (
  SELECT (SELECT count(*) FROM raw_resume) AS raw_rows, (SELECT count(*) FROM tagged) AS distinct_rows,
         (SELECT count(*) FROM tagged WHERE step = 'short_text') AS short_text,
         (SELECT count(*) FROM tagged WHERE step = 'title_outside_taxonomy') AS title_outside_taxonomy,
         (SELECT count(*) FROM tagged WHERE step = 'low_matched_score') AS low_matched_score,
         (SELECT count(*) FROM tagged WHERE step IS NULL) AS kept_rows, (SELECT count(*) FROM ds) AS final_rows),
f AS (
  SELECT 0 AS step_order, 'duplicate_rows' AS step, raw_rows - distinct_rows AS dropped FROM c
  UNION ALL SELECT 1, 'short_text', short_text FROM c
  UNION ALL SELECT 2, 'title_outside_taxonomy', title_outside_taxonomy FROM c
  UNION ALL SELECT 3, 'low_matched_score', low_matched_score FROM c
  UNION ALL SELECT 4, 'duplicate_dataset_rows', kept_rows - final_rows FROM c)
"""


@query("drop_funnel", sql=_FUNNEL_SQL + "SELECT CAST(step_order AS INTEGER) AS step_order, step, CAST(dropped AS BIGINT) AS dropped FROM f WHERE dropped > 0")
def q_drop_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 + A9: rows lost per curation step, in order, zero steps omitted."""
    raw = _raw(spark, sf_dir)
    tagged = materialize(C.tag_rows(raw))  # every count below reads it
    return Q.drop_funnel(raw, tagged, C.dataset(tagged))


@query("training_clean", sql=TAGGED_SQL + f"""SELECT text, category, level FROM (
  SELECT regexp_replace(text, '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS text, category, level FROM ds
  WHERE text IS NOT NULL AND category IS NOT NULL AND level IS NOT NULL) WHERE length(text) >= {tx.MIN_TRAIN_TEXT_LENGTH}""")
def q_training_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curated set cleaned for training (required columns, nulls, strip, length >= 10)."""
    return C.clean_training_set(C.dataset(_tagged(spark, sf_dir)))


@query("union_sources", sql=TAGGED_SQL.replace("WITH ", "WITH " + S.LABELLED_TEXTS + ",\n", 1)
       + "SELECT text, category, level FROM ds UNION ALL SELECT text, category, level FROM labelled_texts")
def q_union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 + U1: curated rows and a second labelled set combined by column name."""
    ds = C.dataset(_tagged(spark, sf_dir))
    other = standins.labelled_texts(spark, sf_dir).select("text", "category", "level")
    return ds.unionByName(other)


def _pct_sql(num: str, den: str) -> str:
    return f"printf('%.1f', CASE WHEN {den} > 0 THEN floor(({num} * 2000 + {den}) / (2 * {den})) / 10.0 ELSE 0.0 END)"


_REPORT_SQL = _FUNNEL_SQL.replace("WITH ", f"WITH {_CATS},\n", 1) + f""", mv AS (
  """ + " UNION ALL ".join(
    f"SELECT '{c}' AS key, count(*) FILTER (WHERE {c} IS NULL) AS m, count(*) AS n FROM raw_resume"
    for c in Q.REPORT_COLUMNS) + f"""),
st AS (SELECT round(avg(matched_score), 4) AS mean, round(stddev_samp(matched_score), 4) AS std,
              round(min(matched_score), 4) AS min, round(max(matched_score), 4) AS max FROM raw_resume)
SELECT 'summary' AS section, 'raw_rows' AS key, CAST(raw_rows AS VARCHAR) AS value FROM c
UNION ALL SELECT 'summary', 'duplicate_rows', CAST(raw_rows - distinct_rows AS VARCHAR) FROM c
UNION ALL SELECT 'summary', 'final_rows', CAST(final_rows AS VARCHAR) FROM c
UNION ALL SELECT 'summary', 'retention_pct', {_pct_sql('final_rows', 'raw_rows')} FROM c
UNION ALL SELECT 'summary', 'categories', CAST((SELECT count(DISTINCT category) FROM ds) AS VARCHAR)
UNION ALL SELECT 'summary', 'levels', CAST((SELECT count(DISTINCT level) FROM ds) AS VARCHAR)
UNION ALL SELECT 'missing_values', key, CAST(m AS VARCHAR) || ' (' || {_pct_sql('m', 'n')} || '%)' FROM mv
UNION ALL SELECT 'drop_funnel', step, '-' || CAST(dropped AS VARCHAR) FROM f WHERE dropped > 0
UNION ALL SELECT 'matched_score', 'mean', CAST(mean AS VARCHAR) FROM st
UNION ALL SELECT 'matched_score', 'std', CAST(std AS VARCHAR) FROM st
UNION ALL SELECT 'matched_score', 'min', CAST(min AS VARCHAR) FROM st
UNION ALL SELECT 'matched_score', 'max', CAST(max AS VARCHAR) FROM st
UNION ALL SELECT 'category_distribution', category, CAST(count(*) AS VARCHAR) FROM ds GROUP BY category
UNION ALL SELECT 'level_distribution', level, CAST(count(*) AS VARCHAR) FROM ds GROUP BY level
UNION ALL SELECT 'missing_categories', category, '' FROM cats WHERE category NOT IN (SELECT category FROM ds)
UNION ALL SELECT 'level_fallback', job_position_name, CAST(count(*) AS VARCHAR) || ' rows' FROM tagged
  WHERE step IS NULL AND level_fallback AND job_position_name IS NOT NULL GROUP BY job_position_name
UNION ALL SELECT 'level_fallback', 'total', CAST(count(*) AS VARCHAR) || ' rows' FROM tagged
  WHERE step IS NULL AND level_fallback AND job_position_name IS NOT NULL HAVING count(*) > 0"""


@query("quality_report", sql=_REPORT_SQL)
def q_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 + A8: the data-quality report as (section, key, value) rows."""
    raw = _raw(spark, sf_dir)
    tagged = materialize(C.tag_rows(raw))  # every section below reads it
    return Q.report(raw, tagged, C.dataset(tagged)).select("section", "key", "value")
