"""DuckDB twins of ``jobtext.sources.standins`` plus SQL helpers for oracles.

Each constant is a CTE body (``name AS (...)``) over the driver views.
"""

from __future__ import annotations

from jobtext.sources.standins import TITLES

LEVEL_OF_LENGTH = (
    "CASE WHEN n_chars < 900 THEN 'intern' WHEN n_chars < 1500 THEN 'junior' "
    "WHEN n_chars < 2700 THEN 'middle' ELSE 'senior' END"
)
DEC_CONFIDENCE = "CAST(CAST(500 + n_chars % 500 AS DECIMAL(12,0)) * 0.001 AS DECIMAL(12,4))"

LABELLED_TEXTS = f"""labelled_texts AS (
  SELECT doc_id AS text_id, text, lang AS category, {LEVEL_OF_LENGTH} AS level,
         {DEC_CONFIDENCE} AS confidence
  FROM documents)"""

MATCH_REQUESTS = """match_requests AS (
  SELECT r.doc_id AS pair_id, r.source AS user_id, r.doc_id AS resume_id, r.text AS resume_text,
         v.doc_id AS vacancy_id, v.text AS vacancy_text,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(r.doc_id) AS created_at
  FROM documents r JOIN documents v ON v.doc_id = (r.doc_id + 1) % (SELECT max(doc_id) + 1 FROM documents))"""


def _sql_str(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


_TITLE_LIST = "[" + ", ".join(_sql_str(t) for t in TITLES) + "]"

RAW_RESUME = f"""raw_resume AS (
  SELECT text AS career_objective,
         CASE WHEN n_chars % 6 = 0 THEN '[''' || lang || ''', None]'
              ELSE '[''' || lang || ''', ''' || source || ''']' END AS skills,
         CASE WHEN n_chars % 3 <> 0 THEN 'Studies ' || lang END AS major_field_of_studies,
         CASE WHEN n_chars % 4 <> 0 THEN '[''' || source || ' position'']' END AS positions,
         'Duty one\\nDuty ' || source AS responsibilities,
         ({_TITLE_LIST})[CAST(substr(source, 4, 10) AS INTEGER) % {len(TITLES)} + 1] AS job_position_name,
         CASE WHEN n_chars % 5 = 0 THEN 'At least ' || CAST(n_chars % 9 AS VARCHAR) || ' years'
              WHEN n_chars % 5 = 1 THEN CAST(n_chars % 4 AS VARCHAR) || ' to ' || CAST(n_chars % 4 + 3 AS VARCHAR) || ' years'
              WHEN n_chars % 5 = 3 THEN 'at least 1 year'
              WHEN n_chars % 5 = 4 THEN 'Not specified' END AS experiencere_requirement,
         CASE WHEN n_chars % 17 <> 0 THEN (n_chars % 100) / 100.0 END AS matched_score
  FROM documents)"""

PREDICT_REQUESTS = """predict_requests AS (
  SELECT e.event_id AS seq, 'u' || CAST(e.user_id AS VARCHAR) AS user_id, d.text, e.ts
  FROM events e JOIN documents d
    ON d.doc_id = e.event_id % (SELECT max(doc_id) + 1 FROM documents))"""

PREDICTION_HISTORY = f"""prediction_history AS (
  SELECT 'p' || CAST(e.event_id AS VARCHAR) AS id, 'u' || CAST(e.user_id AS VARCHAR) AS user_id,
         d.lang AS category, {LEVEL_OF_LENGTH.replace('n_chars', 'd.n_chars')} AS level,
         CAST({DEC_CONFIDENCE.replace('n_chars', 'd.n_chars')} AS DOUBLE) AS confidence,
         e.event_type = 'view' AS cached, 'v1' AS model_version, e.ts AS created_at
  FROM events e JOIN documents d
    ON d.doc_id = e.event_id % (SELECT max(doc_id) + 1 FROM documents))"""

FEEDBACK_EVENTS = """feedback_events AS (
  SELECT event_id AS seq, 'p' || CAST(event_id - event_id % 3 AS VARCHAR) AS prediction_id,
         'u' || CAST(user_id AS VARCHAR) AS user_id,
         CASE WHEN event_id % 5 <> 0 THEN (['backend', 'frontend', 'data_science', 'analytics'])[event_id % 4 + 1] END AS correct_category,
         CASE WHEN event_id % 7 <> 0 THEN (['intern', 'junior', 'middle', 'senior'])[event_id % 4 + 1] END AS correct_level,
         CASE WHEN value > 40 THEN 'comment ' || CAST(event_id AS VARCHAR) END AS comment,
         ts
  FROM events WHERE event_type = 'click')"""

REGISTRATIONS = """registrations AS (
  SELECT event_id AS attempt_id, 'u' || CAST(user_id AS VARCHAR) AS user_id, 'user' || CAST(user_id AS VARCHAR) || '@mail.test' AS email, ts
  FROM events WHERE event_type = 'signup')"""

USERS = """users AS (
  SELECT 'u' || CAST(user_id AS VARCHAR) AS id, 'user' || CAST(user_id AS VARCHAR) || '@mail.test' AS email,
         user_id % 7 <> 0 AS is_active, min(ts) AS created_at
  FROM events GROUP BY user_id)"""

EVAL_PAIRS = """eval_pairs AS (
  SELECT l.doc_id, d.text, CAST(l.quality AS VARCHAR) AS true_label,
         CAST(1 - l.toxic AS VARCHAR) AS predicted_label
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""

# Shared class strings (RE2 and Java agree on these).
WORD_CHARS = r"\p{L}\p{N}_"
SPACE_CHARS = r"\t\n\x0b\x0c\r\x1c-\x1f\x85\p{Z}"


def re2_escape(s: str) -> str:
    return "".join(ch if (ch.isalnum() or ch in " _") else "\\" + ch for ch in s)


def bounded_sql(text_expr: str, literal: str) -> str:
    """DuckDB: literal occurs with no word character glued on either side."""
    pat = f"(^|[^{WORD_CHARS}]){re2_escape(literal)}($|[^{WORD_CHARS}])"
    return f"regexp_matches({text_expr}, '{pat}')"


def skills_sql(text_expr: str, dictionary: dict[str, list[str]]) -> str:
    """DuckDB: list of skill names found (dictionary order), by brute-force regex."""
    low = f"lower({text_expr})"
    parts = []
    for name, variants in dictionary.items():
        cond = " OR ".join(bounded_sql(low, v) for v in variants)
        parts.append(f"CASE WHEN {cond} THEN {_sql_str(name)} END")
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


def normalize_title_sql(expr: str) -> str:
    return f"lower(trim(regexp_replace(coalesce({expr}, ''), '[{SPACE_CHARS}]+', ' ', 'g')))"


def collapse_sql(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '[{SPACE_CHARS}]+', ' ', 'g'))"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
