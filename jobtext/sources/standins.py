"""Stand-in inputs built from the driver tables.

The driver ships generic tables (``documents``, ``events``, ``labels`` …),
not resumes, requests or histories.  These builders only reshape driver
rows into the schemas the jobs expect; they do none of a job's work.  Every
job is written against the schema, not against how these rows are made.

Each builder has a DuckDB twin in ``jobtext.plans.standin_sql`` so the
oracle sees identical input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtext.sources.tables import read

# Stand-in parameter: a dictionary of words that are frequent in the driver's
# invented prose (the real skill dictionary hits almost nothing there).  It
# exercises both the token path and the phrase path of skill extraction.
CORPUS_SKILLS: dict[str, list[str]] = {
    "Und": ["und"],
    "Von": ["von", "von der"],
    "Mit": ["mit"],
    "Die": ["die"],
    "Der": ["der"],
    "Den": ["den"],
    "Est": ["est"],
    "Une": ["une"],
    "Pour": ["pour", "pour la"],
    "Du": ["du"],
    "Les": ["les"],
    "Only": ["only"],
    "Le": ["le"],
    "Et": ["et", "et le"],
    "REST": ["rest", "rest api"],
    "Dans": ["dans"],
}

# Stand-in job titles, indexed by the number in documents.source ('srcN').
TITLES: list[str | None] = [
    "Senior Software Engineer",
    "  database administrator (DBA) ",
    "DevOps Engineer",
    "Full Stack Developer (Python,React js)",
    "AI Engineer",
    "Machine Learning (ML) Engineer",
    "Data  Engineer",
    "Data Science Engineer",
    "Intern (Generative AI Engineering - 2D/3D Image Generation)",
    "Senior iOS Engineer",
    "Lead Data Engineer",
    "Business Analyst",
    "Trainee Accountant",
    "Head of Marketing",
    "Principal Architect",
    "Sales Manager",
    None,
    "data engineer",
    "Graphic Designer",
    "Senior  Software  Engineer",
]

T0 = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"


def level_of_length(n):
    return (F.when(n < 900, "intern").when(n < 1500, "junior").when(n < 2700, "middle")
            .otherwise("senior"))


def dec_confidence(n):
    """A 4-decimal confidence in [0.5, 1.0) from n_chars (stand-in value)."""
    return ((F.lit(500) + n % 500).cast("decimal(12,0)") * F.lit("0.001").cast("decimal(4,3)")).cast("decimal(12,4)")


def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(text_id, text, category, level, confidence): documents with given labels."""
    d = read(spark, sf_dir, "documents", "doc_id", "text", "lang", "n_chars")
    return d.select(
        F.col("doc_id").alias("text_id"), "text", F.col("lang").alias("category"),
        level_of_length(F.col("n_chars")).alias("level"), dec_confidence(F.col("n_chars")).alias("confidence"),
    )


def match_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, user_id, resume_id, resume_text, vacancy_id, vacancy_text, created_at):
    each document is a resume paired with the following document as vacancy,
    the last with the first."""
    d = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    r = d.select(F.col("doc_id").alias("resume_id"), F.col("source").alias("user_id"), F.col("text").alias("resume_text"))
    v = d.select(F.col("doc_id").alias("vacancy_id"), F.col("text").alias("vacancy_text"))
    after = F.pmod(F.col("resume_id") + 1, doc_count(spark, sf_dir).scalar())
    j = r.withColumn("vacancy_id", after).join(v, "vacancy_id")
    return j.select(
        F.col("resume_id").alias("pair_id"), "user_id", "resume_id", "resume_text", "vacancy_id", "vacancy_text",
        F.expr(f"timestampadd(MINUTE, resume_id, {T0})").alias("created_at"),
    )


def raw_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw resume rows (the curation input schema) from documents."""
    d = read(spark, sf_dir, "documents", "text", "lang", "source", "n_chars")
    n = F.col("n_chars")
    src = F.substring("source", 4, 10).cast("int")
    title = F.element_at(F.array(*[F.lit(t) for t in TITLES]), (src % len(TITLES)) + 1)
    q = F.lit("'")
    skills = F.when(n % 6 == 0, F.concat(F.lit("['"), F.col("lang"), F.lit("', None]"))) \
        .otherwise(F.concat(F.lit("['"), F.col("lang"), q, F.lit(", "), q, F.col("source"), F.lit("']")))
    exp = (
        F.when(n % 5 == 0, F.concat(F.lit("At least "), (n % 9).cast("string"), F.lit(" years")))
        .when(n % 5 == 1, F.concat((n % 4).cast("string"), F.lit(" to "), (n % 4 + 3).cast("string"), F.lit(" years")))
        .when(n % 5 == 3, F.lit("at least 1 year"))
        .when(n % 5 == 4, F.lit("Not specified"))
    )
    return d.select(
        F.col("text").alias("career_objective"),
        skills.alias("skills"),
        F.when(n % 3 != 0, F.concat(F.lit("Studies "), F.col("lang"))).alias("major_field_of_studies"),
        F.when(n % 4 != 0, F.concat(F.lit("['"), F.col("source"), F.lit(" position']"))).alias("positions"),
        F.concat(F.lit("Duty one\\nDuty "), F.col("source")).alias("responsibilities"),
        title.alias("job_position_name"),
        exp.alias("experiencere_requirement"),
        F.when(n % 17 != 0, (n % 100) / F.lit(100.0)).alias("matched_score"),
    )


def doc_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents", "doc_id").agg((F.max("doc_id") + 1).alias("n_docs"))


def predict_requests(spark: SparkSession, sf_dir: str, seqs: DataFrame | None = None) -> DataFrame:
    """(seq, user_id, text, ts): the event log as prediction requests; the
    request text is a document picked by the event id. With ``seqs`` (seq),
    the requests of these alone, picked before texts are joined."""
    e = read(spark, sf_dir, "events", "event_id", "user_id", "ts")
    if seqs is not None:
        e = e.join(seqs.select(F.col("seq").alias("event_id")), "event_id", "left_semi")
    d = read(spark, sf_dir, "documents", "doc_id", "text")
    e = e.withColumn("doc_id", F.pmod("event_id", doc_count(spark, sf_dir).scalar()))
    return e.join(d, "doc_id").select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
        "text", "ts",
    )


def prediction_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction history rows (id, user_id, category, level, confidence,
    cached, model_version, created_at) from the event log and documents."""
    e = read(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    d = read(spark, sf_dir, "documents", "doc_id", "lang", "n_chars")
    e = e.withColumn("doc_id", F.pmod("event_id", doc_count(spark, sf_dir).scalar()))
    j = e.join(d, "doc_id")
    return j.select(
        F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
        F.col("lang").alias("category"),
        level_of_length(F.col("n_chars")).alias("level"),
        dec_confidence(F.col("n_chars")).cast("double").alias("confidence"),
        (F.col("event_type") == "view").alias("cached"),
        F.lit("v1").alias("model_version"),
        F.col("ts").alias("created_at"),
    )


def feedback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback submissions from click events; several clicks may address the
    same prediction, some address another user's prediction."""
    e = read(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type", "value")
    e = e.filter(F.col("event_type") == "click")
    i = F.col("event_id")
    cats = F.array(*[F.lit(c) for c in ["backend", "frontend", "data_science", "analytics"]])
    lvls = F.array(*[F.lit(c) for c in ["intern", "junior", "middle", "senior"]])
    return e.select(
        i.alias("seq"),
        F.concat(F.lit("p"), (i - i % 3).cast("string")).alias("prediction_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
        F.when(i % 5 != 0, F.element_at(cats, (i % 4 + 1).cast("int"))).alias("correct_category"),
        F.when(i % 7 != 0, F.element_at(lvls, (i % 4 + 1).cast("int"))).alias("correct_level"),
        F.when(F.col("value") > 40, F.concat(F.lit("comment "), i.cast("string"))).alias("comment"),
        F.col("ts").alias("ts"),
    )


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(attempt_id, user_id, email, ts): signup events as registration attempts."""
    e = read(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type").filter(F.col("event_type") == "signup")
    return e.select(
        F.col("event_id").alias("attempt_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
        F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@mail.test")).alias("email"),
        "ts",
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, email, is_active, created_at): one row per user of the event log."""
    e = read(spark, sf_dir, "events", "user_id", "ts")
    g = e.groupBy("user_id").agg(F.min("ts").alias("created_at"))
    return g.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"),
        F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@mail.test")).alias("email"),
        (F.col("user_id") % 7 != 0).alias("is_active"),
        "created_at",
    )


def eval_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, true_label, predicted_label): labelled documents; the
    prediction column is the complement of the toxicity flag."""
    lab = read(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    d = read(spark, sf_dir, "documents", "doc_id", "text")
    j = lab.join(d, "doc_id")
    return j.select(
        "doc_id", "text",
        F.col("quality").cast("string").alias("true_label"),
        (F.lit(1) - F.col("toxic")).cast("string").alias("predicted_label"),
    )


def arrivals(df: DataFrame, cuts: list) -> list[DataFrame]:
    """``df`` in parts that arrive one after the other: the rows below each cut
    of ``cuts`` (conditions, in turn), then the rest. Input of the stream jobs."""
    out, rest = [], F.lit(True)
    for cut in [*cuts, F.lit(True)]:
        out.append(df.filter(rest & cut))
        rest = rest & ~F.coalesce(cut, F.lit(False))
    return out
