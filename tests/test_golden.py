"""Golden micro-tables derived from the rules (FIXTURES.md §3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from jobtext.functions import match as FM
from jobtext.functions import text as FT
from jobtext.operators import history as H
from jobtext.operators import windows as W
from jobtext.operators.skills import extract_skills


@pytest.mark.parametrize("skill,cat,lvl,rc,vc,expected", [
    (1.0, True, True, 0.9, 0.9, 0.9),
    (0.0, False, True, 0.9, 0.9, 0.09),
    (0.8, True, True, 0.9, 0.88, 0.7832),
    (0.6667, True, False, 0.7, 0.8, 0.525),
    (0.0, True, True, 1.0, 1.0, 0.4),
])
def test_match_score(spark, skill, cat, lvl, rc, vc, expected):
    df = spark.createDataFrame([(skill, cat, lvl, rc, vc)], "s double, c boolean, l boolean, rc double, vc double")
    got = df.select(FM.match_score(F.col("s"), F.col("c"), F.col("l"), F.col("rc"), F.col("vc")).cast("double")).first()[0]
    assert got == expected


def test_skill_match(spark):
    rows = [
        (["Python", "FastAPI", "PostgreSQL", "Redis", "Docker"], ["Python", "PostgreSQL", "Redis", "Kafka", "Docker"]),
        ([" SQL ", "sql", ""], []),
        ([], ["Go"]),
    ]
    df = spark.createDataFrame(rows, "r array<string>, v array<string>")
    cols = FM.skill_match_cols(F.col("r"), F.col("v"))
    out = df.select(*[c.alias(n) for n, c in cols.items()]).collect()
    assert out[0]["matched_skills"] == ["docker", "postgresql", "python", "redis"]
    assert out[0]["missing_skills"] == ["kafka"] and out[0]["extra_resume_skills"] == ["fastapi"]
    assert float(out[0]["skill_score"]) == 0.8
    assert out[1]["matched_skills"] == [] and out[1]["extra_resume_skills"] == ["sql"] and float(out[1]["skill_score"]) == 0
    assert out[2]["missing_skills"] == ["go"] and out[2]["matched_skills"] == [] and float(out[2]["skill_score"]) == 0


@pytest.mark.parametrize("text,skills", [
    ("postgresql", ["PostgreSQL"]),
    ("node.js", ["JavaScript", "Node.js"]),
    ("C++, C#", ["C++", "C#"]),
    ("xc++", []),
    ("яgo go", ["Go"]),
    ("яgo", []),
    ("the rest of it", ["REST API"]),
])
def test_skills(spark, text, skills):
    df = spark.createDataFrame([(text,)], "text string")
    assert extract_skills(df).first()["skills"] == skills


@pytest.mark.parametrize("title,exp,level", [
    ("Senior Software Engineer", None, "senior"),
    ("Intern (Generative AI Engineering - 2D/3D Image Generation)", "At least 5 years", "intern"),
    ("Data Engineer", "At least 5 years", "middle"),
    ("Data Engineer", "2 to 5 years", "junior"),
    ("Data Engineer", "At least 6 years", "senior"),
    ("Data Engineer", "1 year", "middle"),
    ("Senior Intern", None, "intern"),
])
def test_level(spark, title, exp, level):
    df = spark.createDataFrame([(title, exp)], "t string, e string")
    assert df.select(FT.detect_level("t", "e")).first()[0] == level


@pytest.mark.parametrize("value,cleaned", [
    ("['A', 'B']", "A, B"),
    ("['A', None]", "A"),
    ("['a'", "['a'"),
    (None, ""),
    ("x\\ny", "x y"),
    ("x\ny", "x y"),
])
def test_clean_value(spark, value, cleaned):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(FT.clean_value("v")).first()[0] == cleaned


def test_anchored_window_fixture(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, "u", t0 + dt.timedelta(seconds=s)) for i, s in enumerate([0, 30, 59, 60, 125])]
    df = spark.createDataFrame(rows, "id long, user string, ts timestamp_ntz")
    out = W.rate_limit(df, "user", "ts", "id", 60, 2).orderBy("id").collect()
    assert [r["n"] for r in out] == [1, 2, 3, 1, 1]
    assert [r["allowed"] for r in out] == [True, True, False, True, True]
    assert [(r["window_start"] - t0).seconds for r in out] == [0, 0, 0, 60, 125]


def test_feedback_upsert(spark):
    t1, t2 = dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 1, 11)
    df = spark.createDataFrame(
        [(1, "p1", "data_science", "middle", "a", t1), (2, "p1", None, "junior", None, t2)],
        "seq long, prediction_id string, correct_category string, correct_level string, comment string, ts timestamp_ntz")
    r = H.upsert_feedback(df).first()
    assert (r["correct_category"], r["correct_level"], r["comment"], r["created_at"]) == (None, "junior", None, t1)
