"""J3 by a dictionary table: equal to the dictionary in the plan, and a plan that does not grow."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SMOKE
from jobtext import taxonomy as tx
from jobtext.operators import skills as J
from jobtext.sources import standins

ODD = ["c++ and c#, node.js/rest api", "c++x", "xc++", "c++ ", "node.jsx", "rest  api", "rest api", "REST API.", "ci/cd", "", None, "Node.js", ".net", "a.net", "asp.net", "c", "r", "über go", "go_lang", "go-lang", "c+", "c+++", "\nc++\n"]


@pytest.mark.parametrize("most", [J.MAX_SPELLINGS, 3])
def test_equals_the_plan_dictionary(spark, monkeypatch, most):
    monkeypatch.setattr(J, "MAX_SPELLINGS", most)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(None, "java")], "doc_id long, text string")
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text")
    for dictionary in (tx.SKILLS_DICTIONARY, standins.CORPUS_SKILLS, {"plus": ["c++", "+"], "net": [".net", "."], "x": ["é", "a b", "#"]}):
        table = spark.createDataFrame([(n, v) for n, vs in dictionary.items() for v in [*vs, vs[0], ""]], "name string, spelling string")
        df = rows.unionByName(docs)
        got = {r.doc_id: r.skills for r in J.extract_skills_by_table(df, table).collect()}
        want = {r.doc_id: sorted(r.skills) for r in J.extract_skills(df, dictionary=dictionary).where("text is not null").collect()}
        assert got == want | {ODD.index(None): []}


def test_many_spellings(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(20_000)]
    spellings = [" ".join(rng.sample(words, rng.randrange(1, 4))) for _ in range(100_000)]
    texts = [" ".join(rng.choices(words, k=200)) + " " + rng.choice(spellings) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = set(spellings)
    grams = lambda w: {" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)}
    table = spark.createDataFrame([(x, x) for x in spellings], "name string, spelling string")
    out = J.extract_skills_by_table(df, table)
    assert {r.doc_id: r.skills for r in out.collect()} == {i: sorted(grams(t.split()) & known) for i, t in enumerate(texts)}
    size = lambda d: len(d._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(out) - size(J.extract_skills_by_table(df, table.limit(5)))) < 200
