"""Properties over the driver tables (sf0.01)."""

from pyspark.sql import functions as F

from conftest import SF001
from jobtext.plans import QUERIES


def test_skill_sets_partition_requirements(spark):
    m = QUERIES["match_pairs"](spark, SF001)
    bad = m.filter(
        (F.size("vacancy_skills") > 0)
        & (F.size(F.array_union("matched_skills", "missing_skills"))
           != F.size(F.array_distinct(F.transform("vacancy_skills", lambda s: F.lower(s)))))
    ).count()
    assert bad == 0
    assert m.filter((F.col("match_score") < 0) | (F.col("match_score") > 1)).count() == 0


def test_funnel_accounts_for_every_row(spark):
    from jobtext.operators import curate as C
    from jobtext.sources import standins

    raw = standins.raw_resume(spark, SF001)
    dropped = QUERIES["drop_funnel"](spark, SF001).agg(F.sum("dropped")).first()[0]
    final = C.curate(raw).count()
    assert raw.count() - dropped == final


def test_split_is_exact_and_disjoint(spark):
    sp = QUERIES["stratified_split"](spark, SF001)
    n = sp.count()
    t = sp.filter("is_test").count()
    assert t == -(-n // 5)
    per = {r["lang"]: (r["n"], r["t"]) for r in sp.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).collect()}
    for n_c, t_c in per.values():
        assert abs(t_c - n_c * t / n) < 1


def test_confusion_sums_to_samples(spark):
    cm = QUERIES["confusion_matrix"](spark, SF001)
    total = sum(sum(v for k, v in r.asDict().items() if k != "true_label") for r in cm.collect())
    assert total == QUERIES["eval_metrics"](spark, SF001).first()["samples"]


def test_window_counts_are_complete(spark):
    rl = QUERIES["rate_limit"](spark, SF001)
    assert rl.filter(F.col("n") < 1).count() == 0
    per_window = rl.groupBy("user_id", "window_start").agg(F.max("n").alias("m"), F.count(F.lit(1)).alias("c"))
    assert per_window.filter(F.col("m") != F.col("c")).count() == 0
