"""J9 against scoring every pair; plans without products of rows."""

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest

from jobtext.operators import rank as R

SCHEMA = "text_id long, category string, level string, skills array<string>, confidence decimal(12,4), score double, rank string"
D = Decimal


def half_up(x):
    return x.quantize(D("0.0001"), ROUND_HALF_UP)


def brute(resumes, vacancies, k):
    norm = lambda s: {x.strip().lower() for x in s or [] if x and x.strip()}
    out = set()
    for ri, rc, rl, rs, rf in resumes:
        rows = []
        for vi, vc, vl, vs, vf in set((v[0], v[1], v[2], tuple(sorted(norm(v[3]))), v[4]) for v in vacancies):
            n, m = len(vs), len(norm(rs) & set(vs))
            s = D((20000 * m + n) // (2 * n)) / 10000 if n else D(0)
            base = D("0.6") * s + D("0.3") * (rc == vc and rc is not None) + D("0.1") * (rl == vl and rl is not None)
            rows.append((half_up(base * ((rf or D(0)) + (vf or D(0))) / 2), vf or D(0), vi, s))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2]))
        out |= {(ri, j, r[2], r[3], r[0]) for j, r in enumerate(rows[:k], 1)}
    return out


def rows(n, skills, seed, hot=0.3):
    rng = random.Random(seed)
    names = [f"S{i}" for i in range(skills)]
    out = []
    for i in range(n):
        s = ["S0", " s1 "] if rng.random() < hot else rng.sample(names, rng.randrange(0, min(6, skills)))
        out.append((i, rng.choice(["a", "b", None]), rng.choice(["x", "y", "z"]), rng.choice([s, s, s, None, [*s, ""]]), D(rng.randrange(1000, 10000)) / 10000))
    return out


def frame(spark, table):
    return spark.createDataFrame([(*r, 1.0, "") for r in table], SCHEMA).repartition(3)


@pytest.mark.parametrize("n,m,skills,k", [(60, 80, 8, 3), (40, 120, 30, 10), (10, 4, 5, 10), (30, 60, 3, 1)])
def test_equals_all_pairs(spark, n, m, skills, k):
    resumes, vacancies = rows(n, skills, n), rows(m, skills, m + 1)
    vacancies += [(1000 + i, *vacancies[0][1:]) for i in range(15)] + [vacancies[1]]
    got = R.rank_vacancies(frame(spark, resumes), frame(spark, vacancies), k).collect()
    assert {tuple(r) for r in got} == brute(resumes, vacancies, k) and len(got) == len({tuple(r) for r in got})


def test_empty_sides(spark):
    some = rows(5, 4, 1)
    assert R.rank_vacancies(frame(spark, some), frame(spark, some).limit(0), 3).count() == 0
    assert R.rank_vacancies(frame(spark, some).limit(0), frame(spark, some), 3).count() == 0
    bare = [(i, None, None, None, None) for i in range(4)]
    assert {tuple(r) for r in R.rank_vacancies(frame(spark, bare), frame(spark, bare), 2).collect()} == brute(bare, bare, 2)


def test_no_product_of_rows(spark):
    some = frame(spark, rows(30, 6, 2))
    plan = R.rank_vacancies(some, some, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan
    pairs = R._meeting(some.selectExpr("skills as resume_set").distinct(), R._by_rarity(some.selectExpr("skills as vacancy_set").where("size(vacancy_set) > 0").distinct()), R.SHARES[1], R.SHARES[0])
    text = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_first_round_can_settle(spark, monkeypatch):
    """Resumes with many full matches need no set that shares less."""
    seen = []
    real = R._meeting
    monkeypatch.setattr(R, "_meeting", lambda sets, rare, share, above: seen.append(share) or real(sets, rare, share, above))
    table = [(i, "a", "x", ["S1"], D("0.9")) for i in range(20)] + [(100 + i, "b", "y", ["S1", f"T{i}"], D("0.9")) for i in range(20)]
    R.rank_vacancies(frame(spark, table[:5]), frame(spark, table), 3).collect()
    assert seen == [R.SHARES[0]]


def test_joins_are_dealt_by_counted_rows(spark, monkeypatch):
    """Profiles that differ in confidence alone meet k vacancies for each skill share and relation to
    their labels, and the tasks of a join follow from the rows it makes."""
    monkeypatch.setattr(R, "ROWS_A_TASK", 50)
    made, real = [], R._first_of_group
    monkeypatch.setattr(R, "_first_of_group", lambda *args: made.append(real(*args)) or made[-1])
    resumes = [(i, "a", "x", ["S1", "S2"], D(1000 + i) / 10000) for i in range(30)] + rows(10, 5, 3)
    vacancies = [(i, "ab"[i % 2], "x", [["S1"], ["S2"], ["S1", "S2"]][i % 3], D(5000 + i) / 10000) for i in range(60)]
    got = R.rank_vacancies(frame(spark, resumes), frame(spark, vacancies), 2).collect()
    assert {tuple(r) for r in got} == brute(resumes, vacancies, 2)
    # of twenty vacancies that share all with the group, two of the label and two of the other
    one = made[0].groupBy("gid").count().agg({"count": "max"}).first()[0]
    assert 0 < one <= 4
