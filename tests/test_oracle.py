"""Every query with an oracle agrees with DuckDB at sf0.001 (fast subset at sf0.01)."""

import pytest

from conftest import SF001, SMOKE
from jobtext.plans import ORACLE
from oracle_check import compare, duck

SLOW = {"nb_predict"}


@pytest.fixture(scope="module")
def con_smoke():
    return duck(SMOKE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle_smoke(spark, con_smoke, name):
    res = compare(spark, name, SMOKE, con_smoke, verbose=True)
    assert res["ok"], res


@pytest.mark.parametrize("name", ["match_pairs", "curate_dataset", "cache_flags", "tfidf", "feedback_upsert"])
def test_oracle_sf001(spark, name):
    res = compare(spark, name, SF001, verbose=True)
    assert res["ok"], res


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
