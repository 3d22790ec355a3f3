"""Plan shape checks for the scale claims in the README."""

from conftest import SF001
from jobtext.plans import QUERIES


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_limit_before_shuffle(spark):
    plan = _plan(QUERIES["history_page"](spark, SF001))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_text_scan_reads_only_needed_columns(spark):
    plan = _plan(QUERIES["extract_skills"](spark, SF001))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_skill_extraction_has_no_shuffle_on_split_input(spark):
    from jobtext.operators.skills import extract_skills

    d = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").repartition(8)
    plan = _plan(extract_skills(d))
    # only the test's own repartition exchange: extraction itself is row-local
    assert plan.count("Exchange") == 1
    assert plan.count("regexp_extract_all") == 1


def test_split_joins_by_broadcast_only(spark):
    """is_test is a comparison within the row: the texts of the frame meet only
    the broadcast cuts, no shuffle join."""
    from jobtext.operators.evaluate import stratified_split

    d = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text", "lang")
    plan = _plan(stratified_split(d, "lang", "doc_id"))
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "BroadcastHashJoin" in plan


def test_cluster_session_without_shared_folder_is_an_error(spark):
    from types import SimpleNamespace

    import pytest

    from jobtext.session import shared_dir

    class Cluster:
        conf = SimpleNamespace(get=lambda key, default=None: {"spark.master": "spark://host:7077"}.get(key, default))

        @property
        def sparkContext(self):
            raise RuntimeError("no handle")

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Cluster())
