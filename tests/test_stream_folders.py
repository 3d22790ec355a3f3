"""Streams over tables that are one file and over tables that are folders of part files."""

from jobtext.plans.stream_queries import EVENTS_SCHEMA
from jobtext.streaming import stream as ST


def read_all(spark, folder, tmp_path, name):
    src = ST.file_stream(spark, str(folder), "events.parquet", EVENTS_SCHEMA)
    ST.run_available(src, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-ckpt"), "append")
    return sorted(r.event_id for r in spark.read.parquet(str(tmp_path / f"{name}-out")).collect())


def test_file_and_folder_tables(spark, tmp_path):
    one = spark.range(200).selectExpr("id as event_id", "timestamp_ntz'2024-01-01 00:00:00' as ts", "id as user_id", "'a' as event_type", "1.0D as value", "'' as props")
    one.repartition(5).write.parquet(str(tmp_path / "parts" / "events.parquet"))
    one.write.parquet(str(tmp_path / "parts" / "other.parquet"))
    one.coalesce(1).write.parquet(str(tmp_path / "written"))
    (tmp_path / "single").mkdir()
    (tmp_path / "single" / "events.parquet").write_bytes(next((tmp_path / "written").glob("part-*.parquet")).read_bytes())
    assert read_all(spark, tmp_path / "parts", tmp_path, "parts") == list(range(200))
    assert read_all(spark, tmp_path / "single", tmp_path, "single") == list(range(200))
