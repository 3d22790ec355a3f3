"""Readers for the driver tables (Parquet; columns selected explicitly so
the scan's ReadSchema holds only what a job uses)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobtext.session import table_path

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table. ``jobtext.read.partitions``, set by tests
    and bench for their one-row-group files, deals the rows to that many tasks;
    unset, as on a cluster, the file splits stay as they are."""
    df = spark.read.parquet(table_path(sf_dir, name))
    df = df.select(*columns) if columns else df
    n = spark.conf.get("jobtext.read.partitions", None)
    return df.repartition(int(n)) if n else df
