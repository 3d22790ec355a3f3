"""S3–S6, S8, S9 — sinks.

Tables are written in parallel (no coalesce to one file); history tables
are appended partitioned by day, without the ids that are already there.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtext.session import materialize

#: Keeps microseconds, which the default format drops.
JSON_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

REPORT_ORDER = ["summary", "missing_values", "drop_funnel", "matched_score", "category_distribution",
                "missing_categories", "level_distribution", "level_fallback"]


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """S3 (curated set), S6 (CSV with header), S5 (JSON lines)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w = (w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
             .option("ignoreTrailingWhiteSpace", False))
    if fmt == "json":
        w = w.option("timestampNTZFormat", JSON_TIME).option("timestampFormat", JSON_TIME)
    w.format(fmt).save(path)


def _of_days(days: list) -> Column:
    """Partition filter for the days, null (no time) among them."""
    known = [d for d in days if d is not None]
    return F.col("dt").isin(known) | F.col("dt").isNull() if None in days else F.col("dt").isin(known)


def _days(df: DataFrame) -> list:
    """The days that ``df`` touches: a row for each day reaches the driver."""
    return [r.dt for r in df.select("dt").distinct().collect()]


def read_days(spark: SparkSession, path: str, days: list) -> DataFrame | None:
    """The rows of a history table of the given days, ``dt`` among the columns;
    other days' files are not read. None if there is no table or no row yet."""
    try:
        return spark.read.parquet(path).where(_of_days(days))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def _by_day(df: DataFrame) -> DataFrame:
    """Few files for each day, more for a large one."""
    return df.hint("rebalance", "dt")


def append_history(df: DataFrame, path: str, ts_col: str = "created_at", id_col: str | None = None) -> None:
    """Append rows to a history table partitioned by day. Rows whose id
    is already there on their day are left out, so writing a batch again
    changes nothing; only the days of the batch are read, and of them only the
    ids. Rows without time are a day of their own; rows without id are always
    appended."""
    spark, key = df.sparkSession, id_col or ("id" if "id" in df.columns else "pair_id")
    df = materialize(df.withColumn("dt", F.to_date(ts_col)))
    old = read_days(spark, path, _days(df))
    if old is not None:
        old = old.select(F.col(key).alias("_key"), F.col("dt").alias("_dt"))
        df = df.join(old, (F.col(key) == F.col("_key")) & F.col("dt").eqNullSafe(F.col("_dt")), "left_anti")
    _by_day(df).write.mode("append").partitionBy("dt").parquet(path)


def delete_history(spark: SparkSession, path: str, gone: DataFrame, key: str) -> None:
    """J6 on a history table: rows whose ``key`` is in ``gone`` go, copy on
    write. The days that hold such rows are found from the key alone; only
    these are read whole, and their partitions are replaced."""
    names = gone.select(F.col(key)).distinct()
    days = _days(spark.read.parquet(path).select(key, "dt").join(names, key, "left_semi"))
    if not days:
        return
    left = materialize(read_days(spark, path, days).join(names, key, "left_anti"))
    _by_day(left).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)
    full = set(_days(left))
    for day in days:
        if day not in full:  # a day without rows is not among the partitions just written: an empty file takes its place
            left.limit(0).drop("dt").write.mode("overwrite").parquet(f"{path}/dt={day or '__HIVE_DEFAULT_PARTITION__'}")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("dt")


def report_lines(report: DataFrame) -> DataFrame:
    """The (section, pos, key, value) report as markdown lines, by section,
    pos (the funnel's order, the greatest count first) and key."""
    order = F.array_position(F.array(*[F.lit(s) for s in REPORT_ORDER]), F.col("section"))
    line = F.when(F.col("value") == "", F.concat(F.lit("- "), F.col("key"))) \
        .otherwise(F.concat(F.lit("- "), F.col("key"), F.lit(": "), F.col("value")))
    heads = report.select("section").distinct().select(
        "section", F.lit(-(1 << 62)).alias("pos"), F.lit("").alias("key"), F.concat(F.lit("## "), F.col("section")).alias("line"))
    body = report.select("section", "pos", "key", line.alias("line"))
    return heads.unionByName(body).withColumn("_o", order).orderBy("_o", "pos", "key").select("line")


def write_report(report: DataFrame, path: str) -> None:
    report_lines(report).write.mode("overwrite").text(path)
