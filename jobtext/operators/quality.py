"""A2–A9, S4 — data-quality report of the curation run as tables.

Every figure is an aggregate over the raw frame or over the tagged frame
of ``curate.tag_rows``; the report is a long (section, key, value) table
built by ``unionByName`` of those aggregates, each a small result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtext import taxonomy as tx

REPORT_COLUMNS = [*tx.RAW_TEXT_COLUMNS, "job_position_name", "matched_score"]


def pct1(num, den):
    """num/den*100 rounded half-up to one decimal (0 when den is 0), as double."""
    n = num.cast("long")
    d = den.cast("long")
    q = F.floor((n * 2000 + d) / (d * 2))  # exact: both < 2^53
    return F.when(d > 0, (q / 10.0)).otherwise(F.lit(0.0))


def missing_values(raw: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A2: nulls per existing column and their share of all rows, one pass."""
    cols = [c for c in (columns or REPORT_COLUMNS) if c in raw.columns]
    agg = raw.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    long = agg.selectExpr("_n", f"stack({len(cols)}, {stack}) as (column_name, missing)")
    return long.select("column_name", F.col("missing").cast("long").alias("missing"),
                       pct1(F.col("missing"), F.col("_n")).alias("missing_pct"))


def score_stats(raw: DataFrame, column: str = "matched_score") -> DataFrame:
    """A3: mean, sample std, min, max, rounded to 4 decimals."""
    c = F.col(column).cast("double")
    return raw.agg(
        F.round(F.avg(c), 4).alias("mean"), F.round(F.stddev_samp(c), 4).alias("std"),
        F.round(F.min(c), 4).alias("min"), F.round(F.max(c), 4).alias("max"),
    )


def class_distribution(ds: DataFrame) -> DataFrame:
    """A4: counts per category and per level in one pass (explode of the two keys)."""
    kv = F.explode(F.array(
        F.struct(F.lit("category").alias("kind"), F.col("category").alias("value")),
        F.struct(F.lit("level").alias("kind"), F.col("level").alias("value")),
    ))
    return ds.select(kv.alias("kv")).groupBy("kv.kind", "kv.value").agg(F.count(F.lit(1)).alias("n"))


def missing_categories(ds: DataFrame) -> DataFrame:
    """A5 + U5: taxonomy categories with no row (anti join with the present ones)."""
    spark = ds.sparkSession
    cats = spark.createDataFrame([(c,) for c in tx.CATEGORIES], "category string")
    return cats.join(ds.select("category").distinct(), "category", "left_anti")


def level_fallback(tagged: DataFrame) -> DataFrame:
    """Rows of the kept set (before the final distinct) whose level fell
    back to 'middle', counted per raw title, the greatest count first."""
    kept = tagged.filter(F.col("step").isNull() & F.col("level_fallback") & F.col("job_position_name").isNotNull())
    return kept.groupBy("job_position_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "job_position_name")


def drop_funnel(raw: DataFrame, tagged: DataFrame, ds: DataFrame) -> DataFrame:
    """A7 + A9: rows lost per step in pipeline order; steps that lose none are omitted."""
    steps = tagged.agg(
        F.count(F.lit(1)).alias("distinct_rows"),
        *[F.count_if(F.col("step") == s).alias(s) for s in tx.FUNNEL_STEPS[1:4]],
        F.count_if(F.col("step").isNull()).alias("kept_rows"),
    )
    row = steps.withColumn("raw_rows", raw.agg(F.count(F.lit(1))).scalar()) \
        .withColumn("final_rows", ds.agg(F.count(F.lit(1))).scalar())
    row = row.withColumn("duplicate_rows", F.col("raw_rows") - F.col("distinct_rows")) \
        .withColumn("duplicate_dataset_rows", F.col("kept_rows") - F.col("final_rows"))
    stack = ", ".join(f"{i}, '{s}', `{s}`" for i, s in enumerate(tx.FUNNEL_STEPS))
    long = row.selectExpr(f"stack({len(tx.FUNNEL_STEPS)}, {stack}) as (step_order, step, dropped)")
    return long.filter(F.col("dropped") > 0).select(
        F.col("step_order").cast("int").alias("step_order"), "step", F.col("dropped").cast("long").alias("dropped"))


def report(raw: DataFrame, tagged: DataFrame, ds: DataFrame) -> DataFrame:
    """S4 + A8: the whole report as (section, pos, key, value) rows; ``pos`` orders
    a section's lines: summary and funnel steps as they come, fallback titles by
    falling count after their total, the rest by key."""
    sizes = ds.agg(F.count(F.lit(1)).alias("final_rows"), F.countDistinct("category").alias("n_categories"),
                   F.countDistinct("level").alias("n_levels"))
    s = sizes.withColumn("raw_rows", raw.agg(F.count(F.lit(1))).scalar()) \
        .withColumn("distinct_rows", tagged.agg(F.count(F.lit(1))).scalar())
    summary = s.select(
        F.col("raw_rows"), F.col("distinct_rows"), F.col("final_rows"), F.col("n_categories"), F.col("n_levels"),
        pct1(F.col("final_rows"), F.col("raw_rows")).alias("retention_pct"),
    ).selectExpr(
        "stack(6, 'raw_rows', cast(raw_rows as string), 'duplicate_rows', cast(raw_rows - distinct_rows as string),"
        " 'final_rows', cast(final_rows as string), 'retention_pct', format_number(retention_pct, 1),"
        " 'categories', cast(n_categories as string), 'levels', cast(n_levels as string)) as (key, value)"
    ).withColumn("section", F.lit("summary"))
    order = ["raw_rows", "duplicate_rows", "final_rows", "retention_pct", "categories", "levels"]
    summary = summary.withColumn("pos", F.array_position(F.array(*[F.lit(k) for k in order]), F.col("key")))
    miss = missing_values(raw).select(
        F.lit("missing_values").alias("section"), F.col("column_name").alias("key"),
        F.concat(F.col("missing").cast("string"), F.lit(" ("), F.format_number("missing_pct", 1), F.lit("%)")).alias("value"))
    funnel = drop_funnel(raw, tagged, ds).select(
        F.lit("drop_funnel").alias("section"), F.col("step").alias("key"), F.col("step_order").cast("long").alias("pos"), F.concat(F.lit("-"), F.col("dropped").cast("string")).alias("value"))
    st = score_stats(raw).selectExpr(
        "stack(4, 'mean', mean, 'std', std, 'min', min, 'max', max) as (key, v)"
    ).select(F.lit("matched_score").alias("section"), "key", F.col("v").cast("string").alias("value"))
    dist = class_distribution(ds).select(
        F.concat(F.col("kind"), F.lit("_distribution")).alias("section"), F.col("value").alias("key"),
        F.col("n").cast("string").alias("value"))
    mc = missing_categories(ds).select(F.lit("missing_categories").alias("section"), F.col("category").alias("key"),
                                       F.lit("").alias("value"))
    titles = level_fallback(tagged)
    rows_of = lambda n: F.concat(n.cast("string"), F.lit(" rows")).alias("value")
    fb = titles.select(F.lit("level_fallback").alias("section"), F.col("job_position_name").alias("key"), (-F.col("n")).alias("pos"), rows_of(F.col("n")))
    total = titles.agg(F.sum("n").alias("n")).where("n is not null")
    total = total.select(F.lit("level_fallback").alias("section"), F.lit("total").alias("key"), F.lit(-(1 << 61)).alias("pos"), rows_of(F.col("n")))
    cols = ["section", "pos", "key", "value"]
    out = summary.select(*cols)
    zero = F.lit(0).cast("long")
    for part in (miss.withColumn("pos", zero), funnel, st.withColumn("pos", zero), dist.withColumn("pos", zero), mc.withColumn("pos", zero), fb, total):
        out = out.unionByName(part.select(*cols))
    return out
