"""E3 — curation of raw resume rows into a labelled (text, category, level) set.

One lazy plan: de-duplicate the raw rows, assemble the text, then tag every
row with the *first* step that drops it.  The drop funnel, the fallback
listing and the dataset itself are all projections/aggregates of that one
tagged frame, so each count needs one pass and no step is re-derived.
Shuffles: the all-column distinct and the final (text, category, level)
distinct; everything else is row-local.  The title taxonomy is a fixed
10-row table, broadcast by construction.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtext import taxonomy as tx
from jobtext.functions.text import assemble_text, detect_level, is_level_fallback, normalize_title
from jobtext.sources.csvfiles import read_csv

RAW_SCHEMA = (
    "career_objective string, skills string, major_field_of_studies string, positions string, "
    "responsibilities string, job_position_name string, experiencere_requirement string, matched_score double"
)


def title_category_table(spark: SparkSession) -> DataFrame:
    rows = sorted(tx.TITLE_CATEGORY.items())
    return spark.createDataFrame(rows, "title_key string, category string")


def detect_category(df: DataFrame, title_col: str = "job_position_name") -> DataFrame:
    """J2 + F10: left lookup of the normalised title; unknown titles get null."""
    spark = df.sparkSession
    keyed = df.withColumn("title_key", normalize_title(title_col))
    return keyed.join(F.broadcast(title_category_table(spark)), "title_key", "left").drop("title_key")


def with_text(raw: DataFrame, text_columns: list[str] | None = None) -> DataFrame:
    """Assemble the text from the text columns that exist."""
    cols = [c for c in (text_columns or tx.RAW_TEXT_COLUMNS) if c in raw.columns]
    return raw.withColumn("text", assemble_text(cols))


def drop_step(text: Column, category: Column, score: Column, min_len: int, min_score: float) -> Column:
    """First failing step of a (de-duplicated) row, null when the row is kept."""
    return (
        F.when(F.length(text) < min_len, F.lit("short_text"))
        .when(category.isNull(), F.lit("title_outside_taxonomy"))
        .when(~F.coalesce(score >= min_score, F.lit(False)), F.lit("low_matched_score"))
    )


def tag_rows(raw: DataFrame, min_len: int = tx.MIN_TEXT_LENGTH, min_score: float = tx.MIN_MATCHED_SCORE) -> DataFrame:
    """De-duplicated raw rows with text, category, level, fallback flag and drop step."""
    distinct = raw.dropDuplicates()
    t = detect_category(with_text(distinct))
    t = t.withColumn(
        "step", drop_step(F.col("text"), F.col("category"), F.col("matched_score"), min_len, min_score)
    )
    return t.withColumn("level", detect_level("job_position_name", "experiencere_requirement")) \
        .withColumn("level_fallback", is_level_fallback("job_position_name", "experiencere_requirement"))


def dataset(tagged: DataFrame) -> DataFrame:
    """Kept rows projected to (text, category, level), distinct."""
    return tagged.filter(F.col("step").isNull()).select("text", "category", "level").dropDuplicates()


def curate(raw: DataFrame) -> DataFrame:
    return dataset(tag_rows(raw))


# The strings that count as missing in a raw file.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
               "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw CSV with a header and quoted multi-line fields, columns by name.

    A byte-order mark is taken off any column name; missing-value strings are
    null; expected columns that the file lacks are null and its other columns
    are kept as strings. A file is read in blocks by many tasks."""
    df = read_csv(spark, path)
    df = df.toDF(*[c.replace("\ufeff", "") for c in df.columns])
    df = df.select(*[F.when(~F.col(f"`{c}`").isin(*NULL_TOKENS), F.col(f"`{c}`")).alias(c) for c in df.columns])
    wanted = [f.split() for f in RAW_SCHEMA.split(", ")]
    for name, kind in wanted:
        df = df.withColumn(name, F.col(name).try_cast(kind) if name in df.columns else F.lit(None).cast(kind))
    return df.select(*[n for n, _ in wanted], *[f"`{c}`" for c in df.columns if c not in dict(wanted)])


def training_source(spark: SparkSession, read, real: str, synthetic: str, explicit: str | None = None) -> DataFrame:
    """The training table: an explicit path (an error if it is absent), else
    the real and the synthetic set together, else the one that is there.
    ``read(path)`` reads one table."""
    def there(path: str) -> DataFrame | None:
        try:
            return read(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    if explicit:
        df = there(explicit)
        if df is None:
            raise FileNotFoundError(f"no dataset at {explicit}")
        return df
    found = [d for d in map(there, (real, synthetic)) if d is not None]
    if not found:
        raise FileNotFoundError(f"no dataset at {real} or {synthetic}")
    return found[0] if len(found) == 1 else found[0].unionByName(found[1], allowMissingColumns=True)


def write_raw_csv(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def clean_training_set(df: DataFrame, min_len: int = tx.MIN_TRAIN_TEXT_LENGTH) -> DataFrame:
    """Required columns, rows with nulls dropped, values stripped, short texts dropped."""
    missing = {"text", "category", "level"} - set(df.columns)
    if missing:
        raise ValueError(f"dataset lacks columns: {sorted(missing)}")
    from jobtext.functions.text import strip_unicode

    out = df.dropna(subset=["text", "category", "level"]).select(
        strip_unicode(F.col("text").cast("string")).alias("text"),
        strip_unicode(F.col("category").cast("string")).alias("category"),
        strip_unicode(F.col("level").cast("string")).alias("level"),
    )
    out = out.filter(F.length("text") >= min_len)
    if out.isEmpty():
        raise ValueError("no training rows are left after cleaning")
    return out
