"""Quality rules whose cutoffs come from the data: quantile sketches per language and source.

A sketch counts values in buckets of equal ratio (GROWTH), so a quantile is
known within half that ratio, two sketches merge by adding counts, and the
result does not depend on the order of rows. A group's quartiles are blended
with those of its language's merged sketch, and these with those of all, with
weights that change smoothly with the number of documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobtext.llm.common import BLANK_CLASS, ROW, WORD_CLASS, documents, row_name, staged

#: Base rules: fewest words, and the largest share (percent) of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Ratio of neighbouring bucket bounds.
GROWTH = 1.02
#: A value is out if it lies further than FENCE spreads above the upper (below the lower)
#: quartile; the spread is the quartiles' distance, but at least the feature's floor.
FENCE = 7.0
#: A group's quartiles weigh as its documents, those of its language as so many more, and a
#: language's beside those of all likewise: the fewer documents, the more is borrowed.
BORROWED = 200
SYMBOLS = "[#*$%&|<>]"
#: name: (numerator, denominator, least spread, whether low values are out too)
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words", 0.02, False),
    "chars_per_word": ("word_chars", "n_words", 0.2, True),
    "upper_share": ("n_upper", "word_chars", 0.02, False),
    "repeat_share": ("n_repeat_words", "n_words", 0.05, False),
}


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang, source, ...) to a narrow row for each row with the
    counts of its whole text. Null text counts as empty; a null language or
    source is the empty one. Words in repeated windows are found by sorting the
    text's own 64-bit window digests with their positions."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), *row_name("doc_id", "text"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    rows = rows.withColumn("words", F.filter(F.split("text", f"{BLANK_CLASS}+"), lambda w: w != ""))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(WORD_CLASS))))
    rows = rows.select(
        "*", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= 3, F.transform(
            F.slice("words", 1, F.size("words") - 2), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))).alias("windows"))
    rows = rows.drop("text", "words", "lines")
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("sorted", F.when(again, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    rows = rows.withColumn("starts", F.sort_array(F.transform(
        F.filter("sorted", lambda p, k: (p.h == F.get("sorted", k - 1).h) | (p.h == F.get("sorted", k + 1).h)), lambda p: p.i)))
    rows = rows.withColumn("steps", F.transform("starts", lambda s, k: F.least(F.lit(3), F.coalesce(F.get("starts", k + 1) - s, F.lit(3)))))
    covered = F.coalesce(F.aggregate("steps", F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    out = rows.withColumn("n_repeat_words", covered).drop("windows", "sorted", "starts", "steps")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _feature(name: str) -> Column:
    top, bottom, _, _ = FEATURES[name]
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def sketches(measured: DataFrame) -> DataFrame:
    """Bucket counts (lang, source, feature, bucket, n) over documents that
    pass the base rules; bucket null-free, zero values in bucket -10000."""
    values = F.array(*[F.struct(F.lit(f).alias("feature"), _feature(f).alias("x")) for f in FEATURES])
    rows = measured.where(~F.col("base_failed")).select("lang", "source", F.explode(values).alias("v"))
    bucket = F.when(F.col("v.x") > 0, F.ceil(F.ln("v.x") / F.lit(math.log(GROWTH)))).otherwise(F.lit(-10_000)).cast("int")
    return rows.groupBy("lang", "source", F.col("v.feature").alias("feature"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _quartiles(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Total and quartiles of each merged sketch."""
    merged = counts.groupBy(*keys, "feature", "bucket").agg(F.sum("n").alias("n"))
    part = Window.partitionBy(*keys, "feature")
    run = merged.withColumn("upto", F.sum("n").over(part.orderBy("bucket"))).withColumn("total", F.sum("n").over(part))
    value = F.when(F.col("bucket") == -10_000, F.lit(0.0)).otherwise(F.pow(F.lit(GROWTH), F.col("bucket")))
    at = [F.min(F.when(F.col("upto") >= q * F.col("total"), value)).alias(c) for c, q in (("q1", 0.25), ("q3", 0.75))]
    return run.groupBy(*keys, "feature").agg(F.max("total").alias("total"), *at)


def thresholds(counts: DataFrame) -> DataFrame:
    """(lang, source) with columns <feature>_low and <feature>_high."""
    own, lang = _quartiles(counts, ["lang", "source"]), _quartiles(counts, ["lang"])
    every = _quartiles(counts, [])
    renamed = [d.select(*k, "feature", *[F.col(c).alias(f"{c}_{s}") for c in ("total", "q1", "q3")]) for d, k, s in ((lang, ["lang"], "l"), (every, [], "a"))]
    joined = own.join(renamed[0], ["lang", "feature"]).join(renamed[1], "feature")
    blend = lambda n, own, other: (n * own + BORROWED * other) / (n + BORROWED)
    q_of = lambda c: blend(F.col("total"), F.col(c), blend(F.col("total_l"), F.col(f"{c}_l"), F.col(f"{c}_a")))
    q = joined.select("lang", "source", "feature", q_of("q1").alias("q1"), q_of("q3").alias("q3"))
    out = []
    for f, (_, _, floor, both) in FEATURES.items():
        spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(floor)) * FENCE
        out.append(F.max(F.when(F.col("feature") == f, F.col("q3") + spread)).alias(f"{f}_high"))
        if both:
            out.append(F.max(F.when(F.col("feature") == f, F.col("q1") - spread)).alias(f"{f}_low"))
    return q.groupBy("lang", "source").agg(*out)


def verdicts(docs: DataFrame) -> DataFrame:
    """A narrow row for each row of ``docs`` (doc_id, text, lang, source, ...)
    with its counts, ``base_failed`` and ``kept``: passes the base rules and
    lies within every threshold of its language and source. A group in which
    all documents fail the base rules needs no threshold. Repeated rows are
    judged alike; other columns are ignored; empty in, empty out."""
    measured = staged(measures(docs), "measures")
    limits = staged(thresholds(sketches(measured)), "thresholds")
    inside = F.lit(True)
    for f, (_, _, _, both) in FEATURES.items():
        inside = inside & (_feature(f) <= F.col(f"{f}_high"))
        if both:
            inside = inside & (_feature(f) >= F.col(f"{f}_low"))
    judged = measured.join(limits, ["lang", "source"], "left")
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).select(*measured.columns, "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose verdict is kept, all columns."""
    good = verdicts(docs).where("kept").select(*ROW).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row")).select("row", *row_name("row.doc_id", "row.text"))
    return rows.join(good, ROW, "left_semi").select("row.*")


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    feats = ", ".join(f"CASE WHEN {b} > 0 THEN {t}::DOUBLE / {b} ELSE 0.0 END AS {f}" for f, (t, b, _, _) in FEATURES.items())
    long = " UNION ALL ".join(f"SELECT lang, source, '{f}' AS feature, {f} AS x FROM feats WHERE NOT base_failed" for f in FEATURES)

    def quart(keys: str) -> str:
        k = f"{keys}, " if keys else ""
        return (f"(SELECT {k}feature, max(total) AS total, min(CASE WHEN upto >= 0.25 * total THEN value END) AS q1, min(CASE WHEN upto >= 0.75 * total THEN value END) AS q3 FROM "
                f"(SELECT {k}feature, CASE WHEN bucket = -10000 THEN 0.0 ELSE pow({GROWTH}, bucket) END AS value, sum(n) OVER (PARTITION BY {k}feature ORDER BY bucket) AS upto, "
                f"sum(n) OVER (PARTITION BY {k}feature) AS total FROM (SELECT {k}feature, bucket, count(*) AS n FROM buckets GROUP BY {k}feature, bucket)) GROUP BY {k}feature)")

    blend = lambda n, own, other: f"({n} * {own} + {BORROWED} * {other}) / ({n} + {BORROWED})"
    pick = lambda c: blend("o.total", f"o.{c}", blend("l.total", f"l.{c}", f"a.{c}")) + f" AS {c}"
    floor = "CASE feature " + " ".join(f"WHEN '{f}' THEN {x[2]}" for f, x in FEATURES.items()) + " END"
    value = "CASE t.feature " + " ".join(f"WHEN '{f}' THEN d.{f}" for f in FEATURES) + " END"
    low = ", ".join(f"'{f}'" for f, x in FEATURES.items() if x[3])
    return f"""
WITH t AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
win AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM t WHERE len(words) >= 3),
grams AS MATERIALIZED (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM win),
twice AS (SELECT r, g FROM grams GROUP BY r, g HAVING count(*) > 1),
spots AS (SELECT DISTINCT r, i + k AS p FROM grams JOIN twice USING (r, g), (SELECT unnest([0, 1, 2]) AS k)),
reps AS (SELECT r, count(*) AS n FROM spots GROUP BY r),
counts AS (
  SELECT t.r, doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '{SYMBOLS}'))::BIGINT AS n_symbols, len(regexp_extract_all(text, '\\p{{Lu}}'))::BIGINT AS n_upper,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(reps.n, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN reps ON t.r = reps.r),
feats AS MATERIALIZED (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, {feats} FROM counts),
buckets AS MATERIALIZED (
  SELECT lang, source, feature, CASE WHEN x > 0 THEN CAST(ceil(ln(x) / {math.log(GROWTH)!r}) AS INTEGER) ELSE -10000 END AS bucket FROM ({long})),
q AS (SELECT o.lang, o.source, o.feature, {pick('q1')}, {pick('q3')} FROM {quart('lang, source')} o
  JOIN {quart('lang')} l ON l.lang = o.lang AND l.feature = o.feature JOIN {quart('')} a ON a.feature = o.feature),
lim AS (SELECT lang, source, feature, q3 + greatest(q3 - q1, {floor}) * {FENCE} AS high,
  CASE WHEN feature IN ({low}) THEN q1 - greatest(q3 - q1, {floor}) * {FENCE} ELSE -1e300 END AS low FROM q),
bad AS (SELECT DISTINCT d.r FROM feats d JOIN lim t ON t.lang = d.lang AND t.source = d.source WHERE {value} > t.high OR {value} < t.low)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND r NOT IN (SELECT r FROM bad) AS kept
FROM feats"""


OP3_SQL = _oracle()
