"""URL filter: host-suffix and path-prefix expressions joined with rules on short digests."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtext.session import table_path

# Fixed values of the contract: (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Verdict without a fitting rule.
DEFAULT = "allow"
#: Hex digits of the digest that the join uses.
SHORT = 8
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or no ``://``."""
    part = lambda k: F.coalesce(F.regexp_extract(url, _URL, k), F.lit(""))
    return F.translate(part(1), string.ascii_uppercase, string.ascii_lowercase).alias("host"), part(2).alias("path")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(rule_verdict, rule_host, rule_path)."""
    return spark.createDataFrame(rules, "rule_verdict string, rule_host string, rule_path string")


def _digests(df: DataFrame, text: Column) -> DataFrame:
    return df.withColumn("digest", F.sha2(text, 256)).withColumn("short", F.substring("digest", 1, SHORT))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """(page_id, url, ...) and rules to (page_id, host, path, rule, verdict), a row for each row.

    A rule fits its host and all subdomains if the path starts with its own;
    the longest host and path wins, then the longer host, then block. Each
    distinct host and path is expanded into its suffix-prefix expressions of
    the label counts and path lengths that the rules have (both bounded by the
    longest rule), joined by the first SHORT digits of the SHA-256 and confirmed
    by the whole digest and the strings. Rules may be any table; repeated rules
    and rows do no harm; null ids and urls are kept; other columns are ignored."""
    rules = rules.select("rule_verdict", "rule_host", "rule_path", F.size(F.split("rule_host", "\\.")).alias("k"), F.length("rule_path").alias("n"))
    rules = _digests(rules, F.concat("rule_host", "rule_path"))
    shapes = sorted(map(tuple, rules.select("k", "n").distinct().collect()))
    rows = pages.select("page_id", *host_and_path("url"))
    if not shapes:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    places = rows.select("host", "path").where("host <> ''").distinct().withColumn("labels", F.split("host", "\\."))
    fits = lambda k, n: F.when((F.size("labels") >= k) & (F.length("path") >= n), F.struct(F.array_join(F.slice("labels", -k, k), ".").alias("h"), F.substring("path", 1, n).alias("p")))
    parts = places.select("host", "path", F.explode(F.array_compact(F.array(*[fits(k, n) for k, n in shapes]))).alias("e"))
    parts = _digests(parts, F.concat("e.h", "e.p"))
    met = parts.join(rules.withColumnRenamed("digest", "rule_digest"), "short").where("digest = rule_digest and e.h = rule_host and e.p = rule_path")
    rank = F.struct(F.length("rule_host") + F.col("n"), F.length("rule_host"), F.col("rule_verdict") == "block")
    best = met.groupBy("host", "path").agg(F.max_by(F.struct("rule_host", "rule_path", "rule_verdict"), rank).alias("r"))
    out = rows.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.concat("r.rule_host", "r.rule_path").alias("rule"), F.coalesce("r.rule_verdict", F.lit(default)).alias("verdict"))


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(table_path(sf_dir, "pages")), rule_table(spark))


_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
OP7_SQL = f"""
WITH rules(v, h, p) AS (VALUES {_VALUES}),
cut AS (SELECT page_id, row_number() OVER () AS r, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, r, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
met AS (SELECT r, h || p AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC, length(h) DESC, v DESC) AS k
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, '{DEFAULT}') AS verdict FROM parts LEFT JOIN met ON met.r = parts.r AND k = 1"""
