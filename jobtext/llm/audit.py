"""Filter interaction audit with wide packed counters.

Five filters judge every document; a document's failures are a mask of five
bits. What happens to a mask under all 120 orders of the filters, at each of
their 5 steps, is one big integer of 600 fields. These integers, one for each
kind of outcome, are summed over the documents of a part, and the fields of
the sums are the counts of the part. A field has 64 bits and a count fits a
long, so no field ever runs into the next.

Documents of a part with the same mask and labels are counted first, where
they lie: a part then has at most 128 rows whatever its size, and a mask's
integer enters the sum times its count.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtext.llm.common import BLANK_CLASS, documents, staged
from jobtext.session import table_path

FILTERS = "ABCDE"
#: A: fewest words; B: least percentage of distinct words; C: largest percentage of capitals; D: marks.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 50, 65, 5, "[#$%&*|]"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = [(order, step) for order in ORDERS for step in range(len(FILTERS))]
FIELD_BYTES = 8

SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _fails(mask: int, letters: str) -> bool:
    return any(mask >> FILTERS.index(x) & 1 for x in letters)


#: Outcome of a mask at a step: the order's letters before it, and its own letter.
OUTCOMES = {
    "kept": lambda mask, before, own: not _fails(mask, before + own),
    "removed": lambda mask, before, own: _fails(mask, own) and not _fails(mask, before),
    "redundant": lambda mask, before, own: _fails(mask, own) and _fails(mask, before),
    "unique_fails": lambda mask, before, own: mask == 1 << FILTERS.index(own),
}


def packed(kind: str, mask: int) -> int:
    """The outcomes of ``mask`` at all steps, one in each field."""
    outcome = OUTCOMES[kind]
    return sum(1 << 8 * FIELD_BYTES * i for i, (order, k) in enumerate(STEPS) if outcome(mask, order[:k], order[k]))


def unpacked(total: int) -> np.ndarray:
    """The fields of a sum of packed integers."""
    return np.frombuffer(total.to_bytes(FIELD_BYTES * len(STEPS), "little"), "<u8").astype(np.int64)


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, text, source) to (doc_id, part, mask, n): rows with their
    failures; ``n`` counts rows equal in id, text and source.

    Null text is empty, a null source the empty part. E asks for a smaller id
    with the same text anywhere in the table, known by 128 bits of its SHA-256;
    a null id is neither smaller nor larger than another. Texts are read once;
    copies are found by their digest's least id, combined before the shuffle,
    and met again by digest and id, which no group of copies shares."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", f"{BLANK_CLASS}+"), lambda w: w != ""))
    n = F.size("words")
    tests = [n < LEAST_WORDS, 100 * F.size(F.array_distinct("words")) < LEAST_DISTINCT * n,
             100 * F.regexp_count("text", F.lit("[A-Z]")) > MOST_CAPITALS * F.length("text"), F.rlike("text", F.lit(MARKS))]
    mask = sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))
    digest = F.unhex(F.left(F.sha2("text", 256), F.lit(32)))
    rows = rows.select("doc_id", "part", mask.alias("mask"), digest.alias("digest"))
    rows = staged(rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n")), "masks")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    return rows.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("mask") + copy).alias("mask"), "n")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, source, ...) and (doc_id, quality, toxic, ...) to 600
    rows for each part, see SCHEMA; zeros are there.

    A document is good (toxic) if any label row of its id says quality (toxic)
    1; null ids have no label. Repeated rows count as often as they occur.
    Other columns are ignored; no documents give no rows."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"))
    rows = masks(docs).join(known, "doc_id", "left")
    never = F.lit(False)
    counts = rows.groupBy("part", "mask", F.coalesce("good", never).alias("good"), F.coalesce("toxic", never).alias("toxic")).agg(F.sum("n").alias("n"))
    wide = {kind: [packed(kind, m) for m in range(1 << len(FILTERS))] for kind in OUTCOMES}

    def tell(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        def total(kind: str, part: pd.DataFrame) -> np.ndarray:
            return unpacked(sum(int(n) * wide[kind][m] for m, n in zip(part["mask"], part["n"])))

        out = {kind: total(kind, group) for kind in OUTCOMES}
        own = np.array([FILTERS.index(order[k]) for order, k in STEPS])
        over = np.array([out["removed"][own == f].sum() for f in range(len(FILTERS))])
        return pd.DataFrame({
            "part": key[0], "filter_order": [o for o, _ in STEPS], "step": np.array([k + 1 for _, k in STEPS], np.int32), **out,
            "good_lost": total("removed", group[group["good"]]), "toxic_lost": total("removed", group[group["toxic"]]), "shapley": over[own]})

    return counts.groupBy("part").applyInPandas(tell, SCHEMA)


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(table_path(sf_dir, "labels")))


OP12_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT doc_id, part, len(w) < {LEAST_WORDS} AS a, 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w) AS b,
    100 * len(regexp_extract_all(t, '[A-Z]')) > {MOST_CAPITALS} * length(t) AS c, regexp_matches(t, '{MARKS}') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM d),
n AS MATERIALIZED (
  SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
    || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS m,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM f LEFT JOIN l ON l.doc_id = f.doc_id GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS o FROM x p, x q, x r, x s, x t
  WHERE p.x NOT IN (q.x, r.x, s.x, t.x) AND q.x NOT IN (r.x, s.x, t.x) AND r.x NOT IN (s.x, t.x) AND s.x <> t.x),
s AS (SELECT o, k, substr(o, k, 1) AS own, substr(o, 1, k - 1) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
y AS (
  SELECT part, o, k, own, n, good, toxic, contains(m, own) AS here, m = own AS sole,
    m <> '' AND translate(m, before, '') <> m AS gone FROM n, s),
z AS (
  SELECT part, o, k, own, coalesce(sum(n) FILTER (NOT gone AND NOT here), 0) AS kept, coalesce(sum(n) FILTER (here AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (here AND gone), 0) AS redundant, coalesce(sum(n) FILTER (sole), 0) AS unique_fails,
    coalesce(sum(n) FILTER (here AND NOT gone AND good), 0) AS good_lost, coalesce(sum(n) FILTER (here AND NOT gone AND toxic), 0) AS toxic_lost
  FROM y GROUP BY part, o, k, own)
SELECT part, o AS filter_order, k::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM z"""
