"""A10–A13, P10–P12, W4 — evaluation tables and the stratified split.

Metrics come from one pass over the (true, predicted) table: each row is
exploded into its true-label and predicted-label role, and a per-label
aggregate gives support, predicted count and true positives.  That table has
one row per label, so everything after it is tiny.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtext import taxonomy as tx


def label_stats(pairs: DataFrame, true_col: str = "true_label", pred_col: str = "predicted_label") -> DataFrame:
    """(label, support, predicted, tp) over the union of true and predicted labels."""
    ok = F.col(true_col) == F.col(pred_col)
    roles = F.explode(F.array(
        F.struct(F.col(true_col).alias("label"), F.lit(1).alias("is_true"), ok.cast("int").alias("hit")),
        F.struct(F.col(pred_col).alias("label"), F.lit(0).alias("is_true"), F.lit(0).alias("hit")),
    ))
    r = pairs.select(roles.alias("r")).select("r.*")
    return r.groupBy("label").agg(
        F.sum("is_true").cast("long").alias("support"),
        F.sum(1 - F.col("is_true")).cast("long").alias("predicted"),
        F.sum("hit").cast("long").alias("tp"),
    )


def _prf(stats: DataFrame) -> DataFrame:
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    s = stats.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return s.withColumn("f1", f1)


def metrics(pairs: DataFrame, true_col: str = "true_label", pred_col: str = "predicted_label") -> DataFrame:
    """Accuracy, macro precision/recall/F1, weighted F1, samples (4 decimals; 0 on zero division)."""
    s = _prf(label_stats(pairs, true_col, pred_col))
    n = F.sum("support")
    return s.agg(
        F.round(F.sum("tp") / n, 4).alias("accuracy"),
        F.round(F.avg("precision"), 4).alias("precision_macro"),
        F.round(F.avg("recall"), 4).alias("recall_macro"),
        F.round(F.avg("f1"), 4).alias("f1_macro"),
        F.round(F.sum(F.col("f1") * F.col("support")) / n, 4).alias("f1_weighted"),
        n.cast("long").alias("samples"),
    )


def report(pairs: DataFrame, true_col: str = "true_label", pred_col: str = "predicted_label") -> DataFrame:
    """Per-label precision/recall/F1/support plus accuracy, macro avg, weighted avg rows."""
    s = _prf(label_stats(pairs, true_col, pred_col))
    per = s.select("label", "precision", "recall", "f1", "support")
    n = F.sum("support")
    acc = s.agg(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                F.lit(None).cast("double").alias("recall"), (F.sum("tp") / n).alias("f1"), n.alias("support"))
    macro = s.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                  F.avg("f1").alias("f1"), n.alias("support"))
    weighted = s.agg(F.lit("weighted avg").alias("label"),
                     (F.sum(F.col("precision") * F.col("support")) / n).alias("precision"),
                     (F.sum(F.col("recall") * F.col("support")) / n).alias("recall"),
                     (F.sum(F.col("f1") * F.col("support")) / n).alias("f1"), n.alias("support"))
    out = per.unionByName(acc).unionByName(macro).unionByName(weighted)
    return out.select("label", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")],
                      F.col("support").cast("long").alias("support"))


def confusion(pairs: DataFrame, labels: list[str], true_col: str = "true_label", pred_col: str = "predicted_label") -> DataFrame:
    """A10: one row per true label, one count column per predicted label
    (``labels`` = the sorted union of labels; zero cells are 0)."""
    counts = pairs.groupBy(true_col).pivot(pred_col, labels).agg(F.count(F.lit(1)))
    return counts.select(F.col(true_col).alias("true_label"),
                         *[F.coalesce(F.col(f"`{l}`"), F.lit(0)).cast("long").alias(l) for l in labels])


def sorted_labels(pairs: DataFrame, true_col: str = "true_label", pred_col: str = "predicted_label") -> list[str]:
    """The label set for pivot columns; null labels and more than MAX_CLASSES are errors."""
    u = pairs.select(F.col(true_col).alias("l")).union(pairs.select(F.col(pred_col).alias("l"))).distinct()
    found = [r["l"] for r in u.limit(MAX_CLASSES + 1).collect()]
    if len(found) > MAX_CLASSES or None in found:
        raise ValueError(f"labels must be non-null and of at most {MAX_CLASSES} classes")
    return sorted(found)


def class_weights(df: DataFrame, label_col: str) -> DataFrame:
    """Balanced weight n / (k * n_c) per class (a class-sized table)."""
    c = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()  # over the class table only (one row per class)
    c = c.withColumn("n", F.sum("n_c").over(w)).withColumn("k", F.count(F.lit(1)).over(w))
    return c.select(F.col(label_col).alias("label"), "n_c",
                    (F.col("n") / (F.col("k") * F.col("n_c"))).alias("weight"))


def errors(pairs: DataFrame) -> DataFrame:
    """M8 projection: (text, true, predicted, correct)."""
    return pairs.withColumn("correct", F.col("true_label") == F.col("predicted_label"))


def error_examples(errs: DataFrame, target: str) -> DataFrame:
    """Wrong rows; false positives and false negatives of ``target``."""
    wrong = errs.filter(~F.col("correct"))
    hard = wrong.withColumn("kind", F.lit("hard"))
    fp = wrong.filter(F.col("predicted_label") == target).withColumn("kind", F.lit("false_positive"))
    fn = wrong.filter(F.col("true_label") == target).withColumn("kind", F.lit("false_negative"))
    return hard.unionByName(fp).unionByName(fn)


#: Class tables are broadcast and collected; more classes than this are no class labels.
MAX_CLASSES = 10_000

# ---------------------------------------------------------------- W4 split

HASH_BITS = 20  # buckets of the hash order used to find the per-class cut


def split_order(key) -> F.Column:
    """60-bit prefix of md5(seed || key): the shuffle order of the split."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(str(tx.SPLIT_SEED)), key.cast("string"))), 1, 15), 16, 10).cast("long")


def test_counts(df: DataFrame, label_col: str, test_size: float = tx.TEST_SIZE) -> DataFrame:
    """Per-class test sizes: ceil(test_size*N) in total, split by largest
    remainder (ties by label).  A class-sized table."""
    c = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()
    den = round(1 / test_size)
    if abs(den * test_size - 1) > 1e-12:
        raise ValueError("test_size must be 1/k")
    c = c.withColumn("n", F.sum("n_c").over(w))
    c = c.withColumn("t_all", F.floor((F.col("n") + den - 1) / den).cast("long"))
    num = F.col("n_c") * F.col("t_all")
    c = c.withColumn("base", F.floor(num / F.col("n")).cast("long")).withColumn("rem", num % F.col("n"))
    c = c.withColumn("need", F.col("t_all") - F.sum("base").over(w))
    c = c.withColumn("rk", F.row_number().over(Window.partitionBy().orderBy(F.col("rem").desc(), F.col(label_col))))
    return c.select(label_col, "n_c", (F.col("base") + F.when(F.col("rk") <= F.col("need"), 1).otherwise(0)).alias("t_c"))


def stratified_split(df: DataFrame, label_col: str, key_col: str, test_size: float = tx.TEST_SIZE) -> DataFrame:
    """Adds ``is_test``: the first t_c rows of each class in md5 order.

    Exact and skew-free: instead of sorting a whole class, rows are counted
    per (class, hash bucket) — the hash is uniform, so buckets are even — the
    bucket holding each class's cut is found on that small count table, only
    rows of that one bucket are ranked, and the last test row's (hash, key)
    becomes the class's cut.  The cuts are a class-sized table, broadcast, and
    ``is_test`` is a comparison within the row: no other column of the data is
    ever shuffled.  Labels must not be null, keys must be unique.
    """
    keyed = df.select(F.col(label_col).alias("_l"), F.col(key_col).alias("_k"), split_order(F.col(key_col)).alias("_h"))
    keyed = keyed.withColumn("_b", F.shiftright("_h", 60 - HASH_BITS))
    t = test_counts(df, label_col, test_size).withColumnRenamed(label_col, "_l")
    b = keyed.groupBy("_l", "_b").agg(F.count(F.lit(1)).alias("nb"))
    wb = Window.partitionBy("_l").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = b.withColumn("cum", F.sum("nb").over(wb)).withColumn("before", F.col("cum") - F.col("nb"))
    b = b.join(F.broadcast(t), "_l")  # class-sized table
    last = b.filter((F.col("before") < F.col("t_c")) & (F.col("cum") >= F.col("t_c"))).select("_l", "_b", "before", "t_c")
    # classes with t_c == 0 have no cut: nothing of theirs is test
    near = keyed.join(F.broadcast(last), ["_l", "_b"])
    rank = F.row_number().over(Window.partitionBy("_l").orderBy("_h", "_k"))
    cuts = near.withColumn("_r", rank).filter(F.col("before") + F.col("_r") == F.col("t_c")).select("_l", F.struct("_h", "_k").alias("_cut"))
    j = df.join(F.broadcast(cuts), df[label_col] == cuts["_l"], "left")
    mine = F.struct(split_order(F.col(key_col)).alias("_h"), F.col(key_col).alias("_k"))
    return j.withColumn("is_test", F.coalesce(mine <= F.col("_cut"), F.lit(False))).drop("_l", "_cut")
