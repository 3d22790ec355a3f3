"""Keys are made once for every request, texts are read again for the first requests alone."""

from pyspark.sql import functions as F

from jobtext.operators import models as MD

ROWS = [(i, "u", f"t{i % 5}" if i % 11 else None) for i in range(60)] + [(None, "v", "t1"), (None, "v", "alone"), (3, "w", "tie"), (3, "w", "TIE")]


def test_one_row_a_key(spark):
    made, scored = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def key(text):
        made.add(1)
        return text and text.lower()

    @F.udf("string")
    def label(text):
        scored.add(1)
        return f"of {text}"

    rows = spark.createDataFrame(ROWS, "seq long, user string, text string").localCheckpoint()

    def again(seqs):
        return rows.join(seqs.withColumnRenamed("seq", "_s"), F.col("seq").eqNullSafe(F.col("_s")), "left_semi").withColumn("key", key("text"))

    out = MD.score_once(rows.withColumn("key", key("text")), "key", "seq", lambda d: d.withColumn("label", label("text")).withColumn("first", F.col("seq")), ["seq", "user"], again)
    assert out.columns == ["key", "seq", "user", "label", "first"]
    got = out.collect()
    keys = {t.lower() for _, _, t in ROWS if t}
    assert len(got) == sum(t is not None for _, _, t in ROWS) and {r.key for r in got} == keys
    for r in got:
        places = [s for s, _, t in ROWS if t and t.lower() == r.key and s is not None]
        assert r.first == (min(places) if places else None) and r.label.lower() == f"of {r.key}"
    assert scored.value == len(keys)
    assert made.value < 1.5 * len(ROWS)  # twice for every request before


def test_all_columns_by_default(spark):
    requests = spark.createDataFrame(ROWS, "seq long, user string, text string").withColumn("key", F.lower("text"))
    got = MD.score_once(requests, "key", "seq", lambda d: d.select("key", F.col("text").alias("scored")))
    assert got.columns == ["key", "seq", "user", "text", "scored"]
    assert sorted(str((r.seq, r.user, r.text)) for r in got.collect()) == sorted(str(r) for r in ROWS if r[2])
