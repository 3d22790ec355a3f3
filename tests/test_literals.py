"""F15 on lists of any length, against Python's own reading."""

import ast
import random

from pyspark.sql import functions as F

from jobtext.functions.text import clean_value, parse_list_literal


def test_long_lists(spark):
    sizes = [0, 1, 10, 1_500, 100_000, 1_000_000]
    rows = [(n, "[" + ", ".join("None" if i % 7 == 3 else f"'a{i}'" if i % 2 else f'"b {i}, ]"' for i in range(n)) + "]") for n in sizes]
    df = spark.createDataFrame(rows, "n int, v string").repartition(3)
    got = df.select("n", parse_list_literal("v").alias("x")).select("n", F.size("x").alias("size"), F.get("x", F.lit(0)).alias("first"), F.get("x", F.size("x") - 1).alias("last"))
    for r in got.collect():
        want = [x for x in ast.literal_eval(rows[sizes.index(r.n)][1]) if x is not None]
        assert (r.size, r.first, r.last) == (len(want), want[0] if want else None, want[-1] if want else None)


def test_long_values_that_are_no_list(spark):
    bad = ["[" * 200_000, "['a', " * 50_000, "[" + "'a' 'b', " * 20_000 + "]", "['" + "x" * 500_000, "[" + "None " * 100_000 + "]", "[" + "," * 100_000 + "]"]
    df = spark.createDataFrame(list(enumerate(bad)), "i int, v string").repartition(3)
    got = {r.i: r.n for r in df.select("i", F.size(parse_list_literal("v")).alias("n"), F.length(clean_value("v"))).collect()}
    assert got == {i: 20_000 if i == 2 else None for i in range(len(bad))}


def test_random_values(spark):
    rng = random.Random(8)
    parts = ["[", "]", "[", "]", ",", ", ", "'a'", '"b\'"', "None", " ", "\t", "'", '"', "x", "'c, d'", "\\", "\n", "1"]
    values = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(3000)] + ["[" + "".join(rng.choice(parts) for _ in range(rng.randrange(0, 7))) + "]" for _ in range(3000)]

    def want(v):
        if not v.lstrip(" \t").startswith("["):
            return None
        try:
            got = ast.literal_eval(v)
        except (ValueError, SyntaxError, TypeError):
            return None
        return [str(x) for x in got if x is not None] if isinstance(got, list) else None

    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    for r in df.select("i", parse_list_literal("v").alias("x")).collect():
        assert r.x == want(values[r.i]), values[r.i]
