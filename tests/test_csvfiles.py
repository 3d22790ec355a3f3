"""Files read in blocks equal the multi-line reader."""

import random

import pytest

from jobtext.sources import csvfiles


@pytest.fixture
def blocks(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def text(rng, n, end):
    def field():
        kind = rng.randrange(7)
        if kind < 3:
            return "".join(rng.choice("abc é漢") for _ in range(rng.randrange(0, 12))).strip()
        inner = "".join(rng.choice(["a", "b ", ",", end, "\n", '""', "é", ""]) for _ in range(rng.randrange(0, 40 if kind < 6 else 400)))
        return f'"{inner}"'

    return end.join(["id,text,more", *(f"{i},{field()},{field()}" for i in range(n))])


@pytest.mark.parametrize("end,size,seed", [("\n", 64, 1), ("\n", 500, 2), ("\r\n", 64, 3), ("\n", 4000, 4)])
def test_equals_multiline_reader(spark, tmp_path, blocks, end, size, seed):
    rng = random.Random(seed)
    for i, tail in enumerate(("", end)):
        (tmp_path / f"f{i}.csv").write_bytes((text(rng, 120, end) + tail).encode())
    blocks(size)
    got = csvfiles.read_csv(spark, str(tmp_path))
    tasks = spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions()
    assert tasks > 4 if size < 4000 else tasks >= 2
    want = spark.read.option("header", True).options(**csvfiles.OPTIONS).csv(str(tmp_path))
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_long_record_over_many_blocks(spark, tmp_path, blocks):
    long = "\n".join(f'line {i} ""x"", y' for i in range(2000))
    (tmp_path / "a.csv").write_text(f'a,b\n1,"{long}"\n\n2,z\n3,"{long}"')
    blocks(256)
    rows = {r.a: r.b for r in csvfiles.read_csv(spark, str(tmp_path / "a.csv")).collect()}
    assert rows == {"1": long.replace('""', '"'), "2": "z", "3": long.replace('""', '"')}


def test_header_alone_and_multi_line_header(spark, tmp_path, blocks):
    (tmp_path / "h.csv").write_text("a,b\n")
    assert csvfiles.read_csv(spark, str(tmp_path / "h.csv")).count() == 0
    blocks(4)
    (tmp_path / "m.csv").write_text('a,"b\nc"\n1,2\n')
    got = csvfiles.read_csv(spark, str(tmp_path / "m.csv"))
    assert got.columns == ["a", "b\nc"] and [tuple(r) for r in got.collect()] == [("1", "2")]
