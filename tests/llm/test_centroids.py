"""Clustering against whole-number brute force, and that intervals spare vectors."""

import hashlib
import math
import random

import numpy as np
import pytest

from jobtext.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string, x int"


def brute(rows, k, rounds, dims):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    cents = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min((dist(v, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(cents)):
            members = [v for o, (_, v) in zip(own, kept) if o == j]
            if members:
                cents[j] = [sum(c) // len(members) for c in zip(*members)]
    return sorted((str(i), nearest(v)[1], nearest(v)[0]) for i, v in kept), cents


def vectors(n, dims, seed):
    rng = random.Random(seed)
    mids = [[rng.gauss(0, 0.3) for _ in range(dims)] for _ in range(5)]
    rows = [(i, [rng.gauss(m, 0.05) for m in rng.choice(mids)]) for i in range(n)]
    return rows + [(rows[3][0], rows[4][1])] + [(n + j, rows[0][1]) for j in range(n // 2)]


@pytest.mark.parametrize("dims", [8, 64])
def test_against_brute_force(spark, dims):
    rows = vectors(150, dims, dims)
    rows += [(None, rows[1][1]), (None, rows[2][1]), (9001, [0.5] * (dims - 1)), (9002, [0.1] * dims + [0.2]), (9003, None), (9004, []),
             (9005, [None] + [0.0] * (dims - 1)), (9006, [float("nan")] * dims), (9007, [float("-inf")] + [0.0] * (dims - 1)), (9008, [0.0] * dims), (9009, [-0.001] * dims)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA).repartition(5)
    out, cents, _ = centroids.cluster(df, k=7, rounds=3, dims=dims)
    want, want_cents = brute(rows, 7, 3, dims)
    assert cents.tolist() == want_cents
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in out.collect()) == want


def test_few_equal_and_no_vectors(spark):
    same = [(i, [0.25] * 8) for i in range(40)]
    for rows in (same, same[:3], [(1, [1e30] * 8), (2, [-1e30] * 8), (3, [0.0] * 8)]):
        out, cents, _ = centroids.cluster(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA), k=4, dims=8)
        got = out.collect()
        assert len(got) == len(rows) and len(cents) == min(4, len(rows))
        assert all(r.cluster == 0 and r.distance == 0 for r in got) or len({r.vec_id for r in got}) == 3
    out, cents, _ = centroids.cluster(spark.createDataFrame([(1, [None] * 8, "", 0)], SCHEMA), k=4, dims=8)
    assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance"] and len(cents) == 0


def test_intervals_hold_and_spare(spark):
    """Bounds enclose the distances; of clear clusters few vectors are measured."""
    rng = np.random.default_rng(4)
    mids = rng.integers(-60, 60, (6, 64))
    x = (mids[rng.integers(0, 6, 3000)] + rng.integers(-3, 4, (3000, 64))).astype(np.int32)
    df = spark.createDataFrame([(int(i), (v / 64).tolist(), "", 0) for i, v in enumerate(x)], SCHEMA)
    marks = centroids._marks(df, 64, 64)
    cells = centroids.cells_of(x, marks[0])
    b = centroids.Bounds(marks, mids.astype(np.int64))
    exact = ((x[:, None, :].astype(np.int64) - mids) ** 2).sum(2)
    least = sum(b.least[i][cells[:, i]] for i in range(32))
    most = sum(b.most[i][cells[:, i]] for i in range(32))
    assert (least <= exact).all() and (exact <= most).all()
    own, measured = b.nearest(cells, x)
    assert (own == exact.argmin(1)).all() and measured < len(x) / 4
    again, _ = b.nearest(cells[:0], x[:0])
    assert len(again) == 0
