"""M5: packed rows, the rows inside the margin, and their part of the Hessian, against dense arrays."""

import numpy as np
import pyarrow as pa

from jobtext.operators import squared_hinge as SH


def test_rows_inside_the_margin(monkeypatch):
    monkeypatch.setattr(SH, "BLOCK_ENTRIES", 7)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 6)) * (rng.random((30, 6)) < 0.5)
    x[[0, 9]] = 0
    y, s, w = rng.integers(0, 2, 30).astype(np.int32), rng.random(30), rng.normal(size=(2, 7))
    at = [np.flatnonzero(v) for v in x]
    lists = pa.array([a.tolist() if len(a) else None for a in at], pa.list_(pa.int32())), pa.array([v[a].tolist() if len(a) else None for v, a in zip(x, at)], pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.array(y), pa.array(s), *lists], ["y", "s", "indices", "values"])
    w[1] = -3 * w[0]  # rows that are far on the right side for one class are so for both
    full = np.hstack([x, np.ones((30, 1))])
    gap = 1 - np.where(np.arange(2)[:, None] == y, 1, -1) * (w @ full.T)
    blocks = list(SH._blocks(SH._packed(list(SH._blocks(batch)), SH._PACKED)))
    assert len(blocks) > 5 and sum(len(b.sizes) for b in blocks) == 30
    inside = [b for b in (block.inside(w, 0.7) for block in blocks) if b]
    assert sum(len(b.sizes) for b in inside) == (gap > 0).any(axis=0).sum() < 30
    inside = list(SH._blocks(SH._packed(inside, [*SH._PACKED, "curve"])))
    got = sum(b.summed(b.curve * b.scores(w), 6) for b in inside)
    want = (2 * 0.7 * s * (gap > 0) * (w @ full.T)) @ full
    assert np.abs(got - want).max() < 1e-9
