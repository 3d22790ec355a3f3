"""Mixing: targets in fractions, quotas met to the word, no document over its limit, texts as the plan says."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from jobtext.llm import mixing

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def fair(sizes, weights=(3, 1, 2)):
    """Targets as fractions: share again what is above the limit until nothing is."""
    w = [weights[i % 3] for i in range(len(sizes))]
    got, rest = [Fraction(0)] * len(sizes), Fraction(3, 2) * sum(sizes)
    while rest > 0:
        free = [i for i in range(len(sizes)) if got[i] < 2 * sizes[i]]
        unit = rest / sum(w[i] for i in free)
        for i in free:
            got[i] += w[i] * unit
        rest = sum(max(Fraction(0), got[i] - 2 * s) for i, s in enumerate(sizes))
        got = [min(g, Fraction(2 * s)) for g, s in zip(got, sizes)]
    return got


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 100, 1025, 4096])
def test_permutation(n):
    for key in (1, 99):
        p = mixing.Permutation(n, key)
        out = p(np.arange(n))
        assert sorted(out.tolist()) == list(range(n))
        assert all(p.place_of(int(v)) == i for i, v in list(enumerate(out))[:20])
    assert n < 64 or (mixing.Permutation(n, 1)(np.arange(n)) != mixing.Permutation(n, 2)(np.arange(n))).any()


def test_targets():
    rng = random.Random(1)
    for _ in range(300):
        sizes = [rng.choice([0, 1, 7, 100, 100_000]) for _ in range(rng.randrange(0, 9))]
        got, want = mixing.targets(sizes), fair(sizes)
        assert all(abs(g - float(w)) <= 1e-9 * max(1, float(w)) for g, w in zip(got, want))


def table(seed):
    rng = random.Random(seed)
    names = ["b", "", "é", None, "a", "z"]
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(rng.choice([0, 1, 3, 40, 300]))), "b" if rng.random() < 0.4 else rng.choice(names)) for i in range(120)]
    rows += [(5, rows[5][1], rows[5][2])] * 3 + [(None, "no id at all", "a")] * 2 + [(7, "other text", "b"), (130, None, "z"), (131, " \n", "only blanks"), (132, "x " * 5000, "z")]
    return rows


def frame(spark, rows, parts):
    return spark.createDataFrame([(*r, "s", 3) for r in rows], "doc_id long, text string, source string, start string, size int").repartition(parts)


@pytest.mark.parametrize("block,shard", [(16, 8), (1024, 1024), (1, 64)])
def test_mix(spark, block, shard):
    rows = table(block)
    docs = frame(spark, rows, 3)
    out = mixing.mix(docs, block=block, shard=shard)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORDS.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    assert [(s.name, s.size) for s in out.sources] == [(n, sizes[n]) for n in order]
    want = fair([sizes[n] for n in order])
    pieces, laid = out.mixed.collect(), out.rows.collect()
    taken, per = Counter(), Counter()
    for r in pieces:
        taken[r.source_no] += r.length
        per[r.source_no, r.start] += r.length
    assert all(taken[i] == round(float(w)) for i, w in enumerate(want))
    size = {(r.source_no, r.start): r["size"] for r in laid if r["size"]}
    assert len(laid) == len(rows) and all(per[k] <= 2 * size[k] for k in per)
    spans = defaultdict(list)
    for (s, start), n in size.items():
        spans[s].append((start, start + n))
    for s, v in spans.items():
        v.sort()
        assert v[0][0] == 0 and all(a[1] == b[0] for a, b in zip(v, v[1:]))
    slots = defaultdict(int)
    for r in pieces:
        slots[r.shard, r.slot] += r.length
    assert all(n <= block for n in slots.values()) and all(0 <= slot < shard for _, slot in slots)
    if block > 1:
        words = {(i, t): WORDS.findall(t or "") for i, t, _ in rows}
        by_key = {(r.source_no, r.start): r for r in laid if r["size"]}
        texts = {(r.shard, r.slot): r.text for r in mixing.texts(docs, out, block).collect()}
        assert texts.keys() == slots.keys()
        real = {i: [w for (j, _), w in words.items() if j == i] for i in {i for i, _ in words}}
        for key, text in texts.items():
            got = text.split(" ")
            for r in (p for p in pieces if (p.shard, p.slot) == key):
                part = got[r.at : r.at + r.length]
                assert any(w[r.first : r.first + r.length] == part for w in real[by_key[r.source_no, r.start].doc_id])


def test_reruns_agree_and_query(spark):
    rows = table(3)
    a, b = (mixing.mix(frame(spark, rows, n), block=16, shard=8).mixed.drop("copy").collect() for n in (1, 7))
    assert Counter(a) == Counter(b)


def test_nothing_to_mix(spark):
    for rows in ([], [(1, None, "a"), (2, "", None)]):
        out = mixing.mix(frame(spark, rows, 2))
        assert out.mixed.count() == 0 and out.rows.count() == len(rows)
