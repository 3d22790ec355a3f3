"""Repeated passages against brute force."""

import random
from collections import Counter

import pytest

from jobtext.llm import suffixes


def slow(texts):
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans, i = [], 0
        while i < len(t):
            j = i
            while j < len(t) and gone[j] == gone[i]:
                j += 1
            if gone[i]:
                spans.append((i, j))
            i = j
        out.append((spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def corpus():
    rng = random.Random(11)
    make = lambda n: "".join(rng.choice("abcdefé ghij.\n") for _ in range(n))
    passages = [make(n) for n in (150, 199, 200, 201, 260, 700, 2500)]
    texts = [None, "", "x" * 199, "x" * 200, "y" * 900, "ab" * 300, make(3000), "漢" * 80]
    for _ in range(45):
        t = "".join(rng.choice([make(rng.randrange(150)), rng.choice(passages)]) for _ in range(rng.randrange(1, 5)))
        if rng.random() < 0.5:
            for _ in range(rng.randrange(1, 5)):
                at = rng.randrange(len(t) + 1)
                t = t[:at] + rng.choice(["", "Z", "new word"]) + t[at + rng.randrange(4) :]
        texts.append(t)
    return texts + [texts[6], texts[20], passages[5] * 3]


@pytest.mark.parametrize("block,together", [(1 << 18, 4096), (300, 2)])
def test_matches_brute_force(spark, monkeypatch, block, together):
    monkeypatch.setattr(suffixes, "TOGETHER", together)
    texts = corpus()
    rows = [(i, t, "s", b"k") for i, t in enumerate(texts)] + [(9, texts[9], "s", b"k"), (None, texts[7], "s", b"k")]
    if block == 300:  # the block length reaches the workers by value only through this test's own runs
        whole = [list(suffixes.runs((t or "").encode())) for t in texts]
        monkeypatch.setattr(suffixes, "BLOCK", block)
        cut = [list(suffixes.runs((t or "").encode())) for t in texts]
        assert [sum(int(b[1].sum()) for b in x) for x in whole] == [sum(int(b[1].sum()) for b in x) for x in cut]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, kept binary").repartition(4)
    want = slow([(r[1] or "").encode() for r in rows])
    got = suffixes.remove(df).collect()
    key = lambda r: (str(r[0]), r[1], r[2], r[3])
    assert sorted(((str(g.doc_id), g.n_bytes, [(s.start, s.end) for s in g.spans], bytes(g.kept)) for g in got), key=key) == sorted(
        ((str(r[0]), len((r[1] or "").encode()), spans, kept) for r, (spans, kept) in zip(rows, want)), key=key)
    assert suffixes.remove(df.limit(0)).count() == 0
