"""Chunk fingerprints against plain Python."""

import hashlib
import random

from jobtext.llm import chunks


def slow_chunks(text):
    out, start = [], 0
    while start < len(text):
        for end in range(start + chunks.LEAST, min(len(text), start + chunks.MOST)):
            h = 0
            for b in text[max(0, end - 32) : end]:
                h = (h * 2 + int(chunks.GEAR[b])) % (1 << 32)
            if h & (chunks.STRICT if end < start + chunks.NORMAL else chunks.LOOSE) == 0:
                break
        else:
            end = min(len(text), start + chunks.MOST)
        out.append(text[start:end])
        start = end
    return out


def test_chunks_and_shift():
    rng = random.Random(4)
    for n in (0, 1, 24, 25, 63, 64, 65, 300, 3000):
        text = bytes(rng.choice(b"abcdef gh\n") for _ in range(n))
        assert list(chunks.chunks(text)) == slow_chunks(text)
    text = bytes(rng.choice(b"abcdefgh ijklmno") for _ in range(50_000))
    assert chunks.containment(chunks.digests(text), chunks.digests(b"shift" + text)) > 0.99
    sizes = [len(c) for c in chunks.chunks(text)]
    assert max(sizes) <= chunks.MOST and 50 < sum(sizes) / len(sizes) < 110
    block = chunks._BLOCK
    try:
        chunks._BLOCK = 777
        assert b"".join(chunks.chunks(text)) == text and [len(c) for c in chunks.chunks(text)] == sizes
    finally:
        chunks._BLOCK = block


def expected(rows):
    key = lambda r: (r[0] is None, -(r[0] or 0))
    ordered = sorted(rows, key=key)
    out = []
    for k, (i, t) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        new = (t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()
        a, b, c = chunks.digests(t.encode()), chunks.digests(new), chunks.digests(after.encode())
        out.append((str(i), len(t), hashlib.sha256(new).hexdigest(), chunks.written(a), chunks.written(b), chunks.containment(a, b), chunks.containment(a, c)))
    return sorted(out)


def test_next_document_across_ranges(spark):
    rng = random.Random(5)
    text = lambda: "".join(rng.choice("abc déf\U0001f600 gh\n") for _ in range(rng.randrange(400)))
    rows = [(i * 7 % 101 * 1000 - 5000, text()) for i in range(101)] + [(1, None), (2, ""), (3, "x" * 100_000)]
    for some, pieces in ((rows, 6), (rows, 1), (rows[:1], 3), (rows + [(None, "tail")], 4), (rows[:3], 9)):
        df = spark.createDataFrame([(i, t, "f", True) for i, t in some], "doc_id long, text string, fingerprint string, copy boolean").repartition(3)
        got = chunks.fingerprints(df, pieces).collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == expected(some)
    assert chunks.fingerprints(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c"), (None, "z"), (None, "z")], "doc_id long, text string")
    assert chunks.fingerprints(twice, 2).count() == 5
