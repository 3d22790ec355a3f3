"""Line dedup against brute force."""

import random
import re

from jobtext.llm import linededup


def shingles(line):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", line) if x]
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def slow(docs):
    lines = []
    for d in sorted({(i is None, i, t) for i, t in docs if t is not None}, key=lambda d: (d[0], d[1] or 0)):
        lines += [(d[1], d[2], k, shingles(x)) for k, x in enumerate(d[2].split("\n"))]
    gone = {}
    for a, (i, t, k, s) in enumerate(lines):
        for _, _, _, r in lines[:a]:
            if s and r and 5 * len(s & r) >= 4 * len(s | r):
                gone.setdefault((i, t), []).append(k)
                break
    return gone


def corpus():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(vocab, k=rng.choice([1, 4, 6, 30, 60]))) for _ in range(60)]

    def line():
        x = rng.choice(base)
        w = x.split()
        if rng.random() < 0.5:
            for _ in range(rng.randrange(1, 3)):
                at = rng.choice([0, len(w) - 1, rng.randrange(len(w))])
                w[at : at + 1] = [rng.choice(vocab)]
        return "  ".join(w) if rng.random() < 0.1 else " ".join(w)

    docs = [(i, "\n".join(line() if rng.random() < 0.8 else rng.choice(["", " ", "new " + " ".join(rng.choices(vocab, k=12))]) for _ in range(rng.randrange(1, 7)))) for i in range(90)]
    return docs + [(200, None), (201, ""), (202, "\n\n"), docs[3], (None, docs[5][1]), (203, "same words " * 4000 + "\nsame words same words same words")]


def test_matches_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, 5, "l") for i, t in docs], "doc_id long, text string, n int, line string").repartition(4)
    want = slow(docs)
    out = linededup.dedup(df)
    assert out.columns == df.columns

    def expected(i, t):
        if t is None:
            return None
        bad = want.get((i, t), [])
        return "\n".join(x for k, x in enumerate(t.split("\n")) if k not in bad)

    key = lambda r: (r[0] is None, r[0] or 0, str(r[1]))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=key) == sorted(((i, expected(i, t)) for i, t in docs), key=key)
    assert linededup.dedup(df.limit(0)).count() == 0


def test_lines_without_their_text(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    lines = linededup.lines_of(df)
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and not re.search(r"Generate [^\n]*\btext#", plan)  # a text was copied and hashed for each of its lines
    texts = {(r.id_key, r.text_key): r.text for r in df.select(*linededup.row_name("doc_id", "text"), "text").collect()}
    keys = {}
    for r in lines.collect():
        s = shingles(texts[r.id_key, r.text_key].split("\n")[r.line_no])
        assert r.n == len(s) and len(set(r.head)) == len(r.head) == r.n - -(-4 * r.n // 5) + 1
        assert keys.setdefault(r.set_key, s) == s
    assert len(keys) == len(set(keys.values()))
