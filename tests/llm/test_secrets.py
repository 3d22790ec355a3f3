"""Secret scan against plain Python, trained models, redaction."""

import hashlib
import random
import re
import time

import pytest

from jobtext.llm import secrets

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def slow(text):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def b64(rng, n):
    return "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    words = ["get", "user", "name", "account", "balance", "interest", "value", "configuration", "password"]
    ident = lambda: "_".join(rng.choices(words, k=4)) + "_identifier"
    out = [None, "", "token", "token=", "secret: token: abcdefgh", "é\U0001f600 token='abcdef' x", "PASSWORD\"  :  \"a.b/c+d=", "api_key=short api_key=12345",
           "ſecret=abcdefgh Key", "AKIAAKIA" + "A" * 11, "AKIAAKIA" + "A" * 12, "AKIA" * 6, "a" * 24, "g" + "0" * 23 + "G" + "0" * 24, "token=token=abcdefgh",
           " ".join(hexa(24) for _ in range(300)), "x" * 20_000 + hexa(30)]
    for _ in range(60):
        parts = [ident(), rng.choice(words), f"password={hexa(18)}", f'token = "{hexa(40)}"', "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), hexa(32), " \n", "naïve"]
        out.append(" ".join(rng.sample(parts, 5)) + " " + " ".join(rng.choices(words, k=30)))
    planted = [(f"key {b64(rng, 40)} and {ident()}",) for _ in range(20)]
    return [(i, t, 9, "n") for i, t in enumerate(out + [p[0] for p in planted])] + [(None, "hex " + "ab12" * 7, 1, "n"), (3, "token=", 1, "n")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, start int, spans string").repartition(3)


def test_base_and_models(spark, rows):
    got = {(r.doc_id, r.text_key): r for r in secrets.scan(frame(spark, rows)).collect()}
    found = secrets.scan(frame(spark, rows)).select("doc_id", secrets.F.sha2(secrets._joined("base"), 256).alias("h")).collect()
    sha = lambda t: hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in slow(t or "")).encode()).hexdigest()
    assert sorted((str(r.doc_id), r.h) for r in found) == sorted((str(i), sha(t)) for i, t, _, _ in rows)
    by_id = {r.doc_id: r for r in got.values()}
    for i, t, _, _ in rows[-22:-2]:
        new = [s for s in by_id[i].spans if s.kind == "markov"]
        assert len(new) == 1 and t[new[0].start : new[0].end] == t.split()[1]
    for i, t, _, _ in rows[17:77]:
        assert by_id[i].n_markov == 0, t


def test_redaction_and_empty(spark, rows):
    df = frame(spark, rows)
    out = secrets.redact(df)
    assert out.columns == df.columns
    texts = {str(r.doc_id): r.text for r in out.where("doc_id > 3 or doc_id is null").collect()}
    for i, t, _, _ in rows[4:77]:
        want, at = "", 0
        for a, _, b, _ in slow(t):
            if a >= at:
                want += t[at:a] + "[SECRET]"
            at = max(at, b)
        assert texts[str(i)] == want + t[at:] or i == 16
    assert texts["None"] == "hex [SECRET]"
    assert secrets.scan(df.limit(0)).count() == 0


def test_runs_that_hold_more_than_a_secret(spark, rows):
    rng = random.Random(8)
    words = ["get", "user", "name", "account", "balance", "interest", "value", "configuration"]
    path = lambda n: "".join(rng.choice(words) + rng.choice("/_-=") for _ in range(n))
    akia = lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    planted = []
    for n in (4, 12, 20, 60) * 5:
        a, b = b64(rng, 24), b64(rng, 32)
        planted += [(f"see {path(n)}{a}", [a]), (f"see {path(n)}{a}/{path(n)}end", [a]), (f"see {path(n)}{a}/{path(n + 20)}{b}-{path(n)}end", [a, b]), (f"é {akia()}/{b}{a}", [b + a])]
    plain = [(f"see {path(n)}end and {akia()}/{path(8)}end", []) for n in (12, 20, 60)]
    more = [(1000 + i, t, 9, "n") for i, (t, _) in enumerate(planted + plain)]
    df = frame(spark, rows + more)
    spans = {r.doc_id: r.spans for r in secrets.scan(df).where("doc_id >= 1000").collect()}
    texts = {r.doc_id: r.text for r in secrets.redact(df).where("doc_id >= 1000").collect()}
    for (i, t, _, _), (_, want) in zip(more, planted + plain):
        new = [t[s.start : s.end] for s in spans[i] if s.kind == "markov"]
        assert len(new) == len(want) or len(new) == 1 < len(want), t
        assert all(any(w[3:-3] in x for x in new) for w in want), (t, new)
        assert not any(w[3:-3] in texts[i] for w in want), texts[i]
        assert all(s.end <= b.start or b.end <= s.start for s in spans[i] for b in spans[i] if s.kind == "markov" != b.kind)


def test_many_matches_in_a_text(spark):
    """The work grows with the matches, not with their square."""
    rng = random.Random(6)
    text = "é " + " ".join("".join(rng.choice("0123456789abcdef") for _ in range(26)) for _ in range(100_000))
    start = time.perf_counter()
    row = secrets.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert row.text == "é " + " ".join(["[SECRET]"] * 100_000) and time.perf_counter() - start < 60
