"""Quality rules: counts against plain Python, edges, thresholds from merged sketches."""

import random
import re
from collections import Counter

from jobtext.llm import quality


def slow(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    spots = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(spots))


def test_counts_and_edges(spark):
    rng = random.Random(2)
    texts = [None, "", " \n", "a", "a b", "a b c", "a a a a", "x y z x y z\nx y z", "\x0b#\x0c|$ é \U0001f600 w", "l\nl\n \nl", "a b a b a b c", "w " * 20000]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randrange(80))) for _ in range(30)]
    rows = [(i, t, None if i % 3 else "en", "s", 1, True) for i, t in enumerate(texts)] + [(0, None, "en", None, 1, True), (None, "a b", None, None, 2, False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, kept boolean").repartition(3)
    got = quality.verdicts(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = sorted(((r[0], *slow(r[1])) for r in rows), key=key)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key) == want
    assert all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) for r in got)
    assert quality.keep_good(df).columns == df.columns
    assert quality.verdicts(df.limit(0)).count() == 0


def test_outliers_go_and_clean_stays(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    clean = [(i, " ".join(rng.choices(words, k=rng.randrange(60, 200))), "xx", f"s{i % 3}") for i in range(700)]
    junk = [(1000 + i, " ".join(w + "##" for w in rng.choices(words, k=80)), "xx", "s1") for i in range(60)]
    junk += [(2000 + i, " ".join(w.upper() + "!!" for w in rng.choices(words, k=80)), "xx", "rare") for i in range(9)]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in quality.keep_good(df).collect()} == {r[0] for r in clean}
