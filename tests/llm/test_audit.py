"""Filter audit against a plain loop over documents, orders and steps."""

import re
from collections import Counter, defaultdict
from itertools import permutations

from jobtext.llm import audit

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i}" for i in range(60))
SAME = "very " * 80
DOCS = [
    (1, LONG, "a"), (2, LONG, "a"), (2, LONG, "a"), (3, LONG, "b"), (4, LONG + " #", "b"), (5, SAME, "b"), (6, SAME.upper(), None),
    (7, None, ""), (8, "", "a"), (9, "A B $ é漢", None), (10, LONG, None), (None, LONG, "a"), (None, "x", "c"), (11, SAME + "|", "a"), (11, "A" * 9, "a"),
]
LABELS = [(1, 1, 0), (2, 1, None), (2, None, 1), (3, 0, 1), (9, 1, 1), (9, 1, 1), (10, 0, 0), (None, 1, 1), (77, 1, 1)]


def fails(docs):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, s in docs:
        t = t or ""
        w = WORDS.findall(t)
        yield i, s or "", {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}


def brute(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    out, over = defaultdict(Counter), Counter()
    for i, part, f in fails(docs):
        for order in permutations("ABCDE"):
            gone = False
            for k, x in enumerate(order):
                c = out[part, "".join(order), k + 1]
                here = f[x] and not gone
                c["kept"] += not gone and not f[x]
                c["removed"] += here
                c["redundant"] += f[x] and gone
                c["unique_fails"] += f[x] and sum(f.values()) == 1
                c["good_lost"] += here and i in good
                c["toxic_lost"] += here and i in toxic
                over[part, x] += here
                gone = gone or f[x]
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    return {key: (*[c[n] for n in names], over[key[0], key[1][key[2] - 1]]) for key, c in out.items()}


def test_against_loop(spark):
    docs = spark.createDataFrame([(*r, 9, "m") for r in DOCS], "doc_id long, text string, source string, mask int, part string").repartition(3)
    labels = spark.createDataFrame([(*r, "x") for r in LABELS], "doc_id int, quality int, toxic int, text string")
    got = audit.audit(docs, labels).collect()
    want = brute(DOCS, LABELS)
    assert len(got) == len(want) == 600 * 4
    for r in got:
        assert tuple(r)[3:] == want[r.part, r.filter_order, r.step]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs, labels).count() == 0
    assert audit.audit(spark.createDataFrame([(1, "x", "s")], docs.schema), labels).count() == 600


def test_fields_hold_the_largest_counts():
    """Two counts that fill a long to its end leave their neighbours alone."""
    for mask in (0, 5, 31):
        for kind in audit.OUTCOMES:
            one = audit.unpacked(audit.packed(kind, mask))
            assert set(one.tolist()) <= {0, 1}
            assert (audit.unpacked((2**63 - 1) * audit.packed(kind, mask)) == one * (2**63 - 1)).all()
