"""SimHash near-duplicates against brute force on small tables."""

import random

import xxhash
from pyspark.sql import functions as F

from jobtext.llm import simhash
from jobtext.llm.components import components


def slow_fp(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(fps, bits):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if bin(a ^ b).count("1") <= bits:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def corpus():
    rng = random.Random(7)
    vocab = ["w%d" % i for i in range(60)] + ["Éa", "ßx", "ABC", " y"]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.choice([3, 30, 200]))) for _ in range(40)]
    texts = list(base)
    for t in base:
        for _ in range(3):
            w = t.split(" ")
            w[rng.randrange(len(w))] = "zz"
            texts.append(" ".join(w))
    texts += [None, "", " \t\n", "one", "One\n", base[0], base[0], "x " * 30000]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    return rows + [rows[0], (None, base[1], "a", 2), (None, "only null id " * 9, "a", 2)]


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int").repartition(5)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    comp = slow_components({slow_fp(r[1]) for r in rows}, 4)
    least = {}
    for r in rows:
        if r[0] is not None:
            k = comp[slow_fp(r[1])]
            least[k] = min(least.get(k, r[0]), r[0])
    want = sorted((str(r[0]), slow_fp(r[1]), str(least.get(comp[slow_fp(r[1])]))) for r in rows)
    assert sorted((str(g.doc_id), g.fp % (1 << 64), str(g.component_id)) for g in got) == want
    kept = simhash.survivors(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(comp.values()))


def test_survivors_of_near_texts_with_null_ids(spark):
    rng = random.Random(11)
    words = ["w%d" % rng.randrange(500) for _ in range(400)]
    near = [" ".join(words)]
    for i in range(0, 400, 7):
        t = " ".join([*words[:i], "zz", *words[i + 1 :]])
        if 1 <= bin(slow_fp(t) ^ slow_fp(near[0])).count("1") <= 4:
            near.append(t)
    assert len(near) > 3
    rows = [(None, t) for t in near] + [(None, "another text of its own " * 9), (7, near[0][::-1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    comp = slow_components({slow_fp(t) for _, t in rows}, 4)
    kept = simhash.survivors(docs).collect()
    assert len(kept) == len(set(comp.values())) == len({comp[slow_fp(r.text)] for r in kept})


def test_crowded_cells_and_other_limits(spark):
    rng = random.Random(3)
    centre = [rng.getrandbits(64) for _ in range(3)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for c in centre for _ in range(25)}
    fps |= {rng.getrandbits(64) for _ in range(40)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    for bits, cell in ((4, 16), (3, 2), (1, 2)):
        roots = {r.node: r.root for r in components(simhash.links(df, bits, cell)).collect()}
        got = {}
        for (s,) in signed:
            got.setdefault(roots.get(s, s), set()).add(s % (1 << 64))
        want = {}
        for f, r in slow_components(fps, bits).items():
            want.setdefault(r, set()).add(f)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())), (bits, cell)


def test_long_chain_and_empty(spark):
    chain = spark.range(30).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in components(chain).collect()} == {0}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.survivors(empty).count() == 0
