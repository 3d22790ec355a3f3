"""The pipeline's stages against brute-force versions, each on its own input."""

import random
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline
from test_linededup import slow as removed
from test_packing import check
from test_quality import slow as counts
from test_secrets import slow as spans
from test_simhash import slow_components, slow_fp


def corpus():
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    text = lambda: "\n".join(" ".join(rng.choices(words, k=rng.randrange(20, 40))) for _ in range(4))
    base = [text() for _ in range(70)]
    out = base + base[:6] + [t.replace(" ", " zz ", 1) for t in base[6:12]] + ["too short", "", None, "again and " * 60]
    out += [t.replace("\n", " token=" + "".join(rng.choice("0123456789abcdef") for _ in range(30)) + "\n", 1) for t in (text() for _ in range(5))]
    out += [" ".join(w + "###" for w in rng.choices(words, k=90)) for _ in range(3)]
    return [(i, t, "en", "s", 0 if t is None else len(t)) for i, t in enumerate(out)]


def test_stages_and_run(spark, tmp_path):
    rows = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "secret_scan", "packing"]
    docs, texts = spark.read.parquet(str(tmp_path / "documents.parquet")), {r[0]: r[1] for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name == "packing":
            got = out.collect()
            check(got, sorted(texts.items()), 2048)
            break
        assert out.columns == docs.columns
        got = {r.doc_id: r.text for r in out.collect()}
        assert {r.doc_id: r.n_chars for r in out.collect()} == {i: len(t or "") for i, t in got.items()}
        if name == "quality_rules":
            fine = {i for i, t in texts.items() if (c := counts(t))[0] >= 50 and 2 * c[4] <= c[0] and "###" not in t}
            want = {i: t for i, t in texts.items() if i in fine}
        elif name == "line_dedup":
            gone = removed(list(texts.items()))
            want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get((i, t), [])) for i, t in texts.items()}
        elif name == "near_dedup":
            group = slow_components({slow_fp(t) for t in texts.values()}, 4)
            first = {}
            for i, t in sorted(texts.items()):
                first.setdefault(group[slow_fp(t)], i)
            want = {i: texts[i] for i in first.values()}
        else:
            want = {}
            for i, t in texts.items():
                assert "[SECRET]" not in t
                keep, at = "", 0
                for a, _, b, _ in spans(t):
                    if a >= at:
                        keep += t[at:a] + "[SECRET]"
                    at = max(at, b)
                want[i] = keep + t[at:]
            assert any("[SECRET]" in t for t in want.values()) and not any(re.search("[0-9a-f]{24}", t) for t in got.values())
        assert got == want, name
        texts = want
        docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], schema)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(got)
