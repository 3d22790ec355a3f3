"""Packing: every id in one piece, ids as the tokenizers library gives them, cuts of least cost."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from jobtext.llm import packing, tokens

TEXTS = ["", None, "One. Two! x", "  lead", "a  b", "tab\t x \n y ", "end ", " ", "\n \n", "it's we'll   nbsp 　x", "né ß 漢字 123 <|endoftext|>", "<|endoftext|> x", "a<|endoftext|><|endoftext|>\n b  c<|endoftext|>  ", "<|endoftext|", "q" * 5000, "word " * 3000 + ".", "A b.\n\nC  d.\r\n e"]


def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_units_equal_the_library(spark):
    t, coder, rng = reference(), tokens.byte_bpe(packing.RANKS, packing.TOKENIZER), random.Random(5)
    for text in [x or "" for x in TEXTS] + ["".join(rng.choice("ab .\n\t'sé1 \x1c\x85") for _ in range(40)) for _ in range(400)]:
        assert coder.whole(text).tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("window", [8, 12])
def test_least_cost(window):
    rng = random.Random(window)
    for _ in range(60):
        places, penalty = [0], [0]
        for _ in range(rng.randrange(1, 25)):
            places.append(places[-1] + rng.randrange(1, window + 1))
            penalty.append(rng.choice([0, 4, 64]))
        cost = [0] + [10**9] * (len(places) - 1)
        for j in range(1, len(places)):
            for i in range(j):
                n = places[j] - places[i]
                if n <= window:
                    pad = 0 if n & (n - 1) == 0 else window - n
                    cost[j] = min(cost[j], cost[i] + pad + penalty[j] + packing.PER_WINDOW)
        cuts = packing.best_cuts(places, penalty, window)
        got = 0
        for i, j in zip(cuts, cuts[1:]):
            n = places[j] - places[i]
            assert n <= window
            got += (0 if n & (n - 1) == 0 else window - n) + penalty[j] + packing.PER_WINDOW
        assert cuts[0] == 0 and cuts[-1] == len(places) - 1 and got == cost[-1]


def check(rows, docs, window):
    t = reference()
    want = defaultdict(list)
    for i, text in docs:
        want[i].append(t.encode(text or "", add_special_tokens=False).ids + [1])
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
    assert sum(r.length for r in rows) == sum(len(x) for v in want.values() for x in v)
    for i, v in want.items():
        if len(v) == 1:
            at = 0
            for r in sorted(by_doc[i], key=lambda r: r.start):
                ids = v[0][r.start : r.start + r.length]
                assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and r.doc_tokens == len(v[0])
                at += r.length
            assert at == len(v[0])


def test_whole_and_edges(spark, monkeypatch):
    docs = list(enumerate(TEXTS)) + [(None, "no id"), (3, "a  b"), (3, "  lead")]
    df = spark.createDataFrame([(i, x, 7, "s") for i, x in docs], "doc_id long, text string, start int, source string").repartition(3)
    for window, blocks in ((2048, 4), (64, 1)):
        check(packing.pack(df, window=window, blocks=blocks).collect(), docs, window)
    with_ids = packing.pack(df, blocks=2, with_ids=True).collect()
    assert all(len(r.ids) == r.length for r in with_ids)
    assert packing.pack(df.limit(0)).count() == 0
