"""BPE by segment trees against the tiktoken library, and round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from jobtext.llm import bpe, tokens

RANKS = tokens.ranks_of(bpe.RANKS)
LIB = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def texts():
    rng = random.Random(9)
    out = ["", None, " ", "  ", "a", "it's we'll  x", "né ß 漢字 \U0001f600", "tab\t\n x \n\n", "<|endoftext|>", "ab" * 3000, "é" * 500, "x" * 65, " " * 300 + "y"]
    for alphabet in ("abc ", "etaoin shrdlu", "ab .\n\t'sé1 漢\x1c\x85", "0123456789,"):
        out += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    return out + [bytes(rng.randrange(256) for _ in range(90)).decode("latin-1") for _ in range(20)]


def test_equals_library_and_round_trip(spark):
    t = texts()
    rows = [(i, x, b"c", 3) for i, x in enumerate(t)] + [(5, t[5], b"c", 3), (None, "no id", b"c", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids binary, n_tokens int").repartition(3)
    want = sorted((str(r[0]), np.array(LIB.encode_ordinary(r[1] or ""), "<u4").tobytes()) for r in rows)
    out = bpe.decode(bpe.encode(df)).collect()
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in out) == want
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in out) == sorted((str(r[0]), (r[1] or "").encode()) for r in rows)
    assert bpe.encode(df.limit(0)).count() == 0


def test_single_tree_equals_shared():
    coder, rng = bpe.trees(), random.Random(1)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 64))).encode() for _ in range(300)]
    for w in words:
        width = 1 << (len(w) - 1).bit_length()
        assert coder.many([w, w[:-1] + b"q"], width)[0].tolist() == coder.one(w)


def test_cache_limit(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_UNITS", 3)
    coder = bpe.Trees(RANKS)
    for x in texts()[:40]:
        assert np.frombuffer(coder.encode([x or ""])[0], "<u4").tolist() == LIB.encode_ordinary(x or "")
    assert hashlib.sha256(bpe.decoded(coder.encode(["naïve  text"])[0], bpe.token_bytes())).digest() == hashlib.sha256("naïve  text".encode()).digest()
