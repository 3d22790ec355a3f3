"""Words encoded together are cut from one run of bytes."""

from jobtext.llm import bpe


def test_bytes_of_words_encoded_together():
    coder = bpe.trees()
    words = [b"qzxjw", b"kkzzq", b"xy" * 4, b"zq", b"zzzzzzzq"]
    got = coder.many_bytes(words, 8)
    assert [len(x) % 4 for x in got] == [0] * len(words)
    assert got == [b"".join(i.to_bytes(4, "little") for i in coder.one(w)) for w in words]
