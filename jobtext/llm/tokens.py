"""Token ids of whole texts with the public tokenizers, through a bounded cache of units.

A byte-level BPE splits text by a pattern first and merges inside each match.
Every match ends before a space that follows a character other than white
space, and before one that precedes such a character. Texts whose spaces are
all of these kinds are cut there, and equal units are encoded once a process.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable

import numpy as np

#: Units that a process remembers; further ones are encoded when they come.
CACHE_UNITS = 600_000
#: A space inside a run of white space that is not its last character before another word.
INSIDE_RUN = re.compile(r"\s (?:\s|\Z)")
_MADE: dict[str, "UnitEncoder"] = {}


class UnitEncoder(dict):
    """word -> ids of a space and the word as little-endian unsigned 32-bit bytes.

    ``added``: strings of the vocabulary's added tokens and their ids; a text
    is cut at these first, the parts between are encoded each for itself."""

    def __init__(self, encode: Callable[[str], list[int]], added: dict[str, int], limit: int = CACHE_UNITS):
        super().__init__()
        self._encode, self._limit, self._added = encode, limit, added
        longest_first = sorted(added, key=len, reverse=True)
        self._cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None

    def __missing__(self, word: str) -> bytes:
        ids = self.ids(" " + word)
        if len(self) < self._limit and len(word) <= 64:
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        return np.array(self._encode(text), "<u4").tobytes()

    def whole(self, text: str) -> np.ndarray:
        """Ids of the whole text."""
        if any(a in text for a in self._added):
            parts = [self._plain(x) if i % 2 == 0 else np.array([self._added[x]], "<u4").tobytes() for i, x in enumerate(self._cut.split(text))]
            return np.frombuffer(b"".join(parts), "<u4")
        return np.frombuffer(self._plain(text), "<u4")

    def _plain(self, text: str) -> bytes:
        if INSIDE_RUN.search(text):
            return self.ids(text)
        head, *rest = text.split(" ")
        return b"".join([self.ids(head), *map(self.__getitem__, rest)])


def ranks_of(name: str) -> dict[bytes, int]:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def added_tokens(name: str) -> dict[str, int]:
    """Strings and ids of the added tokens of a tokenizer file; those that strip
    or bound their neighbours are not among the public vocabularies' own."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def byte_bpe(ranks: str, tokenizer: str) -> "UnitEncoder":
    """Encoder of a rank file with the added tokens of the tokenizer file of the
    same vocabulary, one for a process."""
    if ranks not in _MADE:
        import public_tokenizers
        import tiktoken

        core = tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(ranks), special_tokens={})
        _MADE[ranks] = UnitEncoder(core.encode_ordinary, added_tokens(tokenizer))
    return _MADE[ranks]


def sentence_ends(ranks: str, tokenizer: str) -> np.ndarray:
    """By id, whether the token's text ends a sentence or a line."""
    found = ranks_of(ranks)
    out = np.zeros(max([*found.values(), *added_tokens(tokenizer).values()]) + 1, bool)
    for token, i in found.items():
        out[i] = token.rstrip(b" \"')")[-1:] in (b".", b"!", b"?", b"\n")
    return out
