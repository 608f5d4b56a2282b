"""Token ids of texts, from the vocabulary file of a public byte-level tokenizer.

The ids are those that the tokenizers library gives for byte_bpe_50k.json without adding special tokens; the merges are
worked out by tiktoken on that file's vocabulary, which takes a fifth of the time.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import public_tokenizers

from ._spark import kept

#: Units whose ids are remembered; later ones are encoded anew each time.
REMEMBERED = 300_000
#: Fixed value: the characters of Unicode's White_Space.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNITS = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
_RUNS = re.compile(f"[{_WHITE}][{_WHITE}]")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a vocabulary file; on a cluster any path that every executor can open serves as well."""
    return public_tokenizers.path(name)


def _alphabet() -> dict[str, int]:
    """The bytes by the characters that stand for them: printable ones of Latin-1 for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Ids:
    """Encodes texts to unsigned 32-bit ids in the machine's order, which is little-endian wherever Spark's workers run.

    special tells whether the vocabulary's special tokens in a text stand for their ids, as in the library's plain
    call, or are ordinary text.

    The pattern that cuts a text before the merges never joins what stands on two sides of the place where white space
    begins. So a text is encoded in units, white space and what follows it, and the ids of frequent units are
    remembered. In a text without two white-space characters in a row the units are cut at its blanks alone.
    """

    def __init__(self, path: str | None = None, special: bool = False):
        import tiktoken

        with open(path or vocabulary(), encoding="utf-8") as f:
            file = json.load(f)
        added = {t["content"]: t["id"] for t in file["added_tokens"]}
        byte = _alphabet()
        ranks = {bytes(map(byte.__getitem__, token)): i for token, i in file["model"]["vocab"].items() if token not in added}
        self.ordinary = frozenset(ranks.values())  # the ids that ordinary text can have
        self.size = max([*self.ordinary, *added.values()]) + 1
        self._special = {t: np.array([i], "<u4").tobytes() for t, i in added.items()} if special else {}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) + ")") if self._special else None
        self._encode = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._units: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}

    def _unit(self, unit: str) -> bytes:
        out = array("I", self._encode(unit)).tobytes()
        if len(self._units) < REMEMBERED:
            self._units[unit] = out
        return out

    def _word(self, word: str) -> bytes:
        """The ids of a blank and a word."""
        out = array("I", self._encode(" " + word)).tobytes()
        if len(self._words) < REMEMBERED:
            self._words[word] = out
        return out

    def _ordinary(self, text: str) -> bytes:
        unit, of = self._units.get, self._unit
        if _RUNS.search(text):
            return b"".join([unit(u) or of(u) for u in _UNITS.findall(text)])
        first, *rest = text.split(" ")
        word, of = self._words.get, self._word
        return b"".join([self._unit(first) if first else b"", *[word(w) or of(w) for w in rest]])

    def __call__(self, text: str) -> bytes:
        if self._cut and self._cut.search(text):
            return b"".join([self._special.get(part) or self._ordinary(part) for part in self._cut.split(text)])
        return self._ordinary(text)


def encoder(path: str | None = None, special: bool = False) -> Ids:
    """One encoder for each worker, vocabulary and treatment of special tokens."""
    path = path or vocabulary()
    return kept(("ids", path, special), lambda: Ids(path, special))
