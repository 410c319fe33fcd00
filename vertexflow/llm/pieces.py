"""Splits texts by a pre-tokeniser's pattern and memoises what each match is worth."""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

#: Entries per generation of a cache: when the young one is full it becomes the old one, so that memory is bounded and frequent matches stay.
MAX_CACHED = 800_000
#: Letters and other characters for which the narrow form of a pattern matches the same as the full one.
LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
OTHERS = "\t\n\x0b\x0c\r -@[-`{-~"


def narrow(pattern: str) -> str | None:
    r"""The pattern with \p{L} and \p{N} spelt out for texts of LETTERS and OTHERS only; None if it has more classes."""
    out = pattern.replace(r"\p{L}\p{N}]", LETTERS + "0-9]").replace(r"\p{L}+", f"[{LETTERS}]+").replace(r"\p{N}+", "[0-9]+")
    return None if r"\p" in out else out


class Memo(dict):
    """Values by match; a missing one is taken from the old generation or encoded."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, match: str) -> bytes:
        value = self.old.get(match)
        if value is None:
            value = self.encode(match)
        if len(self) >= MAX_CACHED:
            self.old = dict(self)
            self.clear()
        self[match] = value
        return value


class PieceCache:
    """encoded(text) is the concatenation of the values of the text's matches."""

    def __init__(self, pattern: str, encode: Callable[[str], bytes]):
        self.memo = Memo(encode)
        self.full = regex.compile(pattern).findall
        small = narrow(pattern)
        self.narrow = re.compile(small).findall if small else None
        self.beyond = re.compile(f"[^{LETTERS}{OTHERS}]").search

    def matches(self, text: str) -> list[str]:
        return self.full(text) if self.narrow is None or self.beyond(text) else self.narrow(text)

    def encoded(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.matches(text)))
