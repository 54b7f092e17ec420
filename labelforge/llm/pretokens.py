"""Splitting text into the pieces that byte-level BPE merges on their own."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import regex

#: Fixed value: the split pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Below this character (Latin, Greek, Cyrillic) letters, numbers and white
#: space are written out for the faster ``re`` engine.
NEAR = 0x530


def _spans(chars: str) -> str:
    """A character class's inside: ``chars`` as ranges."""
    codes = sorted(map(ord, chars))
    edges = [i for i, c in enumerate(codes) if i == 0 or codes[i - 1] != c - 1] + [len(codes)]
    return "".join(f"{re.escape(chr(codes[a]))}-{re.escape(chr(codes[b - 1]))}" for a, b in zip(edges, edges[1:], strict=False))


@lru_cache(maxsize=1)
def _near_split():
    """PATTERN for texts of characters below NEAR."""
    low = "".join(map(chr, range(NEAR)))
    letter, number, space = (_spans("".join(regex.findall(p, low))) for p in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
                      f"|[{space}]+(?![^{space}])|[{space}]+").findall


@lru_cache(maxsize=1)
def _newer() -> str:
    """Characters that only the ``regex`` module's newer Unicode tables take
    for letters or numbers; the tokenizer libraries take them for neither."""
    every = "".join(map(chr, [*range(NEAR, 0xD800), *range(0xE000, 0x110000)]))
    return "".join(c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn")


@lru_cache(maxsize=1)
def splitter():
    """``str -> list[str]``: every match of PATTERN, by the Unicode tables of
    the tokenizer libraries."""
    near, usual, new = _near_split(), regex.compile(PATTERN).findall, _newer()
    far = re.compile(f"[{chr(NEAR)}-\U0010ffff]").search
    odd = re.compile(f"[{_spans(new)}]").search if new else lambda text: None
    # written as one private character that belongs to neither class
    as_other = {ord(c): "\ue000" for c in new}

    def split(text: str) -> list[str]:
        if text.isascii() or not far(text):
            return near(text)
        if not odd(text):
            return usual(text)
        out, at = [], 0
        for piece in usual(text.translate(as_other)):
            at += len(piece)
            out.append(text[at - len(piece) : at])
        return out

    return split
