"""Licence scans: fuzzy search for short notices (operator 8).

Texts are written as their lower-cased words with single blanks.  A notice
that stands in a text with at most k edits contains one of its k+1 parts
without an edit (pigeonhole), so exact hits of the parts locate all
candidates.  The ranges around them are cut into pieces twice as long as the
notice that overlap by its length, so a notice is whole in one of them, and a
piece that holds too few of the notice's pairs of characters for k edits is
passed over.  In a piece the regex library matches the notice with at most k
edits, best first, then left and right of each hit; of hits that overlap the
one with fewest edits stays, so neighbouring notices are all found.  Exact
phrases are searched the same way with no edits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch
from .words import PLAIN, Words, slices

#: The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Short notices searched with edits, by label.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "the software is provided as is without warranty of any kind express or implied": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license": "apache",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "you should have received a copy of the gnu general public license along with this program": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "under the terms of the gnu library general public license": "lgpl",
    "under the terms of the gnu affero general public license": "agpl",
    "under the terms of the gnu free documentation license": "gfdl",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "neither the name of the copyright holder nor the names of its contributors": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this program and the accompanying materials are made available under the terms of the eclipse public license": "epl",
    "this work is licensed under a creative commons attribution": "cc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "distributed under the boost software license version 1 0": "bsl",
    "this software is provided as is without any express or implied warranty": "zlib",
    "this font software is licensed under the sil open font license": "ofl",
    "all rights reserved": "reserved",
}
#: Notices that a table may hold: they go to every task.
MOST_NOTICES = 10_000
#: One edit is allowed for each so many characters of a notice.
CHARS_PER_EDIT = 12

SPAN = "struct<label:string,base:boolean,first_word:bigint,last_word:bigint,edits:int,score:double>"


class Notice:
    """A notice, its parts and its bounded-error pattern."""

    def __init__(self, text: str, label: str, per_edit: int):
        self.text, self.label = text, label
        self.edits = len(text) // per_edit
        ends = [len(text) * i // (self.edits + 1) for i in range(self.edits + 2)]
        self.parts = [(a, text[a:b].encode()) for a, b in zip(ends, ends[1:], strict=False)]
        self.pattern = regex.compile(f"(?:{regex.escape(text)}){{e<={self.edits}}}", regex.BESTMATCH)
        self.pairs = Counter(map("".join, pairwise(text)))
        # an edit changes two pairs of neighbouring characters at most
        self.least = len(text) - 1 - 2 * self.edits

    def possible(self, piece: str) -> bool:
        """Whether ``piece`` holds enough of the notice's pairs of characters."""
        have = Counter(map("".join, pairwise(piece)))
        return sum(min(n, have[p]) for p, n in self.pairs.items()) >= self.least

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(begin, end, edits) of the notice's places in ``text``, none of which
        overlap; of those that would, the one with fewest edits, then the first."""
        size = len(self.text) + self.edits + 1
        found: set[tuple[int, int, int]] = set()
        for at in range(0, max(1, len(text) - size), size):
            todo = [(at, min(len(text), at + 2 * size))]
            while todo:
                a, b = todo.pop()
                if not self.possible(text[a:b]) or not (hit := self.pattern.search(text, a, b)):
                    continue
                found.add((hit.start(), hit.end(), sum(hit.fuzzy_counts)))
                todo += [(a, hit.start()), (hit.end(), b)]
        chosen: list[tuple[int, int, int]] = []
        for hit in sorted(found, key=lambda h: (h[2], h[0], h[1])):
            if all(hit[1] <= c[0] or hit[0] >= c[1] for c in chosen):
                chosen.append(hit)
        return sorted(chosen)


class Plain:
    """The texts of a slice, each a newline and its words with blanks between."""

    def __init__(self, data: np.ndarray, begins: np.ndarray):
        words = Words(data, begins, PLAIN, lower=True)
        self.words = words
        length = words.end - words.start
        total = int(length.sum()) + len(length)
        out = np.full(total, 0x20, np.uint8)
        at = np.cumsum(length + 1) - length  # each word's first byte
        kept = words.data[words.inside]
        out[np.arange(len(kept)) + np.repeat(np.arange(1, len(length) + 1), length)] = kept
        heads = words.first[:-1][words.counts() > 0]
        out[at[heads] - 1] = 0x0A
        self.at, self.raw = at, out.tobytes()

    def word(self, byte: int) -> int:
        """The word that holds this byte, or the one after the blank there."""
        return int(np.searchsorted(self.at, byte, "right")) - 1

    def text_of(self, word: int) -> int:
        return int(np.searchsorted(self.words.first, word, "right")) - 1


@lru_cache(maxsize=4)
def _searches(notices: tuple, phrases: tuple, per_edit: int):
    exact = [(label, re.compile(rb"(?<=[ \n])" + re.escape(p.encode()) + rb"(?=[ \n]|\Z)"), p.count(" ") + 1)
             for p, label in phrases]
    return [Notice(t, label, per_edit) for t, label in notices], exact


def _near(raw: bytes, notice: Notice) -> list[tuple[int, int]]:
    """Merged byte ranges, within one text, that may hold the notice."""
    room, size = notice.edits + 1, len(notice.text.encode())
    ranges = []
    for offset, part in notice.parts:
        at = raw.find(part)
        while at >= 0:
            a, b = max(0, at - offset - room), min(len(raw), at - offset + size + room)
            left = raw.rfind(b"\n", a, at + 1)
            right = raw.find(b"\n", at, b)
            a = left + 1 if left >= 0 else a
            b = right if right >= 0 else b
            while a > 0 and raw[a - 1] not in (0x20, 0x0A):  # to whole words
                a -= 1
            while b < len(raw) and raw[b] not in (0x20, 0x0A):
                b += 1
            ranges.append((a, b))
            at = raw.find(part, at + 1)
    ranges.sort()
    merged: list[tuple[int, int]] = []
    for a, b in ranges:
        if merged and a <= merged[-1][1] and b"\n" not in raw[merged[-1][1] : a + 1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def find_spans(plain: Plain, notices: list[Notice], exact: list) -> list[list[dict]]:
    """Spans of each text: exact phrases and notices with few edits."""
    found: list[list[dict]] = [[] for _ in range(plain.words.n_texts)]
    raw = plain.raw

    def add(first: int, last: int, label: str, base: bool, edits: int, score: float) -> None:
        text = plain.text_of(first)
        own = int(plain.words.first[text])
        found[text].append({"label": label, "base": base, "first_word": first - own, "last_word": last - own,
                            "edits": edits, "score": score})

    for label, pattern, n in exact:
        for hit in pattern.finditer(raw):
            first = plain.word(hit.start())
            add(first, first + n - 1, label, True, 0, 1.0)
    for notice in notices:
        for a, b in _near(raw, notice):
            piece = raw[a:b].decode()
            for start, stop, edits in notice.hits(piece):
                begin, end = a + len(piece[:start].encode()), a + len(piece[:stop].encode())
                first, last = plain.word(min(begin, len(raw) - 1)), plain.word(max(begin, end - 1))
                add(first, last, notice.label, False, edits, 1.0 - edits / len(notice.text))
    return found


def notice_table(table: DataFrame, text_col: str = "text", label_col: str = "label") -> dict[str, str]:
    """The notices of a table, as lower-cased words with single blanks; at most
    MOST_NOTICES, since they go to every task.  Rows without words are left out."""
    rows = table.select(text_col, label_col).where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).limit(MOST_NOTICES + 1).collect()
    if len(rows) > MOST_NOTICES:
        raise ValueError(f"more than {MOST_NOTICES} notices")
    words = [(" ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))), label) for text, label in rows]
    return {text: label for text, label in words if text}


def scan(df: DataFrame, notices: Mapping[str, str] | DataFrame = NOTICES, phrases: Mapping[str, str] = PHRASES,
         per_edit: int = CHARS_PER_EDIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, spans): every phrase and notice with its words' places.
    ``notices`` is a mapping of words to labels, or a table (text, label).

    Null and empty texts have no words and no spans; repeated rows are scanned
    each; long texts are scanned whole; only the two named columns are read.
    """
    if isinstance(notices, DataFrame):
        notices = notice_table(notices)
    fixed = tuple(notices.items()), tuple(phrases.items()), per_edit
    span = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first_word", pa.int64()),
                               ("last_word", pa.int64()), ("edits", pa.int32()), ("score", pa.float64())]))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        searched, exact = _searches(*fixed)
        for row, data, begins in slices(batch.column(1)):
            plain = Plain(data, begins)
            spans = find_spans(plain, searched, exact)
            yield pa.record_batch({id_col: batch.column(0).slice(row, len(spans)),
                                   "n_words": pa.array(plain.words.counts(), pa.int64()),
                                   "spans": pa.array(spans, span)})

    kind = df.schema[id_col].dataType.simpleString()
    return per_batch(df.select(id_col, text_col), run, f"`{id_col}` {kind}, n_words bigint, spans array<{SPAN}>")
