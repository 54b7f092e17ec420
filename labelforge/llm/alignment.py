"""Cross-tokenizer alignment by galloping intersection (operator 13).

A byte-level BPE (A) and a sentencepiece model (B) cut one text into tokens;
each list of tokens is a sorted list of end offsets in bytes.  The shorter list
of a document drives a search into the longer one: exponential steps from the
last known place, then bisection.  Ends found exactly are the common ones, and
slice both lists into groups; the difference of the ranks of a token's two
borders is the range of the other side's tokens that it overlaps.  All
documents of a slice are searched in step, as arrays.

How many documents hold a pair of ids is one grouped count over the corpus;
links find it by a join in which frequent pairs are broadcast (their number is
bounded) and rare ones shuffled.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import ragged
from .common import land, per_batch
from .hot import join_groups
from .pretokens import PATTERN
from .token_counts import byte_characters

#: Bytes of text aligned at once (a longer text makes a larger slice).
SLICE_BYTES = 1 << 18
#: Every so many elements of a driving list are searched from the start of
#: their document, the others from the one before.
ANCHOR = 64
#: Pairs of ids that are broadcast at most.
BROADCAST_PAIRS = 500_000
#: Fixed value: how a piece writes a space.
SPACE_MARK = "▁"

COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class BytePieces:
    """The byte-level BPE of a tokenizers JSON file and the bytes of its tokens;
    strings of special tokens are plain text.

    Its merges must make the tokens in the order of their ids.  A merge is then
    known by the token it makes, and the file is a table of ranks."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, special = spec["model"], {t["content"] for t in spec.get("added_tokens") or []}
        to_byte = {c: b for b, c in enumerate(byte_characters())}
        names = {name: i for name, i in model["vocab"].items() if name not in special}
        made = [names["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if spec.get("normalizer") or model.get("ignore_merges") or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("this tokenizer file asks for more than byte-level BPE")
        if made != list(range(len(to_byte), len(names))):
            raise ValueError("the merges of this tokenizer file are not in the order of its tokens")
        raw = {i: bytes(to_byte[c] for c in name) for name, i in names.items()}
        self.model = tiktoken.Encoding("byte pieces", pat_str=PATTERN, mergeable_ranks={t: i for i, t in raw.items()}, special_tokens={})
        self.width, self.begin, self.table = byte_table(raw)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.model.encode_ordinary(t) for t in texts]


def byte_table(token_bytes: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(width, begin, bytes) of the tokens, by id."""
    parts = [token_bytes.get(i, b"") for i in range(max(token_bytes, default=-1) + 1)]
    width = np.fromiter(map(len, parts), np.int64, len(parts))
    return width, np.cumsum(width) - width, np.frombuffer(b"".join(parts), np.uint8)


class Pieces:
    """A sentencepiece model that adds a leading space, and the bytes of its
    pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.width, self.begin, self.table = byte_table({
            i: bytes([int(name[3:-1], 16)]) if m.is_byte(i) else name.replace(SPACE_MARK, " ").encode() for i, name in enumerate(names)})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def gallop(targets: np.ndarray, low: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each target the first index, at or behind ``low``, of an end that
    is no less; there is one for every target."""
    found = low.copy()
    live = np.flatnonzero(ends[low] < targets)
    before = low[live]  # ends[before] < target
    step, open_at, open_before, open_behind = 1, [], [], []
    while len(live):
        probe = np.minimum(before + step, len(ends) - 1)
        less = ends[probe] < targets[live]
        open_at.append(live[~less])
        open_before.append(before[~less])
        open_behind.append(probe[~less])
        live, before, step = live[less], probe[less], step * 2
    if open_at:
        at, a, b = map(np.concatenate, (open_at, open_before, open_behind))
        while (wide := b - a > 1).any():
            middle = (a + b) >> 1
            less = ends[middle] < targets[at]
            a, b = np.where(wide & less, middle, a), np.where(wide & ~less, middle, b)
        found[at] = b
    return found


def search(targets: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``gallop`` for a rising list of targets, whose documents begin at
    ``first`` in ``ends``: from the last anchor or the document's start."""
    if not len(targets):
        return np.zeros(0, np.int64)
    anchors = gallop(targets[::ANCHOR], first[::ANCHOR], ends)
    return gallop(targets, np.maximum(first, np.repeat(anchors, ANCHOR)[: len(targets)]), ends)


class Links:
    """Groups and links of the documents of one slice.

    ``ends_a`` and ``ends_b`` rise over all documents (every document ends in
    both), ``count_a`` and ``count_b`` are tokens a document.
    """

    def __init__(self, ends_a: np.ndarray, count_a: np.ndarray, ends_b: np.ndarray, count_b: np.ndarray):
        self.n_docs = len(count_a)
        self.doc_a = np.repeat(np.arange(self.n_docs), count_a)
        doc_b = np.repeat(np.arange(self.n_docs), count_b)
        a_drives = count_a <= count_b
        one = self._drive(np.flatnonzero(a_drives[self.doc_a]), self.doc_a, ends_a, ends_b, count_b)
        two = self._drive(np.flatnonzero(~a_drives[doc_b]), doc_b, ends_b, ends_a, count_a)
        #: the tokens of each link
        self.a, self.b = np.concatenate([one[0], two[1]]), np.concatenate([one[1], two[0]])
        #: the last tokens of each group
        last_a, last_b = np.concatenate([one[2], two[3]]), np.concatenate([one[3], two[2]])
        order = np.argsort(last_a, kind="stable")
        self.last_a, self.last_b = last_a[order], last_b[order]

    @staticmethod
    def _drive(own: np.ndarray, doc: np.ndarray, ends: np.ndarray, others: np.ndarray, other_count: np.ndarray):
        """(driving token, other token) of links and of common ends."""
        doc_first = (np.cumsum(other_count) - other_count)[doc[own]]
        target = ends[own]
        place = search(target, doc_first, others)
        common = others[place] == target
        # the rank of a token's start is that of the end before it
        start = place + common
        start = np.maximum(doc_first, np.concatenate([[0], start[:-1]])) if len(own) else doc_first
        n = place - start + 1
        return np.repeat(own, n), ragged(start, n), own[common], place[common]


def _digits(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return byte_table({i: str(i).encode() for i in range(n)})


class Aligner:
    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = BytePieces(byte_path), Pieces(piece_path)
        self.n_b = len(self.b.width)
        self.numbers = _digits(max(len(self.a.width), self.n_b))

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A ids, tokens a text, B ids, tokens a text); a text that is empty
        or does not come back from both has none."""
        spaced = [" " + t for t in texts]
        lists = self.a.encode(spaced), self.b.encode(texts)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in lists)
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in zip(lists, (n_a, n_b), strict=True))
        raw = [t.encode() for t in spaced]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        good = (size > 1) & self._same(self.a, a, n_a, data, size) & self._same(self.b, b, n_b, data, size)
        return a[np.repeat(good, n_a)], np.where(good, n_a, 0), b[np.repeat(good, n_b)], np.where(good, n_b, 0)

    @staticmethod
    def _same(side, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the joined bytes of a text's tokens are its bytes."""
        n = len(size)
        owner = np.repeat(np.arange(n), counts)
        same = np.bincount(owner, side.width[ids], n).astype(np.int64) == size
        some = same[owner]
        spelt = side.table[ragged(side.begin[ids[some]], side.width[ids[some]])]
        byte_of = np.repeat(np.arange(n), size)
        kept = same[byte_of]
        wrong = byte_of[kept][spelt != data[kept]]
        same[wrong] = False
        return same

    def written(self, a: np.ndarray, b: np.ndarray, links: Links) -> tuple[bytes, np.ndarray]:
        """The groups of all texts as ``a1,a2|b1;...`` and where each text's
        begin and end."""
        n_groups = len(links.last_a)
        group_a = np.repeat(np.arange(n_groups), np.diff(links.last_a, prepend=-1))
        group_b = np.repeat(np.arange(n_groups), np.diff(links.last_b, prepend=-1))
        at_a = np.arange(len(a)) + np.concatenate([[-1], links.last_b])[group_a] + 1
        at_b = np.arange(len(b)) + links.last_a[group_b] + 1
        ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = a, b
        mark[at_a[links.last_a]], mark[at_b[links.last_b]] = ord("|"), ord(";")
        width, begin, table = self.numbers
        length = width[ids] + 1
        end = np.cumsum(length)
        out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
        out[end - 1] = mark
        digit = np.ones(len(out), bool)
        digit[end - 1] = False
        out[digit] = table[ragged(begin[ids], width[ids])]
        last = np.zeros(links.n_docs + 1, np.int64)  # groups of one text end with its last token
        doc = links.doc_a[links.last_a]
        last[doc + 1] = end[at_b[links.last_b]]
        return out.tobytes(), np.maximum.accumulate(last)

    def align(self, texts: list[str]) -> dict[str, pa.Array]:
        """One entry a text: COUNTS, the groups, and the different pairs of
        linked ids (``a``, ``b``) with the number of their links (``times``)."""
        n = len(texts)
        a, n_a, b, n_b = self.tokens(texts)
        links = Links(np.cumsum(self.a.width[a]), n_a, np.cumsum(self.b.width[b]), n_b)
        owner = links.doc_a[links.a]
        per_doc = len(self.a.width) * self.n_b
        key, times = np.unique(owner * per_doc + a[links.a] * self.n_b + b[links.b], return_counts=True)
        n_pairs = np.bincount(key // per_doc, minlength=n)
        groups, ends = self.written(a, b, links)
        text = [groups[s : max(s, e - 1)] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        offsets = pa.array(np.concatenate([[0], np.cumsum(n_pairs)]).astype(np.int32))
        pair = key % per_doc
        lists = {"a": pair // self.n_b, "b": pair % self.n_b, "times": times}
        return {
            "n_a": pa.array(n_a), "n_b": pa.array(n_b),
            "n_groups": pa.array(np.bincount(links.doc_a[links.last_a], minlength=n)),
            "n_links": pa.array(np.bincount(owner, minlength=n)),
            "groups": text,
        } | {c: pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for c, x in lists.items()}


@lru_cache(maxsize=1)
def _aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE_BYTES:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def align(df: DataFrame, byte_path: str, piece_path: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text",
          groups: bool = False) -> DataFrame:
    """The ``keep`` columns, COUNTS, ``groups_sha256``, the different pairs of
    linked ids ``a``, ``b`` with ``times`` and (if asked for) ``groups``, as
    ``a1,a2|b1;a3|b2,b3``.

    Texts that are null, empty or do not come back from both tokenizers have
    no tokens and '' for digest and groups.  Repeated rows stay; an output name
    that clashes with a kept column is an error; whole texts are aligned, a
    very long one in a slice of its own.
    """
    made = [*COUNTS, "groups_sha256", "a", "b", "times", *["groups"] * groups]
    if clash := set(keep) & set(made):
        raise ValueError(f"columns {sorted(clash)} would be overwritten")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(byte_path, piece_path)
        for row in range(0, batch.num_rows, 256):
            part = batch.slice(row, 256)
            texts = [t or "" for t in part.column(len(keep)).to_pylist()]
            for begin, end in _slices(texts):
                found = aligner.align(texts[begin:end])
                text = found.pop("groups")
                own = part.slice(begin, end - begin)
                found["groups_sha256"] = pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in text])
                if groups:
                    found["groups"] = pa.array([t.decode() for t in text])
                yield pa.record_batch({c: own.column(i) for i, c in enumerate(keep)} | {c: found[c] for c in made})

    kinds = {**dict.fromkeys(COUNTS, "bigint"), "groups_sha256": "string", "groups": "string",
             **dict.fromkeys(("a", "b", "times"), "array<int>")}
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} {kinds[c]}" for c in made])
    return per_batch(df.select(*keep, df[text_col].alias("__text")), run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n_docs, best): in how many rows of ``aligned`` a pair of ids is
    linked, and whether that is the most of its A id."""
    pairs = aligned.select(F.explode(F.arrays_zip("a", "b")).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n_docs"))
    most = F.max("n_docs").over(Window.partitionBy("a"))  # at most one row a B id
    return pairs.select(_pair("a", "b").alias("pair"), "n_docs", (F.col("n_docs") == most).alias("best"))


def _pair(a: str, b: str):
    return F.shiftleft(F.col(a).cast("bigint"), 32) + F.col(b)


def score_links(df: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text",
                limit: int = BROADCAST_PAIRS) -> DataFrame:
    """(id, COUNTS, n_best, count_sum, groups_sha256) of every row.

    A pair's count is the number of rows that hold it linked; ``n_best`` is the
    number of a row's links whose count is the highest of their A id (ties
    included), ``count_sum`` the sum of counts over its links.  Rows of one id
    stay separate rows; see ``align`` for null, empty and odd texts; an empty
    table gives an empty result.
    """
    source = df.select(F.monotonically_increasing_id().alias("__row"), df[id_col].alias("__id"), df[text_col].alias("__text"))
    aligned = land(align(source, byte_path, piece_path, ("__row", "__id"), "__text"), "aligned")
    pairs = land(pair_counts(aligned), "pair-counts")
    n_links = aligned.agg(F.sum(F.size("a"))).first()[0] or 0
    links = aligned.select("__row", F.explode(F.arrays_zip("a", "b", "times")).alias("p")).select(
        "__row", _pair("p.a", "p.b").alias("pair"), F.col("p.times").cast("bigint").alias("times"))
    counted = join_groups(links, pairs, "pair", "n_docs", n_links, limit=limit)
    sums = counted.groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                        F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return (aligned.select("__row", "__id", *COUNTS, "groups_sha256").join(sums, "__row", "left")
            .select(F.col("__id").alias(id_col), *COUNTS, none("n_best"), none("count_sum"), "groups_sha256"))
