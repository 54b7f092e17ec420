import bisect
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from edge import documents, texts
from tokenizers import Tokenizer

from labelforge.llm import alignment
from labelforge.llm.token_counts import byte_characters

JSON, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["<|endoftext|> a", "▁x", "a▁", "\x00", " ", "  ", "\n", "<s>a</s>", "<0x41>", "a" * 700, "é", "﻿a", "\r\n\r\n", "ﬁ𐍈", "<unk>"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(JSON)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES), {c: b for b, c in enumerate(byte_characters())}


def spans(parts):
    ends = np.cumsum([len(p) for p in parts]).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def brute(text, libraries):
    """(A ids, B ids, groups, links as index pairs) by the libraries."""
    a_lib, b_lib, to_byte = libraries
    if not text:
        return [], [], "", []
    a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
    a_parts = [bytes(to_byte[c] for c in a_lib.id_to_token(i)) for i in a]
    b_parts = [bytes([int(b_lib.id_to_piece(i)[3:-1], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(a_parts) == b"".join(b_parts) == (" " + text).encode():
        return [], [], "", []
    a_spans, b_spans = spans(a_parts), spans(b_parts)
    groups, low = [], 0
    for end in sorted({e for _, e in a_spans} & {e for _, e in b_spans}):
        inside = [[str(i) for i, (_, e) in zip(ids, s, strict=True) if low < e <= end] for ids, s in ((a, a_spans), (b, b_spans))]
        groups.append(",".join(inside[0]) + "|" + ",".join(inside[1]))
        low = end
    starts = [s for s, _ in b_spans]
    links = []
    for i, (s, e) in enumerate(a_spans):
        j = max(0, bisect.bisect_right(starts, s) - 1)
        while j < len(b) and starts[j] < e:
            links.append((i, j))
            j += 1
    return a, b, ";".join(groups), links


def cases():
    return [(i, t) for i, t in texts() if len(t or "") < 20_000] + [(600 + i, t) for i, t in enumerate(ODD)]


def test_documents_against_the_libraries(spark, libraries):
    rows = cases()
    found = [(i, *brute(t, libraries)) for i, t in rows]
    docs_of = Counter(p for _, a, b, _, links in found for p in {(a[i], b[j]) for i, j in links})
    best = {}
    for (a, _), n in docs_of.items():
        best[a] = max(n, best.get(a, 0))
    want = []
    for i, a, b, groups, links in found:
        counts = [(docs_of[a[x], b[y]], best[a[x]]) for x, y in links]
        want.append((i, len(a), len(b), len(groups.split(";")) if groups else 0, len(links), sum(n == m for n, m in counts),
                     sum(n for n, _ in counts), hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    for limit in (alignment.BROADCAST_PAIRS, 7):  # all pairs broadcast; frequent ones only
        got = alignment.score_links(documents(spark, rows), JSON, PIECES, limit=limit).collect()
        assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in names)) for r in got)


def test_groups_are_written_whole(spark, libraries):
    rows = cases()
    got = alignment.align(documents(spark, rows, extra=False), JSON, PIECES, ("doc_id", "text"), groups=True).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["groups"] == brute(r["text"], libraries)[2]


def test_tokens_are_those_of_the_libraries(libraries):
    """Odd strings, whether or not they come back from both."""
    import random

    rng = random.Random(3)
    letters = list("ab 'stre\n1é中!▁<>|") + ["՘", "\U00010940", "<|endoftext|>", "\x85", "‍", "<0x0A>", "  ", " don't", "日本", "\x00", "🙂"]
    texts_ = ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(1500)] + ["aaaaaaaaaa aaaaaaa", "'s'll I'm don't", "a b", "\u2028x"]
    a_lib, b_lib, _ = libraries
    assert alignment.BytePieces(JSON).encode([" " + t for t in texts_]) == [e.ids for e in a_lib.encode_batch([" " + t for t in texts_], add_special_tokens=False)]
    assert alignment.Pieces(PIECES).encode(texts_) == [b_lib.encode(t) for t in texts_]


def test_galloping_finds_what_bisection_finds():
    rng = np.random.default_rng(4)
    for _ in range(50):
        ends = np.unique(rng.integers(0, 5000, rng.integers(1, 900)))
        targets = np.unique(rng.integers(0, ends[-1] + 1, rng.integers(1, 600)))
        want = np.searchsorted(ends, targets)
        low = np.maximum(0, want - rng.integers(0, 70, len(targets)))
        assert (alignment.gallop(targets, low, ends) == want).all()
        assert (alignment.search(targets, np.zeros(len(targets), np.int64), ends) == want).all()


def test_overlaps_against_all_pairs():
    rng = np.random.default_rng(9)
    for _ in range(30):
        a_ends, b_ends, n_a, n_b, at = [], [], [], [], 0
        for _ in range(rng.integers(1, 6)):
            size = int(rng.integers(1, 60))
            for ends, counts in ((a_ends, n_a), (b_ends, n_b)):
                own = np.unique(np.append(rng.integers(1, size + 1, rng.integers(0, size + 1)), size)) + at
                ends.extend(own.tolist())
                counts.append(len(own))
            at += size
        links = alignment.Links(np.array(a_ends), np.array(n_a), np.array(b_ends), np.array(n_b))
        begins = lambda ends: [0, *ends[:-1]]
        want = {(i, j) for i, (s, e) in enumerate(zip(begins(a_ends), a_ends, strict=True))
                for j, (u, v) in enumerate(zip(begins(b_ends), b_ends, strict=True)) if s < v and u < e}
        got = list(zip(links.a.tolist(), links.b.tolist(), strict=True))
        assert len(got) == len(want) and set(got) == want
        assert [a_ends[i] for i in links.last_a] == sorted(set(a_ends) & set(b_ends)) == [b_ends[j] for j in links.last_b]


def test_nothing_and_clashes(spark):
    none = documents(spark, [])
    assert alignment.score_links(none, JSON, PIECES).collect() == []
    with pytest.raises(ValueError, match="overwritten"):
        alignment.align(none.withColumnRenamed("mark", "n_a"), JSON, PIECES, keep=("doc_id", "n_a"))
    only = alignment.score_links(documents(spark, [(1, None), (2, ""), (2, "")]), JSON, PIECES).collect()
    assert sorted(tuple(r) for r in only) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
