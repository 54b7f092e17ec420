import hashlib
import random
import re

import pytest
from edge import by_key, documents, prose, texts

from labelforge.llm import exact_dedup, hot

COLUMNS = ("doc_id", "keep_id", "group_size", "text_sha256")


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    out = []
    for i, t in rows:
        own = groups[normal(t)]
        known = [x for x in own if x is not None]
        out.append({"doc_id": i, "keep_id": min(known) if known else None, "group_size": len(own),
                    "text_sha256": hashlib.sha256(normal(t).encode()).hexdigest()})
    return out


def odd_rows():
    rng = random.Random(1)
    return [*texts(), (500, " "), (501, "\n\t"), (502, "a b"), (503, "a b"), (504, " a b"), (505, "a\x0bb"), (None, "a b"),
            (None, "only here"), (None, "only here"), (506, prose(rng, 30_000)), (507, "x\x00y"), (507, "x\x00y")]


@pytest.mark.parametrize("broadcast_cells", [exact_dedup.BROADCAST_CELLS, 0])
def test_marks_are_those_of_brute_force(spark, broadcast_cells):
    rows = odd_rows()
    got = exact_dedup.mark_copies(documents(spark, rows), broadcast_cells=broadcast_cells).collect()
    assert by_key(got, *COLUMNS) == by_key(brute(rows), *COLUMNS)
    kept = [r for r in got if r["kept"]]
    # one row of each text, the one with the smallest id
    assert len(kept) == len({r["text_sha256"] for r in got}) and all(r["doc_id"] == r["keep_id"] for r in kept)


@pytest.mark.parametrize("broadcast_cells", [exact_dedup.BROADCAST_CELLS, 0])
def test_dropping_keeps_whole_rows_in_place(spark, broadcast_cells):
    rows = odd_rows()
    docs = documents(spark, rows)
    out = exact_dedup.drop_copies(docs, broadcast_cells=broadcast_cells)
    assert out.columns == docs.columns
    got = out.collect()
    want = {r["text_sha256"]: r["keep_id"] for r in brute(rows)}
    assert sorted((hashlib.sha256(normal(r["text"]).encode()).hexdigest(), str(r["doc_id"])) for r in got) == sorted(
        (h, str(i)) for h, i in want.items())
    assert all(r["kept"] == "own" for r in got)


def test_filters_of_any_size_give_the_same(spark, monkeypatch):
    """Cells shared by different texts only bring more rows to the exact step."""
    rows = [(i, f"text {i % 700}") for i in range(1000)]
    monkeypatch.setattr(exact_dedup, "cells_for", lambda n: 64)
    got = exact_dedup.mark_copies(documents(spark, rows, extra=False)).collect()
    assert by_key(got, *COLUMNS) == by_key(brute(rows), *COLUMNS)


def test_lone_rows_are_not_shuffled(spark):
    """Of distinct texts hardly any pass the second filter."""
    docs = documents(spark, [(i, f"text {i}") for i in range(3000)] + [(5000, "text 7")], extra=False)
    prints = docs.select(docs["doc_id"].alias("__id"), exact_dedup.text_digest(docs["text"]).alias("__sha"))
    cells = exact_dedup.cells_for(3001)
    marked = exact_dedup.mark_possible(prints, exact_dedup.repeated_cells(prints, cells), cells, 3001)
    maybe = {r["__id"] for r in marked.where("__maybe").collect()}
    assert {7, 5000} <= maybe and len(maybe) < 60


def test_hot_text_with_rare_ones(spark, monkeypatch):
    """A third of all rows in one group, joined by both ways."""
    monkeypatch.setattr(hot, "BROADCAST_GROUPS", 3)
    rows = [(i, "hot" if i % 3 == 0 else f"t{i // 2}") for i in range(900)]
    got = exact_dedup.mark_copies(documents(spark, rows, extra=False)).collect()
    assert by_key(got, *COLUMNS) == by_key(brute(rows), *COLUMNS)


def test_joins_of_hot_and_rare_groups(spark):
    rows = spark.createDataFrame([("a",)] * 50 + [("b",)] * 2 + [("c",)] + [(None,)], "k string")
    groups = spark.createDataFrame([("a", 50, 1), ("b", 2, 2), ("d", 1, 3)], "k string, n bigint, v int")
    for how, missing in (("inner", 0), ("left", 2)):
        got = hot.join_groups(rows, groups, "k", "n", 54, how, limit=2).groupBy("k", "v").count().collect()
        assert {(r["k"], r["v"]): r["count"] for r in got if r["v"]} == {("a", 1): 50, ("b", 2): 2}
        assert sum(r["count"] for r in got if r["v"] is None) == missing


def test_nothing(spark):
    none = documents(spark, [])
    assert exact_dedup.mark_copies(none).collect() == [] and exact_dedup.drop_copies(none).collect() == []
