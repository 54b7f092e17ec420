from collections import defaultdict

import pytest
from edge import SPACED, by_key, documents, lower, texts

from labelforge.llm import jaccard_join, substring_dedup
from labelforge.llm.components import components


def cut(rows, size):
    first = {}
    for i, t in rows:
        w = SPACED.findall(t or "")
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = SPACED.findall(t or "")
        gone = set()
        for k in range(len(w) - size + 1):
            least = first.get(tuple(w[k : k + size]))
            if least is not None and (i is None or least < i):
                gone.update(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append({"doc_id": i, "n_words": len(w), "n_removed": len(gone), "kept": kept})
    return out


def test_substrings_against_brute_force(spark):
    keys = "doc_id", "n_words", "n_removed", "kept"
    for size, start in ((50, 25), (50, 12), (20, 3), (7, 7)):
        got = substring_dedup.dedup_substrings(documents(spark), size, start)
        assert by_key(got.collect(), *keys) == by_key(cut(texts(), size), *keys), (size, start)


def test_substring_spans_are_the_removed_words(spark):
    for r in substring_dedup.dedup_substrings(documents(spark)).collect():
        assert sum(s["last_word"] - s["first_word"] + 1 for s in r["removed"]) == r["n_removed"]
        assert len(SPACED.findall(r["kept"])) == r["n_words"] - r["n_removed"]


def test_levels_double():
    assert substring_dedup.levels(50, 25) == [25, 50]
    assert substring_dedup.levels(50, 3) == [3, 6, 12, 24, 48, 50]
    assert substring_dedup.levels(4, 9) == [4]


def shingle_set(text, k):
    w = SPACED.findall(lower(text))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def groups(rows, k, percent):
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    least = {r: min((x for x in m if x is not None), default=None) for r, m in members.items()}
    return [{"doc_id": rows[i][0], "n_shingles": len(sets[i]), "component_id": least[find(i)]} for i in range(len(rows))]


def test_jaccard_groups_against_brute_force(spark):
    keys = "doc_id", "n_shingles", "component_id"
    for k, percent in ((4, 85), (2, 60), (1, 90)):
        got = jaccard_join.similar_groups(documents(spark), k, percent)
        assert by_key(got.collect(), *keys) == by_key(groups(texts(), k, percent), *keys), (k, percent)


@pytest.mark.parametrize("meet", [1, 3])
def test_any_number_of_meetings_gives_the_same_links(spark, meet):
    keys = "doc_id", "n_shingles", "component_id"
    assert by_key(jaccard_join.similar_groups(documents(spark), meet=meet).collect(), *keys) == by_key(groups(texts(), 4, 85), *keys)


def test_chains_of_links_are_one_group(spark):
    """Each document is like the next one only."""
    w = [f"w{i}" for i in range(160)]
    rows = [(i, " ".join(w[4 * i : 4 * i + 100])) for i in range(15)]
    got = jaccard_join.similar_groups(documents(spark, rows)).collect()
    assert by_key(got, "doc_id", "component_id") == by_key(groups(rows, 4, 85), "doc_id", "component_id")
    assert {r["component_id"] for r in got} == {0}


def test_overlap_bound_is_never_too_low():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        universe = rng.integers(0, 2**63, 900).astype(np.uint64)
        x = np.unique(rng.choice(universe, rng.integers(1, 800)))
        y = np.unique(rng.choice(universe, rng.integers(1, 800)))
        common = len(np.intersect1d(x, y))
        assert jaccard_join.max_overlap(jaccard_join._parity(x), len(x), jaccard_join._parity(y), len(y)) >= common


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200)] + [(5, 5), (139, 100)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100), **dict.fromkeys((200, 201, 202), 200)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_empty_tables(spark):
    none = documents(spark, [])
    assert substring_dedup.dedup_substrings(none).collect() == []
    assert jaccard_join.similar_groups(none).collect() == []


def test_only_nulls(spark):
    rows = [(None, None), (None, "a b c d e f"), (1, None)]
    got = jaccard_join.similar_groups(documents(spark, rows)).collect()
    assert by_key(got, "doc_id", "n_shingles", "component_id") == by_key(groups(rows, 4, 85), "doc_id", "n_shingles", "component_id")
    kept = substring_dedup.dedup_substrings(documents(spark, rows), 3, 2).collect()
    assert by_key(kept, "doc_id", "n_removed") == [(1, 0), (None, 0), (None, 0)]
    assert sorted(r["kept"] for r in kept) == ["", "", "a b c d e f"]


def test_crowded_bitmaps_change_nothing(spark, monkeypatch):
    """Bitmaps that let most keys through cost rows, not results."""
    from labelforge.llm import sketch

    monkeypatch.setattr(sketch, "MIN_BITS", 1 << 15)
    monkeypatch.setattr(sketch, "MAX_BITS", 1 << 15)
    got = substring_dedup.dedup_substrings(documents(spark)).collect()
    keys = "doc_id", "n_words", "n_removed", "kept"
    assert by_key(got, *keys) == by_key(cut(texts(), 50), *keys)
    groups_got = jaccard_join.similar_groups(documents(spark)).collect()
    keys = "doc_id", "n_shingles", "component_id"
    assert by_key(groups_got, *keys) == by_key(groups(texts(), 4, 85), *keys)


def test_bitmap_holds_its_keys(spark):
    import numpy as np

    from labelforge.llm import sketch

    keys = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 3000)
    df = spark.createDataFrame([(int(k),) for k in keys] + [(None,)], "k bigint")
    bits = sketch.bitmap(df, "k").value
    assert bits.test(keys.view(np.uint64)).all()
    others = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 20_000).view(np.uint64)
    assert bits.test(others).mean() < 0.02
    assert not sketch.bitmap(df.where("k IS NULL"), "k").value.test(others).any()
