import random

import pytest
from pyspark.sql import Window, functions as F

from labelforge.operators import select as S
from labelforge.operators.ordering import with_rank
from labelforge.operators.split import EVAL_FRACTIONS, TRAIN_FRACTIONS, restrict_to_split, stratified_split


def _records(spark):
    rows = [(0, "b1", True, 0.0), (1, "c1", False, 0.9), (2, "c2", False, 0.1), (3, "c3", False, 0.0),
            (4, "c4", False, 0.1), (5, "b2", True, 0.0)]
    return spark.createDataFrame(rows, "seq long, url string, is_bad boolean, confidence double")


def _ordered(df):
    return [r.url for r in df.orderBy(*S.selection_order(df)).collect()]


@pytest.mark.parametrize("target,expected", [
    (4, ["b1", "b2", "c3", "c2"]),
    (5, ["b1", "b2", "c3", "c2", "c4"]),
    (1, ["b1", "b2"]),
    (10, ["b1", "b2", "c3", "c2", "c4", "c1"]),
])
def test_quota_fixture(spark, target, expected):
    assert _ordered(S.quota_fill(_records(spark), target)) == expected


def test_lowest_k_is_the_sorted_head(spark):
    rnd = random.Random(3)
    rows = [(i, round(rnd.random(), 2)) for i in range(3000)]
    df = spark.createDataFrame(rows, "seq long, confidence double")
    for k in (0, 1, 700, 3000, 5000):
        got = S.lowest_k(df, k, ["confidence", "seq"], rank_col="rank").orderBy("rank").collect()
        assert [r.seq for r in got] == [i for _, i in sorted((c, i) for i, c in rows)][:k]
        assert [r["rank"] for r in got] == list(range(min(k, 3000)))


def test_with_rank_matches_window(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.choice([0, 1, 1, 1, None]), rnd.random()) for i in range(5000)]
    df = spark.createDataFrame(rows, "k long, g int, v double")
    ours = {r.k: r.rank for r in with_rank(df, ["v", "k"], group_by=["g"]).collect()}
    w = Window.partitionBy("g").orderBy("v", "k")
    ref = {r.k: r.rn for r in df.select("k", (F.row_number().over(w) - 1).alias("rn")).collect()}
    assert ours == ref


def _truth(spark, n_pos=100, n_neg=100):
    rows = [(f"p{i}", 1) for i in range(n_pos)] + [(f"n{i}", 0) for i in range(n_neg)]
    return spark.createDataFrame(rows, "filename string, label int")


@pytest.mark.parametrize("fractions,sizes", [(EVAL_FRACTIONS, (140, 30, 30)), (TRAIN_FRACTIONS, (160, 36, 4))])
def test_split_sizes(spark, fractions, sizes):
    sp = stratified_split(_truth(spark), fractions=fractions).collect()
    got = {s: [r for r in sp if r.split == s] for s in ("train", "val", "test")}
    assert tuple(len(got[s]) for s in ("train", "val", "test")) == sizes
    for s in got:
        assert sum(r.label for r in got[s]) * 2 == len(got[s])  # stratified: half positive
    assert len({r.filename for r in sp}) == 200  # disjoint and covering


def test_split_deterministic_and_restrict(spark):
    a = {(r.filename, r.split) for r in stratified_split(_truth(spark)).collect()}
    b = {(r.filename, r.split) for r in stratified_split(_truth(spark)).collect()}
    assert a == b
    sp = stratified_split(_truth(spark))
    test_names = {f for f, s in a if s == "test"}
    kept = restrict_to_split(_truth(spark), sp, "test")
    assert {r.filename for r in kept.collect()} == test_names
    assert restrict_to_split(_truth(spark), sp, "all").count() == 200


def test_hash_split_is_close(spark):
    sp = stratified_split(_truth(spark, 2000, 2000), exact=False).groupBy("split").count().collect()
    sizes = {r.split: r["count"] for r in sp}
    assert abs(sizes["train"] - 2800) < 150 and sum(sizes.values()) == 4000


NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("kind,values", [
    ("double", [None, None, -INF, -1e308, -2.5, -2.5, 0.0, 5e-324, 1e-323, 0.1, 0.1 + 1e-17, 0.30000000000000004, 0.3, 1e308, INF, NAN, NAN]),
    ("double", [random.Random(1).choice([0.01, 0.02, 0.5, 0.99]) for _ in range(400)]),
    ("double", [random.Random(2).gauss(0, 10 ** random.Random(i).randint(-9, 9)) for i in range(400)]),
    ("bigint", [-(2**63), 2**63 - 1, 0, 0, 1, -1, None, 10**18, 10**18 + 1]),
    ("bigint", [7] * 30),
])
def test_kth_value_is_that_of_the_sorted_list(spark, kind, values):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}").repartition(3).cache()
    rank = lambda v: (0, 0) if v is None else (2, 0) if v != v else (1, v)
    ordered = sorted(values, key=rank)
    for k in sorted({1, 2, 3, 5, len(values) // 2, len(values) - 1, len(values)}):
        got, before = S.kth_value(df, k, "v")
        assert rank(got) == rank(ordered[k - 1])
        assert before == sum(rank(v) < rank(ordered[k - 1]) for v in values)
        assert before < k <= len(values)
    df.unpersist()


def test_first_k_keeps_the_smallest(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([None, 0.0, 0.25, 0.25, NAN, rnd.random()])) for i in range(2000)]
    df = spark.createDataFrame(rows, "seq long, confidence double").repartition(4).cache()
    rank = lambda r: (0, 0.0, r[0]) if r[1] is None else (2, 0.0, r[0]) if r[1] != r[1] else (1, r[1], r[0])
    ordered = [r[0] for r in sorted(rows, key=rank)]
    for k in (0, 1, 300, 700, 1999, 2000, 2500):
        assert sorted(r.seq for r in S.first_k(df, k, "confidence", "seq").collect()) == sorted(ordered[:k])
    df.unpersist()


def _plan_of(df):
    return df._jdf.queryExecution().toString()


def test_the_fill_shuffles_bins_and_chosen_rows(spark):
    """Candidates beyond the quota are in no exchange."""
    n, k = 4000, 50
    df = spark.createDataFrame([(i, f"u{i}", False, (i * 7919 % n) / n) for i in range(n)], "seq long, url string, is_bad boolean, confidence double")
    chosen = S.first_k(df, k, "confidence", "seq")
    assert chosen.count() == k and "Exchange" not in _plan_of(chosen).split("== Physical Plan ==")[1]


def _largest_remainder(counts, fractions):
    """Cumulative sizes of every stratum, in plain Python."""
    from fractions import Fraction

    up = lambda x: -(-x.numerator // x.denominator)
    n, weight, left, to = sum(counts.values()), sum(f for _, f in fractions), dict(counts), {s: [] for s in counts}
    for _, f in fractions[:-1]:
        held = up(n * Fraction(int(round((1 - f / weight) * 10**6)), 10**6))
        draw = n - held
        low = {s: c * draw // max(n, 1) for s, c in left.items()}
        missing = draw - sum(low.values())
        order = sorted(left, key=lambda s: (-(left[s] * draw % max(n, 1)), s is not None, s or ""))
        part = {s: low[s] + (i < missing) for i, s in enumerate(order)}
        for s in left:
            to[s].append((to[s][-1] if to[s] else 0) + part[s])
            left[s] -= part[s]
        n, weight = held, weight - f
    return to


@pytest.mark.parametrize("fractions", [EVAL_FRACTIONS, TRAIN_FRACTIONS])
def test_sizes_over_many_strata(spark, fractions):
    from labelforge.operators.split import part_sizes

    rnd = random.Random(8)
    counts = {f"s{i}": rnd.choice([1, 1, 2, 3, 7, rnd.randint(1, 4000)]) for i in range(20_000)} | {None: 11}
    sizes = spark.createDataFrame(list(counts.items()), "label string, __lf_n long").repartition(4)
    plan = part_sizes(sizes, "label", fractions)
    assert "Window" not in _plan_of(plan)
    got = {r[0]: list(r)[1:] for r in plan.collect()}
    assert got == _largest_remainder(counts, fractions)


def test_split_of_strata_without_rows_to_share(spark):
    for rows in ([], [("a", "x")], [("a", None), ("b", None)], [(f"k{i}", f"s{i}") for i in range(50)]):
        got = stratified_split(spark.createDataFrame(rows, "filename string, label string")).collect()
        assert sorted(str(r.filename) for r in got) == sorted(str(f) for f, _ in rows)
