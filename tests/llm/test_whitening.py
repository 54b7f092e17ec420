import math
import random
from fractions import Fraction

import numpy as np
import pytest

from labelforge.llm import whitening
from labelforge.llm.queries import op12_whitening


def table(spark, rows, kind="array<float>"):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, f"vec_id bigint, embedding {kind}")
    return df.withColumns({c: F.lit("own") for c in ("n", "whitened", "deviation", "label", "i", "x", "explained")}).repartition(3)


def whole(v):
    return [math.floor(float(np.float32(c)) * 64) + 1_000_000 for c in v]


def brute(vectors):
    """(n, S, exact covariance as fractions) of the fit list."""
    fit = sorted(set(map(tuple, vectors)))
    n, dim = len(fit), len(fit[0])
    total = [sum(v[i] for v in fit) for i in range(dim)]
    cov = [[Fraction(sum((n * v[i] - total[i]) * (n * v[j] - total[j]) for v in fit), n**3) for j in range(dim)] for i in range(dim)]
    return n, total, cov


def sample(dim=6, n=80, scale=1.0):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        base = [rng.gauss(0, 1 + k) * scale for k in range(dim)]
        rows.append((i, [base[k] + 0.3 * base[0] for k in range(dim)]))
    return rows + [(1000 + i, rows[3][1]) for i in range(30)] + [(3, rows[3][1]), (None, rows[5][1])]


ODD = [(900, None), (901, []), (902, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (903, [float("nan")] * 6), (904, [float("inf")] + [0.0] * 5), (905, [1.0, 2.0])]


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e9])
def test_against_fractions(spark, scale):
    rows = sample(scale=scale)
    got = whitening.whiten(table(spark, rows + ODD)).collect()
    assert sorted(str(r["vec_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    n, total, cov = brute([whole(v) for _, v in rows])
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]))
    values, vectors = values[::-1], vectors[:, ::-1]
    by_id = {i: whole(v) for i, v in rows}
    for r in got:
        y = [n * c - s for c, s in zip(by_id[r["vec_id"]], total, strict=True)]
        deviation = sum(c * c for c in y)
        assert r["n"] == n and (int(r["deviation"]) == deviation if deviation < 10**38 else r["deviation"] is None)
        want = np.array([float(Fraction(c, n)) for c in y]) @ (vectors / np.sqrt(values))
        assert np.allclose(np.abs(r["whitened"]), np.abs(want), atol=1e-7)
        assert np.allclose(r["explained"], values / values.sum(), rtol=1e-9)
        assert r["identity_error"] < 1e-9


def test_covariance_is_exact(spark):
    rows = sample()
    frame, dim = whitening.vectors_of(table(spark, rows))
    model = whitening.fit(frame.select("__x").distinct(), dim)
    n, total, cov = brute([whole(v) for _, v in rows])
    assert (model.n, model.sums) == (n, total)
    assert model.covariance.tolist() == [[float(c) for c in row] for row in cov]


@pytest.mark.parametrize("bits", [20, 24, 25, 40, 61])
def test_squares_in_limbs(bits):
    rng = random.Random(bits)
    z = [[rng.randint(-(2**bits) + 1, 2**bits - 1) for _ in range(3)] for _ in range(50)] + [[2**bits - 1] * 3, [1 - 2**bits] * 3]
    want = [sum(r[k] ** 2 for r in z) for k in range(3)]
    for array in (np.array(z, np.int64), np.array(z, object)):
        got = [0, 0, 0]
        for shift, part in whitening.square_sums(array, bits):
            got = [g + (int(p) << shift) for g, p in zip(got, part, strict=True)]
        assert got == want


def test_digits_come_back():
    totals = whitening.Totals(3)
    totals.sums[:] = [-(3**80), 0, 7**60]
    back = [0, 0, 0]
    for b in totals.digits([(0, 0), (1, 1), (2, 2)]):
        for r in b.to_pylist():
            back[r["i"]] += r["v"] << (32 * r["k"])
    assert back == [-(3**80), 0, 7**60]


def test_entries_of_any_size_do_not_crash(spark):
    rows = [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, -1e-38])]
    got = {r["vec_id"]: r for r in whitening.whiten(table(spark, rows)).collect()}
    reach = int(whitening.REACH)
    x = {1: [reach, 64], 2: [-reach, 128], 3: [0, -1]}
    for i, v in x.items():
        y = [3 * c - sum(w[k] for w in x.values()) for k, c in enumerate(v)]
        assert got[i]["n"] == 3 and int(got[i]["deviation"]) == sum(c * c for c in y)
    far = whitening.whiten(table(spark, [(i, [3e38 * (-1) ** i] * 50 + [float(i)]) for i in range(9)])).collect()
    assert len(far) == 9 and all(r["deviation"] is None for r in far)


def test_few_vectors(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, ODD[:5])).collect() == []
    one = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r["n"], int(r["deviation"]), r["whitened"]) for r in one] == [(1, 0, [])] * 2
    flat = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.5, 2.0])], "array<double>")).collect()
    assert all(len(r["whitened"]) == 1 and r["explained"] == [1.0] for r in flat)


def test_query_has_a_row_a_component(spark):
    sf = "/root/testdata/sf0.001"
    got = op12_whitening(spark, sf).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted((r["vec_id"], r["component"]) for r in got) == sorted((i, k) for i, _ in rows for k in range(1, 17))
    n, total, cov = brute([whole(v) for _, v in rows])
    trace = float(sum(cov[i][i] for i in range(len(cov))))
    values = np.linalg.eigvalsh(np.array([[float(c) for c in r] for r in cov]))[::-1]
    by_id = dict(rows)
    for r in got:
        assert r["deviation"] == sum((n * c - s) ** 2 for c, s in zip(whole(by_id[r["vec_id"]]), total, strict=True))
        assert abs(r["explained"] - values[r["component"] - 1] / trace) < 1e-9 and r["identity_error"] < 1e-9
