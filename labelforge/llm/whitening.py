"""Embedding whitening by polarisation covariance (operator 12).

Entries become whole numbers x.  With n different vectors and per-dimension
sums S, a centred entry is y = n*x - S, a whole number too.  Tasks add up the
exact squares y_i^2 of every dimension and (y_i + y_j)^2 of every sum of two
dimensions; a cross-covariance is half of what the second has over the two
first.  Nothing is rounded before the matrix is put together, so neither the
order of rows nor the number of tasks changes it.

What reaches the driver is one number a pair of dimensions; every pass over
the vectors is a Spark job over a written table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import land

#: Entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Scaled entries beyond this count as this (they would not fit a bigint).
REACH = 2.0**61
COMPONENTS = 16

#: Vectors worked on at once, and bits of one limb: a product of two limbs
#: (2^48), doubled and added up over that many vectors, fits 63 bits.
_ROWS, _LIMB = 1024, 24
_DIGIT = 32


def whole_vector(vector: Column) -> Column:
    """The entries as whole numbers."""
    def one(c: Column) -> Column:
        scaled = c.cast("double") * F.lit(float(SCALE))
        return F.floor(F.greatest(F.least(scaled, F.lit(REACH)), F.lit(-REACH))) + F.lit(SHIFT)

    return F.transform(vector, one)


def usable(vector: Column) -> Column:
    """Neither null nor empty, no null and no non-finite entry."""
    finite = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _blocks(batch: pa.RecordBatch, place: int, dim: int) -> Iterator[tuple[int, np.ndarray]]:
    for row in range(0, batch.num_rows, _ROWS):
        yield row, _matrix(batch.column(place).slice(row, _ROWS), dim)


def square_sums(z: np.ndarray, bits: int, axis: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(shift, sums): the exact sum of z^2 along ``axis`` (of at most _ROWS
    entries) is what the parts times 2^shift add up to.  ``bits`` bounds |z|;
    objects (Python's whole numbers) need no limbs."""
    if z.dtype == object:
        yield 0, (z * z).sum(axis)
        return
    limbs = []
    while bits > _LIMB:
        limbs.append(z & ((1 << _LIMB) - 1))
        z, bits = z >> _LIMB, bits - _LIMB
    limbs.append(z)
    for a, left in enumerate(limbs):
        for b in range(a, len(limbs)):
            yield _LIMB * (a + b), (left * limbs[b]).sum(axis) * (1 if a == b else 2)


class Totals:
    """Exact running sums, kept as Python's whole numbers."""

    def __init__(self, size: int):
        self.sums = np.zeros(size, object)

    def add(self, place: slice, parts: Iterator[tuple[int, np.ndarray]]) -> None:
        for shift, part in parts:
            self.sums[place] += part.astype(object) * (1 << shift)

    def digits(self, names: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        """Rows (i, j, k, v): the sum over k of v * 2^(32 k) is the sum of (i, j)."""
        left = np.array(names, np.int32).reshape(-1, 2)
        sign = np.where(self.sums < 0, -1, 1)
        rest, k = np.abs(self.sums), 0
        while len(rest) and (rest > 0).any():
            v = (rest & ((1 << _DIGIT) - 1)).astype(np.int64) * sign
            some = v != 0
            yield pa.record_batch({"i": pa.array(left[some, 0]), "j": pa.array(left[some, 1]),
                                   "k": pa.array(np.full(int(some.sum()), k, np.int32)), "v": pa.array(v[some])})
            rest, k = rest >> _DIGIT, k + 1


def _total(df: DataFrame, column: str, names: list[tuple[int, int]],
           fill: Callable[[Totals, np.ndarray], None], dim: int) -> dict[tuple[int, int], int]:
    """The exact sums that ``fill`` makes of blocks of vectors, over all rows;
    one number for each name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = Totals(len(names))
        for batch in batches:
            for _, x in _blocks(batch, 0, dim):
                fill(totals, x)
        yield from totals.digits(names)

    parts = df.select(column).mapInArrow(run, "i int, j int, k int, v bigint")
    out = dict.fromkeys(names, 0)
    for r in parts.groupBy("i", "j", "k").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] += r["v"] << (_DIGIT * r["k"])
    return out


@dataclass
class Whitener:
    """Estimate of ``fit``: n vectors of the fit list, sums S, covariance of x,
    eigenvalues (falling) and unit eigenvectors (columns), those of
    ``components`` only in ``values`` and ``vectors``."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    wide: bool  #: n*x - S does not fit 62 bits
    bits: int  #: of the largest |y_i + y_j|

    @property
    def explained(self) -> np.ndarray:
        return self.values / np.trace(self.covariance)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exact."""
        if self.wide:
            return x.astype(object) * self.n - np.array(self.sums, object)
        return x * self.n - np.array(self.sums, np.int64)

    def project(self, x: np.ndarray) -> np.ndarray:
        """x - S/n on the components, over the roots of the eigenvalues."""
        y = self.centred(x).astype(np.float64) / self.n if self.n else x.astype(np.float64)
        return y @ (self.vectors / np.sqrt(self.values))


def vectors_of(df: DataFrame, vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """(df with usable vectors and ``__x``, their dimension).  Vectors of other
    lengths than the one most rows have (of equally many, the longest) go."""
    rows = df.where(usable(df[vec_col])).withColumn("__x", whole_vector(F.col(vec_col)))
    dims = rows.groupBy(F.size("__x").alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("d")).limit(1).collect()
    dim = dims[0]["d"] if dims else 0
    return rows.where(F.size("__x") == dim), dim


def fit(different: DataFrame, dim: int, components: int = COMPONENTS) -> Whitener:
    """The estimate from a table of different vectors (column ``__x``)."""
    n = different.count()
    if not n:
        return Whitener(0, [0] * dim, np.zeros((dim, dim)), np.zeros(0), np.zeros((dim, 0)), False, 1)
    half = (1 << _DIGIT) - 1

    def add_up(totals: Totals, x: np.ndarray) -> None:
        totals.add(slice(None), iter([(0, (x & half).sum(0)), (_DIGIT, (x >> _DIGIT).sum(0))]))

    own = [(i, i) for i in range(dim)]
    sums = _total(different, "__x", own, add_up, dim)
    low, high = different.select(F.array_min("__x").alias("a"), F.array_max("__x").alias("b")).agg(F.min("a"), F.max("b")).first()
    sums = [sums[p] for p in own]
    most = max(max(abs(n * low - s), abs(n * high - s)) for s in sums)
    wide = 2 * most >= 1 << 62 or n * max(abs(low), abs(high)) >= 1 << 62
    model = Whitener(n, sums, np.zeros((dim, dim)), np.zeros(0), np.zeros((dim, 0)), wide, (2 * most).bit_length())
    pairs = [(i, j) for i in range(dim) for j in range(i, dim)]
    begin = np.cumsum([0, *[dim - i for i in range(dim)]])

    def squares(totals: Totals, x: np.ndarray) -> None:
        y = model.centred(x)
        for i in range(dim):
            z = y[:, i:] + y[:, i : i + 1]
            z[:, 0] = y[:, i]  # the dimension alone, then its sums with the later ones
            totals.add(slice(begin[i], begin[i + 1]), square_sums(z, model.bits))

    total = _total(different, "__x", pairs, squares, dim)
    cov = np.empty((dim, dim))
    for i, j in pairs:
        twice = 2 * total[i, i] if i == j else total[i, j] - total[i, i] - total[j, j]
        cov[i, j] = cov[j, i] = twice / (2 * n**3)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    some = values > max(values[0], 0.0) * dim * np.finfo(float).eps
    some &= np.arange(dim) < components
    values, vectors = values[some], vectors[:, some]
    # either sign is an eigenvector: the largest entry is made positive
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])]) if vectors.size else vectors
    return replace(model, covariance=cov, values=values, vectors=vectors)


def identity_error(different: DataFrame, model: Whitener) -> float:
    """The largest absolute entry of the covariance of the whitened fit list
    minus the identity."""
    k, dim = len(model.values), len(model.sums)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, x in _blocks(batch, 0, dim):
                w = model.project(x)
                first += w.sum(0)
                second += w.T @ w
        yield pa.record_batch({"p": pa.array(np.arange(k + k * k, dtype=np.int32)), "v": pa.array(np.concatenate([first, second.ravel()]))})

    parts = different.select("__x").mapInArrow(run, "p int, v double").groupBy("p").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(k + k * k)
    for r in parts:
        flat[r["p"]] = r["v"] / model.n
    mean, product = flat[:k], flat[k:].reshape(k, k)
    return float(np.abs(product - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, n, deviation, whitened, explained, identity_error) of every row
    with a usable vector.

    ``whitened`` and ``explained`` have one entry a component, by falling
    eigenvalue; a component without variance is left out, so one vector alone
    has none.  ``deviation`` is the exact sum over dimensions of (n*x - S)^2
    (null beyond 38 digits).  The fit list has every different vector once;
    repeated rows and rows of one id are all returned.  Rows whose vector is
    null or empty, holds null or non-finite entries, or has another length
    than most are not returned; an empty table gives an empty result; other
    columns are not looked at.
    """
    rows, dim = vectors_of(df.select(df[id_col].alias("__id"), df[vec_col].alias("__v")), "__v")
    rows = land(rows.select("__id", "__x"), "whole-vectors")
    different = land(rows.select("__x").distinct(), "different-vectors")
    model = fit(different, dim, components)
    error = identity_error(different, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x in _blocks(batch, 1, dim):
                y = model.centred(x)
                if model.bits * 2 + dim.bit_length() < 64 and not model.wide:
                    deviation = pa.array((y * y).sum(1)).cast(pa.decimal128(38, 0))
                else:
                    exact = (y.astype(object) ** 2).sum(1)
                    deviation = pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
                w = model.project(x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                yield pa.record_batch({"__id": batch.column(0).slice(row, len(w)), "deviation": deviation, "whitened": lists})

    kind = rows.schema["__id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"`__id` {kind}, deviation decimal(38,0), whitened array<double>")
    explained = F.array(*[F.lit(float(v)) for v in model.explained]).cast("array<double>")
    return out.select(F.col("__id").alias(id_col), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                      explained.alias("explained"), F.lit(error).alias("identity_error"))
