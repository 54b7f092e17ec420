"""Ordering, quota and set operators.

``quota_fill`` keeps every bad record and fills up to the target with the
least-confident candidates (ties keep file order).  The border of the fill is
found by histograms of what is left between two bounds (``kth_value``): counts
of bins are shuffled, not candidates, and only the chosen rows are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labelforge.fixed import SELECT_TARGET
from labelforge.operators.ordering import with_rank
from labelforge.session import scratch_path

#: Bins of one histogram pass.
BINS = 4096


def kth_value(df: DataFrame, k: int, value: str):
    """The ``k``-th smallest (from 1) of a numeric column, and how many rows are
    smaller; (None, 0) for a null, which is the smallest.  There must be ``k``
    rows.  NaN is the largest, as in Spark's order.

    Each pass counts the rows between two bounds in BINS bins of equal width
    and goes on in the bin that holds the k-th: about four passes for whole
    numbers of any size, six at most for doubles, each one map-side count."""
    v = F.col(value)
    infinite = F.lit(float("inf"))
    d = v.cast("double")
    kind = F.when(v.isNull(), 0).when(d == -infinite, 1).when(F.isnan(d), 4).when(d == infinite, 3).otherwise(2)
    below = 0
    for r in df.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).orderBy("kind").collect():
        if k <= below + r["n"]:
            break
        below += r["n"]
    if r["kind"] != 2:
        return r["low"], below
    low, high = r["low"], r["high"]
    whole = isinstance(low, int)
    while low != high:
        if whole:
            step = -(-(high - low + 1) // BINS)
            at = F.floor((v.cast("decimal(38,0)") - F.lit(low).cast("decimal(38,0)")) / F.lit(step).cast("decimal(38,0)"))
        else:
            # halved, so that no width overflows
            at = F.floor((d / 2 - low / 2) / F.lit(max((high / 2 - low / 2) / BINS, 5e-324)))
        bins = (df.where((v >= F.lit(low)) & (v <= F.lit(high))).groupBy(at.alias("bin"))
                .agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).orderBy("bin").collect())
        for r in bins:
            if k <= below + r["n"]:
                break
            below += r["n"]
        if len(bins) == 1:  # neighbouring doubles, too close for a width
            exact = df.where((v >= F.lit(low)) & (v <= F.lit(high))).groupBy(v.alias("low")).agg(F.count(F.lit(1)).alias("n")).orderBy("low").collect()
            for r in exact:
                if k <= below + r["n"]:
                    break
                below += r["n"]
            return r["low"], below
        low, high = r["low"], r["high"]
    return low, below


def _equals(v: Column, bound) -> Column:
    """Null-safe, and by ``isnan`` for NaN, which statistics of files leave out."""
    if bound is None:
        return v.isNull()
    return F.isnan(v) if bound != bound else v == F.lit(bound)


def not_above(value: str, bound, position: str, last) -> Column:
    """Rows before the one with ``bound`` and ``last`` in the order of
    (value, position), nulls first, and that one."""
    v, p = F.col(value), F.col(position)
    tie = _equals(v, bound) & (p <= F.lit(last))
    if bound is None:
        return tie
    return tie | v.isNull() | (~F.isnan(v) if bound != bound else v < F.lit(bound))


def first_k(df: DataFrame, k: int, value: str, position: str) -> DataFrame:
    """The ``k`` first rows by (value, position), nulls first; rows equal in
    both at the border all stay."""
    if k <= 0:
        return df.limit(0)
    narrow = df.select(value, position)
    if narrow.count() <= k:
        return df
    bound, before = kth_value(narrow, k, value)
    last, _ = kth_value(narrow.where(_equals(F.col(value), bound)), k - before, position)
    return df.where(not_above(value, bound, position, last))


def sort_by_confidence(df: DataFrame, confidence: str = "confidence", seq: str = "seq") -> DataFrame:
    """ascending confidence, stable (file position breaks ties)."""
    return df.orderBy(F.col(confidence).asc(), F.col(seq).asc())


def lowest_k(df: DataFrame, k: int, order_by, rank_col: str | None = None) -> DataFrame:
    """The ``k`` first rows by a total order ``order_by`` (list of column
    names / sort expressions), optionally with their 0-based rank.  One plan
    for every ``k``: the exact distributed rank."""
    name = rank_col or "__lf_rank"
    if k <= 0:
        out = df.limit(0).withColumn(name, F.lit(None).cast("long"))
    else:
        out = with_rank(df, order_by, rank_col=name).filter(F.col(name) < k)
    return out if rank_col else out.drop(name)


def quota_fill(records: DataFrame, target: int = SELECT_TARGET, bad: str = "is_bad",
               confidence: str = "confidence", seq: str = "seq") -> DataFrame:
    """all bad rows (even past the target) plus the ``target - n_bad``
    lowest-confidence candidates (all of them when too few).

    Adds ``bucket`` (``bad`` / ``candidate``) and ``cand_rank`` (0-based rank
    of a selected candidate, null for bad rows).  Output order: bad rows in
    file order, then candidates by rank (``selection_order`` when writing).
    The input is written to the shared folder first, so the upstream parse runs
    once, a lost executor cannot change what was counted, and a pass reads two
    columns."""
    spark, path = records.sparkSession, scratch_path(records.sparkSession, "quota")
    records.write.parquet(path)
    records = spark.read.schema(records.schema).parquet(path)
    bad_rows = records.filter(F.col(bad))
    candidates = records.filter(~F.col(bad))
    need = max(0, int(target) - bad_rows.count())
    chosen = lowest_k(first_k(candidates, need, confidence, seq), need, [F.col(confidence).asc(), F.col(seq).asc()], rank_col="cand_rank")
    return (bad_rows.withColumn("cand_rank", F.lit(None).cast("long")).withColumn("bucket", F.lit("bad"))
            .unionByName(chosen.withColumn("bucket", F.lit("candidate"))))


def selection_order(selected: DataFrame, seq: str = "seq") -> list:
    """Sort keys that reproduce the output file order of ``quota_fill``."""
    return [F.when(F.col("bucket") == "bad", 0).otherwise(1), F.col("cand_rank"), F.col(seq)]


def head(df: DataFrame, n: int = 5, seq: str = "seq") -> DataFrame:
    """the first ``n`` rows in file order (TakeOrderedAndProject)."""
    return df.orderBy(seq).limit(n)


def bounded_error_log(failures: DataFrame, n: int = 10, seq: str = "pos") -> tuple[DataFrame, DataFrame]:
    """the first ``n`` failures in full plus the count of the rest."""
    first = failures.orderBy(seq).limit(n)
    rest = failures.agg(F.greatest(F.count(F.lit(1)) - F.lit(n), F.lit(0)).alias("suppressed"))
    return first, rest


def sorted_listing(df: DataFrame, path: str = "path") -> DataFrame:
    """listing sorted by path."""
    return df.orderBy(path)


def union_all(*frames: DataFrame) -> DataFrame:
    """G1: concatenation by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    """The set of keys (nulls dropped)."""
    return df.select(key).filter(F.col(key).isNotNull()).distinct()
