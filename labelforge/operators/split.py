"""Stratified splitting (H1) and choosing a split (H2).

Exact mode has the sizes of a two-stage split.  The held-out share of all n
rows is rounded up to a whole number, and so is the last part's share of the
held-out rows.  In each stage a stratum gets its proportional share rounded
down, and the rows still missing go to the strata with the largest remainders
(ties: in the order of the labels).  Inside a stratum, rows are ranked by
``md5('<seed>|<key>')`` (then the key) and the sizes cut the ranking.

The rank is computed with ``ordering.with_rank`` (range shuffle, no
single-partition window), so a stratum holding most of the rows is still
spread over all tasks, and so is a key that repeats.  The sizes are computed
on one row for each stratum.

Hash mode (``exact=False``): each row's part comes from where its hash falls
in ``[0, 1)``; no ranking, no second pass, sizes exact in expectation only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from labelforge.operators.joins import restrict_to_keys
from labelforge.operators.ordering import with_rank
from labelforge.operators.select import kth_value
from labelforge.session import scratch_path

from labelforge.fixed import EVAL_FRACTIONS, SEED, TRAIN_FRACTIONS  # noqa: F401 - re-exported

PPM = 1_000_000


def _cumulative_ppm(fractions: Sequence[tuple[str, float]]) -> list[tuple[str, int]]:
    total = sum(f for _, f in fractions)
    if total <= 0:
        raise ValueError("fractions must add up to a positive number")
    out, acc = [], 0.0
    for name, f in fractions:
        acc += f / total
        out.append((name, int(round(acc * PPM))))
    out[-1] = (out[-1][0], PPM)
    return out


def split_hash(key, seed: int = SEED) -> F.Column:
    """md5 of ``'<seed>|<key>'`` as hex text: the ranking key of a row."""
    return F.md5(F.concat(F.lit(f"{int(seed)}|"), F.col(key).cast("string")))


def stratified_split(df: DataFrame, key: str = "filename", label: str = "label",
                     fractions: Sequence[tuple[str, float]] = EVAL_FRACTIONS, seed: int = SEED,
                     exact: bool = True, split_col: str = "split") -> DataFrame:
    """H1: add ``split_col`` naming the part of each row."""
    cum = _cumulative_ppm(fractions)
    h = split_hash(key, seed)
    if not exact:
        # first 13 hex digits of the md5 -> uniform position in [0, 1)
        pos_ppm = F.floor(F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13)) * PPM)
        expr = None
        for name, bound in cum:
            cond = pos_ppm < F.lit(bound)
            expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
        return df.withColumn(split_col, expr)

    # written and read back: one pass over the rows, and Spark knows its size
    path = scratch_path(df.sparkSession, "strata")
    df.groupBy(label).agg(F.count(F.lit(1)).alias("__lf_n")).write.parquet(path)
    part = part_sizes(df.sparkSession.read.parquet(path), label, fractions)
    # rows of one key are told apart by a number, so that a range can cut them
    salted = df.withColumn("__lf_h", h).withColumn("__lf_row", F.monotonically_increasing_id())
    ranked = with_rank(salted, ["__lf_h", key, "__lf_row"], group_by=[label], rank_col="__lf_rank")
    names = [name for name, _ in fractions]
    placed = ranked.join(part, ranked[label].eqNullSafe(part["__lf_label"]))
    expr = F.lit(names[-1])
    for i, name in reversed(list(enumerate(names[:-1]))):
        expr = F.when(F.col("__lf_rank") < F.col(f"__lf_to{i}"), F.lit(name)).otherwise(expr)
    return placed.withColumn(split_col, expr).select(*df.columns, split_col)


def _share_up(n: int, share: float) -> int:
    """``share`` of ``n`` rounded up to whole rows."""
    return (n * int(round(share * PPM)) + PPM - 1) // PPM


def part_sizes(sizes: DataFrame, label: str, fractions: Sequence[tuple[str, float]]) -> DataFrame:
    """Cumulative part sizes ``__lf_to<i>`` of every stratum, from a written
    table of one row (label, __lf_n) a stratum.

    The rows missing in a stage go to the strata with the largest remainders;
    the border among them is found by counts (``select.kth_value``), and only
    strata equal at the border are ranked by their label, so that a million
    strata are work for all tasks."""
    n, weight = sizes.agg(F.sum("__lf_n")).first()[0] or 0, sum(f for _, f in fractions)
    rows, begun, out = F.col("__lf_n"), F.lit(0).cast("long"), []
    for i, (_, f) in enumerate(fractions[:-1]):
        held_out = _share_up(n, 1 - f / weight)
        share = rows.cast("decimal(38,0)") * F.lit(n - held_out).cast("decimal(19,0)")
        whole = F.lit(max(n, 1)).cast("decimal(19,0)")
        rest = (share % whole).cast("long")
        low = ((share - share % whole) / whole).cast("long")
        staged = sizes.select(F.col(label), low.alias("low"), (-rest).alias("short"))
        missing = n - held_out - (staged.agg(F.sum("low")).first()[0] or 0)
        part = low
        if missing > 0:
            bound, before = kth_value(staged, missing, "short")
            ties = staged.where(F.col("short") == F.lit(bound)).select(label)
            last = with_rank(ties, [F.col(label).asc_nulls_first()], rank_col="turn").where(F.col("turn") == missing - before - 1).first()[0]
            first = F.col(label).isNull() if last is None else F.col(label).isNull() | (F.col(label) <= F.lit(last))
            part = low + ((-rest < F.lit(bound)) | ((-rest == F.lit(bound)) & first)).cast("long")
        begun = begun + part
        out.append(begun.alias(f"__lf_to{i}"))
        rows, n, weight = rows - part, held_out, weight - f
    return sizes.select(F.col(label).alias("__lf_label"), *out)


def restrict_to_split(df: DataFrame, split_df: DataFrame, subset: str = "all",
                      key: str = "filename", split_col: str = "split") -> DataFrame:
    """H2 + D5: keep rows whose key is in the chosen split (left semi join);
    ``all`` keeps everything."""
    if subset == "all":
        return df
    if subset not in {"train", "val", "test"}:
        raise ValueError(f"unknown subset: {subset!r}")
    return restrict_to_keys(df, split_df.filter(F.col(split_col) == subset), key)
