"""Quality rules and robust multivariate outliers (operator 9).

Base rules count words, symbols, repeated lines and repeated 8-word windows.
On top of them a minimum-covariance-determinant (MCD) estimate is fitted per
language and source on all rows that pass the base rules, and a row whose
transformed statistics lie beyond the cutoff of its group's estimate is
rejected.  The estimate rests on the half of a group whose covariance has the
least determinant, so up to half of a group can be junk.

One pass sums the rows of a group into cells a quarter of its spread wide:
counts, sums and products, exact and summed map-side, so a hot source arrives
as cells.  A group has at most CELLS_PER_SIDE ** 4 of them, however many rows it has.  Concentration steps
then run on the cells of one group: the half with the smallest distances gives
the next mean and covariance, which cannot have a larger determinant, until it
no longer falls.  Of several starts the least determinant wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import land, per_batch
from .hot import join_groups, without_keys
from .words import SPACED, Words, slices, window_hashes

#: Symbols counted, and the base rules' limits.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8

#: Statistics of the outlier test, as a share of the text and smoothed so that
#: a short text does not stand out by chance.
STATS = ("word_length", "symbol_share", "line_share", "repeat_share")
#: Spread below which a statistic's deviation means nothing (in its own unit):
#: most groups have no symbols and no repeated lines at all.
FLOORS = (0.35, 0.02, 0.08, 0.06)
#: Steps of the grid on which statistics are counted.
GRID = 10_000
#: Share of a group that the estimate rests on.
KEPT_SHARE = 0.5
#: Width of a cell as a share of the statistic's spread, and cells on one side
#: of the median; what lies farther out is in the last one.
CELL, SIDE = 0.25, 12
CELLS_PER_SIDE = 2 * SIDE + 1
#: Mean word lengths above count as this.
LONGEST = 64
#: Squared distance beyond which a row is an outlier.
CUTOFF = 60.0
#: Smaller groups are judged with their language's other small groups, and
#: those, if still too few, with all small groups.
MIN_GROUP = 50

_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
_NOT_NEWLINE = np.arange(256) != 0x0A
_CHARACTER = (np.arange(256) & 0xC0) != 0x80


def _per_text(flags: np.ndarray, begins: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[begins[1:]] - total[begins[:-1]]


def _repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seen twice or more, seen earlier) for every key."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    earlier = np.zeros(len(key), bool)
    often = np.zeros(len(key), bool)
    earlier[order[1:]] = same
    often[order[1:]] = same
    often[order[:-1]] |= same
    return often, earlier


def text_stats(data: np.ndarray, begins: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of the base rules for the texts of one slice."""
    words = Words(data, begins, SPACED)
    n_texts = words.n_texts
    salt = np.arange(n_texts, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
    out = {
        "n_words": words.counts(),
        "word_chars": _per_text(words.inside & _CHARACTER[data], begins),
        "n_symbols": _per_text(_SYMBOL[data], begins),
    }
    lines = Words(data, begins, _NOT_NEWLINE)
    holds = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    owner = lines.text_of()[holds]
    _, earlier = _repeats(lines.hashes()[holds] + salt[owner])
    out["n_lines"] = np.bincount(owner, minlength=n_texts)
    out["n_dup_lines"] = np.bincount(owner[earlier], minlength=n_texts)
    windows = window_hashes(words.hashes(), REPEAT_WINDOW)
    place = np.flatnonzero(words.window_ok(REPEAT_WINDOW)[: len(windows)])
    owner = words.text_of()
    often, _ = _repeats(windows[place] + salt[owner[place]])
    covered = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(covered, place[often], 1)
    np.add.at(covered, place[often] + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = np.bincount(owner[np.cumsum(covered)[:-1] > 0], minlength=n_texts)
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def count_rules(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The ``keep`` columns, the counts of the base rules and ``base_failed``."""
    if clash := set(keep) & {*COUNTS, "base_failed"}:
        raise ValueError(f"columns {sorted(clash)} would be overwritten")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row, data, begins in slices(batch.column(len(keep))):
            stats = text_stats(data, begins)
            part = batch.slice(row, len(begins) - 1)
            yield pa.record_batch({c: part.column(i) for i, c in enumerate(keep)}
                                  | {c: pa.array(stats[c].astype(np.int64)) for c in COUNTS})

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} bigint" for c in COUNTS])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return per_batch(df.select(*keep, df[text_col].alias("__text")), run, schema).withColumn("base_failed", failed)


def _statistics() -> list[Column]:
    """The transformed statistics on the grid, as whole numbers."""
    c = F.col
    shares = (
        F.least((c("word_chars") + 250) / (c("n_words") + 50), F.lit(float(LONGEST))),
        F.sqrt(c("n_symbols") / (c("word_chars") + 250)),
        F.sqrt(c("n_dup_lines") / (c("n_lines") + 10)),
        F.sqrt(c("n_repeat_words") / (c("n_words") + 200)),
    )
    return [F.round(x * GRID).cast("long").alias(name) for x, name in zip(shares, STATS, strict=True)]


def _keys(by: tuple[str, ...]) -> list[Column]:
    """One text for the values of ``by`` (``__key``) and one for the first
    (``__first``); null values are values of their own."""
    value = lambda b: F.to_json(F.struct(F.col(b).cast("string").alias("v")))
    return [F.concat_ws(",", *map(value, by)).alias("__key"), value(by[0]).alias("__first")]


def _groups(passed: DataFrame, min_group: int) -> DataFrame:
    """(__key, __group): the group each language and source is judged in."""
    own = passed.groupBy("__key", "__first").agg(F.count(F.lit(1)).alias("__n"))
    pooled = own.where(F.col("__n") < min_group).groupBy("__first").agg(F.sum("__n").alias("__m"))
    return (own.join(pooled, "__first", "left")
            .select("__key", "__n", F.when(F.col("__n") >= min_group, F.concat(F.lit("own "), "__key"))
                    .when(F.col("__m") >= min_group, F.concat(F.lit("first "), "__first")).otherwise(F.lit("rest")).alias("__group")))


def _distance(stats: list[Column]) -> Column:
    """Squared Mahalanobis distance by the columns m0.. and p00.. (p: the
    inverse covariance)."""
    d = [s / GRID - F.col(f"m{i}") for i, s in enumerate(stats)]
    total = None
    for i in range(len(d)):
        for j in range(i, len(d)):
            term = d[i] * d[j] * F.col(f"p{i}{j}") * (1 if i == j else 2)
            total = term if total is None else total + term
    return total


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(STATS)) for j in range(i, len(STATS))]


def cells(stats: DataFrame, n_rows: int, floors: tuple[float, ...] = FLOORS) -> DataFrame:
    """The rows of (__group, STATS) summed into cells: (__group, m*, w*, cell,
    n, s*, q**), where m is the group's median (a whole number of the grid), w
    its spread, and s and q are sums and products of what is over the median."""
    k = range(len(STATS))
    big = "decimal(38,0)"
    sizes = [F.count(F.lit(1)).alias("__size")]
    middle = land(stats.groupBy("__group").agg(
        *sizes, *[F.floor(F.percentile(s, 0.5)).alias(f"m{i}") for i, s in enumerate(STATS)]), "mcd-medians")
    over = [F.col(s) - F.col(f"m{i}") for i, s in enumerate(STATS)]
    spread = [F.greatest(F.percentile(F.abs(d), 0.5) * 1.4826 / GRID, F.lit(floors[i])).alias(f"w{i}") for i, d in enumerate(over)]
    keep = [F.first(f"m{i}").alias(f"m{i}") for i in k]
    scale = land(join_groups(stats, middle, "__group", "__size", n_rows).groupBy("__group").agg(*sizes, *keep, *spread), "mcd-spreads")
    level = [F.least(F.greatest(F.round(d / GRID / (CELL * F.col(f"w{i}"))), F.lit(-float(SIDE))), F.lit(float(SIDE))).cast("int") + SIDE
             for i, d in enumerate(over)]
    cell = level[0]
    for x in level[1:]:
        cell = cell * CELLS_PER_SIDE + x
    placed = join_groups(stats, scale, "__group", "__size", n_rows).select(
        "__group", cell.alias("cell"), *[d.alias(f"d{i}") for i, d in enumerate(over)])
    total = lambda c: F.sum(c.cast("decimal(20,0)")).cast(big).cast("double")
    summed = placed.groupBy("__group", "cell").agg(
        F.count(F.lit(1)).cast("double").alias("n"), *[total(F.col(f"d{i}")).alias(f"s{i}") for i in k],
        *[total(F.col(f"d{i}") * F.col(f"d{j}")).alias(f"q{i}{j}") for i, j in _pairs()])
    return land(summed, "mcd-cells").join(scale.drop("__size"), "__group")


def concentrate(n: np.ndarray, s: np.ndarray, q: np.ndarray, mean: np.ndarray, cov: np.ndarray,
                floors: tuple[float, ...], share: float) -> tuple[float, np.ndarray, np.ndarray, int]:
    """(log determinant, mean, covariance, steps) at rest, from cells of n rows
    with sums s and products q, and a first mean and covariance.

    A step takes the ``share`` of rows with the smallest distances, by the mean
    squared distance of a cell and the border cell in part.  The weights make
    the summed distance the least there is, so the determinant cannot rise; it
    takes finitely many values, and the steps end when it does not fall.
    """
    size = share * n.sum()
    floor = np.diag(np.square(floors))
    best, steps = np.inf, 0
    while True:
        inverse = np.linalg.inv(cov)
        far = np.einsum("cij,ij->c", q, inverse) / n - 2 * (s @ (inverse @ mean)) / n + mean @ inverse @ mean
        order = np.argsort(far, kind="stable")
        before = np.cumsum(n[order]) - n[order]
        weight = np.empty(len(n))
        weight[order] = np.clip((size - before) / n[order], 0, 1)
        next_mean = weight @ s / size
        scatter = np.tensordot(weight, q, 1) / size - np.outer(next_mean, next_mean)
        next_cov = CONSISTENCY * scatter + floor
        log_det = float(np.linalg.slogdet(next_cov)[1])
        steps += 1
        if log_det >= best - 1e-9:
            return best, mean, cov, steps
        best, mean, cov = log_det, next_mean, next_cov


def least_determinant(n: np.ndarray, s: np.ndarray, q: np.ndarray, spread: np.ndarray,
                      floors: tuple[float, ...], share: float) -> tuple[float, np.ndarray, np.ndarray, int]:
    """The best of three starts: medians and spreads, the fullest cell and
    spreads, mean and covariance of the whole group."""
    mean = s.sum(0) / n.sum()
    whole = q.sum(0) / n.sum() - np.outer(mean, mean) + np.diag(np.square(floors))
    own = np.diag(np.square(spread))
    fullest = int(np.argmax(n))
    starts = [(np.zeros(len(STATS)), own), (s[fullest] / n[fullest], own), (mean, whole)]
    return min((concentrate(n, s, q, m, c, floors, share) for m, c in starts), key=lambda found: found[0])


def fit_mcd(stats: DataFrame, n_rows: int, floors: tuple[float, ...] = FLOORS, share: float = KEPT_SHARE) -> DataFrame:
    """(__group, m*, p*, log_det, steps) from the table (__group, STATS) of
    ``n_rows`` rows: mean and inverse covariance of each group."""
    k = range(len(STATS))

    def run(group: pa.Table) -> pa.Table:
        column = {c: group.column(c).to_numpy() for c in group.column_names if c != "__group"}
        order = np.argsort(column["cell"])
        n = column["n"][order]
        s = np.stack([column[f"s{i}"][order] for i in k], 1) / GRID
        q = np.empty((len(n), len(STATS), len(STATS)))
        for i, j in _pairs():
            q[:, i, j] = q[:, j, i] = column[f"q{i}{j}"][order] / GRID**2
        spread = np.array([column[f"w{i}"][0] for i in k])
        log_det, mean, cov, steps = least_determinant(n, s, q, spread, floors, share)
        inverse = np.linalg.inv(cov)
        row = {"__group": group.column("__group")[0].as_py(), **{f"m{i}": column[f"m{i}"][0] / GRID + mean[i] for i in k},
               **{f"p{i}{j}": inverse[i, j] for i, j in _pairs()}, "log_det": log_det, "steps": steps}
        return pa.Table.from_pylist([row], schema=pa.schema([(c, pa.int32() if c == "steps" else pa.string() if c == "__group" else pa.float64())
                                                             for c in row]))

    numbers = [*[f"m{i}" for i in k], *[f"p{i}{j}" for i, j in _pairs()], "log_det"]
    schema = ", ".join(["`__group` string", *[f"{c} double" for c in numbers], "steps int"])
    return cells(stats, n_rows, floors).groupBy("__group").applyInArrow(run, schema)


#: Brings the covariance of the inner half to that of the whole (four normal
#: statistics).
CONSISTENCY = 2.11


def fit(counts: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """(__key, __n, m*, p*, log_det, steps): the estimate that the rows of each
    key are judged by, from a written table of counts."""
    passed = counts.where(~F.col("base_failed"))
    groups = land(_groups(passed, min_group), "quality-groups")
    n_rows = groups.agg(F.sum("__n")).first()[0] or 0
    stats = land(join_groups(passed.select("__key", *_statistics()), groups, "__key", "__n", n_rows).select("__group", *STATS), "quality-statistics")
    return land(groups.join(fit_mcd(stats, n_rows), "__group").drop("__group"), "quality-model")


def judge(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), by: tuple[str, ...] = ("lang", "source"),
          text_col: str = "text", cutoff: float = CUTOFF, min_group: int = MIN_GROUP) -> DataFrame:
    """The ``keep`` columns, all counts, ``base_failed``, ``distance`` (squared,
    null for rows that fail the base rules) and ``kept``.

    Null and empty texts have no words and fail the base rules; null languages
    and sources form groups of their own; repeated rows are judged alike; an
    empty table gives an empty result.  Where the text itself is kept, texts
    are counted a second time and not written.
    """
    bys = tuple(f"__by{i}" for i in range(len(by)))
    source = df.select(*[F.col(c) for c in keep], *[F.col(b).alias(f"__by{i}") for i, b in enumerate(by)], F.col(text_col).alias("__t"))
    keyed = lambda counts: counts.select("*", *_keys(bys)).drop(*bys)
    if text_col in keep:
        counts = keyed(count_rules(source, (*keep, *bys), "__t"))
        model = fit(land(keyed(count_rules(source, bys, "__t")), "quality-counts"), min_group)
        judged = counts.join(model, "__key", "left")
    else:
        counts = land(keyed(count_rules(source, (*keep, *bys), "__t")), "quality-counts")
        model = fit(counts, min_group)
        judged = join_groups(counts, model, "__key", "__n", counts.count(), "left")
    distance = F.when(~F.col("base_failed"), _distance(_statistics()))
    return (judged.select(*keep, *COUNTS, "base_failed", distance.alias("distance"))
            .withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)))


def drop_rejected(df: DataFrame, by: tuple[str, ...] = ("lang", "source"), text_col: str = "text",
                  cutoff: float = CUTOFF, min_group: int = MIN_GROUP) -> DataFrame:
    """``df`` without the rows that ``judge`` does not keep, all columns as
    they are, whatever their names.

    A verdict rests on the text and the ``by`` columns alone, so rejected ones
    are known by 128 bits of their hash; texts are read by Python once and
    never written, and rows that a filter shows not to be among the rejected
    are not shuffled.  Null, empty and very long texts, repeated rows and empty
    tables as in ``judge``.
    """
    parts = [x for c in (text_col, *by) for x in (df[c], df[c].isNull())]
    hashes = [F.xxhash64(F.lit(lane), *parts) for lane in (0, 1)]
    source = df.select(hashes[0].alias("__h0"), hashes[1].alias("__h1"), *[df[b].alias(f"__g{i}") for i, b in enumerate(by)], df[text_col].alias("__text_in"))
    judged = judge(source, ("__h0", "__h1"), tuple(f"__g{i}" for i in range(len(by))), "__text_in", cutoff, min_group)
    rejected = land(judged.where("NOT kept").select("__h0", "__h1").distinct(), "rejected")
    return without_keys(df.withColumns({"__h0": hashes[0], "__h1": hashes[1]}), rejected, ["__h0", "__h1"]).drop("__h0", "__h1")
