"""Label encodings, probabilities and bands.

Three class encodings meet in this engine: binary 1/0, verdict 1/2/3 and the
text bands TRUE / FALSE / ``?``.  Every conversion is a Column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from labelforge.functions._util import as_col

from labelforge.fixed import (  # noqa: F401 - re-exported
    BAND_FALSE, BAND_TRUE, BAND_UNSURE, CLASS_NAMES, FALSE_TEXTS, TRUE_TEXTS, UNCERTAINTY_THRESHOLD,
)


def label_from_text(col, scheme: str = "binary") -> Column:
    """B4. ``binary``: exactly ``TRUE`` -> 1, anything else 0.
    ``verdict``: ``TRUE`` -> 1, ``FALSE`` -> 2, anything else null."""
    c = as_col(col)
    if scheme == "binary":
        return F.when(c == F.lit(BAND_TRUE), F.lit(1)).otherwise(F.lit(0))
    if scheme == "verdict":
        return F.when(c == F.lit(BAND_TRUE), F.lit(1)).when(c == F.lit(BAND_FALSE), F.lit(2))
    raise ValueError(f"unknown label scheme: {scheme!r}")


def to_int_label(col, name: str = "label") -> Column:
    """``1.0`` / ``1`` / ``"1"`` -> 1 (truncating); a missing value or a
    non-numeric text fails the job, as the integer conversion it mirrors."""
    c = as_col(col)
    number = c.cast("string").try_cast("double")
    return (F.when(c.isNull(), F.raise_error(F.lit(f"missing value in integer column {name}")))
            .when(number.isNull() | F.isnan(number), F.raise_error(F.concat(F.lit(f"no integer in column {name}: "), c.cast("string"))))
            .otherwise(number.cast("int")))


def sigmoid(col) -> Column:
    """1 / (1 + e^-z)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-as_col(col)))


def uncertainty_band(prob, threshold: float = UNCERTAINTY_THRESHOLD) -> Column:
    """``p < t`` -> FALSE, else ``p > 1 - t`` -> TRUE, else ``?``.
    The FALSE test comes first, so for ``t > 0.5`` it wins; a null stays null.
    NaN is ``?`` (Spark orders it above all numbers, so it is asked for first)."""
    p = as_col(prob)
    t = float(threshold)
    return (F.when(F.isnan(p), F.lit(BAND_UNSURE))
            .when(p < F.lit(t), F.lit(BAND_FALSE))
            .when(p > F.lit(1.0 - t), F.lit(BAND_TRUE))
            .when(p.isNotNull(), F.lit(BAND_UNSURE)))


def prediction_to_num(col, boolean: bool = False, numeric: bool = False) -> Column:
    """TRUE/True -> 1, FALSE/False -> 0, anything else null.
    With ``boolean=True`` the column holds booleans (true -> 1, false -> 0).
    With ``numeric=True`` it holds numbers, or their texts in a file whose
    predictions are all numbers: 1 and 1.0 -> 1, 0 and 0.0 -> 0."""
    c = as_col(col)
    if numeric:
        number = c.try_cast("double")
        return F.when(number == 1, F.lit(1)).when(number == 0, F.lit(0))
    if boolean:
        return F.when(c, F.lit(1)).when(~c, F.lit(0))
    return (F.when(c.isin(*TRUE_TEXTS), F.lit(1))
            .when(c.isin(*FALSE_TEXTS), F.lit(0)))


def binary_to_band(col) -> Column:
    """1 -> TRUE, 0 -> FALSE, anything else ``?``."""
    c = as_col(col)
    return F.when(c == 1, F.lit(BAND_TRUE)).when(c == 0, F.lit(BAND_FALSE)).otherwise(F.lit(BAND_UNSURE))


def class_name(col) -> Column:
    """1 Coniferous, 2 Deciduous, 3 Bad, otherwise null."""
    c = as_col(col)
    expr = None
    for k, v in CLASS_NAMES.items():
        expr = (F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v)))
    return expr


def safe_ratio(num, den) -> Column:
    """Num / den, 0.0 when den is 0."""
    n, d = as_col(num), as_col(den)
    return F.when(d != 0, n.cast("double") / d.cast("double")).otherwise(F.lit(0.0))


def percent_of_total(n, total, digits: int = 1) -> Column:
    """100 * n / total rounded to ``digits`` (0.0 for an empty total)."""
    return F.round(safe_ratio(F.lit(100.0) * as_col(n), total), digits)
