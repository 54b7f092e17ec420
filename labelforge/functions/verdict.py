"""Model verdicts: strict JSON parsing and the typed reading of its fields
(B11-B14).

Spark's JSON readers (``from_json``, ``try_parse_json``) accept trailing text
after the first value (``{"a":1} extra``) while the reference rejects it.  A
small Arrow-batched guard does the strict parse per row and hands back a
normalised JSON text, which ``parse_json`` turns into a VARIANT; every field
test after that is a native expression on the VARIANT, where the *type* of
``class_id`` (number, text, boolean) is visible.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from labelforge.functions._util import as_col
from labelforge.functions.text import strip_ws

from labelforge.fixed import BAD_CLASS, BAD_FETCH_LABEL, BAD_PARSE_LABEL, FENCE, FENCE_JSON

_NUMERIC_TYPES = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")


def _finite(text):
    """A JSON number; one beyond the doubles becomes the text of an infinity."""
    value = float(text)
    return value if math.isfinite(value) else ("Infinity" if value > 0 else "-Infinity")


def _strict_object(text):
    if text is None:
        return None
    try:
        # NaN and infinities cannot live in a VARIANT: they become their text,
        # which reads as no class and, as a double, as NaN or an infinity
        value = json.loads(text, parse_constant=str, parse_float=_finite)
        if not isinstance(value, dict):
            return None
        # a lone surrogate has no UTF-8 form and is written as U+FFFD
        return json.dumps(value, ensure_ascii=False, allow_nan=False).encode("utf-8", "surrogatepass").decode(
            "utf-8", "replace")
    except (ValueError, RecursionError):
        return None


def _strict_json_object(texts: pd.Series) -> pd.Series:
    """Normalised JSON text of a strictly valid JSON *object*, else null.

    Strict means: the whole text is one value (no trailing text) and it is an
    object.  NaN and infinities are accepted, as by the reference's parser, and
    duplicate keys keep the last one."""
    return texts.map(_strict_object)


# Marked non-deterministic only so the optimizer never copies the call into a
# pushed-down filter (which would run the Python stage twice); the function
# itself is pure.
strict_json_object = F.pandas_udf(_strict_json_object, T.StringType()).asNondeterministic()


def parse_strict(text) -> Column:
    """VARIANT of a strictly valid JSON object, else SQL null."""
    return F.try_parse_json(strict_json_object(as_col(text)))


def clean_verdict_text(text) -> Column:
    """Remove every ```` ```json ```` then every ```` ``` ````, then strip."""
    c = as_col(text)
    return strip_ws(F.replace(F.replace(c, F.lit(FENCE_JSON), F.lit("")), F.lit(FENCE), F.lit("")))


def fallback_verdict(raw_text) -> Column:
    """``{raw_text, class_id: 3, label: bad_parse}`` with the uncleaned text."""
    return F.parse_json(F.to_json(F.struct(
        as_col(raw_text).alias("raw_text"),
        F.lit(BAD_CLASS).alias("class_id"),
        F.lit(BAD_PARSE_LABEL).alias("label"),
    )))


def fetch_error_verdict() -> Column:
    """``{class_id: 3, label: bad}`` written for a failed fetch."""
    return F.parse_json(F.to_json(F.struct(F.lit(BAD_CLASS).alias("class_id"),
                                           F.lit(BAD_FETCH_LABEL).alias("label"))))


def with_verdict(df, text: str, prediction: str = "prediction", parsed: str = "parsed"):
    """B12 as two plain columns (the form to use in pipelines).

    The strict parse is its own projection, so every later field read refers
    to one computed VARIANT column instead of re-parsing the text (a struct
    wrapper would be inlined by the optimizer into each field access)."""
    tmp = "__lf_verdict"
    staged = df.withColumn(tmp, parse_strict(clean_verdict_text(text)))
    return (staged.withColumn(parsed, F.col(tmp).isNotNull())
            .withColumn(prediction, F.coalesce(F.col(tmp), fallback_verdict(text)))
            .drop(tmp))


def parse_verdict(text) -> Column:
    """struct(prediction VARIANT, parsed BOOLEAN).

    A text that is not a strict JSON object after cleaning becomes the
    fallback verdict (decision: a valid non-object is a parse failure too).
    Convenient for single expressions; ``with_verdict`` is the faster form
    when several fields are read afterwards."""
    parsed = parse_strict(clean_verdict_text(text))
    return F.struct(
        F.coalesce(parsed, fallback_verdict(text)).alias("prediction"),
        parsed.isNotNull().alias("parsed"),
    )


def _field(prediction, name: str) -> Column:
    return F.try_variant_get(as_col(prediction), f"$.{name}", "variant")


def _is_numeric_type(type_name: Column) -> Column:
    return type_name.isin(*_NUMERIC_TYPES) | type_name.startswith("DECIMAL")


def coerce_class_id(prediction, default: int = BAD_CLASS) -> Column:
    """Integer class of a verdict, as ``int(prediction.get('class_id', 3))``
    with any failure mapped to 3.

    number -> truncated toward zero; boolean -> 1/0; text -> integer text only
    (``"2"`` -> 2, ``"1.9"`` -> 3); absent, null, list, object -> 3.  A number or
    an integer text outside the INT range gives null (an out-of-range class)."""
    v = _field(prediction, "class_id")
    t = F.schema_of_variant(v)
    as_double = F.try_variant_get(v, "$", "double")
    as_text = F.try_variant_get(v, "$", "string")
    integer_text = as_text.rlike(r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$")
    text_value = F.regexp_replace(as_text, "_", "").try_cast("int")
    return (
        F.when(v.isNull() | F.is_variant_null(v), F.lit(default))
        .when(t == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int"))
        .when(_is_numeric_type(t),
              F.when(F.abs(as_double) < F.lit(2147483648.0),
                     (F.signum(as_double) * F.floor(F.abs(as_double))).cast("int")))
        .when((t == "STRING") & integer_text, text_value)
        .otherwise(F.lit(default))
    )


def is_bad(prediction) -> Column:
    """``class_id == 3`` as a *number* (3 or 3.0; text ``"3"`` and the
    boolean do not count) or the lower-cased label text contains ``bad``."""
    v = _field(prediction, "class_id")
    t = F.schema_of_variant(v)
    numeric_three = _is_numeric_type(t) & (F.try_variant_get(v, "$", "double") == F.lit(3.0))
    label = _field(prediction, "label")
    label_text = F.lower(F.coalesce(F.try_variant_get(label, "$", "string"), F.to_json(label), F.lit("")))
    return F.coalesce(numeric_three, F.lit(False)) | label_text.contains("bad")


def label_text(prediction) -> Column:
    """The ``label`` field as text (null when absent)."""
    return F.try_variant_get(as_col(prediction), "$.label", "string")


def fill_confidence(prediction, default: float = 0.0) -> Column:
    """Confidence as a double; absent, null or non-numeric -> ``default``."""
    return F.coalesce(F.try_variant_get(as_col(prediction), "$.confidence", "double"), F.lit(float(default)))


def is_object(variant) -> Column:
    return F.schema_of_variant(as_col(variant)).startswith("OBJECT")
