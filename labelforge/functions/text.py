"""String column functions: keys, names and URL predicates.

All are native Column expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from labelforge.functions._util import as_col

# Characters Python's ``str.strip()`` removes (``str.isspace``); plain ``trim``
# only removes spaces.
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = (
    r"[\t\n\x0B\f\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
)


def strip_ws(col) -> Column:
    """Remove whitespace on both ends, like Python ``str.strip()`` (a native
    trim with an explicit character set, no regex)."""
    return F.btrim(as_col(col), F.lit(WHITESPACE_CHARS))


def normalise_key(col) -> Column:
    """Join key as text with surrounding whitespace removed."""
    return strip_ws(as_col(col).cast("string"))


def url_basename(col) -> Column:
    """B1: trailing slashes removed, then the last ``/`` segment (query kept)."""
    return F.element_at(F.split(F.regexp_replace(as_col(col), "/+$", ""), "/", -1), -1)


def path_basename(col) -> Column:
    """B2: file name of a path (a trailing slash is ignored, as by pathlib)."""
    return url_basename(col)


def positional_name(seq, width: int = 3, ext: str = ".jpg") -> Column:
    """``%0{width}d{ext}`` of a line position; wider numbers keep all digits."""
    return F.format_string(f"%0{int(width)}d{ext}", as_col(seq))


def starts_with_http(col) -> Column:
    """The ingest test (a line must begin with ``http``)."""
    return as_col(col).startswith("http")


def contains_http(col) -> Column:
    """The annotate test (``http`` anywhere in the line)."""
    return as_col(col).contains("http")


def has_image_extension(col, extensions=("jpg", "jpeg", "png")) -> Column:
    """Case-insensitive extension test on a path."""
    alternatives = "|".join(e.lower().lstrip(".") for e in extensions)
    return F.lower(as_col(col)).rlike(rf"\.({alternatives})$")


def is_blank(col) -> Column:
    """A line that is empty after Python-style stripping."""
    return strip_ws(col) == F.lit("")
