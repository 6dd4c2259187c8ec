"""Column helpers for the small text and number rules of SURVEY section I.

All are compositions of built-in functions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Output formats and their media types, the fallback type, the mask.
MEDIA_TYPES = {
    "csv": "text/csv",
    "json": "application/json",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "zip": "application/zip",
}
DEFAULT_MEDIA_TYPE = "application/octet-stream"
MASK = "*****"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_sql(text: Column | str) -> Column:
    """Outer blanks and trailing semicolons removed (query text as sent to a database)."""
    return F.rtrim(F.rtrim(F.trim(_c(text)), F.lit(";")))


def strip_prefix_chars(text: Column | str, chars: str = "?&") -> Column:
    """Leading ``?`` / ``&`` removed (extra connection parameters)."""
    return F.ltrim(_c(text), F.lit(chars))


def contains(text: Column | str, part: str) -> Column:
    """Whether ``part`` occurs in the text."""
    return F.contains(_c(text), F.lit(part))


def quote_plus(text: Column | str) -> Column:
    """The text as a form value: reserved characters in %XX, blanks as plus signs."""
    return F.url_encode(_c(text))


def head(text: Column | str, n: int) -> Column:
    """The first ``n`` characters."""
    return F.left(_c(text), F.lit(n))


def clamp(value: Column | str, low: int | Column, high: int | Column) -> Column:
    """``max(low, min(value, high))``."""
    lo = low if isinstance(low, Column) else F.lit(low)
    hi = high if isinstance(high, Column) else F.lit(high)
    return F.greatest(lo, F.least(_c(value), hi))


def masked(text: Column | str, secret: Column | str) -> Column:
    """Every occurrence of the secret replaced by ``*****``; an empty secret changes nothing."""
    t, s = _c(text), _c(secret)
    return F.when(s != F.lit(""), F.replace(t, s, F.lit(MASK))).otherwise(t)


def file_suffix(path: Column | str) -> Column:
    """Text after the last dot of the file name, lower-cased ('' when there is none)."""
    name = F.substring_index(_c(path), "/", -1)
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def media_type(path: Column | str) -> Column:
    """Media type from the file suffix; anything else is octet-stream."""
    suffix = file_suffix(path)
    expr = F.lit(DEFAULT_MEDIA_TYPE)
    for ext, mt in reversed(list(MEDIA_TYPES.items())):
        expr = F.when(suffix == F.lit(ext), F.lit(mt)).otherwise(expr)
    return expr


def task_id_from_time(prefix: str = "task-") -> Column:
    """A task id from the current epoch second (same value for every row of a query)."""
    return F.concat(F.lit(prefix), F.unix_timestamp().cast("string"))
