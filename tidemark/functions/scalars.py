"""Scalar functions of points: time parts, clamps, casts and text checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16


def hour(ts: Column) -> Column:
    return F.hour(ts).cast("long")


def minute(ts: Column) -> Column:
    return F.minute(ts).cast("long")


def day_of_week(ts: Column) -> Column:
    """0 is Sunday."""
    return (F.dayofweek(ts) - 1).cast("long")


def day_of_month(ts: Column) -> Column:
    return F.dayofmonth(ts).cast("long")


def clamp(v: Column, lo: float | None = None, hi: float | None = None) -> Column:
    v = v if hi is None else F.when(v.isNotNull(), F.least(v, F.lit(float(hi))))
    return v if lo is None else F.when(v.isNotNull(), F.greatest(v, F.lit(float(lo))))


def equals(v: Column, x: float) -> Column:
    """Equal within machine epsilon."""
    return F.abs(v - F.lit(float(x))) < F.lit(EPSILON)


def as_long(v: Column) -> Column:
    """A whole number as a long, else null."""
    return F.when((v == F.floor(v)) & (F.abs(v) < F.lit(9.2e18)), v.cast("long"))


def is_label_name(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$")


def is_identifier(name: Column) -> Column:
    """Up to 256 characters, letters, digits, `_`, `-`, `.`; first a letter, digit or `_`."""
    return name.rlike(r"^[A-Za-z0-9_][A-Za-z0-9_.\-]{0,255}$")


def is_safe(text: Column) -> Column:
    """No control characters."""
    return ~text.rlike(r"[\x00-\x1F\x7F]")


def sanitize(text: Column, most: int = 256) -> Column:
    """Without control characters, trimmed, cut to a number of characters."""
    return F.left(F.trim(F.regexp_replace(text, r"[\x00-\x1F\x7F]", "")), F.lit(most))


def sanitize_identifier(text: Column) -> Column:
    """Other characters become `_`; one that doesn't start with a letter or `_` gets a `_` before it."""
    clean = F.regexp_replace(F.trim(text), r"[^A-Za-z0-9_]", "_")
    return F.when(clean.rlike(r"^[A-Za-z_]"), clean).otherwise(F.concat(F.lit("_"), clean))


def sanitize_key(text: Column) -> Column:
    """Fit for a key in a store: what isn't a letter, digit, `_`, `-`, `.` or `:` becomes `_`."""
    return F.regexp_replace(text, r"[^A-Za-z0-9_.:\-]", "_")


def escape_tag(text: Column) -> Column:
    """Line protocol: backslash before comma, equals sign, space and backslash in names and tags."""
    return F.regexp_replace(text, r"([\\,= ])", r"\\$1")


def escape_string(text: Column) -> Column:
    """Line protocol: backslash before double quote and backslash in string fields."""
    return F.regexp_replace(text, r'([\\"])', r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r'\\([\\,= "])', "$1")
