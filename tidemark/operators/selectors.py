"""Conditions on tags and values as Columns. A missing tag counts as empty for `=`, `!=`, `=~` and `!~`."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import equals
from ..plans import ast

MOST_PATTERN = 1000
MOST_TAG_PATTERN = 4096


def check_regex(pattern: str) -> str:
    """RE2 has no back references or look-around, and long patterns are refused: ValueError."""
    if len(pattern) > MOST_PATTERN:
        raise ValueError("regular expression too long")
    if re.search(r"\\[1-9]|\(\?[=!<]", pattern):
        raise ValueError(f"unsupported regular expression: {pattern!r}")
    re.compile(pattern)
    return pattern


def glob(pattern: str) -> str:
    """The anchored regular expression of a pattern in which `*` stands for anything."""
    return "^" + ".*".join(re.escape(x) for x in pattern.split("*")) + "$"


def tag(tags: Column, m: ast.TagMatcher) -> Column:
    """The condition of one matcher; never null."""
    raw, value = tags[m.key], F.coalesce(tags[m.key], F.lit(""))
    there = F.coalesce(F.map_contains_key(tags, m.key), F.lit(False))
    if m.op == "=":
        return value == m.value
    if m.op == "!=":
        return value != m.value
    if m.op == "=~":
        return value.rlike(f"^(?:{check_regex(m.value)})$")
    if m.op == "!~":
        return ~value.rlike(f"^(?:{check_regex(m.value)})$")
    found = {
        "exists": lambda: there,
        "not_exists": lambda: ~there,
        "prefix": lambda: raw.startswith(m.value),
        "glob": lambda: raw.rlike(glob(m.value)),
        "regex": lambda: raw.rlike(check_regex(m.value)),
        "in": lambda: raw.isin(list(m.value)),
    }
    if m.op not in found:
        raise ValueError(f"unknown tag operator: {m.op!r}")
    return F.coalesce(found[m.op](), F.lit(False))


def any_value_contains(tags: Column, text: str) -> Column:
    """Whether the value of any tag holds the text."""
    return F.coalesce(F.exists(F.map_values(tags), lambda v: v.contains(text)), F.lit(False))


def tag_pattern(tags: Column, pattern: str) -> Column:
    """`k=v,k=pre*,k=regex:expr`: all must match; a missing tag doesn't; an empty pattern matches all."""
    if len(pattern) > MOST_TAG_PATTERN:
        raise ValueError("tag pattern too long")
    parts = [p.partition("=") for p in pattern.split(",") if p.strip()]
    terms = []
    for key, eq, value in parts:
        if not eq:
            raise ValueError(f"not a tag pattern: {pattern!r}")
        op, value = ("regex", value[6:]) if value.startswith("regex:") else ("glob", value)
        terms.append(tag(tags, ast.TagMatcher(key.strip(), op, value)))
    return reduce(and_, terms, F.lit(True))


def value(v: Column, p: ast.Compare) -> Column:
    """A comparison of the value with a number; with NaN nothing holds."""
    if isinstance(p.value, float) and p.value != p.value:
        return F.lit(False)
    x = F.lit(float(p.value))
    return {"=": lambda: equals(v, p.value), "!=": lambda: ~equals(v, p.value), ">": lambda: v > x, ">=": lambda: v >= x, "<": lambda: v < x, "<=": lambda: v <= x}[p.op]()


def condition(c: ast.Condition | None, tags: Column | None = None, v: Column | None = None) -> Column:
    """Any condition tree over the columns tags and value; rows where it is null are left out by where()."""
    tags = F.col("tags") if tags is None else tags
    v = F.col("value") if v is None else v
    if c is None:
        return F.lit(True)
    if isinstance(c, ast.TagMatcher):
        return tag(tags, c)
    if isinstance(c, ast.Compare):
        return value(v, c)
    if isinstance(c, ast.Between):
        return v.between(float(c.low), float(c.high))
    if isinstance(c, ast.InSet):
        return v.isin([float(x) for x in c.values]) if c.values else F.lit(False)
    if isinstance(c, ast.IsNull):
        return v.isNotNull() if c.negated else v.isNull()
    if isinstance(c, ast.Not):
        return ~condition(c.part, tags, v)
    if isinstance(c, ast.And | ast.Or):
        return reduce(and_ if isinstance(c, ast.And) else or_, [condition(p, tags, v) for p in c.parts])
    raise ValueError(f"unknown condition: {c!r}")
