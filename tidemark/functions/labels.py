"""Label rewriting on tag maps."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _set(tags: Column, name: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(tags, lambda k, v: k != name), F.create_map(F.lit(name), value))


def label_replace(tags: Column, dst: str, replacement: str, src: str, pattern: str) -> Column:
    """Where `pattern` occurs in the label `src` (missing: empty), set `dst` to `replacement` with $1, $2 ...
    filled from the groups; else leave the labels. The pattern isn't anchored. ValueError for a bad `dst`."""
    if not _NAME.fullmatch(dst):
        raise ValueError(f"not a label name: {dst!r}")
    value = F.coalesce(tags[src], F.lit(""))
    parts = []
    for literal, group in re.findall(r"([^$]+|\$(?!\d))|\$(\d+)", replacement):
        parts.append(F.lit(literal) if literal else F.regexp_extract(value, pattern, int(group)))
    return F.when(value.rlike(pattern), _set(tags, dst, F.concat(F.lit(""), *parts))).otherwise(tags)


def label_join(tags: Column, dst: str, separator: str, sources: list[str]) -> Column:
    """Set `dst` to the values of the labels that are there, joined."""
    if not _NAME.fullmatch(dst):
        raise ValueError(f"not a label name: {dst!r}")
    return _set(tags, dst, F.concat_ws(separator, *[tags[s] for s in sources]))


def tag_text(tags: Column) -> Column:
    """`k:v` pairs in order of their keys."""
    return F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat_ws(":", e["key"], e["value"]))
