"""Which protocol a payload is in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def protocol(payload: Column, content_type: Column | None = None) -> Column:
    """json, protobuf or line: by the content type if it names one, else by the first byte that isn't blank."""
    head = F.ltrim(F.decode(F.substring(payload.cast("binary"), 1, 64), "ISO-8859-1"), F.lit(" \t\r"))
    by_bytes = F.when(F.substring(payload.cast("binary"), 1, 1) == F.lit(bytearray(b"\n")), "protobuf").when(F.substring(F.ltrim(head, F.lit("\n")), 1, 1).isin("{", "["), "json").otherwise("line")
    if content_type is None:
        return by_bytes
    kind = F.lower(content_type)
    return F.when(kind.contains("json"), "json").when(kind.contains("protobuf"), "protobuf").when(kind.contains("text/plain"), "line").otherwise(by_bytes)
