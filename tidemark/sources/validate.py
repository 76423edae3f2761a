"""Validation of parsed points: general limits and declared measurement schemas. All errors are collected."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parsed import as_double

# Limits of names, values and counts, reserved names, and the range of times in ms.
MOST_NAME, MOST_TEXT, MOST_TAGS, MOST_FIELDS = 256, 65_536, 256, 256
RESERVED = ("time", "_measurement", "_field", "_value", "_start", "_stop")
LEAST_MS, MOST_MS = 0, 4_102_444_800_000


@dataclass(frozen=True)
class FieldRule:
    """kind: float, integer, unsigned, string, boolean or any; a float rule takes any number."""

    kind: str = "any"
    required: bool = False
    least: float | None = None
    most: float | None = None
    allowed: tuple[str, ...] = ()
    most_length: int | None = None


@dataclass(frozen=True)
class TagRule:
    required: bool = False
    allowed: tuple[str, ...] = ()


@dataclass(frozen=True)
class Schema:
    """strict: tags and fields that aren't declared are errors."""

    tags: dict[str, TagRule] = field(default_factory=dict)
    fields: dict[str, FieldRule] = field(default_factory=dict)
    strict: bool = False


_KINDS = {"float": "fiu", "integer": "i", "unsigned": "u", "string": "s", "boolean": "b", "any": "fiusb"}


def _when(bad: Column, text: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.lit(text))


def general() -> list[Column]:
    """An error text or null for each general rule."""
    names = F.concat(F.map_keys("tags"), F.map_keys("fields"))
    ms = F.col("ts_ns") / 1e6
    return [
        F.col("error"),
        _when(F.col("error").isNull() & (F.coalesce(F.length("measurement"), F.lit(0)) == 0), "measurement is missing"),
        _when(F.octet_length("measurement") > MOST_NAME, "measurement name is too long"),
        _when(F.col("error").isNull() & (F.coalesce(F.size("fields"), F.lit(0)) < 1), "no fields"),
        _when(F.size("tags") > MOST_TAGS, "too many tags"),
        _when(F.size("fields") > MOST_FIELDS, "too many fields"),
        _when(F.exists(names, lambda k: F.octet_length(k) > MOST_NAME), "a key is too long"),
        _when(F.exists(names, lambda k: (k == "") | k.rlike(r"[\x00-\x1F\x7F]")), "a key is empty or has control characters"),
        _when(F.exists(names, lambda k: k.isin(*RESERVED)), "a key is reserved"),
        _when(F.exists(F.map_values("tags"), lambda v: F.octet_length(v) > MOST_NAME), "a tag value is too long"),
        _when(F.exists(F.map_values("fields"), lambda v: F.octet_length(v["s"]) > MOST_TEXT), "a text field is too long"),
        _when(F.exists(F.map_values("fields"), lambda v: F.isnan(v["f"]) | (F.abs(v["f"]) == float("inf"))), "a number isn't finite"),
        _when((ms < LEAST_MS) | (ms > MOST_MS), "time is out of range"),
    ]


def declared(schemas: dict[str, Schema]) -> list[Column]:
    """An error text or null for each rule of each measurement's schema."""
    out = []
    for name, schema in schemas.items():
        here = F.col("measurement") == name
        for key, rule in schema.tags.items():
            v = F.col("tags")[key]
            if rule.required:
                out.append(_when(here & v.isNull(), f"tag {key} is missing"))
            if rule.allowed:
                out.append(_when(here & ~v.isin(*rule.allowed), f"tag {key} has a value that isn't allowed"))
        for key, rule in schema.fields.items():
            f = F.col("fields")[key]
            x = as_double(f)
            if rule.required:
                out.append(_when(here & f.isNull(), f"field {key} is missing"))
            out.append(_when(here & ~F.lit(_KINDS[rule.kind]).contains(f["kind"]), f"field {key} isn't {rule.kind}"))
            if rule.least is not None:
                out.append(_when(here & (x < rule.least), f"field {key} is below {rule.least}"))
            if rule.most is not None:
                out.append(_when(here & (x > rule.most), f"field {key} is above {rule.most}"))
            if rule.allowed:
                out.append(_when(here & ~f["s"].isin(*rule.allowed), f"field {key} has a value that isn't allowed"))
            if rule.most_length is not None:
                out.append(_when(here & (F.length(f["s"]) > rule.most_length), f"field {key} is too long"))
        if schema.strict:
            out.append(_when(here & (F.size(F.array_except(F.map_keys("tags"), F.array(*map(F.lit, schema.tags)).cast("array<string>"))) > 0), "a tag isn't declared"))
            out.append(_when(here & (F.size(F.array_except(F.map_keys("fields"), F.array(*map(F.lit, schema.fields)).cast("array<string>"))) > 0), "a field isn't declared"))
    return out


def validate(parsed: DataFrame, schemas: dict[str, Schema] | None = None) -> DataFrame:
    """parsed with `errors`, an array of texts, empty for good rows."""
    rules = [*general(), *declared(schemas or {})]
    return parsed.withColumn("errors", F.array_compact(F.array(*rules)))


def split(parsed: DataFrame, schemas: dict[str, Schema] | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with their errors)."""
    checked = validate(parsed, schemas)
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def rising(points: DataFrame) -> DataFrame:
    """Series whose times don't strictly rise in arrival order: series_key, broken (points out of place)."""
    from pyspark.sql import Window

    before = F.lag("ts").over(Window.partitionBy("series_key").orderBy("seq"))
    return points.withColumn("b", before).groupBy("series_key").agg(F.count_if(F.col("ts") <= F.col("b")).alias("broken")).where("broken > 0")
