"""JSON columns as VARIANT: parsed once, read by path and type, with defaults for what is missing or malformed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """A VARIANT; null for null and for text that isn't JSON."""
    return F.try_parse_json(text)


def field(value: Column, path: str, kind: str, default=None) -> Column:
    """What stands at a path, as a type; the default where there is nothing, or nothing that can be read so."""
    got = F.try_variant_get(value, path, kind)
    return got if default is None else F.coalesce(got, F.lit(default))


def items(value: Column, kind: str) -> Column:
    """A list; an empty one where there is none."""
    return F.coalesce(F.try_variant_get(value, "$", f"array<{kind}>"), F.array().cast(f"array<{kind}>"))
