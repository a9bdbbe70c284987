"""JSON out of text that a model wrote, and merged maps (AJ01, AJ08)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def model_json(x: Column) -> tuple[Column, Column]:
    """(JSON text, error): a text that is JSON, else what stands from its first brace to its last, if that is; one of the two is null."""
    within = F.regexp_extract(F.coalesce(x, F.lit("")), r"(?s)\{.*\}", 0)
    valid = lambda t: F.try_parse_json(t).isNotNull()
    found = F.when(valid(F.trim(x)), F.trim(x)).when((within != "") & valid(within), within)
    return found, F.when(F.coalesce(F.trim(x), F.lit("")) == "", "empty response").when(found.isNull(), "could not extract JSON")


def merged(a: Column, b: Column) -> Column:
    """Two maps in one; where both have a key, b's value stands, a null too. A null map is an empty one."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    a, b = F.coalesce(a, none), F.coalesce(b, none)
    return F.map_zip_with(a, b, lambda k, x, y: F.when(F.map_contains_key(b, k), y).otherwise(x))
