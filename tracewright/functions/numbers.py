"""Guarded arithmetic and repeatable pseudo-random draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper row bounds of the dataset size classes.
SIZE_CLASSES = [("small", 10_000), ("medium", 100_000), ("large", 500_000)]


def safe_ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 when the whole is 0."""
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def percentage(part: Column, whole: Column) -> Column:
    return safe_ratio(part * 100.0, whole)


def ratio_to_at_least_one(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def size_class(n_rows: Column) -> Column:
    kind = None
    for name, bound in SIZE_CLASSES:
        kind = F.when(n_rows < bound, name) if kind is None else kind.when(n_rows < bound, name)
    return kind.otherwise("very_large")


def draw_key(seed: int, *ids: Column) -> Column:
    """32 hex digits that depend only on the seed and the ids, not on partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[i.cast("string") for i in ids]))


def hex_number(key: Column, start: int, digits: int) -> Column:
    """Digits [start, start+digits) of a hex key as a whole number; never null, so usable as a join key as is."""
    return F.coalesce(F.conv(F.substring(key, start, digits), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))


def draw_unit(key: Column, start: int = 1) -> Column:
    """A number in [0, 1) from eight digits of a hex key."""
    return hex_number(key, start, 8) / F.lit(float(16**8))


def fixed(value: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, rounding the exact binary value like printf does."""
    return F.call_function("format_number", value.cast("double"), F.lit("0." + "0" * digits))
