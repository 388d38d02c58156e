"""Arithmetic on array<float/double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.numbers import draw_key, hex_number


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def normalize(vector: Column, floor: float = 1e-12) -> Column:
    """Unit-length vector; the length is floored so zero vectors stay zero."""
    length = F.greatest(norm(vector), F.lit(floor))
    return F.transform(as_doubles(vector), lambda x: x / length)


def cosine(a: Column, b: Column, temperature: float = 1.0) -> Column:
    lengths = F.greatest(norm(a), F.lit(1e-12)) * F.greatest(norm(b), F.lit(1e-12))
    return dot(a, b) / lengths / F.lit(float(temperature))


def squared_distance(a: Column, b: Column) -> Column:
    gaps = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def interpolate(a: Column, b: Column, share: Column) -> Column:
    return F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x + share * (y - x))


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def pad_or_cut(values: Column, length: int, filler: Column) -> Column:
    """First ``length`` entries, filled up on the right."""
    kept = F.slice(values, 1, length)
    return F.concat(kept, F.array_repeat(filler, F.lit(length) - F.size(kept)))


def pad_mask(values: Column, length: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: (i <= F.size(values)).cast("int"))


def top_attention(attention: Column, k: int = 10) -> Column:
    """The k largest weights after the first position, ascending, zero-filled on the right."""
    others = F.slice(as_doubles(attention), 2, F.greatest(F.size(attention) - 1, F.lit(0)))
    best = F.reverse(F.slice(F.sort_array(others, asc=False), 1, k))
    return F.concat(best, F.array_repeat(F.lit(0.0), F.lit(k) - F.size(best)))


def concat_blocks(*blocks: Column) -> Column:
    return F.concat(*[as_doubles(b) for b in blocks])


def mask_features(vector: Column, row_id: Column, ratio: float = 0.15, seed: int = 42) -> Column:
    """Set a repeatable share of the entries to zero; the draw depends on row id, position and seed."""
    cut = int(ratio * 16**6)
    return F.transform(
        as_doubles(vector),
        lambda x, i: F.when(hex_number(draw_key(seed, row_id, i), 1, 6) < cut, 0.0).otherwise(x),
    )
