"""Joins against lookup tables whose keys may be very unevenly used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import settle

BROADCAST_BYTES = 64 << 20
# At most this many keys can each hold more than one part in HEAVY_PARTS of the rows.
HEAVY_PARTS = 1000


def explode_values(rows: DataFrame, keep: list, values, name: str) -> DataFrame:
    """One row per non-null entry of an array.

    The outer form with a filter behind it: a plain explode makes the optimizer
    test the array's size first, and so compute an array expression (a
    tokenizer, a JSON parser) again for the test.
    """
    return rows.select(*keep, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())


def measured_bytes(df: DataFrame, row_bytes: int) -> int:
    """Size of a table: ``row_bytes`` a row or more, where texts, binaries and arrays are counted entry by entry."""
    long = F.lit(0).cast("bigint")
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if kind in ("string", "binary"):
            long = long + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif kind.startswith(("array", "map")):
            long = long + 16 * F.coalesce(F.cardinality(field.name), F.lit(0))
    size = df.select(F.greatest(long + 16 * len(df.columns), F.lit(row_bytes)).alias("b")).agg(F.sum("b").alias("b")).first()["b"]
    return size or 0


def lookup_join(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "left",
                row_bytes: int = 256, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join rows to a lookup table with unique keys; ``how`` is inner or left.

    The lookup table is written unless it has been, so that measuring it doesn't
    run what stands behind it twice. One that was measured and fits is broadcast. Otherwise the few
    keys that hold more than a thousandth of the rows each (at most a thousand
    by definition) are joined by broadcast, so they never meet in one task, and
    all other keys go through an ordinary shuffle join.
    """
    if not getattr(lookup, "is_settled", False):
        lookup = settle(lookup, "lookup")
    if measured_bytes(lookup, row_bytes) <= limit:
        return rows.join(F.broadcast(lookup), keys, how)
    rows = settle(rows, "rows")
    counts = settle(rows.groupBy(*keys).agg(F.count("*").alias("key_rows")), "keys")
    total = counts.agg(F.sum("key_rows").alias("n")).first()["n"] or 0
    heavy = counts.where(F.col("key_rows") * HEAVY_PARTS > total).select(*keys)
    hot_lookup = lookup.join(F.broadcast(heavy), keys, "left_semi")
    hot = rows.join(F.broadcast(heavy), keys, "left_semi").join(F.broadcast(hot_lookup), keys, how)
    cold = rows.join(F.broadcast(heavy), keys, "left_anti").join(lookup, keys, how)
    return hot.unionByName(cold)


def remaining(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return work.join(done.select(*keys).distinct(), keys, "left_anti")
