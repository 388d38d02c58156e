"""Exact ranks, samples, splits and running totals without one-task windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracewright.functions.numbers import draw_key
from tracewright.operators.joining import BROADCAST_BYTES, lookup_join, measured_bytes
from tracewright.session import settle

# Hex digits of a draw key that name its bucket: 16**5 buckets, so a class of
# 10**12 rows still has about a million rows per bucket.
BUCKET_DIGITS = 5
# Coarser buckets where only the one around a cut is ranked.
CUT_DIGITS = 4
# Split points for ordering by a number.
SPLIT_POINTS = 512


def _running(group: list[str], order: str):
    return W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)


def _bucketed(df: DataFrame, group: list[str], ids: list[str], seed: int, digits: int) -> DataFrame:
    """Add draw, bucket, bucket_rows, rows_before and group_rows; one small row per (group, bucket) is joined in."""
    keyed = df.withColumn("draw", draw_key(seed, *[F.col(c) for c in ids]))
    keyed = keyed.withColumn("bucket", F.substring("draw", 1, digits))
    names = [f"group_{i}" for i in range(len(group))]
    sizes = keyed.groupBy(*[F.col(c).alias(n) for c, n in zip(group, names)], F.col("bucket").alias("in_bucket"))
    sizes = sizes.agg(F.count("*").alias("bucket_rows"))
    sizes = sizes.withColumn("rows_before", F.coalesce(F.sum("bucket_rows").over(_running(names, "in_bucket")), F.lit(0)))
    sizes = sizes.withColumn("group_rows", F.sum("bucket_rows").over(W.partitionBy(*names)))
    if digits == CUT_DIGITS:  # the table needs no shuffle for anything else, so it isn't shuffled for this
        sizes = settle(sizes, "bucket-sizes")
        sizes = F.broadcast(sizes) if measured_bytes(sizes, 64) <= BROADCAST_BYTES else sizes
    same = F.col("bucket") == F.col("in_bucket")
    for c, n in zip(group, names):
        same = same & F.col(c).eqNullSafe(F.col(n))
    return keyed.join(sizes, same).drop("in_bucket", *names)


HELPERS = ["draw", "bucket", "bucket_rows", "rows_before"]


def draw_rank(df: DataFrame, group: list[str], ids: list[str], seed: int = 42) -> DataFrame:
    """Add ``rank`` (1-based, by hashed id within the group) and ``group_rows``.

    The hash decides the order, so the rank is the same however the rows are
    partitioned. Rows are shuffled by (group, hash bucket): a class with most
    of the rows is spread over all buckets, and only the bucket sizes pass
    through a window per group.
    """
    joined = _bucketed(df, group, ids, seed, BUCKET_DIGITS)
    inside = F.row_number().over(W.partitionBy(*group, "bucket").orderBy("draw", *ids))
    return joined.withColumn("rank", F.col("rows_before") + inside).drop(*HELPERS)


def draw_first(df: DataFrame, group: list[str], ids: list[str], cut: Column, seed: int = 42) -> DataFrame:
    """Add boolean ``first``: whether the row's rank by hashed id is at most ``cut``, and ``group_rows``.

    ``cut`` may use ``group_rows``. Whole buckets fall on one side of the cut;
    only rows of the one bucket per group that straddles it are ranked, so the
    table itself is not shuffled.
    """
    joined = _bucketed(df, group, ids, seed, CUT_DIGITS).withColumn("cut", cut)
    straddles = (F.col("rows_before") < F.col("cut")) & (F.col("rows_before") + F.col("bucket_rows") > F.col("cut"))
    clear = joined.where(~straddles).withColumn("first", F.col("rows_before") < F.col("cut"))
    inside = F.row_number().over(W.partitionBy(*group, "bucket").orderBy("draw", *ids))
    edge = joined.where(straddles).withColumn("first", F.col("rows_before") + inside <= F.col("cut"))
    return clear.unionByName(edge).drop(*HELPERS, "cut")


def sample_rows(df: DataFrame, n: int, ids: list[str], seed: int = 42) -> DataFrame:
    """Exactly n rows (or all), chosen by hashed id."""
    return draw_first(df, [], ids, F.lit(n), seed).where("first").drop("first", "group_rows")


def sample_per_class(df: DataFrame, label: str, ids: list[str], per_class: int = 1500,
                     total: int = 50_000, seed: int = 42) -> DataFrame:
    """At most ``per_class`` rows of each class, then at most ``total`` rows."""
    picked = draw_first(df, [label], ids, F.lit(per_class), seed).where("first").drop("first", "group_rows")
    return sample_rows(picked, total, ids, seed)


def split_rows(df: DataFrame, ids: list[str], train_share: float = 0.8, seed: int = 42) -> DataFrame:
    """Add ``part`` = train for exactly floor(share * n) rows, else test."""
    return _part(draw_first(df, [], ids, F.floor(F.col("group_rows") * F.lit(train_share)), seed))


def stratified_split(df: DataFrame, label: str, ids: list[str], test_share: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Add ``part``: within each class round(share * n) rows are test rows."""
    n_test = F.floor(F.col("group_rows") * F.lit(test_share) + F.lit(0.5))
    return _part(draw_first(df, [label], ids, F.col("group_rows") - n_test, seed))


def _part(cut: DataFrame) -> DataFrame:
    return cut.withColumn("part", F.when(F.col("first"), "train").otherwise("test")).drop("first", "group_rows")


def stratified_folds(df: DataFrame, label: str, ids: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` in 0..k-1 so that each class is spread evenly over the folds."""
    ranked = draw_rank(df, [label], ids, seed)
    return ranked.withColumn("fold", F.pmod(F.col("rank") - 1, F.lit(k)).cast("int")).drop("rank", "group_rows")


def running_totals(points: DataFrame, group: list[str], order: str, sums: list[str]) -> DataFrame:
    """Add ``cum_<c>`` per sum column: total over rows of the group with a value >= this one.

    ``points`` has one row per (group, value). Values are cut at fixed split
    points; totals per (group, range) are accumulated first, and the window
    then runs inside one range, so no group has to fit in one task. Any split
    points give the same result; they only set how evenly the ranges fill.
    """
    accuracy = SPLIT_POINTS * 4
    steps = F.array(*[F.lit(i / SPLIT_POINTS) for i in range(1, SPLIT_POINTS)])
    found = points.agg(F.percentile_approx(F.col(order).cast("double"), steps, F.lit(accuracy)).alias("q")).first()
    splits = sorted(set(found["q"] or []))
    cuts = F.array(*[F.lit(float(s)) for s in splits]) if splits else F.array().cast("array<double>")
    at = F.size(F.filter(cuts, lambda s: s > F.col(order)))
    ranged = points.withColumn("at", at)
    totals = ranged.groupBy(*group, "at").agg(*[F.sum(c).alias(f"t_{c}") for c in sums])
    before = _running(group, "at")
    totals = totals.select(*group, "at", *[
        F.coalesce(F.sum(f"t_{c}").over(before), F.lit(0)).alias(f"b_{c}") for c in sums])
    inside = W.partitionBy(*group, "at").orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = ranged.join(totals, [*group, "at"])
    for c in sums:
        joined = joined.withColumn(f"cum_{c}", F.col(f"b_{c}") + F.sum(c).over(inside))
    return joined.drop("at", *[f"b_{c}" for c in sums])


def exact_quantile(rows: DataFrame, value: str, share: float, keys: list[str] | None = None) -> DataFrame:
    """(keys, quantile): the least value that at least ``share`` of the values of a group don't exceed.

    An approximate quantile on both sides brackets the place; only values in
    between are put in order, and what lies below is counted. Nulls don't count.
    """
    keys = keys or []
    slack, accuracy = 0.001, 10_000
    points = settle(rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v_")), "quantile")
    low, high = (F.percentile_approx("v_", s, accuracy) for s in (max(0.0, share - slack), min(1.0, share + slack)))
    marks = settle(points.groupBy(*keys).agg(low.alias("lo_"), high.alias("hi_"), F.count("*").alias("n_")), "quantile-marks")
    one = F.lit(1)
    points, marks = points.withColumn("k_", one), marks.withColumn("k_", one)
    inside = lookup_join(points, marks, [*keys, "k_"], "inner", row_bytes=96)
    counts = inside.groupBy(*keys, "n_").agg(F.count_if(F.col("v_") < F.col("lo_")).alias("below_"))
    steps = inside.where((F.col("v_") >= F.col("lo_")) & (F.col("v_") <= F.col("hi_"))).groupBy(*keys, "v_").agg(F.count("*").alias("c_"))
    upto = F.sum("c_").over(W.partitionBy(*keys).orderBy("v_"))
    steps = steps.withColumn("upto_", upto).withColumn("k_", one)
    place = F.greatest(F.ceil(F.col("n_") * share), F.lit(1))
    found = lookup_join(steps, counts.withColumn("k_", one), [*keys, "k_"], "inner", row_bytes=96)
    found = found.where(F.col("below_") + F.col("upto_") >= place)
    return found.groupBy(*keys).agg(F.min("v_").alias("quantile"))
