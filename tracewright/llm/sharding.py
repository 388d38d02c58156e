"""Assign groups of rows to shards by longest processing time first."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import text_bytes
from tracewright.session import settle

SHARDS = 16
# Small groups are scheduled in this many bundles; groups above a share of one shard are scheduled one by one.
BUNDLES = 4096
LARGE_PARTS = 64


def schedule(items: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Name -> shard: largest first, each to the shard with the least so far."""
    heap = [(0, s) for s in range(shards)]
    place = {}
    for name, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        place[name] = s
        heapq.heappush(heap, (load + size, s))
    return place


def _group(text: Column) -> Column:
    """Key of a text; all null texts share one."""
    return F.coalesce(F.sha2(text.cast("binary"), 256), F.lit("null"))


def _bundle(group: Column) -> Column:
    """Bundle of a small group. Bundles differ in width from 0 to twice the mean, so that small ones come last and even out."""
    share = F.conv(F.substring(F.sha2(group, 256), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return F.concat(F.lit("b"), F.floor(F.sqrt(share) * BUNDLES).cast("string"))


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every row of ``docs`` (text, ...) with the columns size (UTF-8 bytes and 1) and shard; shards get near equal bytes.

    Rows with equal text stay together. At most shards * 64 groups are larger
    than 1/64 of a shard; they are scheduled one by one, all others in 4096
    bundles drawn by digest, so a bounded list reaches the driver and is
    broadcast back, whatever the input. Rows aren't shuffled, only group
    digests with sizes.

    Null texts form one group of size 1 each row. Empty texts have size 1. Equal
    rows go together. An empty table gives an empty result. Columns of the
    input called size or shard are replaced.
    """
    spark = docs.sparkSession
    rows = docs.drop("size", "shard").withColumns({
        "__group": _group(F.col("text")), "size": text_bytes(F.col("text")) + 1})
    groups = settle(rows.groupBy("__group").agg(F.sum("size").alias("n")), "shard-groups")
    total = groups.agg(F.sum("n").alias("n")).first()["n"] or 0
    large = F.col("n") * (shards * LARGE_PARTS) > total
    items = [(r["g"], r["n"]) for r in groups.where(large).select(F.col("__group").alias("g"), "n")
             .unionByName(groups.where(~large).groupBy(_bundle(F.col("__group")).alias("g")).agg(F.sum("n").alias("n"))).collect()]
    place = spark.createDataFrame(list(schedule(items, shards).items()), "__name string, shard int")
    own = F.broadcast(place.withColumnRenamed("__name", "__group").withColumnRenamed("shard", "__own"))
    rest = F.broadcast(place.withColumnRenamed("__name", "__bundle").withColumnRenamed("shard", "__rest"))
    out = rows.join(own, "__group", "left").withColumn("__bundle", _bundle(F.col("__group"))).join(rest, "__bundle", "left")
    return out.select(*[f"`{c}`" for c in docs.columns if c not in ("size", "shard")], "size",
                      F.coalesce("__own", "__rest").alias("shard"))


def add_slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in the order of a digest of ``order`` and then those columns.

    The first bits of the digest cut each shard into 256 ranges that are
    numbered apart, behind the rows of the ranges before.
    """
    rows = settle(rows.withColumn("__h", F.xxhash64(*order)).withColumn("__part", F.shiftrightunsigned("__h", 56)), "shard-rows")
    counts = rows.groupBy("shard", "__part").agg(F.count("*").alias("__n"))
    w = Window.partitionBy("shard").orderBy("__part")
    before = counts.select("shard", "__part", (F.sum("__n").over(w) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("shard", "__part").orderBy("__h", *order))
    out = rows.withColumn("__inside", inside).join(before, ["shard", "__part"])
    return out.withColumn("slot", (F.col("__before") + F.col("__inside") - 1).cast("bigint")).drop("__h", "__part", "__inside", "__before")
