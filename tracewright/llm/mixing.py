"""Mix sources to target weights by weighted fair queueing, with column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import word_count
from tracewright.operators.joining import lookup_join
from tracewright.session import settle

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
# Ranges per step when the place of the cut is searched.
RANGES = 4096


def _source(col: Column) -> Column:
    """A key without nulls; sorts like the source, and null is told apart by its own letter."""
    return F.when(col.isNull(), "n").otherwise(F.concat(F.lit("s"), col.cast("string")))


def _order_key(doc_id: Column, text: Column) -> Column:
    """The shuffle: a digest of id and text. Equal rows have one key and are taken alike."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """Target of each source, from (src, source_size); one row per source.

    Weights repeat over the sources in code point order, null last. Targets
    share the sum of all sizes by weight; none is above ``most`` times its
    source, and what is cut off is shared again by weight. In order of
    cap / weight the capped sources come first, so the final share per unit of
    weight is the largest share any row would get if all before it were capped.
    """
    w = Window.orderBy(F.col("src") == "n", "src")
    each = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(w) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.select("src", "source_size", each.cast("bigint").alias("w"), (F.col("source_size") * most).alias("cap"))
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("src") == "n", "src")
    everything = Window.partitionBy()
    rows = rows.select(
        "*", F.sum("source_size").over(everything).alias("budget"),
        F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("w").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("w_left"))
    rows = rows.withColumn("unit", F.max((F.col("budget") - F.col("before")) / F.col("w_left")).over(everything))
    return rows.select("src", "source_size", "budget", F.least(F.col("cap").cast("double"), F.col("w") * F.col("unit")).alias("target"))


def _cut(copies: DataFrame, budget: int) -> float:
    """The largest finish time up to which all copies together stay within the budget.

    Finish times are counted per range, in two steps of 4096 ranges, and the
    copies of the range with the cut are added up in order; a tie is taken whole
    or not at all. Three rows reach the driver.
    """
    x = F.col("finish") / (F.col("finish") + 1) * RANGES
    rows, left = copies.select("finish", "size", F.floor(x).alias("r1"), F.floor((x - F.floor(x)) * RANGES).alias("r2")), budget
    for name in ("r1", "r2"):
        sums = rows.groupBy(name).agg(F.sum("size").alias("n"))
        run = sums.select(name, "n", F.sum("n").over(Window.orderBy(name)).alias("upto"))
        at = run.where(F.col("upto") > left).orderBy(name).first()
        if at is None:
            return float("inf")
        rows, left = rows.where(F.col(name) == at[name]), left - (at["upto"] - at["n"])
    inside = rows.groupBy("finish").agg(F.sum("size").alias("n"))
    run = inside.select("finish", F.sum("n").over(Window.orderBy("finish")).alias("upto"))
    over = run.where(F.col("upto") > left).agg(F.min("finish").alias("f")).first()["f"]
    below = copies.where(F.col("finish") < over).agg(F.max("finish").alias("f")).first()["f"]
    return -1.0 if below is None else below


def cut_points(docs: DataFrame, weights=WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """(src, source_size, target, k1 .. k<most>): in pass i a source's documents up to key k<i> are taken.

    Documents of a source queue in key order, pass after pass. The finish time
    of a document is the words queued up to its end, divided by the target of
    its source. All copies are ranked by finish time and cut at the budget.
    Sums run over 4096 key ranges per source and then inside a range, so that a
    source with most rows isn't one task's work.
    """
    items = docs.select(_source(F.col("source")).alias("src"), _order_key(F.col("doc_id"), F.col("text")).alias("key"),
                        word_count(F.col("text")).alias("size"))
    items = settle(items.groupBy("src", "key").agg(F.sum("size").alias("size"))
                   .withColumn("part", F.substring("key", 1, 3)), "mix-items")
    parts = settle(items.groupBy("src", "part").agg(F.sum("size").alias("n")), "mix-parts")
    goal = settle(targets(parts.groupBy("src").agg(F.sum("n").alias("source_size")), weights, most), "mix-targets")
    offsets = parts.select("src", "part", (F.sum("n").over(Window.partitionBy("src").orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("src", "part").orderBy("key"))
    queue = items.withColumn("inside", inside).join(offsets, ["src", "part"])
    queue = queue.select("src", "key", "size", (F.col("before") + F.col("inside")).alias("upto"))
    queue = lookup_join(queue, goal.where(F.col("target") > 0), ["src"], "inner", row_bytes=96)
    finish = (F.col("pass") * F.col("source_size") + F.col("upto")) / F.col("target")
    copies = settle(queue.withColumn("pass", F.explode(F.array(*[F.lit(i) for i in range(most)])))
                    .select("src", "key", "size", "pass", finish.alias("finish")), "mix-copies")
    budget = goal.agg(F.max("budget").alias("b")).first()["b"] or 0
    taken = copies.where(F.col("finish") <= _cut(copies, budget))
    last = taken.groupBy("src").agg(*[F.max(F.when(F.col("pass") == i, F.col("key"))).alias(f"k{i + 1}") for i in range(most)])
    # A source without words costs nothing: its documents pass once.
    free = F.when(F.col("target") <= 0, "g")
    return settle(goal.join(last, "src", "left").select(
        "src", "source_size", "target", F.coalesce("k1", free).alias("k1"), *[f"k{i + 1}" for i in range(1, most)]), "mix-cuts")


def mix_sources(docs: DataFrame, weights=WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, source, ...) with size, source_size, target, copies and taken.

    ``copies`` (0 to ``most``) says how often the mix takes the row and
    ``taken`` how many words that is. Reruns agree, whatever the partitioning.

    Null text: size 0. Null source: a source of its own, last in order. Null id:
    ordered by text alone. Rows equal in id and text are taken alike. A source
    whose texts have no words has target 0 and its rows pass once. An empty
    table gives an empty result. Columns of the input named like the new ones
    are replaced. The rows are never shuffled; only (source, digest, size) is.
    """
    cuts = cut_points(docs, weights, most)
    cuts = cuts.select(*[F.col(c).alias(f"__mix_{c}") for c in cuts.columns])
    new = ("size", "source_size", "target", "copies", "taken")
    rows = docs.withColumns({"__mix_src": _source(F.col("source")), "__mix_key": _order_key(F.col("doc_id"), F.col("text")),
                             "__mix_size": word_count(F.col("text"))})
    rows = lookup_join(rows, cuts, ["__mix_src"], "left", row_bytes=256)
    taken = [F.coalesce((F.col("__mix_key") <= F.col(f"__mix_k{i + 1}")).cast("int"), F.lit(0)) for i in range(most)]
    copies = sum(taken[1:], taken[0])
    return rows.select(
        *[f"`{c}`" for c in docs.columns if c not in new], F.col("__mix_size").alias("size"),
        F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), copies.alias("copies"),
        (copies * F.col("__mix_size")).cast("bigint").alias("taken"))


def mixed_rows(docs: DataFrame, weights=WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """The mix itself: each row as often as it is taken, with the columns of the input."""
    rows = mix_sources(docs, weights, most).where(F.col("copies") > 0)
    return (rows.withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select(*[f"`{c}`" for c in docs.columns]))
