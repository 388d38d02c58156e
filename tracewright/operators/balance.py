"""Oversampling of rare classes: synthetic rows between neighbours, and cleaning steps.

Every draw is taken from a digest of the seed row, the copy number and the
seed, so results do not depend on partitioning. A class of n rows that needs m
new ones takes floor(m / n) or one more from each seed row, the extra ones
going to the first rows by draw order; m is met exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tracewright.functions import vectors as vc
from tracewright.functions.numbers import draw_key, draw_unit, hex_number
from tracewright.operators import multilabel as ml
from tracewright.operators.clustering import kmeans, silhouette_squared
from tracewright.operators.counts import balance_improvement
from tracewright.operators.joining import lookup_join
from tracewright.operators.neighbors import nearest
from tracewright.operators.pooling import matrix_of
from tracewright.operators.ranking import draw_rank
from tracewright.operators.vector_stats import cluster_centroids, matrix_stats, project, width_of
from tracewright.session import settle

# Copies of one seed row are made in runs of this length, so a tiny class that
# needs very many rows is still built by many tasks.
COPY_RUN = 10_000


def deficits(rows: DataFrame, label: str = "label", below: float | None = None) -> DataFrame:
    """(label, n, need): rows missing to the size of the largest class.

    ``below`` keeps only classes smaller than that share of the largest.
    """
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    counts = counts.withColumn("most", counts.agg(F.max("n")).scalar())
    short = F.col("n") < (F.col("most") * below if below is not None else F.col("most"))
    return counts.where(short).select(label, "n", (F.col("most") - F.col("n")).alias("need"))


def _spread_copies(seeds: DataFrame, copies: Column) -> DataFrame:
    """One row per copy, numbered from 1 in ``copy``."""
    runs = F.sequence(F.lit(0).cast("bigint"), F.floor((copies - 1) / COPY_RUN))
    seeds = seeds.withColumn("copies_", copies).where(F.col("copies_") > 0).withColumn("run_", F.explode(runs))
    seeds = seeds.repartition("row_id", "run_")
    first = F.col("run_") * COPY_RUN + 1
    last = F.least(F.col("copies_"), (F.col("run_") + 1) * COPY_RUN)
    return seeds.withColumn("copy", F.explode(F.sequence(first, last))).drop("copies_", "run_")


def _even_copies(seeds: DataFrame, label: str, need: DataFrame, seed: int) -> DataFrame:
    """Share each class's need evenly over its seed rows."""
    ranked = draw_rank(seeds, [label], ["row_id"], seed).join(need.select(label, "need"), label)
    extra = (F.col("rank") <= F.col("need") % F.col("group_rows")).cast("bigint")
    copies = F.floor(F.col("need") / F.col("group_rows")) + extra
    return _spread_copies(ranked, copies).drop("rank", "group_rows", "need")


def _between(copies: DataFrame, base: DataFrame, label: str, k: int, near: DataFrame, seed: int) -> DataFrame:
    """Synthetic rows on the segments from seed rows to one of their neighbours."""
    sizes = near.groupBy("query_id").agg(F.max("rank").alias("n_near"))
    rows = lookup_join(copies, sizes.select(F.col("query_id").alias("row_id"), "n_near"), ["row_id"], "left",
                       row_bytes=32)
    key = draw_key(seed, F.col("row_id"), F.col("copy"))
    rows = rows.withColumn("key_", key).withColumn(
        "rank", (F.pmod(hex_number(F.col("key_"), 9, 8), F.coalesce("n_near", F.lit(1))) + 1).cast("int"))
    pairs = near.select(F.struct(F.col("query_id").alias("row_id"), F.col("rank").cast("int").alias("rank")).alias("at"),
                        "neighbor_id")
    rows = rows.withColumn("at", F.struct("row_id", "rank"))
    rows = lookup_join(rows, pairs, ["at"], "left", row_bytes=48)
    ends = base.select(F.col("row_id").alias("neighbor_id"), F.col("vec").alias("end_"))
    rows = lookup_join(rows, ends, ["neighbor_id"], "left", row_bytes=16 * 1024)
    # A class with a single row has no neighbour: the row is repeated.
    moved = vc.interpolate(F.col("vec"), F.coalesce("end_", "vec"), draw_unit(F.col("key_"), 1))
    return rows.select(F.col("row_id").alias("seed_id"), F.col("copy"), "neighbor_id", label, moved.alias("vec"))


def _points(rows: DataFrame, row_id: str, vector: str, label: str) -> DataFrame:
    return settle(rows.select(F.col(row_id).cast("bigint").alias("row_id"), vc.as_doubles(F.col(vector)).alias("vec"),
                              F.col(label).alias(label)), "points")


def _seeded(points: DataFrame, seeds: DataFrame, need: DataFrame, label: str, k: int, seed: int) -> DataFrame:
    """Even shares over ``seeds``, neighbours from the same class in ``points``."""
    near = settle(_same_class_neighbors(points, need, label, k), "near")
    copies = _even_copies(seeds, label, need, seed)
    return _between(copies, points, label, k, near, seed)


def _same_class_neighbors(points: DataFrame, need: DataFrame, label: str, k: int) -> DataFrame:
    rare = settle(points.join(need.select(label), label, "left_semi"), "rare")
    return nearest(rare, rare, k, by=label)


def smote(rows: DataFrame, k: int = 5, row_id: str = "row_id", vector: str = "vec", label: str = "label",
          below: float | None = None, seed: int = 42) -> DataFrame:
    """Synthetic rows (seed_id, copy, neighbor_id, label, vec) that fill every class up to the largest."""
    points = _points(rows, row_id, vector, label)
    need = settle(deficits(points, label, below), "need")
    seeds = points.join(need.select(label), label, "left_semi")
    return _seeded(points, seeds, need, label, k, seed)


def _other_share(points: DataFrame, need: DataFrame, label: str, m: int) -> DataFrame:
    """(row_id, label, others): how many of a rare row's m nearest rows are of another class."""
    rare = settle(points.join(need.select(label), label, "left_semi"), "rare")
    near = nearest(rare, points, m)
    names = points.select(F.col("row_id").alias("neighbor_id"), F.col(label).alias("their"))
    near = lookup_join(near, names, ["neighbor_id"], "inner", row_bytes=64)
    mine = rare.select(F.col("row_id").alias("query_id"), label)
    joined = near.join(mine, "query_id")
    return joined.groupBy(F.col("query_id").alias("row_id"), label).agg(
        F.count_if(F.col("their") != F.col(label)).alias("others"))


def borderline_smote(rows: DataFrame, k: int = 5, m: int = 10, row_id: str = "row_id", vector: str = "vec",
                     label: str = "label", seed: int = 42) -> DataFrame:
    """Like ``smote``, seeded only by rows with at least half but not all of m neighbours of another class.

    A class without such rows gets nothing.
    """
    points = _points(rows, row_id, vector, label)
    need = settle(deficits(points, label), "need")
    share = settle(_other_share(points, need, label, m), "share")
    danger = share.where((F.col("others") * 2 >= m) & (F.col("others") < m)).select("row_id")
    seeds = points.join(need.select(label), label, "left_semi").join(danger, "row_id", "left_semi")
    return _seeded(points, seeds, need, label, k, seed)


def adasyn(rows: DataFrame, k: int = 5, row_id: str = "row_id", vector: str = "vec", label: str = "label",
           seed: int = 42) -> DataFrame:
    """Copies per seed row in proportion to its share of neighbours of another class."""
    points = _points(rows, row_id, vector, label)
    need = settle(deficits(points, label), "need")
    share = settle(_other_share(points, need, label, k), "share")
    total = share.groupBy(label).agg(F.sum("others").alias("total"))
    weighted = lookup_join(lookup_join(share, total, [label], "inner", row_bytes=64), need.select(label, "need"), [label], "inner", row_bytes=64)
    copies = F.coalesce(F.rint(F.col("others") * F.col("need") / F.nullif("total", F.lit(0))), F.lit(0)).cast("bigint")
    seeds = points.join(weighted.select("row_id", copies.alias("share_")), "row_id")
    near = settle(_same_class_neighbors(points, need, label, k), "near")
    spread = _spread_copies(seeds, F.col("share_")).drop("share_")
    return _between(spread, points, label, k, near, seed)


def fourier_features(points: DataFrame, width: int, features: int, gamma: float, seed: int, out: str = "features") -> DataFrame:
    """Add random features whose products stand for exp(-gamma * squared distance); they depend on the seed alone."""
    rng = np.random.default_rng(seed)
    turn, shift = rng.normal(size=(width, features)) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, features)
    shared = points.sparkSession.sparkContext.broadcast((turn, shift))
    schema = T.StructType([*points.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    place = points.columns.index("vec")

    def run(batches):
        import pyarrow as pa

        turn_, shift_ = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                batch = whole.slice(a, 2048)
                x = np.sqrt(2 / len(shift_)) * np.cos(matrix_of(batch.column(place), len(turn_))[0] @ turn_ + shift_)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, out])

    return points.mapInArrow(run, schema)


def margins(points: DataFrame, label: str, features: int = 256, gamma: float | None = None, seed: int = 42) -> DataFrame:
    """``points`` with ``margin``: how far a row lies on the own side of the boundary of its class against all others.

    The boundary is that of a machine with a Gaussian kernel, by random Fourier
    features; ``gamma`` is 1 / (width * variance of all entries) unless given.
    All classes are trained in the same passes.
    """
    width = width_of(points, "vec")
    names = sorted(r[label] for r in points.select(label).distinct().collect())
    if gamma is None:
        spread = matrix_stats(points, "vec", width).first()["std"] if width else None
        gamma = 1.0 / (width * spread * spread) if spread else 1.0
    index = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(label)) - 1
    ready = settle(fourier_features(points, width, features, gamma, seed).withColumn("y_", index.cast("int")), "fourier")
    bits = F.transform(F.sequence(F.lit(0), F.lit(max(len(names) - 1, 0))), lambda i: (i == F.col("y_")).cast("double"))
    weights = ml.fit(settle(ready.select(F.col("features").alias("vec"), bits.alias("bits")), "margin-train"), len(names), tolerance=1e-4, hinge=True)
    shared = points.sparkSession.sparkContext.broadcast(weights.matrix)
    places = [ready.columns.index(c) for c in ("features", "y_")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x, own = matrix_of(batch.column(places[0]), features)[0], shared.value[batch.column(places[1]).to_numpy()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((x * own[:, :-1]).sum(axis=1) + own[:, -1])], [*batch.schema.names, "margin"])

    return ready.mapInArrow(run, T.StructType([*ready.schema.fields, T.StructField("margin", T.DoubleType())])).drop("features", "y_")


def svm_smote(rows: DataFrame, k: int = 5, row_id: str = "row_id", vector: str = "vec",
              label: str = "label", seed: int = 42, gamma: float | None = None) -> DataFrame:
    """Like ``smote``, seeded by the rows of each class inside the margin of its boundary against the rest.

    These are the support vectors of a machine with a Gaussian kernel: rows
    whose signed margin doesn't exceed 1. A class without any is seeded by all of its rows.
    """
    points = _points(rows, row_id, vector, label)
    need = settle(deficits(points, label), "need")
    scored = settle(margins(points, label, gamma=gamma, seed=seed).join(need.select(label), label, "left_semi"), "margin")
    near = scored.where(F.col("margin") <= 1)
    bare = need.select(label).join(near.select(label).distinct(), label, "left_anti")
    seeds = near.unionByName(scored.join(bare, label, "left_semi")).select("row_id", "vec", label)
    return _seeded(points, seeds, need, label, k, seed)


def kmeans_smote(rows: DataFrame, n_clusters: int = 8, k: int = 5, row_id: str = "row_id", vector: str = "vec",
                 label: str = "label", seed: int = 42) -> DataFrame:
    """New rows inside clusters where the class is at least as common as in all rows, more in sparse ones.

    A class without such a cluster falls back to all of its rows.
    """
    points = _points(rows, row_id, vector, label)
    need = settle(deficits(points, label), "need")
    placed = settle(kmeans(points, "vec", n_clusters, "cluster", seed), "placed")
    cells = placed.groupBy("cluster", label).agg(F.count("*").alias("n"))
    cells = cells.withColumn("in_cluster", F.sum("n").over(W.partitionBy("cluster")))
    cells = cells.withColumn("in_class", F.sum("n").over(W.partitionBy(label)))
    cells = cells.withColumn("total", points.agg(F.count("*").alias("n")).scalar())
    dense = settle(cells.where((F.col("n") > k) & (F.col("n") * F.col("total") >= F.col("in_cluster") * F.col("in_class")))
                   .join(need.select(label), label, "left_semi").select("cluster", label, "n"), "dense")
    width = width_of(points, "vec")
    inside = placed.join(dense.select("cluster", label), ["cluster", label], "left_semi").withColumn(
        "cell", F.concat_ws(":", "cluster", label))
    centre = cluster_centroids(inside, "cell", "vec", width)
    wide = lookup_join(inside, centre.select("cell", "centroid"), ["cell"], "inner", row_bytes=8 * width + 64)
    sparse = wide.groupBy("cell", "cluster", label).agg(
        (F.avg(vc.distance(F.col("vec"), F.col("centroid"))) / F.count("*")).alias("sparsity"), F.count("*").alias("n"))
    sparse = sparse.withColumn("share", F.col("sparsity") / F.sum("sparsity").over(W.partitionBy(label)))
    by_cell = sparse.join(need.select(label, F.col("need").alias("class_need")), label)
    order = W.partitionBy(label).orderBy("cell")
    upto = F.sum("share").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    edge = F.round(F.col("class_need") * F.round(upto, 9)).cast("bigint")
    by_cell = by_cell.withColumn("edge", edge)
    by_cell = settle(by_cell.withColumn("need", F.col("edge") - F.coalesce(F.lag("edge").over(order), F.lit(0)))
                     .select("cell", "need"), "cells")
    grouped = settle(inside.select("row_id", "vec", label, "cell"), "inside")
    near = settle(nearest(grouped, grouped, k, by="cell"), "near")
    made = _between(_even_copies(grouped, "cell", by_cell, seed), points, label, k, near, seed)
    left_over = settle(need.join(dense.select(label).distinct(), label, "left_anti"), "need")
    if left_over.take(1):
        seeds = points.join(left_over.select(label), label, "left_semi")
        made = made.unionByName(_seeded(points, seeds, left_over, label, k, seed))
    return made


def random_oversample(rows: DataFrame, row_id: str = "row_id", label: str = "label", below: float | None = 0.5,
                      seed: int = 42) -> DataFrame:
    """(row_id, copy): repeats of rows of classes below half the largest, up to the largest."""
    need = deficits(rows, label, below)
    seeds = rows.select(F.col(row_id).alias("row_id"), label).join(need.select(label), label, "left_semi")
    return _even_copies(seeds, label, need, seed).select("row_id", label, "copy")


def with_synthetic(rows: DataFrame, synthetic: DataFrame, row_id: str = "row_id", vector: str = "vec",
                   label: str = "label") -> DataFrame:
    """Original and synthetic rows in one table; (row_id, copy) is the key, originals have copy 0."""
    old = rows.select(F.col(row_id).cast("bigint").alias("row_id"), F.lit(0).cast("bigint").alias("copy"), label,
                      vc.as_doubles(F.col(vector)).alias("vec"), F.lit(False).alias("is_synthetic"))
    new = synthetic.select(F.col("seed_id").alias("row_id"), F.col("copy").cast("bigint").alias("copy"), label, "vec",
                           F.lit(True).alias("is_synthetic"))
    return old.unionByName(new)


def _numbered(balanced: DataFrame) -> DataFrame:
    """Give every row a plain id in (row_id, copy) order within a draw."""
    ranked = draw_rank(balanced, [], ["row_id", "copy"])
    return settle(ranked.withColumnRenamed("rank", "id").drop("group_rows"), "balanced")


def drop_disagreeing(balanced: DataFrame, k: int = 3, label: str = "label") -> DataFrame:
    """Keep rows whose k nearest rows all have their own class."""
    rows = _numbered(balanced)
    near = nearest(rows, rows, k, row_id="id")
    names = rows.select(F.col("id").alias("neighbor_id"), F.col(label).alias("their"))
    near = lookup_join(near, names, ["neighbor_id"], "inner", row_bytes=64)
    mine = rows.select(F.col("id").alias("query_id"), label)
    bad = near.join(mine, "query_id").where(F.col("their") != F.col(label)).select(F.col("query_id").alias("id"))
    return rows.join(bad.distinct(), "id", "left_anti").drop("id")


def drop_tomek_links(balanced: DataFrame, label: str = "label") -> DataFrame:
    """Drop both rows of every mutually nearest pair of different classes."""
    rows = _numbered(balanced)
    near = settle(nearest(rows, rows, 1, row_id="id").select("query_id", "neighbor_id"), "near")
    back = near.select(F.col("neighbor_id").alias("query_id"), F.col("query_id").alias("neighbor_id"))
    mutual = near.join(back, ["query_id", "neighbor_id"], "left_semi")
    first = rows.select(F.col("id").alias("query_id"), F.col(label).alias("mine"))
    second = rows.select(F.col("id").alias("neighbor_id"), F.col(label).alias("their"))
    links = mutual.join(first, "query_id").join(second, "neighbor_id").where(F.col("mine") != F.col("their"))
    return rows.join(links.select(F.col("query_id").alias("id")), "id", "left_anti").drop("id")


def smote_enn(rows: DataFrame, seed: int = 42, **columns) -> DataFrame:
    return drop_disagreeing(settle(with_synthetic(rows, smote(rows, seed=seed, **columns), **columns), "both"))


def smote_tomek(rows: DataFrame, seed: int = 42, **columns) -> DataFrame:
    return drop_tomek_links(settle(with_synthetic(rows, smote(rows, seed=seed, **columns), **columns), "both"))


VARIANTS = {
    "smote": smote, "borderline": borderline_smote, "adasyn": adasyn, "svm_smote": svm_smote,
    "kmeans_smote": kmeans_smote,
}
CLEANED_VARIANTS = {"smote_enn": smote_enn, "smote_tomek": smote_tomek}


def balance(rows: DataFrame, variant: str = "smote", row_id: str = "row_id", vector: str = "vec",
            label: str = "label", seed: int = 42) -> DataFrame:
    """Balanced table (row_id, copy, label, vec, is_synthetic) by any variant."""
    columns = {"row_id": row_id, "vector": vector, "label": label}
    if variant in CLEANED_VARIANTS:
        return CLEANED_VARIANTS[variant](rows, seed=seed, **columns)
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant}")
    made = settle(VARIANTS[variant](rows, seed=seed, **columns), "made")
    if not made.take(1):
        # A variant that cannot place any row gives way to plain repetition.
        copies = random_oversample(rows, row_id, label, seed=seed)
        points = _points(rows, row_id, vector, label)
        made = lookup_join(copies, points.select("row_id", "vec"), ["row_id"], "inner", row_bytes=4096).withColumnRenamed("row_id", "seed_id")
    return with_synthetic(rows, made, **columns)


def balance_groups(rows: DataFrame, groups: DataFrame, classes: str = "classes", bits: str = "label_vector",
                   row_id: str = "row_id", vector: str = "vec", variant: str = "smote", seed: int = 42) -> DataFrame:
    """Balance group membership (any label of the group) group by group, appending synthetic rows.

    ``groups`` is (label, group). Synthetic rows take over the label bits of
    their seed row. One round per group; the number of groups is small.
    """
    now = rows.select(F.col(row_id).cast("bigint").alias("row_id"), vc.as_doubles(F.col(vector)).alias("vec"),
                      F.col(classes).alias("classes"), F.col(bits).alias("label_vector"), F.lit(False).alias("is_synthetic"))
    now = settle(now, "rows")
    members: dict[str, list] = {}
    for r in groups.collect():
        members.setdefault(r["group"], []).append(r[0])
    for name in sorted(members):
        wanted = F.array(*[F.lit(m) for m in sorted(members[name])])
        inside = F.exists(F.arrays_zip(F.col("classes").alias("c"), F.col("label_vector").alias("b")),
                          lambda z: (z["b"] == 1) & F.array_contains(wanted, z["c"]))
        tagged = settle(now.withColumn("label", inside.cast("int")), "tagged")
        made = settle(VARIANTS[variant](tagged, seed=seed), "made")
        bits_of = tagged.select(F.col("row_id").alias("seed_id"), "classes", "label_vector")
        made = lookup_join(made, bits_of, ["seed_id"], "inner", row_bytes=1024)
        # New ids follow the largest one in use.
        top = now.agg(F.max("row_id").alias("m")).first()["m"] or 0
        fresh = draw_rank(made, [], ["seed_id", "copy"], seed).select(
            (F.col("rank") + F.lit(top)).alias("row_id"), "vec", "classes", "label_vector", F.lit(True).alias("is_synthetic"))
        now = settle(now.unionByName(fresh), "rows")
    return now


def diversity(rows: DataFrame, vector: str = "vec", label: str = "label") -> DataFrame:
    """(diversity_score): silhouette of the classes after projection to two components, for squared distances."""
    flat = settle(project(rows, vector, 2), "flat")
    return silhouette_squared(flat, "projected", label).withColumnRenamed("silhouette", "diversity_score")


def balance_variants(rows: DataFrame, variants: list[str], row_id: str = "row_id", vector: str = "vec",
                     label: str = "label", seed: int = 42) -> DataFrame:
    """One row per variant: rows, synthetic rows, balance_improvement, synthetic_quality and diversity_score of its table."""
    points = _points(rows, row_id, vector, label)
    parts = []
    for variant in variants:
        table = settle(balance(points, variant, label=label, seed=seed), "balanced")
        made = table.where("is_synthetic").withColumnRenamed("row_id", "seed_id")
        part = table.agg(F.lit(variant).alias("variant"), F.count("*").alias("n_rows"), F.count_if("is_synthetic").alias("n_synthetic"))
        part = part.withColumn("balance_improvement", balance_improvement(points, table, label).select("balance_improvement").scalar())
        part = part.withColumn("synthetic_quality", synthetic_quality(points, made).scalar())
        parts.append(part.withColumn("diversity_score", diversity(table, label=label).scalar()))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def synthetic_quality(originals: DataFrame, synthetic: DataFrame, vector: str = "vec") -> DataFrame:
    """1 / (1 + mean distance from a synthetic row to its nearest original)."""
    made = settle(draw_rank(synthetic, [], ["seed_id", "copy"]).select(F.col("rank").alias("row_id"), vector), "made")
    near = nearest(made, originals, 1, skip_self=False, vector=vector)
    return near.agg((F.lit(1.0) / (F.lit(1.0) + F.avg("distance"))).alias("synthetic_quality"))
