"""Pseudo-labels by clustering, and measures of cluster quality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import vectors as vc
from tracewright.functions.numbers import draw_key, draw_unit
from tracewright.operators import blocks as bk
from tracewright.operators import shared_scan as ss
from tracewright.operators.blocks import pairwise_squared, stack
from tracewright.operators.components import connected_components
from tracewright.operators.joining import lookup_join
from tracewright.operators.linkage import ward_clusters
from tracewright.operators.neighbors import nearest_label
from tracewright.operators.ranking import running_totals
from tracewright.operators.vector_stats import (
    cluster_centroids, mean_agg, mean_vector, standardize, width_of)
from tracewright.session import settle


def _features(rows: DataFrame, vector: str) -> DataFrame:
    return rows.withColumn("features_", array_to_vector(vc.as_doubles(F.col(vector))))


def kmeans(rows: DataFrame, vector: str, k: int, out: str = "cluster", seed: int = 42, starts: int = 1,
           row_id: str = "row_id") -> DataFrame:
    """K-means ids; the best of ``starts`` seeds by training cost, all of them trained in the same passes.

    Rows without a vector get null, null entries count as 0.
    """
    models = ss.fit(ss.prepared(rows, vector, row_id), [k], starts, seed).models
    if not models:
        return rows.withColumn(out, F.lit(None).cast("int"))
    return ss.assign(rows, vector, {out: models[0]})


def bisecting(rows: DataFrame, vector: str, k: int, out: str = "cluster", seed: int = 42) -> DataFrame:
    """Hierarchical clusters by repeated splitting.

    Splits start from a nudge relative to the centre, so centred data is moved
    away from the origin first; distances stay the same.
    """
    data = rows.withColumn("features_", array_to_vector(F.transform(vc.as_doubles(F.col(vector)), lambda x: x + 10.0)))
    model = BisectingKMeans(k=k, seed=seed, featuresCol="features_", predictionCol=out).fit(data)
    return model.transform(data).drop("features_")


def pseudo_labels(rows: DataFrame, vector: str, k: int | None = None, out: str = "cluster",
                  row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """K-means on standardized vectors; without ``k`` the number with the best (squared) silhouette is used."""
    scaled = settle(standardize(rows, vector, out="scaled_"), "scaled")
    if k:
        return kmeans(scaled, "scaled_", k, out, seed, row_id=row_id).drop("scaled_")
    found = k_search(scaled, "scaled_", row_id=row_id, seed=seed)
    if not found:
        return kmeans(scaled, "scaled_", 2, out, seed, row_id=row_id).drop("scaled_")
    best = max(found, key=lambda pair: (pair[1], -pair[0].k))[0]
    return ss.assign(scaled, "scaled_", {out: best}).drop("scaled_")


def k_search(rows: DataFrame, vector: str, max_k: int = 20, row_id: str = "row_id", seed: int = 42) -> list[tuple[ss.Model, float]]:
    """Models for k = 2 .. min(max_k, n / 10) with their silhouettes of squared distances.

    The number of passes over the rows doesn't depend on ``max_k``.
    """
    points = ss.prepared(rows, vector, row_id)
    ks = list(range(2, min(max_k, points.count() // 10) + 1))
    models = ss.fit(points, ks, seed=seed).models if ks else []
    return list(zip(models, ss.silhouettes(points, models))) if models else []


def silhouette_by_k(rows: DataFrame, vector: str, max_k: int = 20, row_id: str = "row_id",
                    seed: int = 42, exact: bool = False) -> DataFrame:
    """(k, silhouette) for k = 2 .. min(max_k, n / 10).

    The silhouette is that of squared distances, linear in the rows. ``exact``
    takes plain distances: all k then share one pass over all pairs of rows.
    """
    found = k_search(rows, vector, max_k, row_id, seed)
    if not exact or not found:
        return rows.sparkSession.createDataFrame([(m.k, s) for m, s in found], "k int, silhouette double")
    labelled = settle(ss.assign(rows.where(F.col(vector).isNotNull()).select(row_id, vector), vector, {f"k{m.k}": m for m, _ in found}), "labelled")
    return silhouettes(labelled, vector, [f"k{m.k}" for m, _ in found], row_id).select(
        F.substring("labels", 2, 3).cast("int").alias("k"), "silhouette")


def best_k(rows: DataFrame, vector: str, max_k: int = 20, row_id: str = "row_id", seed: int = 42,
           exact: bool = False) -> int:
    best = silhouette_by_k(rows, vector, max_k, row_id, seed, exact).orderBy(F.desc("silhouette"), "k").first()
    return best["k"] if best else 2


def level_clusters(rows: DataFrame, vector: str, nodes_in_next_level: int, method: str = "kmeans",
                   out: str = "cluster", seed: int = 42) -> DataFrame:
    """Clusters for one taxonomy level on standardized vectors: kmeans, agglomerative (Ward) or bisecting."""
    k = nodes_in_next_level or min(8, max(2, rows.count() // 100))
    scaled = settle(standardize(rows, vector, out="scaled_"), "scaled")
    if method == "kmeans":
        return kmeans(scaled, "scaled_", k, out, seed, starts=10).drop("scaled_")
    if method == "agglomerative":
        return ward_clusters(scaled, "scaled_", k, out).drop("scaled_")
    return bisecting(scaled, "scaled_", k, out, seed).drop("scaled_")


def level_pseudo_labels(rows: DataFrame, vector: str, levels: int = 3, seed: int = 42) -> DataFrame:
    """One cluster column per level, with fewer clusters further down."""
    n = rows.count()
    for level in range(levels):
        k = min(8, max(2, n // (10 * (level + 1))))
        rows = kmeans(rows, vector, k, f"level_{level}", seed)
    return rows


def cluster_summary(rows: DataFrame, cluster: str, vector: str) -> DataFrame:
    return cluster_centroids(rows, cluster, vector, width_of(rows, vector))


def distance_to_centroid(rows: DataFrame, cluster: str, vector: str, out: str = "outlier_score") -> DataFrame:
    """Distance of each row to the mean of its cluster; centroids are one row per cluster."""
    centroids = mean_vector(rows, vector, [cluster], width_of(rows, vector), "centroid_")
    joined = lookup_join(rows, centroids, [cluster], "inner", row_bytes=8 * 1024)
    return joined.withColumn(out, vc.distance(F.col(vector), F.col("centroid_"))).drop("centroid_")


# -- density clustering ------------------------------------------------------------------

# Rows, on average, that every row meets before others: they settle most rows where the data is dense.
SAMPLE_ROWS = 8192


def _count_within(eps: float):
    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        near = pairwise_squared(stack(x["vec"]), stack(y["vec"])) <= eps * eps * (1 + 1e-12)
        copies = y["copies"].to_numpy()
        return pd.DataFrame({"id": x["id"].to_numpy(), "n": near @ copies if (copies != 1).any() else np.count_nonzero(near, axis=1)})
    return run


def _links_within(eps: float):
    """Star edges that connect what the block connects: at most one edge per row, not one per pair."""
    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        near = pairwise_squared(stack(x["vec"]), stack(y["vec"])) <= eps * eps * (1 + 1e-12)
        big = np.iinfo(np.int64).max
        xid, yid = x["id"].to_numpy(), y["id"].to_numpy()
        if np.count_nonzero(near) <= near.size // 16:
            i, j = np.nonzero(near)
            return _stars(pd.DataFrame({"a": xid[i], "b": yid[j]}))
        lx = xid.copy()
        while True:
            ly = np.minimum(np.where(near, lx[:, None], big).min(0), yid)
            new = np.minimum(np.where(near, ly[None, :], big).min(1), lx)
            if (new == lx).all():
                break
            lx = new
        edges = pd.DataFrame({"a": np.concatenate([xid, yid]), "b": np.concatenate([lx, ly])})
        return edges[edges["a"] != edges["b"]]
    return run


def _stars(edges: pd.DataFrame) -> pd.DataFrame:
    """One edge per row, to the smallest id it is connected with."""
    ids, at = np.unique(np.concatenate([edges["a"], edges["b"]]).astype(np.int64), return_inverse=True)
    a, b = at[:len(edges)], at[len(edges):]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = pd.DataFrame({"a": ids, "b": ids[label]})
    return out[out["a"] != out["b"]]


def _smallest_within(eps: float):
    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        near = pairwise_squared(stack(x["vec"]), stack(y["vec"])) <= eps * eps * (1 + 1e-12)
        low = np.where(near, y["component"].to_numpy()[None, :], np.iinfo(np.int64).max).min(1)
        hit = near.any(1)
        return pd.DataFrame({"id": x["id"].to_numpy()[hit], "component": low[hit]})
    return run


def _for_few(layout: dict, left: DataFrame, sampled: bool) -> dict:
    """The layout without cells where the left side has few rows, as each of their cells would be sent most right rows."""
    return layout | {"pivots": None} if sampled and left.count() <= bk.WIDE * layout["block_rows"] else layout


def _all_links(core: DataFrame, few: Column, eps: float, layout: dict) -> DataFrame:
    """Links (a, b) that connect what all pairs of core rows in reach connect: those with a sample, and all with a row outside the largest part this makes."""
    first = settle(bk._against_all(core, core.where(few).toPandas(), _links_within(eps), "a bigint, b bigint", layout["block_rows"]).distinct(), "links")
    parts = settle(connected_components(first), "parts")
    largest = parts.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").first()
    if not largest:
        return bk.pair_blocks(core, core, _links_within(eps), "a bigint, b bigint", fold=_stars, **layout)
    outside = settle(core.join(parts.where(F.col("component") == largest["component"]), "id", "left_anti").select("grp", "id", "vec"), "outside")
    return first.unionByName(bk.pair_blocks(outside, core, _links_within(eps), "a bigint, b bigint", fold=_stars, **_for_few(layout, outside, True)))


def dbscan(rows: DataFrame, vector: str, eps: float = 0.5, min_samples: int = 5, row_id: str = "row_id",
           out: str = "cluster", fill_noise: bool = True, block_rows: int = bk.BLOCK_ROWS,
           local_bytes: int = bk.LOCAL_BYTES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Density clusters numbered 0.. by their first core row; noise is -1.

    A row with ``min_samples`` rows within ``eps`` (itself included) is a core
    row; core rows within ``eps`` share a cluster; another row joins the
    lowest-numbered cluster with a core row in reach. ``fill_noise`` gives the
    remaining rows the cluster of their nearest clustered row, if any.
    Exact copies are folded into one weighted row first.

    A sample of the rows is met by all others first. A row with enough of it in
    reach is a core row, whatever else lies there; and rows that it joins to the
    largest part of a cluster needn't be compared with each other. Only what it
    leaves open meets all rows, so dense data is not quadratic. The result is
    the same for any sample.
    """
    everything = rows.select(F.col(row_id).alias("id"), F.xxhash64(vc.as_doubles(F.col(vector))).alias("digest"),
                             vc.as_doubles(F.col(vector)).alias("vec"))
    points = settle(everything.groupBy("digest", "vec").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
                    .withColumn("grp", F.lit(0)), "points")
    n = points.count()
    pivots = bk.pick_pivots(points, n, block_rows) if n > 8 * block_rows else None
    layout = dict(reach=float(eps), pivots=pivots, block_rows=block_rows, local_bytes=local_bytes)
    plain = points.select("grp", "id", "vec")

    sampled = n > 4 * sample_rows
    few = draw_unit(draw_key(42, F.col("id"))) * n < sample_rows
    weighted, open_rows, sure = points.select("grp", "id", "vec", "copies"), plain, None
    if sampled:
        seen = bk._against_all(plain, weighted.where(few).toPandas(), _count_within(eps), "id bigint, n bigint", block_rows)
        sure = settle(seen.groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples).select("id"), "sure")
        open_rows = settle(plain.join(sure, "id", "left_anti").select("grp", "id", "vec"), "open")
    counted = bk.pair_blocks(open_rows, weighted, _count_within(eps), "id bigint, n bigint", **_for_few(layout, open_rows, sampled))
    core_ids = counted.groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples).select("id")
    core_ids = settle(core_ids if sure is None else core_ids.unionByName(sure), "core")
    core = settle(plain.join(core_ids, "id", "left_semi").select("grp", "id", "vec"), "core")
    links = _all_links(core, few, eps, layout) if sampled else bk.pair_blocks(core, core, _links_within(eps), "a bigint, b bigint", fold=_stars, **layout)
    comps = connected_components(settle(links, "links"))
    core_comp = settle(core.join(comps, "id", "left")
                       .select("grp", "id", "vec", F.coalesce("component", "id").alias("component")), "component")
    others = settle(plain.join(core_ids, "id", "left_anti").select("grp", "id", "vec"), "others")
    border = bk.pair_blocks(others, core_comp, _smallest_within(eps), "id bigint, component bigint", **_for_few(layout, others, sampled))
    border = border.groupBy("id").agg(F.min("component").alias("component"))
    found = settle(core_comp.select("id", "component").unionByName(border), "found")

    order = found.select("component").distinct().select(
        "component", (-F.col("component")).alias("order"), F.lit(1).alias("one"))
    numbers = running_totals(settle(order, "order"), [], "order", ["one"]).select(
        "component", (F.col("cum_one") - 1).cast("int").alias(out))
    labelled = settle(plain.join(found.join(numbers, "component"), "id", "left").select("id", "vec", out), "labelled")
    clustered = labelled.where(F.col(out).isNotNull())
    noise = labelled.where(F.col(out).isNull())
    if fill_noise and clustered.take(1) and noise.take(1):
        filled = nearest_label(noise, clustered, out, row_id="id").withColumnRenamed("query_id", "id")
        labelled = clustered.unionByName(noise.drop(out).join(filled, "id").select("id", "vec", out))
    labelled = settle(labelled.select("id", "vec", F.coalesce(out, F.lit(-1)).alias(out)), "labelled")
    # Every copy gets the label of its vector.
    copies = lookup_join(everything.select("id", "vec"), labelled.select("vec", out), ["vec"], "inner", row_bytes=2048)
    return rows.join(copies.select(F.col("id").alias(row_id), out), row_id)


# -- quality -----------------------------------------------------------------------------

def _sums_per_cluster(sizes: list[int]):
    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        d = np.sqrt(pairwise_squared(stack(x["vec"]), stack(y["vec"])))
        # A row meets itself at distance zero, whatever the rounding.
        d[x["id"].to_numpy()[:, None] == y["id"].to_numpy()[None, :]] = 0.0
        member = stack(y["slots"]).astype(int)
        parts = []
        for j, k in enumerate(sizes):
            onehot = np.zeros((len(y), k))
            onehot[np.arange(len(y)), member[:, j]] = 1.0
            parts.append(d @ onehot)
        return pd.DataFrame({"id": x["id"].to_numpy(), "sums": list(np.hstack(parts))})
    return run


def silhouettes(rows: DataFrame, vector: str, labels: list[str], row_id: str = "row_id",
                block_rows: int = bk.BLOCK_ROWS, local_bytes: int = bk.LOCAL_BYTES) -> DataFrame:
    """(labels, silhouette): exact Euclidean silhouette of each label column; one cluster gives 0.

    All label columns share one pass over the distances. Tasks send on one sum
    per row and cluster, never the pairs.
    """
    counts = {}
    for name in labels:
        found = rows.groupBy(name).agg(F.count("*").alias("n")).collect()
        counts[name] = sorted((r[name], r["n"]) for r in found)
    usable = [c for c in labels if len(counts[c]) > 1]
    spark = rows.sparkSession
    trivial = spark.createDataFrame([(c, 0.0) for c in labels if c not in usable], "labels string, silhouette double")
    if not usable:
        return trivial
    slot = {c: F.array_position(F.array(*[F.lit(v) for v, _ in counts[c]]), F.col(c)).cast("int") - 1 for c in usable}
    points = settle(rows.select(
        F.lit(0).alias("grp"), F.col(row_id).cast("bigint").alias("id"), vc.as_doubles(F.col(vector)).alias("vec"),
        F.array(*[slot[c] for c in usable]).alias("slots")), "points")
    sizes = [len(counts[c]) for c in usable]
    parts = bk.pair_blocks(points.select("grp", "id", "vec"), points, _sums_per_cluster(sizes),
                           "id bigint, sums array<double>", block_rows=block_rows, local_bytes=local_bytes)
    total = sum(sizes)
    sums = parts.groupBy("id").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(total)]).alias("sums"))
    joined = sums.join(points.select("id", "slots"), "id")
    columns, start = [], 0
    for j, c in enumerate(usable):
        ns = F.array(*[F.lit(n) for _, n in counts[c]])
        columns.append(F.avg(_silhouette_of(F.slice("sums", start + 1, sizes[j]), F.col("slots")[j], ns)).alias(c))
        start += sizes[j]
    wide = joined.agg(*columns)
    pairs = F.array(*[F.struct(F.lit(c).alias("labels"), F.col(c).alias("silhouette")) for c in usable])
    return wide.select(F.inline(pairs)).unionByName(trivial)


def _silhouette_of(sums: Column, own: Column, sizes: Column) -> Column:
    mine = F.get(sizes, own)
    inside = F.get(sums, own) / F.greatest(mine - 1, F.lit(1))
    means = F.transform(sums, lambda s, i: F.when(i == own, None).otherwise(s / F.get(sizes, i)))
    outside = F.array_min(means)
    score = (outside - inside) / F.greatest(outside, inside)
    return F.when(mine == 1, F.lit(0.0)).otherwise(F.coalesce(score, F.lit(0.0)))


def silhouette(rows: DataFrame, vector: str, label: str, row_id: str = "row_id", **layout) -> DataFrame:
    return silhouettes(rows, vector, [label], row_id, **layout).select("silhouette")


def silhouette_squared(rows: DataFrame, vector: str, label: str) -> DataFrame:
    """Silhouette for squared Euclidean distance, in one pass without comparing rows.

    The mean squared distance to a cluster follows from its size, mean vector
    and mean squared length, so only those (one row per cluster) are needed.
    """
    width = width_of(rows, vector)
    v = vc.as_doubles(F.col(vector))
    data = rows.select(F.col(label).alias("c"), v.alias("v"), vc.dot(v, v).alias("q"))
    stats = data.groupBy("c").agg(F.count("*").alias("n"), mean_agg("v", width).alias("m"),
                                  F.avg("q").alias("mq"))
    table = stats.agg(F.collect_list(F.struct("c", "n", "m", "mq")).alias("t"))
    both = data.withColumn("t", table.scalar())

    def gap(s):
        return F.greatest(F.col("q") + s["mq"] - F.lit(2.0) * vc.dot(F.col("v"), s["m"]), F.lit(0.0))

    own = F.element_at(F.filter("t", lambda s: s["c"] == F.col("c")), 1)
    both = both.select(
        own["n"].alias("n"), (gap(own) * own["n"] / F.greatest(own["n"] - 1, F.lit(1))).alias("inside"),
        F.array_min(F.transform(F.filter("t", lambda s: s["c"] != F.col("c")), gap)).alias("outside"))
    score = (F.col("outside") - F.col("inside")) / F.greatest("outside", "inside")
    return both.agg(F.avg(F.when(F.col("n") == 1, 0.0).otherwise(F.coalesce(score, F.lit(0.0)))).alias("silhouette"))


def contingency(rows: DataFrame, truth: str, cluster: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("t"), F.col(cluster).alias("c")).agg(F.count("*").alias("n"))


def adjusted_rand(rows: DataFrame, truth: str, cluster: str) -> DataFrame:
    """Adjusted Rand index from the contingency counts; 0 when there is one true class."""
    cells = contingency(rows, truth, cluster)

    def pairs(n):
        return n * (n - F.lit(1)) / F.lit(2.0)
    per_t = cells.groupBy("t").agg(F.sum("n").alias("n")).agg(
        F.sum(pairs(F.col("n"))).alias("pt"), F.count("*").alias("kt"), F.sum("n").alias("total"))
    per_c = cells.groupBy("c").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("pc"), F.count("*").alias("kc"))
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("same"))
    both = (both.withColumn("t_", per_t.select(F.struct("*")).scalar())
            .withColumn("c_", per_c.select(F.struct("*")).scalar()))
    expected = F.col("t_.pt") * F.col("c_.pc") / pairs(F.col("t_.total"))
    highest = (F.col("t_.pt") + F.col("c_.pc")) / 2
    ari = (F.col("same") - expected) / F.nullif(highest - expected, F.lit(0.0))
    return both.select(F.when(F.col("t_.kt") <= 1, 0.0).otherwise(F.coalesce(ari, F.lit(1.0))).alias("ari"))


def mutual_information(rows: DataFrame, truth: str, cluster: str) -> DataFrame:
    """Normalized mutual information (arithmetic mean); 0 when there is one true class."""
    cells = contingency(rows, truth, cluster)
    total = cells.agg(F.sum("n").alias("n"))

    def side(key):
        p = F.col("n") / F.col("total")
        counts = cells.groupBy(key).agg(F.sum("n").alias("n")).withColumn("total", total.scalar())
        return counts.agg(-F.sum(p * F.log(p)))
    nt, ncl = cells.groupBy("t").agg(F.sum("n").alias("nt")), cells.groupBy("c").agg(F.sum("n").alias("nc"))
    joined = cells.join(nt, "t").join(ncl, "c").withColumn("total", total.scalar())
    p = F.col("n") / F.col("total")
    mi = joined.agg(F.sum(p * F.log(F.col("n") * F.col("total") / (F.col("nt") * F.col("nc")))).alias("mi"))
    both = mi.withColumn("ht", side("t").scalar()).withColumn("hc", side("c").scalar())
    mean = (F.col("ht") + F.col("hc")) / 2
    nmi = F.greatest(F.col("mi"), F.lit(0.0)) / F.nullif(mean, F.lit(0.0))
    return both.select(F.when(F.col("ht") <= 0, 0.0).otherwise(F.coalesce(nmi, F.lit(0.0))).alias("nmi"))
