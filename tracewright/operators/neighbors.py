"""Exact k-nearest-neighbour join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracewright.operators import blocks as bk
from tracewright.operators.blocks import pairwise_squared, stack
from tracewright.operators.joining import lookup_join
from tracewright.session import settle


def _points(rows: DataFrame, row_id: str, vector: str, by: str | None) -> DataFrame:
    grp = F.col(by) if by else F.lit(0)
    return rows.select(grp.alias("grp"), F.col(row_id).cast("bigint").alias("id"),
                       F.col(vector).cast("array<double>").alias("vec"))


def distinct_vectors(points: DataFrame, keep: int) -> DataFrame:
    """One row per (grp, vec) with its ``keep`` smallest ids and whether there are copies.

    A neighbour list of length ``keep`` can never use more ids of one vector,
    so however many copies exist, no more than that many are collected.
    """
    # The digest in front lets the sort settle on one number before it looks at the arrays.
    order = W.partitionBy("grp", "digest", "vec").orderBy("id")
    most = max(keep, 2)  # the second one tells that there are copies
    first = points.withColumn("digest", F.xxhash64("vec")).withColumn("n_", F.row_number().over(order)).where(F.col("n_") <= most)
    ids = first.groupBy("grp", "digest", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return ids.select("grp", F.element_at("ids", 1).alias("id"), "vec", F.slice("ids", 1, keep).alias("ids"),
                      (F.size("ids") > 1).alias("copies"))


# Columns whose minimum stands for them where a bound is looked for.
MINIMA = 64


def _reach_of_rows(d2: np.ndarray, k: int) -> np.ndarray:
    """For each row, a value that its ``k`` smallest entries don't exceed and few others stay below.

    Where a row is long, that is the k-th smallest of the minima of MINIMA columns each: k entries at least are no larger.
    """
    whole = d2.shape[1] // MINIMA
    if whole >= 4 * k:
        minima = d2[:, :whole * MINIMA].reshape(len(d2), MINIMA, whole).min(axis=1)
        d2 = np.concatenate([minima, d2[:, whole * MINIMA:]], axis=1)
    return np.partition(d2, k - 1, axis=1)[:, k - 1]


def _top_of_block(keep: int):
    held: list = [None, None, None]  # the right side last seen, its matrix and its squared norms

    def top(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if held[0] is not y:
            matrix = stack(y["vec"])
            held[:] = y, matrix, (matrix * matrix).sum(1)
        a, b, norms = stack(x["vec"]), held[1], held[2]
        first = y["id"].to_numpy()
        d2 = pairwise_squared(a, b, norms)
        edge = _reach_of_rows(d2, min(keep, len(b)))
        slack = 1e-9 * ((a * a).sum(1) + norms.max() + 1.0)
        r, c = np.nonzero(d2 <= (edge + slack)[:, None])
        gap = a[r] - b[c]
        dist = np.sqrt((gap * gap).sum(1))
        order = np.lexsort((first[c], dist, r))
        r, c, dist = r[order], c[order], dist[order]
        within = np.arange(len(r)) - np.searchsorted(r, r, side="left")
        r, c, dist = (v[within < keep] for v in (r, c, dist))
        members = y["ids"].to_numpy()
        sizes = np.array([len(members[j]) for j in c])
        r, dist = np.repeat(r, sizes), np.repeat(dist, sizes)
        ids = np.concatenate([np.asarray(members[j]) for j in c])
        order = np.lexsort((ids, dist, r))
        r, dist, ids = r[order], dist[order], ids[order]
        inside = np.arange(len(r)) - np.searchsorted(r, r, side="left") < keep
        r, dist, ids = r[inside], dist[inside], ids[inside]
        starts = np.searchsorted(r, np.arange(len(a) + 1))
        return pd.DataFrame({
            "grp": x["grp"].to_numpy(), "id": x["id"].to_numpy(),
            "dists": [dist[s:e] for s, e in zip(starts[:-1], starts[1:])],
            "ids": [ids[s:e] for s, e in zip(starts[:-1], starts[1:])]})
    return top


def _reach_of_cells(right: DataFrame, pivots: np.ndarray, keep: int):
    """Upper bound on the distance of the ``keep``-th neighbour for any left row of a cell."""
    order = W.partitionBy("grp", "cell").orderBy("own", "id")
    near = (bk.assign_cells(right.select("grp", "id", "vec"), pivots)
            .withColumn("n_", F.row_number().over(order)).where(F.col("n_") <= keep)
            .select("grp", "cell", "own").collect())
    by_group: dict = {}
    for row in near:
        by_group.setdefault(row["grp"], []).append((row["cell"], row["own"]))
    gaps = np.sqrt(pairwise_squared(pivots, pivots))

    def reach(radii: dict) -> dict:
        limits = {}
        for (grp, cell), (_, radius) in radii.items():
            bounds = sorted(radius + gaps[cell, j] + own for j, own in by_group.get(grp, []))
            limits[(grp, cell)] = bounds[keep - 1] if len(bounds) >= keep else float("inf")
        return limits

    return reach


def nearest(queries: DataFrame, base: DataFrame, k: int, row_id: str = "row_id", vector: str = "vec",
            by: str | None = None, skip_self: bool = True, block_rows: int = bk.BLOCK_ROWS,
            local_bytes: int = bk.LOCAL_BYTES) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the k nearest base rows by (distance, id).

    ``by`` restricts neighbours to rows with the same value. With ``skip_self``
    a row is never its own neighbour. Exact copies are handled as one vector.
    """
    keep = k + 1 if skip_self else k
    same = queries is base
    all_queries = _points(queries, row_id, vector, by)
    right = settle(distinct_vectors(_points(base, row_id, vector, by), keep), "base")
    n_right = right.count()
    pivots = bk.pick_pivots(right, n_right, block_rows) if n_right > 8 * block_rows else None
    if same:
        left = right.select("grp", "id", "vec", "copies")
    else:
        left = all_queries.groupBy("grp", "vec").agg(F.min("id").alias("id"), (F.count("*") > 1).alias("copies"))
        left = settle(left, "queries")
    reach = _reach_of_cells(right, pivots, keep) if pivots is not None and len(pivots) > 1 else float("inf")
    grp_type = right.schema["grp"].dataType.simpleString()
    schema = f"grp {grp_type}, id bigint, dists array<double>, ids array<bigint>"
    sent = right.drop("copies")
    parts = bk.pair_blocks(sent if same else left.select("grp", "id", "vec"), sent, _top_of_block(keep), schema, reach, pivots,
                           block_rows, local_bytes, twin=same)
    flat = parts.select("grp", "id", F.inline(F.arrays_zip(F.col("dists").alias("distance"),
                                                           F.col("ids").alias("neighbor_id"))))
    order = W.partitionBy("grp", "id").orderBy("distance", "neighbor_id")
    best = flat.withColumn("n_", F.row_number().over(order)).where(F.col("n_") <= keep)
    lists = best.groupBy("grp", "id").agg(
        F.sort_array(F.collect_list(F.struct("distance", "neighbor_id"))).alias("near"))
    lists = settle(lists.join(left, ["grp", "id"]), "near")
    single = lists.where(~F.col("copies")).select(F.col("id").alias("query_id"), "near")
    repeated = lists.where("copies").select("grp", "vec", "near")
    if repeated.take(1):
        copies = lookup_join(all_queries, repeated, ["grp", "vec"], "inner", row_bytes=8 * 1024)
        single = single.unionByName(copies.select(F.col("id").alias("query_id"), "near"))
    if skip_self:
        single = single.withColumn("near", F.filter("near", lambda n: n["neighbor_id"] != F.col("query_id")))
    return (single.select("query_id", F.posexplode(F.slice("near", 1, k)).alias("pos", "n"))
            .select("query_id", (F.col("pos") + 1).alias("rank"), F.col("n.neighbor_id").alias("neighbor_id"),
                    F.col("n.distance").alias("distance")))


def nearest_label(points: DataFrame, labelled: DataFrame, label: str, row_id: str = "row_id",
                  vector: str = "vec") -> DataFrame:
    """(query_id, label) of the nearest labelled row."""
    near = nearest(points, labelled, 1, row_id, vector, skip_self=False)
    names = labelled.select(F.col(row_id).alias("neighbor_id"), label)
    return lookup_join(near, names, ["neighbor_id"], "inner", row_bytes=32).select("query_id", label)
