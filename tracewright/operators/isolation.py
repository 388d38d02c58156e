"""Isolation forest: rows that random cuts set apart early are outliers.

A tree is grown on 256 rows by definition, so the forest is fitted on a bounded
number of rows drawn by digest, and is small. It travels to every task as flat
arrays; rows are scored where they lie, a level of all trees at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions import vectors as vc
from tracewright.functions.numbers import draw_key
from tracewright.operators.pooling import matrix_of
from tracewright.operators.ranking import exact_quantile
from tracewright.operators.vector_stats import width_of

TREES = 100
ROWS = 256
# Numbers of the drawn rows that may reach the driver.
MOST_NUMBERS = 8 << 20
CHUNK = 2048
EULER = 0.5772156649015329


def mean_depth(n):
    """Mean depth of an unsuccessful search among ``n`` keys of a binary tree: what a leaf of n rows stands for."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        many = 2.0 * (np.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n
    return np.where(n > 2, many, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Flat arrays over the nodes of all trees; a leaf points to itself. ``depth`` is that of a leaf with its mean depth."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: np.ndarray
    levels: int
    rows: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the larger the more of an outlier."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        every = np.arange(len(x))[:, None]
        for _ in range(self.levels):
            at = np.where(x[every, self.feature[at]] < self.cut[at], self.left[at], self.right[at])
        return 2.0 ** (-self.depth[at].mean(axis=1) / max(float(mean_depth(self.rows)), 1e-12))


def grow(sample: np.ndarray, trees: int, rows: int, seed: int) -> Forest:
    """Trees over at most ``rows`` different rows of the sample each; cuts are even over the range of a feature that isn't constant."""
    rows = min(rows, len(sample))
    levels = int(np.ceil(np.log2(max(rows, 2))))
    feature, cut, left, right, depth, roots = [], [], [], [], [], []
    rng = np.random.default_rng(seed)

    def node(x: np.ndarray, level: int) -> int:
        me = len(feature)
        for held in (feature, left, right):
            held.append(0)
        cut.append(0.0)
        depth.append(0.0)
        low, high = x.min(axis=0), x.max(axis=0)
        uneven = np.flatnonzero(high > low)
        if level == levels or len(x) < 2 or not len(uneven):
            left[me] = right[me] = me
            depth[me] = level + float(mean_depth(len(x)))
            return me
        feature[me] = int(rng.choice(uneven))
        cut[me] = rng.uniform(low[feature[me]], high[feature[me]])
        goes = x[:, feature[me]] < cut[me]
        if not goes.any():  # the drawn cut is the minimum itself
            cut[me] = np.nextafter(low[feature[me]], high[feature[me]])
            goes = x[:, feature[me]] < cut[me]
        left[me] = node(x[goes], level + 1)
        right[me] = node(x[~goes], level + 1)
        return me

    for _ in range(trees):
        roots.append(node(sample[rng.choice(len(sample), rows, replace=False)], 0))
    return Forest(np.array(roots), *[np.array(a) for a in (feature, cut, left, right, depth)], levels, rows)


def drawn_rows(rows: DataFrame, vector: str, most: int, row_id: str, seed: int) -> DataFrame:
    """(vec) of ``most`` rows by the smallest digest of their id; rows without a vector, or with a null entry, aren't drawn."""
    whole = rows.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    return whole.select(draw_key(seed, F.col(row_id)).alias("key"), vc.as_doubles(F.col(vector)).alias("vec")).orderBy("key", "vec").limit(most).select("vec")


def fit(rows: DataFrame, vector: str, trees: int = TREES, tree_rows: int = ROWS, row_id: str = "row_id", seed: int = 42) -> Forest | None:
    """A forest on ``trees`` draws of ``tree_rows`` rows from a sample of as many rows as all trees take together, or as
    MOST_NUMBERS allows; None without rows."""
    width = width_of(rows, vector)
    most = min(trees * tree_rows, max(tree_rows, MOST_NUMBERS // max(width, 1)))
    sample = [r["vec"] for r in drawn_rows(rows, vector, most, row_id, seed).collect()]
    return grow(np.array(sample), trees, tree_rows, seed) if sample else None


def score(rows: DataFrame, vector: str, forest: Forest | None, out: str = "outlier_score") -> DataFrame:
    """Add the outlier score; null for rows without a vector, with a null entry, or without a forest."""
    rows = rows.drop(out)
    if forest is None:
        return rows.withColumn(out, F.lit(None).cast("double"))
    shared = rows.sparkSession.sparkContext.broadcast(forest)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())])
    place, width = rows.columns.index(vector), width_of(rows, vector)

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for a in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(a, CHUNK)
                x, there = matrix_of(batch.column(place), width)
                gone = np.zeros(len(x), bool) if there is None else ~there.all(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(x), pa.float64(), mask=gone)], [*batch.schema.names, out])

    return rows.mapInArrow(run, schema)


def flag_outliers(scored: DataFrame, share: float = 0.1, score: str = "outlier_score", out: str = "is_outlier") -> DataFrame:
    """Flag rows whose inlier score (the negated outlier score) lies below its exact ``share`` quantile."""
    cut = exact_quantile(scored.select((-F.col(score)).alias("inlier")).where(F.col("inlier").isNotNull()), "inlier", share).select("quantile").scalar()
    return scored.withColumn(out, F.coalesce(-F.col(score) < cut, F.lit(False)))
