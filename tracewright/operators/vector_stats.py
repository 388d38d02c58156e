"""Statistics over vector columns, each in one aggregate without exploding dimensions."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import vectors as vc
from tracewright.operators.ranking import exact_quantile


def width_of(rows: DataFrame, vector: str) -> int:
    first = rows.where(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).first()
    return first["n"] if first else 0


# Up to this width one generated aggregate column per dimension is fastest; beyond it the generated code gets
# too large and a single vector aggregate is.
WIDE = 64


def mean_agg(vector: str, width: int) -> Column:
    """Mean vector as an aggregate: partial aggregation per task, no explode.

    At every width, entries that are null or beyond the end of a short vector
    don't count, entries beyond ``width`` are left out, and a dimension without
    any entry is null.
    """
    if width > WIDE:
        entries = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.get(F.col(vector), i).cast("double"))
        values = F.transform(entries, lambda x: F.coalesce(x, F.lit(0.0)))
        there = F.transform(entries, lambda x: x.isNotNull().cast("double"))
        means = [vector_to_array(Summarizer.mean(array_to_vector(v))) for v in (values, there)]
        return F.zip_with(*means, lambda s, n: s / F.nullif(n, F.lit(0.0)))
    return F.array(*[F.avg(F.get(F.col(vector), F.lit(i)).cast("double")) for i in range(width)])


def mean_vector(rows: DataFrame, vector: str, keys: list[str], width: int, name: str = "mean") -> DataFrame:
    return rows.groupBy(*keys).agg(mean_agg(vector, width).alias(name))


def dimension_stats(rows: DataFrame, vector: str) -> DataFrame:
    """One row: mean and population deviation per dimension."""
    summary = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(vc.as_doubles(F.col(vector))))
    n = F.col("s.count").cast("double")
    # The summary gives the sample variance.
    dev = F.transform(vector_to_array("s.variance"), lambda v: F.sqrt(v * (n - 1) / n))
    return rows.agg(summary.alias("s")).select(vector_to_array("s.mean").alias("mean"), dev.alias("dev"))


def matrix_stats(rows: DataFrame, vector: str, width: int) -> DataFrame:
    """Rows, width, min, max, mean and population deviation over all entries.

    Row sums and sums of squares are folded inside each row first.
    """
    v = vc.as_doubles(F.col(vector))
    zero = F.lit(0.0)
    folded = rows.select(
        F.size(vector).alias("w"), F.array_min(v).alias("lo"), F.array_max(v).alias("hi"),
        F.aggregate(v, zero, lambda a, x: a + x).alias("s"),
        F.aggregate(v, zero, lambda a, x: a + x * x).alias("q"))
    n = F.sum("w")
    mean = F.sum("s") / n
    return folded.agg(F.count("*").alias("n_rows"), F.max("w").alias("width"), F.min("lo").alias("min"),
                      F.max("hi").alias("max"), mean.alias("mean"),
                      F.sqrt(F.greatest(F.sum("q") / n - mean * mean, F.lit(0.0))).alias("std"))


def standardize(rows: DataFrame, vector: str, out: str = "scaled") -> DataFrame:
    """Zero mean, unit population deviation; constant dimensions are only centred.

    The 2 x width statistics come in as a scalar subquery.
    """
    stats = dimension_stats(rows, vector).select(F.struct("mean", "dev").alias("s"))
    scale = F.transform(F.col("stats_.dev"), lambda d: F.when(d > 0, d).otherwise(1.0))
    centred = F.zip_with(vc.as_doubles(F.col(vector)), F.col("stats_.mean"), lambda x, m: x - m)
    return (rows.withColumn("stats_", stats.scalar())
            .withColumn(out, F.zip_with(centred, scale, lambda x, d: x / d)).drop("stats_"))


def cluster_centroids(rows: DataFrame, cluster: str, vector: str, width: int) -> DataFrame:
    return rows.groupBy(cluster).agg(F.count("*").alias("n_rows"),
                                     mean_agg(vector, width).alias("centroid"))


def project(rows: DataFrame, vector: str, k: int = 2, out: str = "projected") -> DataFrame:
    """First k principal components."""
    prepared = rows.withColumn("v_", array_to_vector(vc.as_doubles(F.col(vector))))
    model = PCA(k=k, inputCol="v_", outputCol="p_").fit(prepared)
    return model.transform(prepared).withColumn(out, vector_to_array("p_")).drop("v_", "p_")


def reconstruction_scores(rows: DataFrame, vector: str, k: int, out: str = "score") -> DataFrame:
    """Mean squared error after projecting to k components and back.

    The basis (width x k numbers) is a literal, so scoring is one projection
    without a shuffle.
    """
    width = width_of(rows, vector)
    centred = (rows.withColumn("mean_", dimension_stats(rows, vector).select("mean").scalar())
               .withColumn("c_", F.zip_with(vc.as_doubles(F.col(vector)), F.col("mean_"), lambda x, m: x - m)))
    prepared = centred.withColumn("v_", array_to_vector("c_"))
    model = PCA(k=k, inputCol="v_", outputCol="p_").fit(prepared)
    basis = model.pc.toArray()
    columns = [F.array(*[F.lit(float(x)) for x in basis[:, j]]) for j in range(k)]
    # The basis is orthonormal: lost energy is the squared length minus that of the projection.
    kept = sum((vc.dot(F.col("c_"), c) * vc.dot(F.col("c_"), c) for c in columns), F.lit(0.0))
    lost = F.greatest(vc.dot(F.col("c_"), F.col("c_")) - kept, F.lit(0.0))
    return centred.withColumn(out, lost / F.lit(float(width))).drop("mean_", "c_")


def score_threshold(rows: DataFrame, score: str, share: float) -> DataFrame:
    return exact_quantile(rows, score, share).select(F.col("quantile").alias("threshold"))


def flag_anomalies(rows: DataFrame, score: str, threshold: float = 0.5) -> DataFrame:
    return rows.withColumn("is_anomaly", (F.col(score) > threshold).cast("int"))


def flag_above_share(rows: DataFrame, score: str, share: float) -> DataFrame:
    cut = score_threshold(rows, score, share).scalar()
    return rows.withColumn("threshold", cut).withColumn(
        "is_anomaly", (F.col(score) > F.col("threshold")).cast("int"))
