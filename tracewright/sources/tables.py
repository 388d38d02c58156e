"""Parquet tables of compact records, features and labels; manifests and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.numbers import size_class

FEATURE_KEYS = ["embedding_type", "log_type"]


def write_compact(records: DataFrame, path: str) -> None:
    """One partition per log type; rewriting a type replaces only that type."""
    (records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("log_type").parquet(path))


def read_compact(spark: SparkSession, path: str, log_type: str | None = None,
                 skip_corrupt: bool = False) -> DataFrame:
    """Compact records, optionally of one type (partition pruning); an unknown type is an error."""
    rows = spark.read.option("ignoreCorruptFiles", skip_corrupt).parquet(path)
    rows = rows.withColumn("log_type", F.col("log_type").cast("string"))
    if log_type is not None:
        rows = rows.where(F.col("log_type") == log_type)
        if not rows.take(1):
            raise FileNotFoundError(f"no records of type {log_type} in {path}")
    return rows


def write_features(rows: DataFrame, path: str) -> None:
    """row_id, embedding, label_vector by embedding type and log type."""
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*FEATURE_KEYS).parquet(path))


def read_features(spark: SparkSession, path: str, embedding_type: str | None = None,
                  log_type: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    for key, wanted in zip(FEATURE_KEYS, [embedding_type, log_type]):
        rows = rows.withColumn(key, F.col(key).cast("string"))
        if wanted is not None:
            rows = rows.where(F.col(key) == wanted)
    return rows


def available_pairs(features: DataFrame, labels: DataFrame) -> DataFrame:
    """(log_type, embedding_type) pairs present on both sides."""
    return (features.select("log_type", "embedding_type").distinct()
            .join(labels.select("log_type", "embedding_type").distinct(),
                  ["log_type", "embedding_type"], "left_semi"))


def class_index(class_lists: DataFrame, key: str = "log_type") -> DataFrame:
    """(key, idx, class) from one sorted class list per key."""
    return class_lists.select(key, F.posexplode("classes").alias("idx", "class"))


def missing_outputs(work: DataFrame, manifest: DataFrame, required: list[str]) -> DataFrame:
    """Work items that do not yet have every required artefact."""
    done = (manifest.where(F.col("artefact").isin(required)).groupBy("log_type")
            .agg(F.count_distinct("artefact").alias("n")).where(F.col("n") == len(required)))
    return work.join(done, "log_type", "left_anti")


def estimate_sizes(files: DataFrame, key: str = "log_type", bytes_per_row: int = 100) -> DataFrame:
    """Row estimate and size class per key from file lengths."""
    rows = F.floor(F.sum("bytes") / bytes_per_row)
    return files.groupBy(key).agg(rows.alias("estimated_rows")).withColumn(
        "size_class", size_class(F.col("estimated_rows")))


def count_sizes(rows: DataFrame, key: str = "log_type") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n_rows")).withColumn(
        "size_class", size_class(F.col("n_rows")))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    flat = [f.name for f in rows.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    rows.select(flat).write.mode("overwrite").option("header", True).csv(path)


def write_report(lines: DataFrame, path: str) -> None:
    """Ordered (line_no, text) rows as text files whose name order is line order."""
    lines.repartitionByRange("line_no").sortWithinPartitions("line_no").select("text").write.mode(
        "overwrite").text(path)
