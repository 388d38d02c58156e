"""Validation of compact records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

CHECKS = ["bad_log", "bad_labels", "bad_type"]


def record_checks(records: DataFrame, log: str = "log", labels: str = "labels", log_type: str = "log_type") -> DataFrame:
    """0/1 columns per rule: text present, labels a JSON list, type present."""
    parsed = F.try_parse_json(labels)
    is_list = F.coalesce(F.schema_of_variant(parsed).startswith("ARRAY"), F.lit(False))
    return (records
            .withColumn("bad_log", (F.coalesce(F.length(log), F.lit(0)) == 0).cast("int"))
            .withColumn("bad_labels", (~is_list).cast("int"))
            .withColumn("bad_type", (F.coalesce(F.length(log_type), F.lit(0)) == 0).cast("int")))


def validate_files(records: DataFrame, file: str = "file", head: int | None = None, order: str = "line_no",
                   **columns) -> DataFrame:
    """(file, n_records, failures per rule, valid); ``head`` checks only the first records of each file."""
    if head:
        ranked = W.partitionBy(file).orderBy(order)
        records = records.withColumn("n_", F.row_number().over(ranked)).where(F.col("n_") <= head).drop("n_")
    checked = record_checks(records, **columns)
    sums = checked.groupBy(file).agg(F.count("*").alias("n_records"), *[F.sum(c).alias(c) for c in CHECKS])
    return sums.withColumn("valid", sum((F.col(c) for c in CHECKS), F.lit(0)) == 0)


def add_empty_files(report: DataFrame, files: DataFrame, file: str = "file") -> DataFrame:
    """Files without any record fail."""
    empty = files.select(file).join(report, file, "left_anti")
    zero = [F.lit(0).cast("bigint").alias(c) for c in ["n_records", *CHECKS]]
    return report.unionByName(empty.select(file, *zero, F.lit(False).alias("valid")))


def validate_dataset(report: DataFrame) -> DataFrame:
    """True when there is at least one file and all files are valid."""
    return report.agg(F.count("*").alias("n_files"), F.coalesce(F.bool_and("valid"), F.lit(False)).alias("valid"))
