"""Raw logs and label files to the compact labelled table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import labels as lb
from tracewright.functions import text as tx
from tracewright.sources import logs as lg
from tracewright.sources.tables import write_compact


def compact_records(lines: DataFrame, labels: DataFrame, strict_types: bool = False) -> DataFrame:
    """Typed, compacted, labelled lines from (rel_path, line_no, value) and (rel_path, line_no, labels)."""
    if "log_type" not in lines.columns:
        lines = lines.withColumn("tenant", tx.tenant(F.col("rel_path"))).withColumn(
            "log_type", tx.log_type(F.col("rel_path"), strict_types))
    joined = lg.join_labels(lines, labels)
    return joined.select(
        "tenant", "rel_path", "line_no", tx.timestamp_text(F.col("value")).alias("log_ts_text"),
        tx.message_text(F.col("value")).alias("message"), lb.clean_labels(F.col("labels")).alias("labels"), "log_type")


def labelled_logs(spark: SparkSession, logs_root: str, labels_root: str, by_name: bool = False,
                  strict_types: bool = False, probe_text: bool = True) -> DataFrame:
    """Compact records of a log tree and its label tree.

    Labels are matched on the relative path; ``by_name`` matches on file names
    across folders instead. Files that do not look like text are left out.
    """
    raw = lg.scan_lines(spark, logs_root)
    blocks = lg.block_table(raw)
    lines = lg.number_lines(raw, logs_root, strict_types, blocks).where(~tx.is_blank(F.col("value")))
    lines = lines.where(~tx.is_hidden(F.col("rel_path")))
    if probe_text:
        lines = lines.join(lg.text_files(raw, logs_root, blocks=blocks), "rel_path", "left_semi")
    labels = lg.read_labels(spark, labels_root)
    if by_name:
        pairs = lg.match_label_files(lg.list_files(spark, logs_root), lg.list_files(spark, labels_root))
        labels = (labels.join(pairs, labels["rel_path"] == pairs["label_path"])
                  .select(pairs["log_path"].alias("rel_path"), "line_no", "labels"))
    return compact_records(lines, labels, strict_types)


def run(spark: SparkSession, logs_root: str, labels_root: str, out: str, **options) -> None:
    write_compact(labelled_logs(spark, logs_root, labels_root, **options), out)
