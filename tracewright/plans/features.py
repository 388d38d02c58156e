"""Compact records to embeddings and label vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import md5_prefix
from tracewright.operators import counts as ct
from tracewright.operators import embedding as em


def feature_table(records: DataFrame, vocab: DataFrame, width: int, embedding_type: str,
                  combined: bool = False) -> DataFrame:
    """row_id, embedding, labels, classes, label_vector for each record.

    Class lists are per log type, or over all types when ``combined``.
    """
    rows = em.tokenize(records.withColumn("row_id", md5_prefix(F.concat_ws(":", "rel_path", "line_no"), 32)))
    pooled = em.mean_pool(rows, vocab, width)
    lists = ct.class_list(records) if combined else ct.class_lists_by(records)
    labelled = ct.attach_label_vectors(pooled, lists, None if combined else "log_type")
    return labelled.select("row_id", "log_type", F.lit(embedding_type).alias("embedding_type"), "embedding", "labels",
                           "classes", "label_vector")


def realign(tables: dict[str, DataFrame]) -> DataFrame:
    """Stack feature tables and rebuild label vectors on the classes of all of them."""
    stacked = em.union_embeddings(tables).drop("classes", "label_vector")
    return ct.attach_label_vectors(stacked, ct.class_list(stacked), None)
