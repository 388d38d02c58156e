"""Report tables and ordered text lines (line_no, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracewright.functions.numbers import fixed
from tracewright.operators.counts import top_per_key

# Leading columns of the evaluation matrix and of the dashboard.
MATRIX_COLUMNS = ["embedding_type", "micro_f1", "macro_f1", "hamming_loss", "pseudo_label_micro_f1",
                  "micro_precision", "micro_recall", "jaccard_micro"]
DASHBOARD_COLUMNS = ["embedding_type", "micro_f1", "macro_f1", "hamming_loss", "pseudo_label_micro_f1"]


def evaluation_matrix(results: DataFrame) -> DataFrame:
    """Available metric columns plus rare-event F1 columns, best micro then macro F1 first."""
    rare = sorted(c for c in results.columns if c.startswith("rare_event_") and c.endswith("_f1"))
    keep = [c for c in MATRIX_COLUMNS if c in results.columns] + rare
    return results.select(*keep).orderBy(F.desc("micro_f1"), F.desc("macro_f1"), "embedding_type")


def _line(number: Column, text: Column) -> list[Column]:
    return [number.cast("bigint").alias("line_no"), text.alias("text")]


def numbered_text(rows: DataFrame, first: int, *order: Column) -> DataFrame:
    """Number (text) rows of a report; a report has one row per type or class."""
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order))
    return rows.withColumn("line_no", (place + (first - 1)).cast("bigint"))


def markdown_matrix(results: DataFrame, title: str) -> DataFrame:
    matrix = evaluation_matrix(results)
    names = matrix.columns
    cells = [F.col("embedding_type")] + [fixed(F.col(c), 4) for c in names[1:]]
    body = numbered_text(matrix.withColumn("text", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))), 5,
                         F.desc("micro_f1"), F.desc("macro_f1"), F.col("embedding_type"))
    head = [(1, f"# Evaluation Matrix for {title} Anomaly Detection"), (2, ""),
            (3, "| " + " | ".join(names) + " |"), (4, "|" + "|".join([" --- "] * len(names)) + "|")]
    top = results.sparkSession.createDataFrame(head, "line_no bigint, text string")
    return top.unionByName(body.select("line_no", "text"))


def dashboard(results: DataFrame) -> DataFrame:
    return results.select(*[c for c in DASHBOARD_COLUMNS if c in results.columns])


def top_class_f1(per_class: DataFrame, n: int = 5) -> DataFrame:
    """(embedding_type, class, f1, rank) of the n best classes per embedding type."""
    return top_per_key(per_class, "embedding_type", "f1", "class", n).select("embedding_type", "class", "f1", "rank")


# Report sections, their titles, and the metrics each lists.
REPORT_SECTIONS = [
    ("detection", "DETECTION PERFORMANCE:", [("accuracy", "Accuracy"), ("precision", "Precision"),
                                             ("recall", "Recall"), ("f1_score", "F1-Score"), ("auc_roc", "AUC-ROC")]),
    ("hierarchical", "HIERARCHICAL PERFORMANCE:", [("path_consistency", "Path Consistency"),
                                                   ("level_coverage", "Level Coverage")]),
    ("clustering", "CLUSTERING QUALITY:", [("silhouette_score", "Silhouette Score"),
                                           ("adjusted_rand_index", "Adjusted Rand Index")]),
    ("smote", "SMOTE OVERSAMPLING QUALITY:", [("balance_improvement", "Balance Improvement"),
                                              ("synthetic_quality", "Synthetic Quality"),
                                              ("diversity_score", "Diversity Score")]),
    ("cv", "CROSS-VALIDATION RESULTS:", [("cv_f1_score_mean", "F1-Score"), ("cv_auc_roc_mean", "AUC-ROC")]),
]


def evaluation_report(metrics: DataFrame, title: str, log_type: str | None = None, embedding_type: str | None = None) -> DataFrame:
    """Text lines from a long metric table (section, metric, value); sections without rows are left out.

    Accuracies of levels (level_<n>_accuracy) come before the other lines of
    their section, cross-validated means show their deviation, and section
    method_comparison lists metrics named <metric>|<method> by metric.
    """
    spark = metrics.sparkSession
    rows, number = [], 100
    for section, heading, items in REPORT_SECTIONS:
        rows.append((number, section, None, heading))
        for offset, (metric, name) in enumerate(items, start=51 if section == "hierarchical" else 1):
            rows.append((number + offset, section, metric, f"  {name}: "))
        number += 100
    frame = spark.createDataFrame(rows, "line_no bigint, section string, metric string, lead string")
    present = metrics.select("section").distinct()
    values = metrics.select("section", "metric", "value")
    spread = values.where(F.col("metric").endswith("_std")).select("section", F.regexp_replace("metric", "_std$", "_mean").alias("metric"), F.col("value").alias("deviation"))
    joined = frame.join(present, "section", "left_semi").join(values, ["section", "metric"], "left").join(spread, ["section", "metric"], "left")
    told = F.concat("lead", fixed(F.coalesce("value", F.lit(0.0)), 4), F.when(F.col("deviation").isNotNull(), F.concat(F.lit(" ± "), fixed(F.col("deviation"), 4))).otherwise(F.lit("")))
    body = joined.select("line_no", F.when(F.col("metric").isNull(), F.col("lead")).otherwise(told).alias("text"))
    level = F.regexp_extract("metric", r"^level_([0-9]{1,2})_accuracy$", 1)
    levels = values.where((F.col("section") == "hierarchical") & (level != "")).select(
        (level.cast("bigint") + [n for n, s, m, _ in rows if s == "hierarchical" and m is None][0] + 1).alias("line_no"),
        F.concat(F.lit("  Level "), level, F.lit(" Accuracy: "), fixed(F.col("value"), 4)).alias("text"))
    return _report_ends(spark, title, log_type, embedding_type).unionByName(body).unionByName(levels).unionByName(_comparison_lines(values))


def _comparison_lines(values: DataFrame) -> DataFrame:
    """A heading, a line per metric, and one below it per method; a few rows."""
    parts = F.split("metric", r"\|")
    rows = values.where((F.col("section") == "method_comparison") & F.col("metric").contains("|")).select(
        F.initcap(F.replace(parts[0], F.lit("_"), F.lit(" "))).alias("name"), parts[1].alias("method"), "value")
    place = F.dense_rank().over(W.partitionBy(F.lit(0)).orderBy("name")) * 1000 + 50_000
    each = F.row_number().over(W.partitionBy("name").orderBy("method"))
    numbered = rows.select("*", place.cast("bigint").alias("at"), each.alias("n"))
    lines = numbered.select((F.col("at") + F.col("n")).alias("line_no"), F.concat(F.lit("    "), "method", F.lit(": "), fixed(F.col("value"), 4)).alias("text"))
    names = numbered.select(F.col("at").alias("line_no"), F.concat(F.lit("  "), "name", F.lit(":")).alias("text")).distinct()
    head = numbered.select(F.lit(50_000).cast("bigint").alias("line_no"), F.lit("METHOD COMPARISON:").alias("text")).distinct()
    return head.unionByName(names).unionByName(lines)


def _report_ends(spark, title: str, log_type: str | None, embedding_type: str | None) -> DataFrame:
    ends = [(1, "=" * 60), (2, f"EVALUATION REPORT: {title}"), (3, "=" * 60), (100_000, "=" * 60)]
    ends += [(n, f"{name}: {value}") for n, name, value in ((4, "Log Type", log_type), (5, "Embedding Type", embedding_type)) if value is not None]
    return spark.createDataFrame(ends, "line_no bigint, text string")


def oversampling_report(overall: DataFrame, per_class: DataFrame, variants: DataFrame, title: str) -> DataFrame:
    """Markdown lines from imbalance tables and (variant, sample_increase, improvement_factor)."""
    spark = overall.sparkSession
    items = [("Total samples", F.col("total_samples").cast("string")), ("Normal samples", F.col("normal_samples").cast("string")),
             ("Attack samples", F.col("attack_samples").cast("string")),
             ("Imbalance ratio", fixed(F.col("imbalance_ratio"), 2))]
    stats = overall.select(F.inline(F.array(*[
        F.struct(F.lit(10 + i).cast("bigint").alias("line_no"), F.concat(F.lit(f"- {name}: "), value).alias("text"))
        for i, (name, value) in enumerate(items)])))
    line = F.format_string("- **%s**: %d samples (prevalence: %s, ratio: %s)", "class", "positive",
                           fixed(F.col("prevalence"), 3), fixed(F.col("imbalance_ratio"), 2))
    classes = numbered_text(per_class.withColumn("text", line), 1001, F.col("class")).select("line_no", "text")
    done = F.format_string("- **%s**: sample increase %sx, imbalance improvement %sx", F.upper("variant"),
                           fixed(F.col("sample_increase"), 2), fixed(F.col("improvement_factor"), 2))
    made = numbered_text(variants.withColumn("text", done), 1_000_001, F.col("variant")).select("line_no", "text")
    heads = spark.createDataFrame([(1, f"# SMOTE Oversampling Report for {title.upper()}"), (2, "### Original Data Statistics"),
                                   (1000, "### Per-Class Distribution"), (1_000_000, "### SMOTE Variant Results")],
                                  "line_no bigint, text string")
    return heads.unionByName(stats).unionByName(classes).unionByName(made)


BLOCK_LINES = 10_000_000


def oversampling_batch_report(overall: DataFrame, per_class: DataFrame, cells: DataFrame, title: str) -> DataFrame:
    """Markdown lines with one block per embedding type.

    ``overall`` and ``per_class`` are imbalance tables with embedding_type;
    ``cells`` has embedding_type, variant, status, message, sample_increase,
    improvement_factor and output_path. A cell with an error shows its message.
    """
    spark = overall.sparkSession
    names = cells.select("embedding_type").unionByName(overall.select("embedding_type")).distinct()
    place = (F.row_number().over(W.partitionBy(F.lit(0)).orderBy("embedding_type")) * BLOCK_LINES).cast("bigint")  # a few embeddings
    blocks = F.broadcast(names.withColumn("first", place))

    def lines(rows: DataFrame, number: Column, text: Column) -> DataFrame:
        return rows.join(blocks, "embedding_type").select((F.col("first") + number).cast("bigint").alias("line_no"), text.alias("text"))

    heads = F.inline(F.array(*[F.struct(F.lit(n).alias("n"), t.alias("t")) for n, t in (
        (0, F.concat(F.lit("## "), F.upper("embedding_type"), F.lit(" Embeddings"))), (1, F.lit("### Original Data Statistics")),
        (1000, F.lit("### Per-Class Distribution")), (1_000_000, F.lit("### SMOTE Variant Results")))]))
    parts = [names.select("embedding_type", heads)]
    items = [("Total samples", F.col("total_samples").cast("string")), ("Normal samples", F.col("normal_samples").cast("string")),
             ("Attack samples", F.col("attack_samples").cast("string")), ("Imbalance ratio", fixed(F.col("imbalance_ratio"), 2))]
    parts.append(overall.select("embedding_type", F.inline(F.array(*[
        F.struct(F.lit(10 + i).alias("n"), F.concat(F.lit(f"- {name}: "), value).alias("t")) for i, (name, value) in enumerate(items)]))))
    each = W.partitionBy("embedding_type")
    line = F.format_string("- **%s**: %d samples (prevalence: %s, ratio: %s)", "class", "positive", fixed(F.col("prevalence"), 3), fixed(F.col("imbalance_ratio"), 2))
    parts.append(per_class.select("embedding_type", (F.row_number().over(each.orderBy("class")) + 1000).alias("n"), line.alias("t")))
    name = F.concat(F.lit("- **"), F.upper("variant"), F.lit("**:"))
    good = F.array(name, F.concat(F.lit("  - Sample increase: "), fixed(F.col("sample_increase"), 2), F.lit("x")),
                   F.concat(F.lit("  - Imbalance improvement: "), fixed(F.col("improvement_factor"), 2), F.lit("x")), F.concat(F.lit("  - Output path: "), "output_path"))
    told = F.when(F.col("status") == "done", good).otherwise(F.array(F.concat(name, F.lit(" Error - "), F.coalesce("message", F.lit("")))))
    numbered = cells.withColumn("n_", F.row_number().over(each.orderBy("variant")) * 10 + 1_000_000)
    parts.append(numbered.select("embedding_type", "n_", F.posexplode(told).alias("at_", "t")).select("embedding_type", (F.col("n_") + F.col("at_")).alias("n"), "t"))
    out = spark.createDataFrame([(1, f"# SMOTE Oversampling Report for {title.upper()}")], "line_no bigint, text string")
    for part in parts:
        out = out.unionByName(lines(part, F.col("n"), F.col("t")))
    return out
