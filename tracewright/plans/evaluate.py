"""From feature tables to scores, metrics and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import labels as lb
from tracewright.operators import balance as bl
from tracewright.operators import clustering as cl
from tracewright.operators import counts as ct
from tracewright.operators import models as md
from tracewright.operators import taxonomy as tn
from tracewright.operators.ranking import draw_rank
from tracewright.operators.reports import evaluation_report
from tracewright.session import settle
from tracewright.sources import tables as tb


def configuration_metrics(rows: DataFrame, vector: str = "vec", label: str = "label", row_id: str = "row_id",
                          trees: int = 100, folds: int = 5, seed: int = 42) -> DataFrame:
    """(section, metric, value) for one embedding type and log type: detection, clusters,
    oversampling of pseudo-labels, taxonomy paths and cross-validation."""
    parts = []

    def add(section: str, wide: DataFrame, names: list[str]) -> None:
        parts.append(md.long_metrics(wide, names).withColumn("section", F.lit(section)))

    rows = settle(rows.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(vector).alias("vec"),
                              F.col(label).cast("int").alias("label")), "rows")
    add("detection", md.forest_evaluation(rows, trees=trees, seed=seed), [*md.CV_METRICS, "auc_pr"])

    k = min(5, rows.select("label").distinct().count())
    clustered = settle(cl.kmeans(rows, "vec", max(2, k), "cluster", seed), "clustered")
    quality = (cl.silhouette(clustered, "vec", "cluster").withColumnRenamed("silhouette", "silhouette_score")
               .withColumn("adjusted_rand_index", cl.adjusted_rand(clustered, "label", "cluster").scalar())
               .withColumn("normalized_mutual_info", cl.mutual_information(clustered, "label", "cluster").scalar()))
    add("clustering", quality, ["silhouette_score", "adjusted_rand_index", "normalized_mutual_info"])

    pseudo = settle(cl.pseudo_labels(rows.drop("label"), "vec", out="label", seed=seed), "pseudo")
    made = settle(bl.smote(pseudo, seed=seed), "made")
    after = bl.with_synthetic(pseudo, made)
    smote = ct.balance_improvement(pseudo, after).select("balance_improvement")
    if made.take(1):
        smote = smote.withColumn("synthetic_quality", bl.synthetic_quality(pseudo, made).scalar())
        smote = smote.withColumn("diversity_score", bl.diversity(settle(after, "after")).scalar())
        add("smote", smote, ["balance_improvement", "synthetic_quality", "diversity_score"])
    else:
        add("smote", smote, ["balance_improvement"])

    paths = settle(tn.fit_predict(rows, "vec", seed=seed), "paths")
    hier = tn.path_consistency(paths).withColumn(
        "level_coverage", paths.agg(F.max(F.size("path")) / F.lit(4.0)).scalar())
    add("hierarchical", hier, ["path_consistency", "level_coverage"])

    scores = settle(md.cross_validate(rows, k=folds, trees=trees, seed=seed), "cv")
    summary = scores.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    cv = summary.select(F.inline(F.array(
        F.struct(F.concat(F.lit("cv_"), "metric", F.lit("_mean")).alias("metric"), F.col("mean").alias("value")),
        F.struct(F.concat(F.lit("cv_"), "metric", F.lit("_std")).alias("metric"), F.col("std").alias("value")))))
    parts.append(cv.withColumn("section", F.lit("cv")))
    return reduce(DataFrame.unionByName, parts).select("section", "metric", "value")


def run(spark: SparkSession, features: str, out: str, trees: int = 100, folds: int = 5, seed: int = 42) -> None:
    """Evaluate every (log type, embedding type) found in a feature table and write metrics and reports.

    Work already present in the output is skipped, so a restarted job goes on
    where it stopped. There is one entry per configuration, not per row.
    """
    table = tb.read_features(spark, features)
    work = table.select("log_type", "embedding_type").distinct()
    try:
        finished = spark.read.parquet(f"{out}/metrics").select("log_type", "embedding_type").distinct()
        work = work.join(finished, ["log_type", "embedding_type"], "left_anti")
    except AnalysisException:  # no output yet
        pass
    for item in work.orderBy("log_type", "embedding_type").collect():
        rows = tb.read_features(spark, features, item["embedding_type"], item["log_type"])
        rows = draw_rank(rows, [], ["row_id"], seed).withColumnRenamed("rank", "id").drop("group_rows")
        rows = rows.withColumn("label", lb.has_any_bit(F.col("label_vector")))
        values = settle(configuration_metrics(rows, "embedding", "label", "id", trees, folds, seed), "metrics")
        title = f"{item['log_type']} / {item['embedding_type']}"
        tb.write_report(evaluation_report(values, title, item["log_type"], item["embedding_type"]), f"{out}/reports/{item['log_type']}/{item['embedding_type']}")
        (values.withColumn("log_type", F.lit(item["log_type"])).withColumn("embedding_type", F.lit(item["embedding_type"]))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("log_type", "embedding_type").parquet(f"{out}/metrics"))
