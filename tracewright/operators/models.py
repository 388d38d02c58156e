"""Classifiers, cross-validation and anomaly tables."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions import vectors as vc
from tracewright.operators import metrics as mt
from tracewright.operators import multilabel as ml
from tracewright.operators.ranking import stratified_folds, stratified_split
from tracewright.operators.vector_stats import flag_anomalies, standardize
from tracewright.session import settle


def _prepared(rows: DataFrame, vector: str) -> DataFrame:
    return rows.withColumn("features", array_to_vector(vc.as_doubles(F.col(vector))))


def score_classes(train: DataFrame, test: DataFrame, classes: list[str], vector: str = "vec",
                  bits: str = "label_vector", row_id: str = "row_id", max_iter: int = 1000) -> DataFrame:
    """Cells (row_id, class, y_true, score): one logistic model per class on standardized vectors.

    All classes are trained in the same passes. A class that is constant in the
    training rows scores as that constant. Null labels count as 0.
    """
    both = train.withColumn("train_", F.lit(True)).unionByName(test.withColumn("train_", F.lit(False)))
    both = settle(standardize(both.select(row_id, vector, bits, "train_"), vector, out="scaled_").select(row_id, "scaled_", bits, "train_"), "scaled")
    weights = ml.fit(ml.prepared(both.where("train_"), "scaled_", bits, row_id, "classes-train"), len(classes), max_iter)
    return ml.cells(ml.prepared(both.where("NOT train_"), "scaled_", bits, row_id, "classes-test"), weights, classes, row_id)


def evaluate_embedding(rows: DataFrame, classes: list[str], vector: str = "vec", bits: str = "label_vector",
                       row_id: str = "row_id", seed: int = 42) -> DataFrame:
    """Cells of the test part with tuned thresholds applied."""
    strata = rows.withColumn("any_", F.exists(bits, lambda b: b == 1))
    parts = settle(stratified_split(strata, "any_", [row_id], seed=seed).drop("any_"), "parts")
    train, test = parts.where("part = 'train'").drop("part"), parts.where("part = 'test'").drop("part")
    cells = settle(score_classes(train, test, classes, vector, bits, row_id), "cells")
    return mt.apply_thresholds(cells, mt.best_f1_thresholds(cells))


def forest_scores(train: DataFrame, test: DataFrame, vector: str = "vec", label: str = "label",
                  row_id: str = "row_id", trees: int = 100, seed: int = 42) -> DataFrame:
    """(row_id, y_true, y_pred, score) of a random forest for a 0/1 label."""
    model = RandomForestClassifier(numTrees=trees, seed=seed, labelCol="y").fit(
        _prepared(train, vector).withColumn("y", F.col(label).cast("double")).select("features", "y"))
    scored = model.transform(_prepared(test, vector))
    return scored.select(row_id, F.col(label).cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"),
                         F.get(vector_to_array("probability"), F.lit(1)).alias("score"))


def detection_metrics(scored: DataFrame) -> DataFrame:
    """Weighted metrics plus ROC and PR areas of (y_true, y_pred, score) rows."""
    base = mt.weighted_binary(scored)
    cells = scored.select("y_true", "score")
    auc, ap = mt.roc_auc(cells, []), mt.average_precision(cells, [])
    return base.withColumn("auc_roc", auc.scalar()).withColumn("auc_pr", ap.scalar())


def forest_evaluation(rows: DataFrame, vector: str = "vec", label: str = "label", row_id: str = "row_id",
                      trees: int = 100, seed: int = 42) -> DataFrame:
    parts = settle(stratified_split(rows, label, [row_id], seed=seed), "parts")
    scored = forest_scores(parts.where("part = 'train'"), parts.where("part = 'test'"), vector, label, row_id, trees,
                           seed)
    return detection_metrics(settle(scored, "scored"))


def long_metrics(wide: DataFrame, names: list[str], *keys: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return wide.select(*keys, F.inline(pairs))


CV_METRICS = ["accuracy", "precision", "recall", "f1_score", "auc_roc"]


def cross_validate(rows: DataFrame, vector: str = "vec", label: str = "label", row_id: str = "row_id", k: int = 5,
                   trees: int = 100, seed: int = 42) -> DataFrame:
    """(fold, metric, value) of a random forest over stratified folds."""
    folded = settle(stratified_folds(rows, label, [row_id], k, seed), "folds")
    parts = []
    for fold in range(k):
        train, test = folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)
        scored = settle(forest_scores(train, test, vector, label, row_id, trees, seed), "scored")
        parts.append(long_metrics(detection_metrics(scored), CV_METRICS).withColumn("fold", F.lit(fold)))
    return reduce(DataFrame.unionByName, parts)


def anomaly_table(scored: DataFrame, threshold: float = 0.5, row_id: str = "row_id", score: str = "score") -> DataFrame:
    return flag_anomalies(scored, score, threshold).select(row_id, "is_anomaly", score)
