"""Evaluation of multi-label predictions.

Cells are long rows (row_id, class, y_true, y_pred and / or score). Everything
starts with one aggregation per class (or per class and score), so only small
count tables meet later steps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracewright.functions.numbers import fixed, safe_ratio
from tracewright.operators.joining import explode_values, lookup_join
from tracewright.operators.ranking import running_totals
from tracewright.session import settle

# Candidate thresholds 0.10, 0.15, ... 0.85, in hundredths.
THRESHOLD_HUNDREDTHS = list(range(10, 86, 5))


def explode_cells(rows: DataFrame, classes: str = "classes", truth: str = "y_true", pred: str = "y_pred",
                  row_id: str = "row_id") -> DataFrame:
    """Vector columns to one row per (row, class)."""
    cells = F.arrays_zip(F.col(classes).alias("class"), F.col(truth).alias("y_true"), F.col(pred).alias("y_pred"))
    return explode_values(rows, [row_id], cells, "z").select(row_id, "z.*")


def confusion(cells: DataFrame, *keys: str) -> DataFrame:
    t, p = F.col("y_true") == 1, F.col("y_pred") == 1
    keys = keys or ("class",)
    return cells.groupBy(*keys).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
                                    F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))


def precision_of(tp: Column, fp: Column) -> Column:
    return safe_ratio(tp, tp + fp)


def recall_of(tp: Column, fn: Column) -> Column:
    return safe_ratio(tp, tp + fn)


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return safe_ratio(tp * 2.0, tp * 2 + fp + fn)


def per_class_metrics(cells: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return confusion(cells).select(
        "class", precision_of(tp, fp).alias("precision"), recall_of(tp, fn).alias("recall"),
        f1_of(tp, fp, fn).alias("f1"), (tp + fn).alias("support"))


def micro_macro(cells: DataFrame) -> DataFrame:
    """Micro and macro precision, recall, F1, plus Jaccard and Hamming loss, from the class counts."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    stp, sfp, sfn = F.sum(tp), F.sum(fp), F.sum(fn)
    return confusion(cells).agg(
        precision_of(stp, sfp).alias("micro_precision"), recall_of(stp, sfn).alias("micro_recall"),
        f1_of(stp, sfp, sfn).alias("micro_f1"), F.avg(precision_of(tp, fp)).alias("macro_precision"),
        F.avg(recall_of(tp, fn)).alias("macro_recall"), F.avg(f1_of(tp, fp, fn)).alias("macro_f1"),
        safe_ratio(stp, stp + sfp + sfn).alias("jaccard_micro"),
        ((sfp + sfn) / F.sum(tp + fp + fn + F.col("tn"))).alias("hamming_loss"))


def subset_accuracy(cells: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Share of rows with every class right."""
    rows = cells.groupBy(row_id).agg(F.bool_and(F.col("y_true") == F.col("y_pred")).alias("same"))
    return rows.agg(F.avg(F.col("same").cast("int")).alias("accuracy"))


def subset_accuracy_of_vectors(rows: DataFrame, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    return rows.agg(F.avg((F.col(truth) == F.col(pred)).cast("int")).alias("accuracy"))


def weighted_binary(rows: DataFrame, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Accuracy and support-weighted precision, recall, F1 over the values of the label."""
    pairs = rows.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    return _weighted(pairs, [])


def _weighted(pairs: DataFrame, keys: list[str]) -> DataFrame:
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    true_side = pairs.groupBy(*keys, F.col("t").alias("v")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    pred_side = pairs.groupBy(*keys, F.col("p").alias("v")).agg(F.sum("n").alias("claimed"))
    both = true_side.join(pred_side, [*keys, "v"], "left").withColumn("claimed", F.coalesce("claimed", F.lit(0)))
    total = F.sum("support")
    prec, rec = safe_ratio(F.col("tp"), F.col("claimed")), safe_ratio(F.col("tp"), F.col("support"))
    f1 = safe_ratio(F.col("tp") * 2.0, F.col("claimed") + F.col("support"))
    return both.groupBy(*keys).agg(
        (F.sum("tp") / total).alias("accuracy"), (F.sum(prec * F.col("support")) / total).alias("precision"),
        (F.sum(rec * F.col("support")) / total).alias("recall"), (F.sum(f1 * F.col("support")) / total).alias("f1_score"))


# -- curves ------------------------------------------------------------------------------

def score_points(cells: DataFrame, *keys: str) -> DataFrame:
    """Positives and negatives per (class, score), the input of every curve."""
    return cells.groupBy(*keys, "score").agg(F.count_if(F.col("y_true") == 1).alias("pos"),
                                             F.count_if(F.col("y_true") != 1).alias("neg"))


def _cumulated(cells: DataFrame, keys: list[str]) -> DataFrame:
    points = settle(score_points(cells, *keys), "points")
    totals = points.groupBy(*keys).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    running = running_totals(points, keys, "score", ["pos", "neg"])
    if keys:
        return lookup_join(running, totals, keys, "inner", row_bytes=64)
    return running.withColumn("t_", totals.select(F.struct("*")).scalar()).select(
        "*", F.col("t_.all_pos").alias("all_pos"), F.col("t_.all_neg").alias("all_neg")).drop("t_")


def roc_curve(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(class, score, fpr, tpr) at every distinct score, highest first."""
    keys = ["class"] if keys is None else keys
    run = _cumulated(cells, keys)
    return run.select(*keys, "score", safe_ratio(F.col("cum_neg"), F.col("all_neg")).alias("fpr"),
                      safe_ratio(F.col("cum_pos"), F.col("all_pos")).alias("tpr"))


def roc_auc(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Tie-aware area under the curve; 0 when only one class value is present."""
    keys = ["class"] if keys is None else keys
    run = _cumulated(cells, keys)
    wins = F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0)
    area = F.sum(wins) / F.nullif(F.max("all_pos").cast("double") * F.max("all_neg"), F.lit(0.0))
    return run.groupBy(*keys).agg(F.coalesce(area, F.lit(0.0)).alias("auc"))


def auc_summary(cells: DataFrame) -> DataFrame:
    """Micro AUC over all cells at once and macro AUC; macro is 0 if a class has one value only."""
    per_class = roc_auc(cells)
    valid = cells.groupBy("class").agg(F.count_distinct("y_true").alias("v")).agg((F.min("v") > 1).alias("ok"))
    macro = per_class.agg(F.avg("auc").alias("m"))
    micro = roc_auc(cells, []).select(F.col("auc").alias("micro_auc"))
    return (micro.withColumn("macro_", macro.scalar()).withColumn("ok_", valid.scalar())
            .select("micro_auc", F.when(F.col("ok_"), F.col("macro_")).otherwise(0.0).alias("macro_auc")))


def pr_curve(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = ["class"] if keys is None else keys
    run = _cumulated(cells, keys)
    return run.select(*keys, "score", (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
                      safe_ratio(F.col("cum_pos"), F.col("all_pos")).alias("recall"))


def average_precision(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sum of precision times recall step."""
    keys = ["class"] if keys is None else keys
    run = _cumulated(cells, keys)
    step = F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return run.groupBy(*keys).agg(safe_ratio(F.sum(step), F.max("all_pos")).alias("average_precision"))


def best_f1_thresholds(cells: DataFrame) -> DataFrame:
    """(class, threshold, f1): the first threshold with the highest F1, 0.5 if none is above 0.

    Scores are counted by how many candidates they reach; the counts at or
    above each candidate follow from that small table.
    """
    reached = F.lit(0)
    for h in THRESHOLD_HUNDREDTHS:
        reached = reached + (F.col("score") >= F.lit(h / 100)).cast("int")
    counts = (cells.groupBy("class", reached.alias("reached"))
              .agg(F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") != 1).alias("neg")))
    per_class = counts.groupBy("class").agg(F.collect_list(F.struct("reached", "pos", "neg")).alias("bins"))

    def total(column, at_least):
        return F.aggregate(F.filter("bins", lambda b: b["reached"] >= at_least), F.lit(0).cast("bigint"),
                           lambda acc, b: acc + b[column])
    candidates = []
    for i, h in enumerate(THRESHOLD_HUNDREDTHS, start=1):
        tp, fp = total("pos", i), total("neg", i)
        fn = total("pos", 0) - tp
        candidates.append(F.struct(f1_of(tp, fp, fn).alias("f1"), F.lit(-h).alias("order")))
    best = per_class.select("class", F.array_max(F.array(*candidates)).alias("b"))
    return best.select("class", F.when(F.col("b.f1") > 0, -F.col("b.order") / 100.0).otherwise(0.5).alias("threshold"),
                       F.col("b.f1").alias("f1"))


def youden_thresholds(cells: DataFrame) -> DataFrame:
    """(class, threshold, youden): the highest score with the largest tpr - fpr."""
    curve = roc_curve(cells).withColumn("gain", F.col("tpr") - F.col("fpr"))
    return curve.groupBy("class").agg(
        F.max_by("score", F.struct(F.round("gain", 12), "score")).alias("threshold"), F.max("gain").alias("youden"))


def apply_thresholds(cells: DataFrame, thresholds: DataFrame) -> DataFrame:
    """y_pred = score >= threshold of the class; one threshold row per class."""
    return (lookup_join(cells, thresholds.select("class", "threshold"), ["class"], "inner", row_bytes=64)
            .withColumn("y_pred", (F.col("score") >= F.col("threshold")).cast("int")).drop("threshold"))


# -- pseudo-labels and rare classes ------------------------------------------------------

def majority_labels(rows: DataFrame, cluster: str, truth: str) -> DataFrame:
    """(cluster, majority): most frequent true class per cluster, smallest name on ties."""
    counts = rows.groupBy(cluster, truth).agg(F.count("*").alias("n"))
    order = W.partitionBy(cluster).orderBy(F.desc("n"), truth)
    return (counts.withColumn("r", F.row_number().over(order)).where("r = 1")
            .select(cluster, F.col(truth).alias("majority"), "n"))


def pseudo_label_f1(rows: DataFrame, cluster: str, truth: str) -> DataFrame:
    """Micro F1 of the clusters' majority classes; with one class per row it equals accuracy."""
    counts = rows.groupBy(cluster, truth).agg(F.count("*").alias("n"))
    best = counts.groupBy(cluster).agg(F.max("n").alias("hit"), F.sum("n").alias("n"))
    return best.agg((F.sum("hit") / F.sum("n")).alias("pseudo_label_micro_f1"))


def rare_class_f1(cells: DataFrame, max_prevalence: float = 0.05) -> DataFrame:
    per_class = confusion(cells)
    prevalence = (F.col("tp") + F.col("fn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return (per_class.select("class", prevalence.alias("prevalence"),
                             f1_of(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))
            .where(F.col("prevalence") <= max_prevalence))


# -- comparisons -------------------------------------------------------------------------

def fold_summary(folds: DataFrame, key: str = "metric") -> DataFrame:
    """Mean and population deviation per metric over folds."""
    return folds.groupBy(key).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def metrics_summary(metrics: DataFrame, names: list[str]) -> DataFrame:
    """One row per embedding type, four decimals as text; missing metrics are 0."""
    wide = metrics.groupBy("embedding_type").pivot("metric", names).agg(F.first("value"))
    return wide.select("embedding_type", *[
        fixed(F.coalesce(F.col(n), F.lit(0.0)), 4).alias(n) for n in names])


def compare_methods(metrics: DataFrame) -> DataFrame:
    """(metric, best, worst and their values) over embedding types."""
    return metrics.groupBy("metric").agg(
        F.min_by("embedding_type", F.struct(-F.col("value"), "embedding_type")).alias("best_method"),
        F.max("value").alias("best_value"),
        F.min_by("embedding_type", F.struct("value", "embedding_type")).alias("worst_method"),
        F.min("value").alias("worst_value"))


def paired_t(folds: DataFrame, first: str, second: str) -> DataFrame:
    """Paired t statistic per metric between two methods over the same folds."""
    a = folds.where(F.col("embedding_type") == first).select("metric", "fold", F.col("value").alias("a"))
    b = folds.where(F.col("embedding_type") == second).select("metric", "fold", F.col("value").alias("b"))
    gap = F.col("a") - F.col("b")
    stats = a.join(b, ["metric", "fold"]).groupBy("metric").agg(
        F.avg(gap).alias("mean_gap"), F.stddev_samp(gap).alias("dev"), F.count("*").alias("n"))
    t = F.col("mean_gap") / F.nullif(F.col("dev") / F.sqrt("n"), F.lit(0.0))
    return stats.select("metric", "mean_gap", t.alias("t_stat"), (F.col("n") - 1).alias("df"))


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t for a whole number of degrees of freedom (the closed finite sum)."""
    t, n = t.cast("double"), df.cast("int")
    angle = F.atan(t / F.sqrt(n))
    cos2 = F.cos(angle) * F.cos(angle)
    odd = n % 2 == 1
    # Each term is the one before times cos^2 and a ratio of neighbouring numbers.
    steps = F.when(n >= 4, F.sequence(F.when(odd, F.lit(3)).otherwise(F.lit(2)), n - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(a, i):
        term = a["term"] * cos2 * (i - 1) / i
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    total = F.aggregate(steps, start, add, lambda a: a["sum"])
    inside = F.when(n == 1, 2 * angle / F.pi()).when(
        odd, 2 / F.pi() * (angle + F.sin(angle) * F.cos(angle) * total)).otherwise(F.sin(angle) * total)
    return F.when(n >= 1, F.greatest(F.lit(0.0), 1 - F.abs(inside)))


def best_against_worst(folds: DataFrame, level: float = 0.05) -> DataFrame:
    """Per metric the methods with the highest and the lowest mean over folds, their paired t, its p-value and whether it is significant.

    Ties go to the first name. Fold values are gathered per metric and method,
    a few numbers each.
    """
    means = folds.groupBy("metric", "embedding_type").agg(
        F.avg("value").alias("mean"), F.map_from_entries(F.collect_list(F.struct("fold", "value"))).alias("values"))
    picked = means.groupBy("metric").agg(
        F.min_by(F.struct("embedding_type", "values"), F.struct(-F.col("mean"), "embedding_type")).alias("best"),
        F.min_by(F.struct("embedding_type", "values"), F.struct("mean", "embedding_type")).alias("worst"))
    gaps = picked.select("metric", F.col("best.embedding_type").alias("best_method"), F.col("worst.embedding_type").alias("worst_method"),
                         F.explode("best.values").alias("fold", "a"), F.col("worst.values").alias("w"))
    stats = gaps.withColumn("gap", F.col("a") - F.col("w")[F.col("fold")]).where(F.col("gap").isNotNull()).groupBy(
        "metric", "best_method", "worst_method").agg(F.avg("gap").alias("mean_gap"), F.stddev_samp("gap").alias("dev"), F.count("*").alias("n"))
    t = F.col("mean_gap") / F.nullif(F.col("dev") / F.sqrt("n"), F.lit(0.0))
    out = stats.select("metric", "best_method", "worst_method", "mean_gap", t.alias("t_stat"), (F.col("n") - 1).alias("df"))
    return out.withColumn("p_value", t_p_value(F.col("t_stat"), F.col("df"))).withColumn("significant", F.col("p_value") < level)


def bootstrap_f1(cells: DataFrame, samples: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(class, f1, low, high): percentile interval of F1 over resampled rows.

    Resampling n rows with replacement draws the four confusion counts from a
    multinomial, so replicates are drawn from the counts and the rows are read
    once, however many replicates there are.
    """
    counts = confusion(cells)

    def draw(batches):
        for pdf in batches:
            for _, r in pdf.iterrows():
                cells_ = np.array([r.tp, r.fp, r.fn, r.tn], dtype=float)
                n = int(cells_.sum())
                digest = [ord(ch) for ch in str(r["class"])]
                rng = np.random.default_rng([seed, *digest])
                got = rng.multinomial(n, cells_ / n, size=samples)
                bottom = 2 * got[:, 0] + got[:, 1] + got[:, 2]
                f1 = np.where(bottom > 0, 2 * got[:, 0] / np.maximum(bottom, 1), 0.0)
                low, high = np.percentile(f1, [50 * (1 - level), 50 * (1 + level)])
                base = 2 * r.tp + r.fp + r.fn
                yield pd.DataFrame({"class": [r["class"]], "f1": [2 * r.tp / base if base else 0.0],
                                    "low": [low], "high": [high]})

    return counts.mapInPandas(draw, "class string, f1 double, low double, high double")
