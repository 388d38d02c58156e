"""Multi-label metrics, curves, thresholds, comparisons, reports, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.inputs import CELLS, CLASSES, documents, event_cells, event_vectors, vectors
from catalog.registry import query
from tracewright.operators import counts as ct
from tracewright.operators import metrics as mt
from tracewright.operators import models as md
from tracewright.operators import reports as rp
from tracewright.session import settle


def rounded(df, *names, digits=6):
    for n in names:
        df = df.withColumn(n, F.round(n, digits))
    return df


PRF = """round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"""


@query("e01_confusion", f"WITH {CELLS} SELECT class, tp, fp, fn, tn FROM conf")
def confusion(spark, sf):
    return mt.confusion(event_cells(spark, sf))


@query("e02_per_class", f"WITH {CELLS} SELECT class, {PRF}, tp + fn AS support FROM conf")
def per_class(spark, sf):
    return rounded(mt.per_class_metrics(event_cells(spark, sf)), "precision", "recall", "f1")


@query("e03_e08_e09_micro_macro", f"""WITH {CELLS} SELECT round(sum(tp) / sum(tp + fp), 6) AS micro_precision, round(sum(tp) / sum(tp + fn), 6) AS micro_recall,
  round(2.0 * sum(tp) / sum(2 * tp + fp + fn), 6) AS micro_f1, round(avg(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0)), 6) AS macro_precision,
  round(avg(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0)), 6) AS macro_recall, round(avg(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS macro_f1,
  round(sum(tp) / sum(tp + fp + fn), 6) AS jaccard_micro, round(sum(fp + fn) / sum(tp + fp + fn + tn), 6) AS hamming_loss FROM conf""")
def micro_macro(spark, sf):
    out = mt.micro_macro(event_cells(spark, sf))
    return rounded(out, *out.columns)


@query("e03_subset_accuracy", f"WITH {CELLS}, r AS (SELECT row_id, bool_and(y_true = y_pred) AS ok FROM cell GROUP BY 1) SELECT round(avg(ok::INTEGER), 6) AS accuracy FROM r")
def subset_accuracy(spark, sf):
    return rounded(mt.subset_accuracy_of_vectors(event_vectors(spark, sf)), "accuracy")


@query("e03_subset_accuracy_of_cells", f"WITH {CELLS}, r AS (SELECT row_id, bool_and(y_true = y_pred) AS ok FROM cell GROUP BY 1) SELECT round(avg(ok::INTEGER), 6) AS accuracy FROM r")
def subset_accuracy_of_cells(spark, sf):
    return rounded(mt.subset_accuracy(event_cells(spark, sf)), "accuracy")


@query("e03w_weighted_binary", f"""WITH {CELLS}, r AS (SELECT row_id, max(y_true) AS t, max(y_pred) AS p FROM cell GROUP BY 1),
  v AS (SELECT v, count(*) FILTER (t = v) AS s, count(*) FILTER (p = v) AS c, count(*) FILTER (t = v AND p = v) AS tp FROM r, (VALUES (0), (1)) x(v) GROUP BY 1)
  SELECT round(sum(tp)::DOUBLE / sum(s), 6) AS accuracy, round(sum(coalesce(tp::DOUBLE / nullif(c, 0), 0) * s) / sum(s), 6) AS precision,
    round(sum(coalesce(tp::DOUBLE / nullif(s, 0), 0) * s) / sum(s), 6) AS recall, round(sum(coalesce(2.0 * tp / nullif(s + c, 0), 0) * s) / sum(s), 6) AS f1_score FROM v""")
def weighted_binary(spark, sf):
    rows = event_vectors(spark, sf).select(F.array_max("y_true").alias("y_true"), F.array_max("y_pred").alias("y_pred"))
    out = mt.weighted_binary(rows)
    return rounded(out, *out.columns)


POINTS = """pt AS (SELECT class, score, sum(y_true)::BIGINT AS pos, sum(1 - y_true)::BIGINT AS neg FROM cell GROUP BY 1, 2),
run AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY class) AS np, sum(neg) OVER (PARTITION BY class) AS nn
  FROM pt WINDOW w AS (PARTITION BY class ORDER BY score DESC))"""


@query("e04_roc_curve", f"WITH {CELLS}, {POINTS} SELECT class, score, round(cn / nn, 6) AS fpr, round(cp / np, 6) AS tpr FROM run")
def roc_curve(spark, sf):
    return rounded(mt.roc_curve(event_cells(spark, sf)), "fpr", "tpr")


@query("e04_roc_auc", f"WITH {CELLS}, {POINTS} SELECT class, round(sum(neg * (cp - pos / 2.0)) / max(np * nn), 6) AS auc FROM run GROUP BY 1")
def roc_auc(spark, sf):
    return rounded(mt.roc_auc(event_cells(spark, sf)), "auc")


@query("e04_auc_micro_macro", f"""WITH {CELLS}, {POINTS}, m AS (SELECT avg(a) AS macro_auc FROM (SELECT sum(neg * (cp - pos / 2.0)) / max(np * nn) AS a FROM run GROUP BY class)),
  p2 AS (SELECT score, sum(pos) AS pos, sum(neg) AS neg FROM pt GROUP BY 1), r2 AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS cp FROM p2)
  SELECT round((SELECT sum(neg * (cp - pos / 2.0)) / (sum(pos) * sum(neg)) FROM r2), 6) AS micro_auc, round(macro_auc, 6) AS macro_auc FROM m""")
def auc_micro_macro(spark, sf):
    return rounded(mt.auc_summary(event_cells(spark, sf)), "micro_auc", "macro_auc")


@query("e05_pr_curve", f"WITH {CELLS}, {POINTS} SELECT class, score, round(cp / (cp + cn), 6) AS precision, round(cp / np, 6) AS recall FROM run")
def pr_curve(spark, sf):
    return rounded(mt.pr_curve(event_cells(spark, sf)), "precision", "recall")


@query("e05_average_precision", f"WITH {CELLS}, {POINTS} SELECT class, round(sum(pos * cp / (cp + cn)) / max(np), 6) AS average_precision FROM run GROUP BY 1")
def average_precision(spark, sf):
    return rounded(mt.average_precision(event_cells(spark, sf)), "average_precision")


BEST = """th AS (SELECT h, h / 100.0::DOUBLE AS t FROM (SELECT unnest(range(10, 86, 5)) AS h)),
tf AS (SELECT class, h, coalesce(2.0 * count(*) FILTER (y_true = 1 AND score >= t) / nullif(count(*) FILTER (y_true = 1) + count(*) FILTER (score >= t), 0), 0) AS f1
  FROM cell, th GROUP BY class, h),
best AS (SELECT class, f1, CASE WHEN f1 > 0 THEN h / 100.0::DOUBLE ELSE 0.5 END AS threshold FROM (
  SELECT *, row_number() OVER (PARTITION BY class ORDER BY f1 DESC, h) AS rn FROM tf) WHERE rn = 1)"""


@query("e06_best_f1_thresholds", f"WITH {CELLS}, {BEST} SELECT class, round(threshold, 2) AS threshold, round(f1, 6) AS f1 FROM best")
def best_f1_thresholds(spark, sf):
    return rounded(rounded(mt.best_f1_thresholds(event_cells(spark, sf)), "f1"), "threshold", digits=2)


@query("e06_p08_thresholds_applied", f"""WITH {CELLS}, {BEST} SELECT class, count(*) FILTER (score >= threshold) AS n_flagged,
  count(*) FILTER (score >= threshold AND y_true = 1) AS n_hit FROM cell JOIN best USING (class) GROUP BY 1""")
def thresholds_applied(spark, sf):
    cells = event_cells(spark, sf).drop("y_pred")
    out = mt.apply_thresholds(cells, mt.best_f1_thresholds(cells))
    return out.groupBy("class").agg(F.sum("y_pred").alias("n_flagged"), F.count_if((F.col("y_pred") == 1) & (F.col("y_true") == 1)).alias("n_hit"))


@query("e07_youden", f"""WITH {CELLS}, {POINTS}, g AS (SELECT class, score, round(cp / np - cn / nn, 12) AS gain FROM run)
  SELECT class, score AS threshold, round(gain, 6) AS youden FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY gain DESC, score DESC) AS rn FROM g) WHERE rn = 1""")
def youden(spark, sf):
    return rounded(mt.youden_thresholds(event_cells(spark, sf)), "youden")



@query("e10_pseudo_label_f1", """WITH c AS (SELECT lang AS cluster, source AS truth, count(*) AS n FROM documents GROUP BY 1, 2)
  SELECT round(sum(hit)::DOUBLE / sum(n), 6) AS pseudo_label_micro_f1 FROM (SELECT cluster, max(n) AS hit, sum(n) AS n FROM c GROUP BY 1)""")
def pseudo_label_f1(spark, sf):
    return rounded(mt.pseudo_label_f1(documents(spark, sf), "lang", "source"), "pseudo_label_micro_f1")


@query("e10_majority_labels", """WITH c AS (SELECT lang AS cluster, source AS truth, count(*) AS n FROM documents GROUP BY 1, 2)
  SELECT cluster AS lang, truth AS majority, n FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, truth) AS rn FROM c) WHERE rn = 1""")
def majority_labels(spark, sf):
    return mt.majority_labels(documents(spark, sf), "lang", "source")


@query("e11_rare_class_f1", f"""WITH {CELLS} SELECT class, round((tp + fn)::DOUBLE / (tp + fp + fn + tn), 6) AS prevalence,
  round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM conf WHERE (tp + fn)::DOUBLE / (tp + fp + fn + tn) <= 0.05""")
def rare_class_f1(spark, sf):
    return rounded(mt.rare_class_f1(event_cells(spark, sf)), "prevalence", "f1")


def _metrics_by_type(spark, sf):
    """(embedding_type, fold, metric, value): log types play the part of methods, id remainders of folds."""
    cells = event_cells(spark, sf).withColumn("fold", (F.col("row_id") % 5).cast("int"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    conf = mt.confusion(cells, "log_type", "fold")
    wide = conf.select(F.col("log_type").alias("embedding_type"), "fold", mt.precision_of(tp, fp).alias("precision"),
                       mt.recall_of(tp, fn).alias("recall"), mt.f1_of(tp, fp, fn).alias("f1"))
    return md.long_metrics(wide, ["precision", "recall", "f1"], "embedding_type", "fold")


METRICS = """fc AS (SELECT log_type AS embedding_type, (row_id % 5)::INTEGER AS fold, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp,
  count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp, count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn FROM cell GROUP BY 1, 2),
fm AS (SELECT embedding_type, fold, 'precision' AS metric, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS value FROM fc
  UNION ALL SELECT embedding_type, fold, 'recall', coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) FROM fc
  UNION ALL SELECT embedding_type, fold, 'f1', coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) FROM fc),
mm AS (SELECT embedding_type, metric, avg(value) AS value FROM fm GROUP BY 1, 2)"""


@query("a17_fold_summary", f"WITH {CELLS}, {METRICS} SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM fm GROUP BY 1")
def fold_summary(spark, sf):
    return rounded(mt.fold_summary(_metrics_by_type(spark, sf)), "mean", "std")


def _means(spark, sf):
    return _metrics_by_type(spark, sf).groupBy("embedding_type", "metric").agg(F.avg("value").alias("value"))


@query("e12_metrics_summary", f"""WITH {CELLS}, {METRICS} SELECT embedding_type, printf('%.4f', max(value) FILTER (metric = 'precision')) AS precision,
  printf('%.4f', max(value) FILTER (metric = 'recall')) AS recall, printf('%.4f', max(value) FILTER (metric = 'f1')) AS f1, '0.0000' AS micro_auc FROM mm GROUP BY 1""")
def metrics_summary(spark, sf):
    return mt.metrics_summary(_means(spark, sf), ["precision", "recall", "f1", "micro_auc"])


@query("e13_compare_methods", f"""WITH {CELLS}, {METRICS}, r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, embedding_type) AS hi,
  row_number() OVER (PARTITION BY metric ORDER BY value, embedding_type) AS lo FROM mm)
  SELECT metric, max(embedding_type) FILTER (hi = 1) AS best_method, round(max(value), 6) AS best_value,
  max(embedding_type) FILTER (lo = 1) AS worst_method, round(min(value), 6) AS worst_value FROM r GROUP BY 1""")
def compare_methods(spark, sf):
    return rounded(mt.compare_methods(_means(spark, sf)), "best_value", "worst_value")


@query("e14_paired_t", f"""WITH {CELLS}, {METRICS}, d AS (SELECT metric, a.value - b.value AS g FROM fm a JOIN fm b USING (metric, fold)
  WHERE a.embedding_type = 'vpn' AND b.embedding_type = 'wp-error')
  SELECT metric, round(avg(g), 6) AS mean_gap, round(avg(g) / (stddev_samp(g) / sqrt(count(*))), 4) AS t_stat, count(*) - 1 AS df FROM d GROUP BY 1""")
def paired_t(spark, sf):
    return rounded(rounded(mt.paired_t(_metrics_by_type(spark, sf), "vpn", "wp-error"), "mean_gap"), "t_stat", digits=4)


@query("e14_best_worst", f"""WITH {CELLS}, {METRICS}, r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, embedding_type) AS hi,
    row_number() OVER (PARTITION BY metric ORDER BY value, embedding_type) AS lo FROM mm),
  d AS (SELECT metric, b.embedding_type AS best_method, w.embedding_type AS worst_method, x.value - y.value AS g FROM r b JOIN r w USING (metric)
    JOIN fm x ON x.metric = b.metric AND x.embedding_type = b.embedding_type JOIN fm y ON y.metric = b.metric AND y.embedding_type = w.embedding_type AND y.fold = x.fold
    WHERE b.hi = 1 AND w.lo = 1),
  s AS (SELECT metric, best_method, worst_method, avg(g) AS gap, avg(g) / (stddev_samp(g) / sqrt(count(*))) AS t, count(*) - 1 AS df FROM d GROUP BY 1, 2, 3),
  p AS (SELECT *, 1 - abs(sin(atan(t / 2)) * (1 + cos(atan(t / 2)) ** 2 / 2)) AS p FROM s)
  SELECT metric, best_method, worst_method, round(gap, 6) AS mean_gap, round(t, 4) AS t_stat, df, round(p, 6) AS p_value, p < 0.05 AS significant FROM p WHERE df = 4""")
def best_worst(spark, sf):
    out = mt.best_against_worst(_metrics_by_type(spark, sf))
    return rounded(rounded(out, "mean_gap", "p_value"), "t_stat", digits=4)


@query("e15_bootstrap_f1", f"WITH {CELLS} SELECT class, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, true AS interval_holds_it FROM conf")
def bootstrap_f1(spark, sf):
    """The ends of the interval are drawn; that they lie on both sides is compared."""
    out = mt.bootstrap_f1(event_cells(spark, sf))
    return out.select("class", F.round("f1", 6).alias("f1"), ((F.col("low") <= F.col("f1")) & (F.col("f1") <= F.col("high"))).alias("interval_holds_it"))


def _result_rows(spark, sf):
    """One wide result row per log type, with rare-event columns."""
    cells = event_cells(spark, sf)
    conf = mt.confusion(cells, "log_type", "class")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    base = conf.groupBy(F.col("log_type").alias("embedding_type")).agg(
        F.round(mt.f1_of(F.sum(tp), F.sum(fp), F.sum(fn)), 6).alias("micro_f1"), F.round(F.avg(mt.f1_of(tp, fp, fn)), 6).alias("macro_f1"),
        F.round((F.sum(fp) + F.sum(fn)) / F.sum(tp + fp + fn + F.col("tn")), 6).alias("hamming_loss"),
        F.round(mt.precision_of(F.sum(tp), F.sum(fp)), 6).alias("micro_precision"),
        F.round(mt.f1_of(F.sum(F.when(F.col("class") == "data_leak", tp).otherwise(0)), F.sum(F.when(F.col("class") == "data_leak", fp).otherwise(0)),
                         F.sum(F.when(F.col("class") == "data_leak", fn).otherwise(0))), 6).alias("rare_event_data_leak_f1"),
        F.lit("x").alias("note"))
    return base


RESULT = """tc AS (SELECT log_type AS embedding_type, class, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp,
  count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn, count(*) AS n FROM cell GROUP BY 1, 2),
res AS (SELECT embedding_type, round(2.0 * sum(tp) / nullif(sum(2 * tp + fp + fn), 0), 6) AS micro_f1, round(avg(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS macro_f1,
  round(sum(fp + fn) / sum(n), 6) AS hamming_loss, round(sum(tp) / sum(tp + fp), 6) AS micro_precision,
  round(coalesce(2.0 * sum(tp) FILTER (class = 'data_leak') / nullif(sum(2 * tp + fp + fn) FILTER (class = 'data_leak'), 0), 0), 6) AS rare_event_data_leak_f1 FROM tc GROUP BY 1)"""


@query("r03_p10_t01_evaluation_matrix", f"WITH {CELLS}, {RESULT} SELECT * FROM res ORDER BY micro_f1 DESC, macro_f1 DESC")
def evaluation_matrix(spark, sf):
    return rp.evaluation_matrix(_result_rows(spark, sf))


@query("r03_markdown_matrix", f"""WITH {CELLS}, {RESULT} SELECT 4 + row_number() OVER (ORDER BY micro_f1 DESC, macro_f1 DESC, embedding_type) AS line_no,
  '| ' || embedding_type || ' | ' || printf('%.4f', micro_f1) || ' | ' || printf('%.4f', macro_f1) || ' | ' || printf('%.4f', hamming_loss) || ' | '
  || printf('%.4f', micro_precision) || ' | ' || printf('%.4f', rare_event_data_leak_f1) || ' |' AS text FROM res
  UNION ALL SELECT * FROM (VALUES (1, '# Evaluation Matrix for events Anomaly Detection'), (2, ''),
    (3, '| embedding_type | micro_f1 | macro_f1 | hamming_loss | micro_precision | rare_event_data_leak_f1 |'),
    (4, '| --- | --- | --- | --- | --- | --- |'))""")
def markdown_matrix(spark, sf):
    return rp.markdown_matrix(_result_rows(spark, sf), "events")


@query("r04_dashboard", f"WITH {CELLS}, {RESULT} SELECT embedding_type, micro_f1, macro_f1, hamming_loss FROM res")
def dashboard(spark, sf):
    return rp.dashboard(_result_rows(spark, sf))


@query("r04_t03_top_class_f1", f"""WITH {CELLS}, {RESULT}, f AS (SELECT embedding_type, class, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM tc),
  r AS (SELECT *, row_number() OVER (PARTITION BY embedding_type ORDER BY f1 DESC, class) AS rank FROM f) SELECT embedding_type, class, f1, rank FROM r WHERE rank <= 5""")
def top_class_f1(spark, sf):
    conf = mt.confusion(event_cells(spark, sf), "log_type", "class")
    f1 = conf.select(F.col("log_type").alias("embedding_type"), "class", F.round(mt.f1_of(F.col("tp"), F.col("fp"), F.col("fn")), 6).alias("f1"))
    return rp.top_class_f1(f1)


@query("r05_evaluation_report", f"""WITH {CELLS}, r AS (SELECT row_id, max(y_true) AS t, max(y_pred) AS p FROM cell GROUP BY 1),
  v AS (SELECT v, count(*) FILTER (t = v) AS s, count(*) FILTER (p = v) AS c, count(*) FILTER (t = v AND p = v) AS tp FROM r, (VALUES (0), (1)) x(v) GROUP BY 1),
  m AS (SELECT sum(tp)::DOUBLE / sum(s) AS acc, sum(coalesce(tp::DOUBLE / nullif(c, 0), 0) * s) / sum(s) AS pr, sum(tp::DOUBLE) / sum(s) AS re,
    sum(coalesce(2.0 * tp / nullif(s + c, 0), 0) * s) / sum(s) AS f1 FROM v)
  SELECT 1 AS line_no, repeat('=', 60) AS text UNION ALL SELECT 2, 'EVALUATION REPORT: events' UNION ALL SELECT 3, repeat('=', 60)
  UNION ALL SELECT 100, 'DETECTION PERFORMANCE:' UNION ALL SELECT 101, '  Accuracy: ' || printf('%.4f', acc) FROM m UNION ALL SELECT 102, '  Precision: ' || printf('%.4f', pr) FROM m
  UNION ALL SELECT 103, '  Recall: ' || printf('%.4f', re) FROM m UNION ALL SELECT 104, '  F1-Score: ' || printf('%.4f', f1) FROM m
  UNION ALL SELECT 105, '  AUC-ROC: 0.0000' UNION ALL SELECT 100000, repeat('=', 60)""")
def evaluation_report(spark, sf):
    rows = event_vectors(spark, sf).select(F.array_max("y_true").alias("y_true"), F.array_max("y_pred").alias("y_pred"))
    wide = mt.weighted_binary(rows)
    values = md.long_metrics(wide, ["accuracy", "precision", "recall", "f1_score"]).withColumn("section", F.lit("detection"))
    return rp.evaluation_report(settle(values, "metrics"), "events")


@query("r06_oversampling_report", f"""WITH {CELLS}, r AS (SELECT row_id, max(y_true) AS a FROM cell GROUP BY 1),
  o AS (SELECT count(*) AS t, count(*) FILTER (a = 0) AS n, count(*) FILTER (a = 1) AS k FROM r),
  c AS (SELECT class, sum(y_true)::BIGINT AS pos, avg(y_true) AS prev, sum(1 - y_true)::DOUBLE / greatest(sum(y_true), 1) AS ratio FROM cell GROUP BY 1)
  SELECT 1 AS line_no, '# SMOTE Oversampling Report for EVENTS' AS text UNION ALL SELECT 2, '### Original Data Statistics'
  UNION ALL SELECT 10, '- Total samples: ' || t FROM o UNION ALL SELECT 11, '- Normal samples: ' || n FROM o UNION ALL SELECT 12, '- Attack samples: ' || k FROM o
  UNION ALL SELECT 13, '- Imbalance ratio: ' || printf('%.2f', n::DOUBLE / greatest(k, 1)) FROM o UNION ALL SELECT 1000, '### Per-Class Distribution'
  UNION ALL SELECT 1000 + row_number() OVER (ORDER BY class), '- **' || class || '**: ' || pos || ' samples (prevalence: ' || printf('%.3f', prev) || ', ratio: ' || printf('%.2f', ratio) || ')' FROM c
  UNION ALL SELECT 1000000, '### SMOTE Variant Results'
  UNION ALL SELECT 1000001, '- **RANDOM**: sample increase ' || printf('%.2f', 2.0 * greatest(n, k) / t) || 'x, imbalance improvement ' || printf('%.2f', greatest(n, k)::DOUBLE / least(n, k)) || 'x' FROM o""")
def oversampling_report(spark, sf):
    from tracewright.operators.balance import random_oversample
    e = settle(event_vectors(spark, sf).select("row_id", "y_true", "classes", F.array_max("y_true").cast("int").alias("label")), "rows")
    after = e.select("label").unionByName(random_oversample(e, below=None).select("label"))
    variants = ct.oversampling_quality(e, after).select(F.lit("random").alias("variant"), "sample_increase", "improvement_factor")
    return rp.oversampling_report(ct.imbalance_overall(e, "y_true"), ct.imbalance_per_class(e, "y_true"), variants, "events")


def _binary_vectors(spark, sf):
    """Vectors with a 0/1 label: the sign of the first entry, or class 0."""
    v = vectors(spark, sf)
    return v.withColumn("label", ((F.col("vec")[0] + F.col("vec")[1] > 0.08) | (F.col("label") == 0)).cast("int"))


@query("v01_linear_cells")
def linear_cells(spark, sf):
    """One model per event class over the vectors; labels are those of the event with the same id."""
    e = event_vectors(spark, sf).select("row_id", F.col("y_true").alias("label_vector"))
    rows = vectors(spark, sf).select("row_id", "vec").join(e, "row_id")
    cells = md.evaluate_embedding(rows, CLASSES)
    return mt.per_class_metrics(cells)


@query("v01_class_support", f"""WITH {CELLS}, has AS (SELECT row_id, max(y_true) AS a FROM cell JOIN embeddings ON vec_id = row_id GROUP BY 1),
  r AS (SELECT row_id, row_number() OVER (PARTITION BY a ORDER BY md5('42:' || row_id), row_id) AS rn, count(*) OVER (PARTITION BY a) AS n FROM has),
  test AS (SELECT row_id FROM r WHERE rn > n - floor(n * 0.2 + 0.5))
  SELECT class, count(*) AS n_rows, sum(y_true)::BIGINT AS support, 0 AS outside, true AS learned FROM cell JOIN test USING (row_id) GROUP BY 1""")
def class_support(spark, sf):
    """Rows and support of each class in the test part; scores are probabilities. Every third dimension of a vector is moved by
    the label it stands for, so that a model that learns puts positives above negatives."""
    e = event_vectors(spark, sf).select("row_id", F.col("y_true").alias("label_vector"))
    moved = F.transform(F.col("vec"), lambda x, i: x.cast("double") + F.when(i % 3 == 0, 3.0 * F.coalesce(F.get("label_vector", F.floor(i / 3).cast("int")), F.lit(0))).otherwise(0.0))
    rows = vectors(spark, sf).select("row_id", "vec").join(e, "row_id").withColumn("vec", moved)
    cells = settle(md.evaluate_embedding(rows, CLASSES), "cells")
    mean = lambda y: F.avg(F.when(F.col("y_true") == y, F.col("score")))
    return cells.groupBy("class").agg(F.count("*").alias("n_rows"), F.sum("y_true").alias("support"), F.count_if(~F.col("score").between(0, 1)).cast("int").alias("outside"),
                                      F.coalesce(mean(1) > mean(0), F.lit(True)).alias("learned"))


@query("v03_forest_detection")
def forest_detection(spark, sf):
    return md.forest_evaluation(_binary_vectors(spark, sf))


@query("v02_a17_cross_validation")
def cross_validation(spark, sf):
    scores = md.cross_validate(_binary_vectors(spark, sf))
    return mt.fold_summary(scores)


@query("v04_anomaly_table", f"WITH {CELLS} SELECT row_id, max(score) AS score, (max(score) > 0.5)::INTEGER AS is_anomaly FROM cell GROUP BY 1")
def anomaly_table(spark, sf):
    return md.anomaly_table(event_vectors(spark, sf).withColumn("score", F.array_max("scores")))
