"""Whole jobs on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import embedding as em
from tracewright.operators import models as md
from tracewright.plans import evaluate, features
from tracewright.sources import tables as tb


@pytest.fixture(scope="module")
def records(spark):
    rows = []
    r = np.random.default_rng(7)
    for i in range(160):
        bad = i % 8 == 0
        text = " ".join(r.choice(["failed", "denied", "attack"] if bad else ["session", "opened", "closed", "user"], 6))
        rows.append(("t/auth.log" if i % 2 else "t/access.log", i, text, ["brute"] if bad else [],
                     "auth" if i % 2 else "wp-access"))
    rows += [("t/auth.log", 1000, "12 34", ["Odd"], "auth")]
    return spark.createDataFrame(rows, "rel_path string, line_no bigint, message string, labels array<string>, log_type string")


@pytest.fixture(scope="module")
def feature_rows(spark, records):
    vocab = em.hashed_vectors(em.vocabulary_counts(em.tokenize(records)), 6)
    return features.feature_table(records, vocab, 6, "hashed")


def test_feature_table(feature_rows):
    rows = feature_rows.collect()
    assert len(rows) == 161 and len({r.row_id for r in rows}) == 161
    odd = [r for r in rows if list(r.labels) == ["Odd"]][0]
    assert list(odd.embedding) == [0.0] * 6
    assert all(len(r.label_vector) == len(r.classes) for r in rows)
    assert {r.log_type: list(r.classes) for r in rows} == {"auth": ["Odd"], "wp-access": ["brute"]}


def test_realigned_vectors_share_classes(feature_rows):
    parts = {"x": feature_rows, "y": feature_rows.where("log_type = 'auth'")}
    rows = features.realign(parts).collect()
    assert {tuple(r.classes) for r in rows} == {("Odd", "brute")}
    assert sum(sum(r.label_vector) for r in rows) == 20 + 1 + 1


def test_evaluation_run_writes_and_skips_finished_work(spark, feature_rows, tmp_path):
    store, out = str(tmp_path / "features"), str(tmp_path / "out")
    both = feature_rows.withColumn("label_vector", F.col("label_vector").cast("array<tinyint>"))
    tb.write_features(both.where("log_type = 'wp-access'"), store)
    evaluate.run(spark, store, out, trees=5, folds=2)
    values = {(r.section, r.metric): r.value for r in spark.read.parquet(f"{out}/metrics").collect()}
    assert values[("detection", "accuracy")] == 1.0
    assert 0 <= values[("hierarchical", "path_consistency")] <= 1
    assert values[("cv", "cv_accuracy_mean")] > 0.9 and ("smote", "balance_improvement") in values
    text = [r.value for r in spark.read.text(f"{out}/reports/wp-access/hashed").collect()]
    assert "DETECTION PERFORMANCE:" in text and "  Accuracy: 1.0000" in text
    before = spark.read.parquet(f"{out}/metrics").select(F.max("_metadata.file_modification_time")).first()[0]
    evaluate.run(spark, store, out, trees=5, folds=2)
    assert spark.read.parquet(f"{out}/metrics").select(F.max("_metadata.file_modification_time")).first()[0] == before


def test_linear_cells_find_a_separable_class(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(120, 4))
    rows = [(i, [float(t) for t in v], [int(v[0] > 0), 0]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id bigint, vec array<double>, label_vector array<int>")
    cells = md.evaluate_embedding(df, ["a", "never"]).collect()
    hits = [c.y_true == c.y_pred for c in cells if c["class"] == "a"]
    assert sum(hits) / len(hits) > 0.85
    assert all(c.score == 0.0 for c in cells if c["class"] == "never")
