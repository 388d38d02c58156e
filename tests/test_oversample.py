"""The oversampling batch: counts, errors, a stop half-way, its report."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import balance as bl
from tracewright.operators import counts as ct
from tracewright.operators import reports as rp
from tracewright.plans import oversample as ov
from tracewright.sources import tables as tb


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    rows = [(f"r{i}", "auth", e, rng.normal(size=3).tolist(), [1, 0] if i % 10 == 0 else [0, 1] if i % 4 == 0 else [0, 0], ["a", "b"])
            for e in ("one", "two") for i in range(80)]
    path = str(tmp_path_factory.mktemp("features") / "t")
    tb.write_features(spark.createDataFrame(rows, "row_id string, log_type string, embedding_type string, embedding array<double>, label_vector array<tinyint>, classes array<string>"), path)
    return path


def test_batch_stops_and_goes_on(spark, store, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    assert ov.run(spark, store, out, ["smote", "adasyn"], most_cells=1) == 1
    first = {r["attempt"] for r in ov.read_manifest(spark, out).collect()}
    real = bl.balance

    def breaks(rows, variant, **more):
        if variant == "smote":
            raise RuntimeError("lost")
        return real(rows, variant, **more)

    monkeypatch.setattr(bl, "balance", breaks)
    assert ov.run(spark, store, out, ["smote", "adasyn"]) == 3
    told = {(r["embedding_type"], r["variant"]): r for r in ov.read_manifest(spark, out).collect()}
    assert told["two", "smote"]["status"] == "error" and told["two", "smote"]["message"] == "RuntimeError: lost"
    assert {c: r["status"] for c, r in told.items()} == {(e, v): "error" if v == "smote" else "done" for e in ("one", "two") for v in ("smote", "adasyn")}
    # What an attempt without a manifest row left behind isn't read.
    spark.read.parquet(f"{out}/balanced").limit(5).withColumn("attempt", F.lit("torn")).write.mode("append").partitionBy(*ov.CELL, "attempt").parquet(f"{out}/balanced")
    monkeypatch.undo()
    assert ov.run(spark, store, out, ["smote", "adasyn"]) == 2 and ov.run(spark, store, out, ["smote", "adasyn"]) == 0
    assert first <= {r["attempt"] for r in ov.read_manifest(spark, out).collect()}
    sizes = {(r[0], r[1], r[2]): r[3] for r in ov.read_balanced(spark, out).where("variant = 'smote'").groupBy("embedding_type", "variant", "label").count().collect()}
    assert sizes == {(e, "smote", c): 60 for e in ("one", "two") for c in (-1, 0, 1)} or set(sizes.values()) == {max(sizes.values())}
    done = [r for r in ov.read_manifest(spark, out).collect() if r["variant"] == "smote"]
    assert all(r["n_before"] == 80 and r["n_after"] == sum(n for (e, _, _), n in sizes.items() if e == r["embedding_type"]) and r["max_ratio_after"] == 1.0 for r in done)


def test_batch_on_clusters(spark, store, tmp_path):
    out = str(tmp_path / "out")
    assert ov.run(spark, store, out, ["smote"], use_pseudo_labels=True) == 2
    assert {r["status"] for r in ov.read_manifest(spark, out).collect()} == {"done"}


def test_batch_report(spark, store):
    rows = tb.read_features(spark, store)
    overall = rows.groupBy("embedding_type").agg(F.count("*").alias("total_samples"), F.lit(54).alias("normal_samples"), F.lit(26).alias("attack_samples"), F.lit(54 / 26).alias("imbalance_ratio"))
    per_class = ct.imbalance_per_class(rows.where("embedding_type = 'one'")).withColumn("embedding_type", F.lit("one"))
    cells = spark.createDataFrame([("one", "smote", "done", None, 2.0, 3.5, "p/1"), ("one", "adasyn", "error", "ValueError: no", None, None, None), ("two", "smote", "done", None, 1.0, 1.0, "p/2")],
                                  "embedding_type string, variant string, status string, message string, sample_increase double, improvement_factor double, output_path string")
    text = [r["text"] for r in rp.oversampling_batch_report(overall, per_class, cells, "auth").orderBy("line_no").collect()]
    assert text[0] == "# SMOTE Oversampling Report for AUTH" and text[1:7] == [
        "## ONE Embeddings", "### Original Data Statistics", "- Total samples: 80", "- Normal samples: 54", "- Attack samples: 26", "- Imbalance ratio: 2.08"]
    assert text[7:10] == ["### Per-Class Distribution", "- **a**: 8 samples (prevalence: 0.100, ratio: 9.00)", "- **b**: 16 samples (prevalence: 0.200, ratio: 4.00)"]
    assert text[10:16] == ["### SMOTE Variant Results", "- **ADASYN**: Error - ValueError: no", "- **SMOTE**:", "  - Sample increase: 2.00x", "  - Imbalance improvement: 3.50x", "  - Output path: p/1"]
    assert text[16] == "## TWO Embeddings" and len(text) == 28


def test_evaluation_report_with_all_sections(spark):
    values = [("detection", "accuracy", 0.5), ("hierarchical", "level_0_accuracy", 0.25), ("hierarchical", "level_1_accuracy", 0.75), ("hierarchical", "path_consistency", 1.0),
              ("cv", "cv_f1_score_mean", 0.5), ("cv", "cv_f1_score_std", 0.125), ("method_comparison", "f1_score|word2vec", 0.5), ("method_comparison", "f1_score|fasttext", 0.25),
              ("method_comparison", "accuracy|fasttext", 1.0)]
    rows = rp.evaluation_report(spark.createDataFrame(values, "section string, metric string, value double"), "auth / x", "auth", "x").orderBy("line_no").collect()
    text = [r["text"] for r in rows]
    at = text.index("HIERARCHICAL PERFORMANCE:")
    assert text[3:5] == ["Log Type: auth", "Embedding Type: x"]
    assert text[at + 1:at + 4] == ["  Level 0 Accuracy: 0.2500", "  Level 1 Accuracy: 0.7500", "  Path Consistency: 1.0000"]
    assert "  F1-Score: 0.5000 ± 0.1250" in text and "CLUSTERING QUALITY:" not in text
    at = text.index("METHOD COMPARISON:")
    assert text[at + 1:] == ["  Accuracy:", "    fasttext: 1.0000", "  F1 Score:", "    fasttext: 0.2500", "    word2vec: 0.5000", "=" * 60]
    assert len({r["line_no"] for r in rows}) == len(rows)
