"""Oversampling of every log type, embedding and variant, with a run manifest.

A cell of work is (log type, embedding, variant). Its balanced table is written
to a folder of its own attempt; one row appended to the manifest then makes it
part of the output. A job that was stopped goes on with the cells that have no
such row, and what an unfinished attempt left behind is never read.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewright.functions import labels as lb
from tracewright.operators import balance as bl
from tracewright.operators import clustering as cl
from tracewright.operators import counts as ct
from tracewright.operators.ranking import draw_rank
from tracewright.session import settle
from tracewright.sources import tables as tb

VARIANTS = ("smote", "borderline", "adasyn")
CELL = ["log_type", "embedding_type", "variant"]
MANIFEST = ("log_type string, embedding_type string, variant string, status string, message string, attempt string, n_before bigint, "
            "n_after bigint, sample_increase double, max_ratio_before double, max_ratio_after double, improvement_factor double")


def read_manifest(spark: SparkSession, out: str) -> DataFrame:
    """The last row of every cell: done with its attempt and measures, or error with a message."""
    try:
        rows = spark.read.schema(f"{MANIFEST}, at timestamp").parquet(f"{out}/manifest")
    except AnalysisException:  # nothing is finished yet
        return spark.createDataFrame([], f"{MANIFEST}, at timestamp")
    last = Window.partitionBy(*CELL).orderBy(F.desc("at"), F.desc("attempt"))  # a few rows per cell
    return rows.withColumn("n_", F.row_number().over(last)).where(F.col("n_") == 1).drop("n_")


def work_cells(features: DataFrame, variants) -> DataFrame:
    pairs = features.select("log_type", "embedding_type").distinct()
    return pairs.select("*", F.explode(F.array(*[F.lit(v) for v in variants])).alias("variant"))


def read_balanced(spark: SparkSession, out: str) -> DataFrame:
    """Balanced rows of all finished cells: the cell, row_id, copy, label, vec, is_synthetic."""
    done = read_manifest(spark, out).where(F.col("status") == "done").select(*CELL, "attempt")
    rows = spark.read.parquet(f"{out}/balanced")
    for name in (*CELL, "attempt"):
        rows = rows.withColumn(name, F.col(name).cast("string"))
    return rows.join(F.broadcast(done), [*CELL, "attempt"], "left_semi").drop("attempt")  # one manifest row per cell


def labelled_rows(features: DataFrame, use_pseudo_labels: bool, seed: int) -> DataFrame:
    """(row_id, vec, label): numbered rows with their class, or with a cluster of their vector in its place."""
    rows = draw_rank(features, [], ["row_id"], seed).select(F.col("rank").alias("row_id"), F.col("embedding").alias("vec"),
                                                            lb.single_class(F.col("label_vector")).alias("label"))
    if use_pseudo_labels:
        rows = cl.pseudo_labels(settle(rows.drop("label"), "oversample-rows"), "vec", out="label", seed=seed)
    return settle(rows, "oversample-labelled")


def _finish(spark: SparkSession, out: str, cell: dict, **values) -> None:
    names = [f.split()[0] for f in MANIFEST.split(", ")]
    row = {**dict.fromkeys(names), **cell, **values}
    frame = spark.createDataFrame([tuple(row[n] for n in names)], MANIFEST)
    frame.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{out}/manifest")


def run(spark: SparkSession, features: str, out: str, variants=VARIANTS, use_pseudo_labels: bool = False, seed: int = 42,
        most_cells: int | None = None) -> int:
    """Balance every cell of a feature table that isn't done; the number of cells worked on.

    Rows of a pair of log type and embedding are read and labelled once for all
    its variants. A cell that fails gets an error row and is tried again by the
    next run. ``most_cells`` stops early. The loop goes over configurations;
    rows stay on the executors.
    """
    table = tb.read_features(spark, features)
    done = read_manifest(spark, out).where(F.col("status") == "done").select(*CELL)
    cells = [r.asDict() for r in work_cells(table, variants).join(done, CELL, "left_anti").orderBy(*CELL).limit(most_cells or 1 << 30).collect()]
    pair = rows = None
    for cell in cells:
        try:
            if pair != (cell["log_type"], cell["embedding_type"]):
                pair, rows = (cell["log_type"], cell["embedding_type"]), None
                rows = labelled_rows(tb.read_features(spark, features, cell["embedding_type"], cell["log_type"]), use_pseudo_labels, seed)
            if rows is None:
                raise ValueError("the rows of this log type and embedding could not be labelled")
            attempt = uuid.uuid4().hex
            balanced = bl.balance(rows, cell["variant"], seed=seed)
            keyed = balanced.select("*", *[F.lit(cell[c]).alias(c) for c in CELL], F.lit(attempt).alias("attempt"))
            keyed.write.mode("append").partitionBy(*CELL, "attempt").parquet(f"{out}/balanced")
            written = spark.read.parquet(f"{out}/balanced").where((F.col("attempt") == attempt))
            quality = ct.oversampling_quality(rows, written).first().asDict()
            _finish(spark, out, cell, status="done", attempt=attempt, n_before=rows.count(), n_after=written.count(), **quality)
        except Exception as error:  # noqa: BLE001 - one cell must not end the batch; the manifest tells what went wrong
            _finish(spark, out, cell, status="error", message=f"{type(error).__name__}: {error}"[:500])
    return len(cells)
