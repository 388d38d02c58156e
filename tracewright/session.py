"""Session settings, the shared working folder, and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "tracewright", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are written for.

    On a cluster ``master`` and sizing come from spark-submit; the values here
    only turn on adaptive execution (runtime join choice, skew splitting,
    partition coalescing) and pin the time zone.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    settings.update({k: str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="tracewright-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/tracewright/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "step", lean: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage with a durable columnar copy: later reads survive executor
    loss, prune columns, and give the optimizer true sizes for join choice.
    ``lean`` keeps disk low: files are packed tighter, and what was shuffled for
    them goes as soon as they are written.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    if lean:
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path, **({"compression": "zstd"} if lean else {}))
    finally:
        if lean:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.is_settled, out.settled_at = True, path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.settled_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_workspace(spark: SparkSession) -> bool:
    """Delete the folder that holds this application's settled tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
