"""Session construction and lineage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "embedscope",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Local/test session with AQE on and the UI off.

    On a cluster the caller's session builder is used instead; nothing here
    is required by the operators themselves.
    """
    master = master or os.environ.get("EMBEDSCOPE_MASTER", "local[8]")
    cores = _cores_of(master)
    parts = shuffle_partitions or max(8, cores)
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("EMBEDSCOPE_DRIVER_MEMORY", "16g"))
        .config("spark.python.worker.reuse", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _cores_of(master: str) -> int:
    if master.startswith("local["):
        inner = master[len("local["):-1].split(",")[0]
        if inner == "*":
            return os.cpu_count() or 8
        try:
            return int(inner)
        except ValueError:
            return 8
    return 8


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that
    setting is read and used as is.  Only a local-mode session without the
    setting (tests, laptops) gets a fresh temporary folder.  A cluster
    session without the setting is an error: a machine-local folder would
    not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="embedscope-ckpt-")
        sc.setCheckpointDir(path)
        return sc.getCheckpointDir()
    raise RuntimeError(
        "spark.checkpoint.dir is not set; iterative operators need a shared "
        "checkpoint folder on the cluster")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as a Parquet table in the shared
    checkpoint folder and read them back.

    A written table survives the loss of executors like a reliable
    checkpoint, and unlike ``Dataset.checkpoint`` it gives the planner the
    real size of the data: a checkpoint carries the estimate of the plan it
    replaces, and in an iterative job (connected components, Boruvka
    rounds) those estimates multiply round after round until planning
    itself stalls.
    """
    base = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{base}/embedscope-cut/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def default_parallelism(spark: SparkSession) -> int:
    try:
        return max(1, int(spark.sparkContext.defaultParallelism))
    except Exception:  # pragma: no cover - connect sessions
        return 8
