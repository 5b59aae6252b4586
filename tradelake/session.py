"""Spark session and checkpoint-directory helpers.

The library itself never creates a session behind the caller's back; these helpers are for
tests, the benchmark and command-line use.  On a cluster, ``spark.checkpoint.dir`` must name
a shared folder; a machine-local temporary folder is only chosen for local masters.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "tradelake",
    driver_memory: str = "8g",
    extra: dict[str, str] | None = None,
    call_sites_in_errors: bool = False,
) -> SparkSession:
    """Session for tests, the benchmark and command-line jobs.

    ``call_sites_in_errors=False`` turns off PySpark's per-call capture of the Python call site
    (several JVM round trips for every Column function); plans with many expressions, such as
    the correlation matrix, are otherwise built slower than they run."""
    master = master or os.environ.get("TRADELAKE_MASTER", "local[*]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", str(call_sites_in_errors).lower())
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory, configuring it from ``spark.checkpoint.dir``.

    A private temporary folder is created only when the setting is absent and the master is
    local (tests, benchmark).  On a cluster an unset directory is an error: executors must be
    able to reread checkpoints after a loss, so the folder has to be shared storage.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at shared storage for this cluster"
            )
        configured = tempfile.mkdtemp(prefix="tradelake-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


TASK_BYTES = 4 * 1024 * 1024  # of input files, a few hundred thousand rows of a columnar table


def tasks_for(df: DataFrame) -> int:
    """Partitions for a shuffle that holds about all rows of ``df``, by the size of its input files, so that a
    task's rows do not grow with the input; the session's number if it reads none.  Given as a number, Spark
    does not merge them by their compressed size, which says little about rows in memory."""
    spark, size = df.sparkSession, 0
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for name in df.inputFiles():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(name))
        size += path.getFileSystem(hadoop).getFileStatus(path).getLen()
    return max(spark.sparkContext.defaultParallelism, size // TASK_BYTES) if size else int(spark.conf.get("spark.sql.shuffle.partitions"))
