"""Session helpers: one place for the Spark settings the library relies on.

On a cluster the session is created by the platform; ``configure`` only
fills in settings that are not set yet, so cluster values always win.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the operators are written against. AQE re-plans shuffles at run
# time (partition coalescing, skew-join splitting, broadcast conversion when a
# side turns out small); the session time zone pins timestamp text.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # what a task and its Python worker each hold of whole texts at a time
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "bourse") -> SparkSession:
    """Local session for tests and the bench (UI off, no extra ports)."""
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", os.environ.get("BOURSE_DRIVER_MEMORY", "16g"))
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
         .config("spark.default.parallelism", str(cpus)))
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply DEFAULTS where unset and make sure a checkpoint folder exists."""
    for k, v in DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The cluster's value is used as is. When nothing is set, a session on a
    local master gets a fresh private folder; any other master is an error,
    since executors cannot see a folder of the driver's machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="bourse-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder below the shared checkpoint folder.

    Used for written intermediate tables (landed files, store versions)
    so that every executor and a restarted job can read them. A lazy result
    reads them later, so they stay until ``remove_scratch`` is called.
    """
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/bourse/{name}-{uuid.uuid4().hex[:12]}"


def remove_scratch(spark: SparkSession) -> None:
    """Remove every folder that ``scratch_path`` named, once no result needs them any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark).rstrip('/')}/bourse")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
