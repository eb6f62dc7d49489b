"""Session construction and the few cluster settings the library depends on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "quarry") -> SparkSession:
    """Build (or reuse) a session. The launcher's settings (spark-submit, spark-defaults) win; the
    defaults here only fill what is unset."""
    from pyspark import SparkContext
    memory = os.environ.get("QUARRY_DRIVER_MEMORY", "16g")
    if SparkContext._gateway is None and "PYSPARK_GATEWAY_PORT" not in os.environ:  # no launcher: the JVM starts here
        os.environ.setdefault("PYSPARK_SUBMIT_ARGS", f"--driver-memory {memory} pyspark-shell")
    SparkContext._ensure_initialized()
    launched = SparkContext._jvm.org.apache.spark.SparkConf(True)
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    own = dict(_LOCAL_DEFAULTS)
    if shuffle_partitions:
        own["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if (master or "").startswith("local"):  # single small files: deal their rows over the cores (profile.spread)
        own["spark.quarry.inputPartitions"] = str(shuffle_partitions or os.cpu_count() or 1)
    for k, v in own.items():
        if not launched.contains(k) or k == "spark.ui.showConsoleProgress":  # the shell's own default
            builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster in spark.checkpoint.dir.

    Only when the setting is absent and the master is local do we choose a scratch folder: on a cluster a
    folder of one machine is of no use to the others, so the setting must be there."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="quarry-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
