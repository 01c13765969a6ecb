"""Spark session defaults and the shared checkpoint folder.

The builder here is what a user would write for these reports: AQE on (partition
coalescing, runtime broadcast switch, skew-join splitting), UTC session time,
ANSI on, no web UI.  On a cluster the session already exists and only
``checkpoint_dir`` is used.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

#: Session settings the reports rely on (time zone for date/timestamp casts,
#: AQE for skewed joins and small-result coalescing).
REPORT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join partition even when that costs an extra shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    master: str | None = "local[*]",
    shuffle_partitions: int | None = 8,
    app_name: str = "freightlens",
    extra: dict | None = None,
) -> SparkSession:
    """Local/test session.  With ``master=None`` the launcher's master and
    cluster settings are kept (spark-submit); only the report SQL options are
    added."""
    b = SparkSession.builder.appName(app_name).config("spark.ui.enabled", "false")
    if master is not None:
        b = b.master(master).config(
            "spark.driver.memory", os.environ.get("FREIGHTLENS_DRIVER_MEMORY", "8g")
        )
    if shuffle_partitions is not None:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**REPORT_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


#: What an existing session must have for right results and skew handling;
#: partition sizes stay as the cluster has them.
REQUIRED_CONF = ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")


def apply_report_conf(spark: SparkSession) -> None:
    """Set the session-level SQL options on an existing session."""
    for k in REQUIRED_CONF:
        spark.conf.set(k, REPORT_CONF[k])


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in ``spark.checkpoint.dir``."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    return d or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's checkpoint folder; only when none is set (local runs,
    tests) create a scratch one."""
    d = checkpoint_dir(spark)
    if d:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(d)
        return d
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    d = tempfile.mkdtemp(prefix="freightlens-ckpt-")
    spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d
