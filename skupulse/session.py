"""Spark session helpers.

On a cluster the session is created by the platform; ``get_session`` only
fills in settings that are unset, so cluster-level values (shuffle
partitions, checkpoint dir, memory) always win.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every plan in this library assumes.  ANSI mode stays on (Spark 4
# default); all casts and divisions that may fail use try_* forms.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "skupulse") -> SparkSession:
    """Return the active session, or build a local one for tests/bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("SKUPULSE_DRIVER_MEM", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only when the setting is absent (local tests) a scratch folder is made
    and registered; on a cluster the configured shared path is used as is.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster; "
                           "a machine-local scratch folder is only used in local mode")
    known = spark.sparkContext.getCheckpointDir()
    if known is None:
        known = tempfile.mkdtemp(prefix="skupulse-ckpt-")
        spark.sparkContext.setCheckpointDir(known)
    return known


def materialize(df):
    """Cut lineage: write ``df`` once to the checkpoint folder and read it back.

    Used where one derived input (e.g. a month of order lines from a 5-way
    join) feeds many branches of a plan: the join runs once, every branch
    scans the checkpoint, and a lost executor re-reads files instead of
    recomputing the join.  Reliable checkpoint only (never a local one).
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def share(df):
    """Write ``df`` once as a columnar table in the shared checkpoint folder and
    read it back: several branches of a plan scan it, each only the columns and
    row groups that it needs."""
    path = f"{checkpoint_dir(df.sparkSession)}/shared-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
