"""Spark session helpers.

The library never creates its own cluster settings for production use: it
reads what the session has.  ``local_session`` is for tests and the bench.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared scratch folder of the session.

    A folder that the caller already gave to the SparkContext wins and is
    never replaced; otherwise ``spark.checkpoint.dir`` names it.  Only a
    ``local`` master (tests, bench) may fall back to a scratch folder of its
    own: on a cluster a machine-local folder would lose data, so it raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if current:
        return configured or current
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="evalframe-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, configured)
    sc.setCheckpointDir(configured)
    return configured


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "evalframe", driver_memory: str = "8g") -> SparkSession:
    """A local session tuned for the small test scale factors."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    log_dir = os.environ.get("EVALFRAME_EVENT_LOG_DIR")
    if log_dir:
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def cut_lineage(df):
    """Materialise ``df`` to the session's reliable checkpoint folder.

    Used between long stages so that a lost executor does not recompute the
    whole lineage.  Never a local checkpoint: those die with the executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

