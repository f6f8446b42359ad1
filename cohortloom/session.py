"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str | int = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A session for one machine: tests and bench. On a cluster the caller brings the session."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("cohortloom")
    for k, v in (SETTINGS | {"spark.sql.shuffle.partitions": str(partitions)} | extra).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_shared_dir(spark: SparkSession) -> None:
    """Make sure that checkpoints go to the folder named in spark.checkpoint.dir.

    Only where that setting is absent and the master runs in this process is a folder of this machine used.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        sc.setCheckpointDir(named)
    elif sc.master == "local" or sc.master.startswith("local["):
        sc.setCheckpointDir("file://" + os.path.join(tempfile.gettempdir(), "cohortloom-checkpoints"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and go on from there; survives the loss of executors."""
    ensure_shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast if it is counted and has at most this many rows; df should be cheap to count, as after cut."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
