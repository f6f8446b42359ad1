"""Streaming extension: windows, sessions and deduplication over a stream of events.

The reference work has no stream; these are offered beside it. Batch twins of the same plans give the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.session import ensure_shared_dir


def tumbling(events: DataFrame, at: str, keys: list[str], value: str, width: str = "7 days", late: str = "1 hour") -> DataFrame:
    """Count and sum per window and keys."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, at: str, keys: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events per session: runs of events of one key without a longer gap."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), *keys, "n")


def unique_events(events: DataFrame, at: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """First of each key within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def run_to_end(spark: SparkSession, df: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there and read its result back from the shared folder: the final state of an
    aggregating one, or (mode append) all rows it lets through. A batch that is run again replaces its own rows."""
    ensure_shared_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows" + (f"/batch={number}" if mode == "append" else ""))

    df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/rows")
