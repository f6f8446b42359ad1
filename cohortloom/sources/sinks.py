"""Writers: delimited files, files per timepoint, text lists, reports and run manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_slices(df: DataFrame, path: str, by: str, fmt: str = "parquet") -> None:
    """One folder per value; rows of a value go to as many files as it has tasks, so that a hot value is no single file."""
    df.write.mode("overwrite").partitionBy(by).format(fmt).save(path)


def write_lines(df: DataFrame, line: str, path: str) -> None:
    df.where(F.col(line).isNotNull()).select(line).write.mode("overwrite").text(path)


def report_lines(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Fixed-width lines of a small table."""
    return df.select(F.concat(*(F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), w, " ") for c, w in widths.items())).alias("line"))


def manifest(df: DataFrame, run: dict[str, str]) -> DataFrame:
    """One row about a run: its parameters, rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(*(F.lit(v).alias(k) for k, v in run.items()), "n_rows", F.lit(len(df.columns)).alias("n_columns"))


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file on any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(data), 0, len(data))
    finally:
        out.close()
