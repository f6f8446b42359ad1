"""Readers for the project's parquet tables and the normal forms that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.text import norm_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; columns and filters are pushed into the scan by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reference_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every reference of problem 1 as ``kind, key, at, period, table_name, row_id, ref_field``; each table is read once."""
    out = None
    for name, fields in (
        ("processed_clinical_data", {"id": "participant"}),
        ("processed_placental_data", {"id": "participant"}),
        ("sample_metadata", {"subject_id": "participant", "metadata_canonical_id": "sample"}),
    ):
        at = F.col("loaded_at").cast("timestamp_ntz")
        refs = F.array(*(F.struct(F.lit(kind).alias("kind"), norm_id(F.col(f)).alias("key"), F.lit(f).alias("ref_field")) for f, kind in fields.items()))
        x = table(spark, d, name).select("row_id", at.alias("at"), F.explode(refs).alias("r")).where("r.key is not null").select(
            "r.kind", "r.key", "at", F.date_format("at", "yyyy-MM").alias("period"), F.lit(name).alias("table_name"), "row_id", "r.ref_field")
        out = x if out is None else out.unionByName(x)
    return out


def live_spans(spark: SparkSession, d: str) -> DataFrame:
    """When participants and samples are there: registry rows, and samples from their first loading on."""
    ntz = "timestamp_ntz"
    people = table(spark, d, "cohort_registry").select(
        F.lit("participant").alias("kind"), norm_id(F.col("id")).alias("key"), F.col("registered_at").cast(ntz).alias("start"), F.col("deleted_at").cast(ntz).alias("end"))
    samples = table(spark, d, "sample_metadata").groupBy(norm_id(F.col("sample_id")).alias("key")).agg(F.min("loaded_at").cast(ntz).alias("start")).select(
        F.lit("sample").alias("kind"), "key", "start", F.lit(None).cast(ntz).alias("end"))
    return people.unionByName(samples)
