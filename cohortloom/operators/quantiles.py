"""Exact quantiles per group for groups of any size.

Values are first counted per group and value (map-side), then per group and bucket; ranks are carried over buckets, and
only values of the buckets that hold a wanted rank are ordered. Buckets are relative to size, 256 to each doubling, so
that scores below one and intensities of billions are spread alike; only values within 0.3 % of each other share one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(v: Column) -> Column:
    """A whole number that never falls as v grows: 256 to each doubling of size, those of negative values mirrored."""
    size = F.floor(F.log2(F.least(F.abs(v), F.lit(1.7e308))) * 256) + 300_000  # the smallest numbers lie above zero
    return F.when(v > 0, size).when(v < 0, -size).otherwise(0)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One row per group: the keys, ``n``, and one column per entry of probs, by linear interpolation.

    Null and NaN values are left out; groups without a value give no row; null keys form a group.
    """
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    return quantiles_of_counts(clean.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c")), keys, probs)


def quantiles_of_counts(counted: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """As exact_quantiles, from one row per keys and value: ``_v`` and its count ``_c``."""
    counted = counted.withColumn("_b", bucket(F.col("_v")))
    by_bucket = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    buckets = counted.groupBy(*keys, "_b").agg(F.sum("_c").alias("_n")).withColumn("_before", F.sum("_n").over(by_bucket) - F.col("_n")).withColumn("n", F.sum("_n").over(whole))
    wanted: dict[str, tuple[Column, Column]] = {k: (F.floor((F.col("n") - 1) * q), F.ceil((F.col("n") - 1) * q)) for k, q in probs.items()}
    holds = F.lit(False)
    for lo, hi in wanted.values():
        holds = holds | ((F.col("_before") <= hi) & (F.col("_before") + F.col("_n") > lo))
    kept = buckets.where(holds).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_b").alias("_bb"), "_before", "n")
    on = F.col("_b") == F.col("_bb")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    within = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.join(kept, on).select(*keys, "_b", "_v", "_c", "_before", "n").withColumn("_to", F.col("_before") + F.sum("_c").over(within)).withColumn("_from", F.col("_to") - F.col("_c"))
    at = lambda r: F.max(F.when((F.col("_from") <= r) & (F.col("_to") > r), F.col("_v")))
    ends = ranked.groupBy(*keys, "n").agg(*(x for k, (lo, hi) in wanted.items() for x in (at(lo).alias(f"_{k}_lo"), at(hi).alias(f"_{k}_hi"))))
    frac = lambda q: (F.col("n") - 1) * q - F.floor((F.col("n") - 1) * q)
    return ends.select(*keys, "n", *((F.col(f"_{k}_lo") + (F.col(f"_{k}_hi") - F.col(f"_{k}_lo")) * frac(q)).alias(k) for k, q in probs.items()))
