"""Quality rules over long measurements (sample, feature, value): missingness, dispersion, internal standards, drop log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.quantiles import exact_quantiles
from cohortloom.session import cut

#: Limits of the rules.
FEATURE_MISSING, SAMPLE_MISSING, MISSING_GAP, RSD_LIMIT, MAD_LIMIT = 0.20, 0.50, 0.10, 30.0, 5.0
IQR_LOW, IQR_HIGH, IQR_FLOOR, IQR_CEILING, IQR_SAMPLES = 0.05, 0.95, 0.1, 5.0, 4


def missing_by_feature(df: DataFrame, feature: str, value: str, case: Column) -> DataFrame:
    """Share of missing values per feature in controls and cases, drop and warning marks."""
    gone = F.col(value).isNull().cast("double")
    x = df.withColumn("_case", case).groupBy(feature).agg(F.avg(F.when(~F.col("_case"), gone)).alias("control_missing"), F.avg(F.when(F.col("_case"), gone)).alias("case_missing"))
    over = lambda c: F.coalesce(F.col(c) > FEATURE_MISSING, F.lit(False))
    drop = over("control_missing") | over("case_missing")
    return x.select(feature, "control_missing", "case_missing", drop.alias("drop"), (~drop & F.coalesce(F.abs(F.col("control_missing") - F.col("case_missing")) > MISSING_GAP, F.lit(False))).alias("warn"))


def missing_by_window(df: DataFrame, feature: str, window: str, value: str, case: Column) -> DataFrame:
    """As above per time window: a feature is dropped if both arms miss too much in the same window."""
    gone = F.col(value).isNull().cast("double")
    x = df.withColumn("_case", case).groupBy(feature, window).agg(F.avg(F.when(~F.col("_case"), gone)).alias("a"), F.avg(F.when(F.col("_case"), gone)).alias("b"))
    high, edge = F.coalesce((F.col("a") > FEATURE_MISSING) & (F.col("b") > FEATURE_MISSING), F.lit(False)), lambda c: F.coalesce(F.col(c).between(MISSING_GAP, FEATURE_MISSING), F.lit(False))
    return x.groupBy(feature).agg(F.bool_or(high).alias("drop"), F.bool_or(edge("a") | edge("b")).alias("borderline"))


def poor_samples(df: DataFrame, sample: str, value: str, biological: Column) -> DataFrame:
    """Biological samples that miss more than half of their values."""
    return df.where(biological).groupBy(sample).agg(F.avg(F.col(value).isNull().cast("double")).alias("missing")).where(F.col("missing") > SAMPLE_MISSING)


def rsd(df: DataFrame, feature: str, batch: str, value: str, least: int = 2) -> DataFrame:
    """Relative standard deviation of pools per batch; a feature fails if any batch is above the limit or undefined."""
    x = df.groupBy(feature, batch).agg(F.count(value).alias("n"), F.stddev_samp(value).alias("sd"), F.avg(value).alias("m")).where(F.col("n") >= least)
    r = F.col("sd") / F.nullif(F.col("m"), F.lit(0.0)) * 100
    return x.withColumn("rsd", r).groupBy(feature).agg(F.max("rsd").alias("worst_rsd"), F.bool_or(F.coalesce(F.col("rsd") > RSD_LIMIT, F.lit(True))).alias("fails"))


def mad_outliers(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows further than five raw median deviations from the median of their keys; a zero deviation flags none."""
    mid = exact_quantiles(df, keys, value, {"mid": 0.5}).drop("n")
    x = cut(df.where(F.col(value).isNotNull()).join(mid, keys).withColumn("_dev", F.abs(F.col(value) - F.col("mid"))))
    mad = exact_quantiles(x, keys, "_dev", {"mad": 0.5}).drop("n")
    return x.join(mad, keys).where((F.col("mad") > 0) & (F.col("_dev") > MAD_LIMIT * F.col("mad"))).drop("_dev")


def iqr_filter(df: DataFrame, feature: str, timepoint: str, value: str) -> DataFrame:
    """Median over timepoints of the interquartile range; flat and wild features are marked against all features."""
    q = exact_quantiles(df, [feature, timepoint], value, {"q1": 0.25, "q3": 0.75}).where(F.col("n") >= IQR_SAMPLES).select(feature, (F.col("q3") - F.col("q1")).alias("iqr"))
    per = q.groupBy(feature).agg(F.median("iqr").alias("iqr"))  # one row per timepoint
    lo, hi = (per.agg(F.percentile("iqr", p)).scalar() for p in (IQR_LOW, IQR_HIGH))
    flat = (F.col("iqr") < lo) & (F.col("iqr") < IQR_FLOOR)
    wild = (F.col("iqr") > hi) & (F.col("iqr") > IQR_CEILING)
    return per.select(feature, "iqr", (flat | wild).alias("drop"))


def taxa_filter(df: DataFrame, sample: str, feature: str, count: str, least_reads: int = 3, prevalence: float = 0.10, abundance: float = 0.005) -> DataFrame:
    """Features with enough reads in enough samples and a sufficient mean share of their samples."""
    total = df.groupBy(sample).agg(F.sum(count).alias("_total"))
    x = df.join(total, sample)
    return x.groupBy(feature).agg(F.avg((F.col(count) >= least_reads).cast("double")).alias("prevalence"), F.avg(F.col(count) / F.col("_total")).alias("mean_share")).where((F.col("prevalence") >= prevalence) & (F.col("mean_share") >= abundance))


def contaminants(df: DataFrame, sample: str, feature: str, count: str, control: Column, share: float = 0.01) -> DataFrame:
    """Features with a notable share in a negative control and in a study sample."""
    total = df.groupBy(sample).agg(F.sum(count).alias("_total"))
    x = df.join(total, sample).withColumn("_high", F.col(count) / F.col("_total") >= share).withColumn("_control", control)
    return x.groupBy(feature).agg(F.bool_or(F.col("_high") & F.col("_control")).alias("in_control"), F.bool_or(F.col("_high") & ~F.col("_control")).alias("in_study")).select(feature, (F.col("in_control") & F.col("in_study")).alias("contaminant"))


def drop_log(before: DataFrame, steps: list[tuple[str, DataFrame]], entity: str) -> DataFrame:
    """One row per entity and the first step that dropped it."""
    log = reduce(DataFrame.unionByName, (d.select(entity, F.lit(i).alias("step"), F.lit(name).alias("step_name")) for i, (name, d) in enumerate(steps, 1)))
    return before.select(entity).distinct().join(log.groupBy(entity).agg(F.min(F.struct("step", "step_name")).alias("s")), entity).select(entity, "s.step", "s.step_name")
