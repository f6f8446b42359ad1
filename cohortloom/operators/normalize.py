"""Normalisation and transforms over long measurements."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.quantiles import exact_quantiles


def half_min(df: DataFrame, feature: str, value: str, logged: bool = True) -> DataFrame:
    """Missing values become half the feature's least one (one less on the log2 scale); features without any stay."""
    low = df.groupBy(feature).agg(F.min(value).alias("_low"))
    fill = F.col("_low") - 1 if logged else F.col("_low") / 2
    return df.join(low, feature, "left").withColumn(value, F.coalesce(F.col(value), fill)).drop("_low")


def geometric_mean(c: Column) -> Column:
    """Over positive values."""
    return F.exp(F.avg(F.log(F.when(c > 0, c))))


def by_standards(df: DataFrame, sample: str, batch: str, value: str, standard: Column) -> DataFrame:
    """Values over the geometric mean of their sample's standards, else the batch's median of it, else the overall one."""
    own = df.where(standard).groupBy(sample).agg(geometric_mean(F.col(value)).alias("_own"))
    samples = df.select(sample, batch).distinct().join(own, sample, "left")
    per_batch = exact_quantiles(samples, [batch], "_own", {"_batch": 0.5}).drop("n")
    overall = samples.agg(F.median("_own")).scalar()
    factor = samples.join(per_batch, batch, "left").select(sample, F.coalesce("_own", "_batch", overall).alias("_factor"))
    return df.where(~standard).join(factor, sample).withColumn(value, F.col(value) / F.col("_factor")).drop("_factor")


#: The internal standard that lipids of a class are divided by.
CLASS_STANDARDS = {
    "LPC": "18:1_LPC-d7",
    "LPE": "18:1_LPC-d7",
    "LPI": "18:1_LPC-d7",
    "LPG": "18:1_LPC-d7",
    "LPS": "18:1_LPC-d7",
    "LPA": "18:1_LPC-d7",
    "PC": "15:0/18:1_PC-d7",
    "PE": "15:0/18:1_PC-d7",
    "PI": "15:0/18:1_PC-d7",
    "PG": "15:0/18:1_PC-d7",
    "PS": "15:0/18:1_PC-d7",
    "PA": "15:0/18:1_PC-d7",
    "SM": "18:1_SM-d9",
    "Cer": "18:1_SM-d9",
    "HexCer": "18:1_SM-d9",
    "DG": "15:0/18:1_DG-d7",
    "MG": "15:0/18:1_DG-d7",
    "TG": "15:0/18:1/15:0_TG-d7",
    "CE": "18:1_CE-d7",
}


def by_class_standards(df: DataFrame, sample: str, batch: str, feature: str, kind: str, value: str, standard: Column, classes: dict[str, str] = CLASS_STANDARDS) -> DataFrame:
    """Values over the standard of their class in the sample; where the class has none, or it is not positive there,
    over the geometric mean of the sample's standards, else the batch's median of it, else the overall one.

    ``matched`` says which. classes is a short list; standards are few per sample.
    """
    std = df.where(standard)
    own = std.groupBy(sample).agg(geometric_mean(F.col(value)).alias("_own"))
    samples = df.select(sample, batch).distinct().join(own, sample, "left")
    per_batch = exact_quantiles(samples, [batch], "_own", {"_batch": 0.5}).drop("n")
    overall = samples.agg(F.median("_own")).scalar()
    pooled = samples.join(per_batch, batch, "left").select(F.col(sample).alias("_s"), F.coalesce("_own", "_batch", overall).alias("_pooled"))
    named = F.lit(None).cast("string")
    for k, name in classes.items():
        named = F.when(F.col(kind) == k, name).otherwise(named)
    one = std.groupBy(F.col(sample).alias("_s1"), F.col(feature).alias("_f1")).agg(F.max(F.when(F.col(value) > 0, F.col(value))).alias("_one"))
    x = df.where(~standard).withColumn("_n", named).join(one, (F.col(sample) == F.col("_s1")) & (F.col("_n") == F.col("_f1")), "left").join(pooled, F.col(sample) == F.col("_s"))
    return x.withColumn(value, F.col(value) / F.coalesce("_one", "_pooled")).withColumn("matched", F.col("_one").isNotNull()).drop("_n", "_s1", "_f1", "_one", "_s", "_pooled")


def batch_factors(df: DataFrame, feature: str, batch: str, value: str, pool: Column, reference) -> DataFrame:
    """Median over features of the batch's pool median over the reference batch's."""
    m = exact_quantiles(df.where(pool), [feature, batch], value, {"mid": 0.5}).drop("n")
    ref = m.where(F.col(batch) == reference).select(feature, F.col("mid").alias("_ref"))
    ratio = m.join(ref, feature).where(F.col("_ref") != 0).withColumn("_ratio", F.col("mid") / F.col("_ref"))
    return ratio.groupBy(batch).agg(F.median("_ratio").alias("factor"))  # one row per feature


def panel_shift(df: DataFrame, keys: list[str], panel: str, value: str) -> DataFrame:
    """Bring the median of every panel to the median of the panels' medians within its keys."""
    mid = exact_quantiles(df, [*keys, panel], value, {"_mid": 0.5}).drop("n")
    goal = mid.groupBy(*keys).agg(F.median("_mid").alias("_goal"))
    return df.join(mid, [*keys, panel]).join(goal, keys).withColumn(value, F.col(value) - F.col("_mid") + F.col("_goal")).drop("_mid", "_goal")


def location_scale(df: DataFrame, feature: str, batch: str, value: str, reference) -> DataFrame:
    """Every batch's mean and spread brought to those of the reference batch; spread without meaning counts as 1."""
    s = df.groupBy(feature, batch).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"), F.count(value).alias("_n"))
    good = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0), F.col(c)).otherwise(1.0)
    ref = s.where((F.col(batch) == reference) & (F.col("_n") >= 2)).select(feature, F.col("_m").alias("_rm"), good("_s").alias("_rs"))
    x = df.join(s, [feature, batch]).join(ref, feature, "left")
    return x.withColumn(value, F.coalesce((F.col(value) - F.col("_m")) / good("_s") * F.col("_rs") + F.col("_rm"), F.col(value))).drop("_m", "_s", "_n", "_rm", "_rs")


def clr(df: DataFrame, sample: str, value: str) -> DataFrame:
    """Logarithm less the sample's mean logarithm; values must be positive."""
    m = df.groupBy(sample).agg(F.avg(F.log(value)).alias("_m"))
    return df.join(m, sample).withColumn(value, F.log(value) - F.col("_m")).drop("_m")


def shares(df: DataFrame, sample: str, value: str) -> DataFrame:
    """Value over its sample's total."""
    total = df.groupBy(sample).agg(F.sum(value).alias("_t"))
    return df.join(total, sample).withColumn("share", F.col(value) / F.nullif(F.col("_t"), F.lit(0))).drop("_t")


def zeros_replaced(df: DataFrame, sample: str, count: str) -> DataFrame:
    """Count-zero multiplicative replacement: zeros take a prior's share, the others give it up in proportion.

    The prior is that of the square root of the total, spread evenly over the sample's features, cut at 0.65 of the
    least non-zero share. Samples without any count have no shares.
    """
    s = df.groupBy(sample).agg(F.sum(count).alias("_n"), F.count(F.lit(1)).alias("_d"), F.sum((F.col(count) == 0).cast("int")).alias("_z"), F.min(F.when(F.col(count) > 0, F.col(count))).alias("_low"))
    strength = F.sqrt("_n")
    put = F.least(strength / F.col("_d") / (F.nullif(F.col("_n"), F.lit(0)) + strength), 0.65 * F.col("_low") / F.nullif(F.col("_n"), F.lit(0)))
    x = df.join(s, sample).withColumn("_r", put)
    return x.withColumn("share", F.when(F.col(count) == 0, F.col("_r")).otherwise(F.col(count) / F.nullif(F.col("_n"), F.lit(0)) * (1 - F.col("_z") * F.col("_r")))).drop("_n", "_d", "_z", "_low", "_r")


def robust_scaled(df: DataFrame, feature: str, value: str, fit: Column) -> DataFrame:
    """Less the median, over the interquartile range, both of the rows to fit on; a zero range counts as 1."""
    q = exact_quantiles(df.where(fit), [feature], value, {"_a": 0.25, "_b": 0.5, "_c": 0.75}).drop("n")
    width = F.when(F.col("_c") - F.col("_a") > 0, F.col("_c") - F.col("_a")).otherwise(1.0)
    return df.join(q, feature).withColumn("scaled", (F.col(value) - F.col("_b")) / width).drop("_a", "_b", "_c")


def combat(df: DataFrame, sample: str, feature: str, batch: str, value: str, rounds: int = 30, mean_only: bool = False) -> DataFrame:
    """Empirical-Bayes batch correction (parametric, without covariates).

    Features are standardised by the pooled spread, batch effects shrunk to the batch's common prior, and taken out. A
    single batch, features without spread and missing values come back unchanged. Batch means and variances per
    feature, and the priors per batch, are plain aggregates; only the fixed point of each (feature, batch) row is
    solved in Python.
    """
    x = df.where(F.col(value).isNotNull())
    per = x.groupBy(feature, batch).agg(F.count(F.lit(1)).alias("n_b"), F.avg(value).alias("m_b"), F.sum(F.col(value) * F.col(value)).alias("q_b"))
    f = per.groupBy(feature).agg(F.sum("n_b").alias("n"), (F.sum(F.col("n_b") * F.col("m_b")) / F.sum("n_b")).alias("grand"),
                                 F.sqrt(F.sum(F.col("q_b") - F.col("n_b") * F.col("m_b") * F.col("m_b")) / F.sum("n_b")).alias("pooled"), F.count(F.lit(1)).alias("n_batches")).where("pooled > 1e-12 and n_batches > 1")
    s = per.join(f, feature).withColumn("gamma", (F.col("m_b") - F.col("grand")) / F.col("pooled")).withColumn(
        "delta", (F.col("q_b") - F.col("n_b") * F.col("m_b") * F.col("m_b")) / F.nullif(F.col("n_b") - 1, F.lit(0)) / (F.col("pooled") * F.col("pooled")))
    prior = s.groupBy(batch).agg(F.avg("gamma").alias("g_bar"), F.var_samp("gamma").alias("t2"), F.avg("delta").alias("d_bar"), F.var_samp("delta").alias("d_var"))
    rows = s.join(prior, batch).select(feature, batch, "n_b", "grand", "pooled", "gamma", "delta", "g_bar", "t2", "d_bar", "d_var")
    schema = rows.select(feature, batch, "grand", "pooled").schema.add("gamma_star", "double").add("delta_star", "double")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            n, g, d = p["n_b"].to_numpy(float), p["gamma"].to_numpy(float), p["delta"].fillna(1.0).to_numpy(float)
            gb, t2 = p["g_bar"].to_numpy(float), p["t2"].fillna(0.0).to_numpy(float)
            m, v = p["d_bar"].fillna(1.0).to_numpy(float), p["d_var"].fillna(0.0).to_numpy(float)
            v = np.where(v > 1e-12, v, 1e-12)
            a, b = (2 * v + m * m) / v, (m * v + m**3) / v
            gs, ds = g.copy(), np.maximum(d, 1e-12)
            for _ in range(rounds):
                gs = (t2 * n * g + ds * gb) / np.maximum(t2 * n + ds, 1e-12)
                around = (n - 1) * d + n * (g - gs) ** 2
                ds = (0.5 * around + b) / (n / 2 + a - 1)
            out = p[[feature, batch, "grand", "pooled"]].copy()
            out["gamma_star"], out["delta_star"] = gs, np.ones_like(ds) if mean_only else ds
            yield out

    star = rows.mapInPandas(solve, schema)
    y = df.join(star, [feature, batch], "left")
    z = ((F.col(value) - F.col("grand")) / F.col("pooled") - F.col("gamma_star")) / F.sqrt("delta_star")
    return y.withColumn(value, F.when(F.col("pooled").isNotNull(), z * F.col("pooled") + F.col("grand")).otherwise(F.col(value))).drop("grand", "pooled", "gamma_star", "delta_star")
