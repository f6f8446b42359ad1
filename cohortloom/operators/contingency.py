"""Tests on tables of counts and on group means; over-representation; standardised differences."""

from __future__ import annotations

import math
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric(a: int, b: int, c: int, d: int, side: str) -> float:
    """Fisher's exact p of the table [[a, b], [c, d]]: side "two" or "greater"."""
    row, col, n = a + b, a + c, a + b + c + d
    lo, hi = max(0, row + col - n), min(row, col)
    p = lambda x: math.exp(_log_choose(col, x) + _log_choose(n - col, row - x) - _log_choose(n, row))
    if side == "greater":
        return min(1.0, sum(p(x) for x in range(a, hi + 1)))
    here = p(a) * (1 + 1e-7)
    return min(1.0, sum(v for x in range(lo, hi + 1) if (v := p(x)) <= here))


def _fisher(side: str):
    @F.pandas_udf(T.DoubleType())
    def f(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([hypergeometric(int(w), int(x), int(y), max(int(z), 0), side) if min(w, x, y) >= 0 else None for w, x, y, z in zip(a, b, c, d, strict=True)], dtype="float64")

    return f


def fisher(a: Column, b: Column, c: Column, d: Column, side: str = "two") -> Column:
    """Exact p; a negative last cell counts as zero. Meant for one row per test."""
    return _fisher(side)(a, b, c, d)


def chi_square(df: DataFrame, row: str, column: str, yates: bool = True) -> DataFrame:
    """Pearson's statistic of a contingency table, with the 2 x 2 correction, and its degrees of freedom."""
    n = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(F.count(F.lit(1)).alias("o"))
    r, c = n.groupBy(row).agg(F.sum("o").alias("r")), n.groupBy(column).agg(F.sum("o").alias("c"))
    size = n.agg(F.sum("o")).scalar()
    # a contingency table has as many cells as its labels allow: every row label meets every column label
    grid = r.join(c.withColumn("_all", F.lit(1)), F.col("_all") == 1).join(n, [row, column], "left")
    e = F.col("r") * F.col("c") / size
    k = grid.select(F.coalesce("o", F.lit(0)).alias("o"), e.alias("e"), row, column)
    shape = k.agg(F.countDistinct(row).alias("nr"), F.countDistinct(column).alias("nc"), F.sum(F.pow(F.col("o") - F.col("e"), F.lit(2)) / F.col("e")).alias("plain"),
                  F.sum(F.pow(F.greatest(F.abs(F.col("o") - F.col("e")) - 0.5, F.lit(0.0)), F.lit(2)) / F.col("e")).alias("corrected"))
    two = (F.col("nr") == 2) & (F.col("nc") == 2) & F.lit(yates)
    return shape.select(F.when(two, F.col("corrected")).otherwise(F.col("plain")).alias("chi2"), ((F.col("nr") - 1) * (F.col("nc") - 1)).alias("df"))


def anova(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """F of the one-way analysis of variance from counts, sums and squares per group."""
    g = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(*keys, group).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    t = g.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between, within = F.col("b") - F.col("s") * F.col("s") / F.col("n"), F.col("q") - F.col("b")
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    return t.select(*keys, ((between / F.nullif(d1, F.lit(0))) / F.nullif(within / F.nullif(d2, F.lit(0)), F.lit(0.0))).alias("f"), d1.alias("df1"), d2.alias("df2"))


def welch(df: DataFrame, keys: list[str], value: str, second: Column) -> DataFrame:
    """Welch's t and its degrees of freedom."""
    x = df.withColumn("_g", second).where(F.col("_g").isNotNull() & F.col(value).isNotNull())
    part = lambda f, g: f(F.when(F.col("_g") == F.lit(g), F.col(value)))
    s = x.groupBy(*keys).agg(*(part(f, g).alias(f"{k}{int(g)}") for g in (False, True) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    a, b = F.col("v0") / F.nullif(F.col("n0"), F.lit(0)), F.col("v1") / F.nullif(F.col("n1"), F.lit(0))
    df_ = (a + b) * (a + b) / F.nullif(a * a / F.nullif(F.col("n0") - 1, F.lit(0)) + b * b / F.nullif(F.col("n1") - 1, F.lit(0)), F.lit(0.0))
    return s.select(*keys, ((F.col("m0") - F.col("m1")) / F.sqrt(F.nullif(a + b, F.lit(0.0)))).alias("t"), df_.alias("df"))


def smd_continuous(df: DataFrame, keys: list[str], value: str, second: Column) -> DataFrame:
    """Difference of means over the root of the mean variance."""
    x = df.withColumn("_g", second).where(F.col("_g").isNotNull())
    part = lambda f, g: f(F.when(F.col("_g") == F.lit(g), F.col(value)))
    s = x.groupBy(*keys).agg(*(part(f, g).alias(f"{k}{int(g)}") for g in (False, True) for k, f in (("m", F.avg), ("v", F.var_samp))))
    return s.select(*keys, F.abs((F.col("m0") - F.col("m1")) / F.sqrt(F.nullif((F.col("v0") + F.col("v1")) / 2, F.lit(0.0)))).alias("smd"))


def smd_binary(df: DataFrame, keys: list[str], flag: Column, second: Column) -> DataFrame:
    """Difference of shares over the root of their mean variance."""
    x = df.withColumns({"_g": second, "_f": flag.cast("double")}).where("_g is not null and _f is not null")
    s = x.groupBy(*keys).agg(*(F.avg(F.when(F.col("_g") == F.lit(g), F.col("_f"))).alias(f"p{int(g)}") for g in (False, True)))
    v = (F.col("p0") * (1 - F.col("p0")) + F.col("p1") * (1 - F.col("p1"))) / 2
    return s.select(*keys, F.abs((F.col("p0") - F.col("p1")) / F.sqrt(F.nullif(v, F.lit(0.0)))).alias("smd"))


def smd_levels(df: DataFrame, category: str, second: Column) -> DataFrame:
    """Multinomial difference over all levels but the first, with the pseudo-inverse of the mean covariance."""
    x = df.withColumn("_g", second).where(F.col("_g").isNotNull() & F.col(category).isNotNull())
    c = x.groupBy(F.col(category).cast("string").alias("level")).agg(F.sum((~F.col("_g")).cast("long")).alias("a"), F.sum(F.col("_g").cast("long")).alias("b"))

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        p = p.sort_values("level")
        a, b = p["a"].to_numpy(float) / max(p["a"].sum(), 1), p["b"].to_numpy(float) / max(p["b"].sum(), 1)
        cov = lambda s: np.diag(s) - np.outer(s, s)
        d, s = (a - b)[1:], (cov(a[1:]) + cov(b[1:])) / 2
        return pd.DataFrame({"smd": [float(np.sqrt(max(d @ np.linalg.pinv(s) @ d, 0.0)))], "n_levels": [len(p)]})

    return c.groupBy().applyInPandas(solve, "smd double, n_levels long")  # one row per level


def over_represented(edges: DataFrame, hits: DataFrame, background: DataFrame, item: str, pathway: str) -> DataFrame:
    """Per pathway the cells of its 2 x 2 table; the sizes of both lists are read once."""
    bg, hit = background.select(item).distinct(), hits.select(item).distinct()
    e = edges.select(item, pathway).distinct().join(bg, item, "left_semi").join(hit.withColumn("_hit", F.lit(1)), item, "left")
    per = e.groupBy(pathway).agg(F.count("_hit").alias("n_hits_in_pw"), F.count(F.lit(1)).alias("n_bg_in_pw"))
    n_hits, n_bg = hit.join(bg, item, "left_semi").agg(F.count(F.lit(1))).scalar(), bg.agg(F.count(F.lit(1))).scalar()
    return per.where("n_hits_in_pw > 0").select(pathway, "n_hits_in_pw", n_hits.alias("n_hits_total"), "n_bg_in_pw", n_bg.alias("n_bg_total"))
