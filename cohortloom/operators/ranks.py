"""Ranks, running counts and the rank tests built on them, for groups of any size.

Rows are reduced to counts per distinct value first; counts are carried over order-keeping buckets of the value, so that
no group is ordered as a whole in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions import tails
from cohortloom.operators.quantiles import bucket


def running(counted: DataFrame, keys: list[str], value: str, sums: list[str]) -> DataFrame:
    """Adds ``<sum>_before``: the sum over all smaller values of the same keys. One row per keys and value is given."""
    b = counted.withColumn("_b", bucket(F.col(value)))
    per = b.groupBy(*keys, "_b").agg(*(F.sum(s).alias(f"_t_{s}") for s in sums))
    over = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = per.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_b").alias("_bb"), *((F.sum(f"_t_{s}").over(over) - F.col(f"_t_{s}")).alias(f"_p_{s}") for s in sums))
    on = F.col("_b") == F.col("_bb")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return b.join(base, on).select(*counted.columns, *((F.col(f"_p_{s}") + F.sum(s).over(inside) - F.col(s)).alias(f"{s}_before") for s in sums))


def value_counts(df: DataFrame, keys: list[str], value: str, parts: dict[str, Column]) -> DataFrame:
    """keys, v, c (rows with this value) and one count per part, with all of them for smaller values."""
    x = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("c"), *(F.sum(F.coalesce(p.cast("long"), F.lit(0))).alias(k) for k, p in parts.items()))
    return running(x, keys, "v", ["c", *parts])


def mid_rank() -> Column:
    """Mean rank of a value among value_counts."""
    return F.col("c_before") + (F.col("c") + 1) / 2


def mann_whitney(df: DataFrame, keys: list[str], value: str, second: Column, least: int = 5) -> DataFrame:
    """U of the first group, tie-corrected normal z with continuity correction, sizes; null below the least size.

    ``second`` is true for rows of the second group and false for the first; rows where it is null are left out.
    """
    x = df.withColumn("_g", second).where("_g is not null")
    v = value_counts(x, keys, value, {"c1": ~F.col("_g")})
    s = v.groupBy(*keys).agg(F.sum("c1").alias("n1"), F.sum(F.col("c") - F.col("c1")).alias("n2"), F.sum(F.col("c1") * mid_rank()).alias("r1"), F.sum(F.pow(F.col("c").cast("double"), 3) - F.col("c")).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    s = s.withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2).withColumn("var", n1 * n2 / 12 * (n + 1 - F.col("ties") / F.nullif(n * (n - 1), F.lit(0.0))))
    z = (F.greatest(F.col("u"), n1 * n2 - F.col("u")) - n1 * n2 / 2 - 0.5) / F.sqrt(F.nullif(F.col("var"), F.lit(0.0)))
    fit = (F.col("n1") >= least) & (F.col("n2") >= least)
    return s.select(*keys, "n1", "n2", F.when(fit, F.col("u")).alias("u"), F.when(fit, z).alias("z"), (F.col("ties") > 0).alias("tied"), (~fit).alias("excluded"))


def wilcoxon(df: DataFrame, keys: list[str], delta: str, least: int = 5) -> DataFrame:
    """Signed-rank W after leaving out zeros, z without continuity correction; null below the least size."""
    x = df.where(F.col(delta) != 0).withColumn("_a", F.abs(delta))
    v = value_counts(x, keys, "_a", {"up": F.col(delta) > 0})
    s = v.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.col("up") * mid_rank()).alias("w_up"), F.sum((F.col("c") - F.col("up")) * mid_rank()).alias("w_down"), F.sum(F.pow(F.col("c").cast("double"), 3) - F.col("c")).alias("ties"))
    n, w = F.col("n").cast("double"), F.least("w_up", "w_down")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    fit = F.col("n") >= least
    return s.select(*keys, F.col("n").alias("n_pairs"), F.when(fit, w).alias("w"), F.when(fit, (w - n * (n + 1) / 4) / F.sqrt(F.nullif(var, F.lit(0.0)))).alias("z"), (F.col("ties") > 0).alias("tied"), (~fit).alias("excluded"))


def kolmogorov(df: DataFrame, keys: list[str], value: str, second: Column, least: int = 2) -> DataFrame:
    """Greatest distance of the two distribution functions; null below the least size or with one distinct value."""
    x = df.withColumn("_g", second).where("_g is not null")
    v = value_counts(x, keys, value, {"c1": ~F.col("_g"), "c2": F.col("_g")})
    size = v.groupBy(*keys).agg(F.sum("c1").alias("n1"), F.sum("c2").alias("n2"), F.count(F.lit(1)).alias("n_values"))
    d = F.abs((F.col("c1_before") + F.col("c1")) / F.nullif(F.col("n1"), F.lit(0)) - (F.col("c2_before") + F.col("c2")) / F.nullif(F.col("n2"), F.lit(0)))
    fit = (F.col("n1") >= least) & (F.col("n2") >= least) & (F.col("n_values") > 1)
    return v.join(size, keys).groupBy(*keys, "n1", "n2", "n_values").agg(F.max(d).alias("_d")).select(*keys, "n1", "n2", F.when(fit, F.col("_d")).alias("d"))


def kruskal(df: DataFrame, keys: list[str], value: str, group: str, least: int = 5) -> DataFrame:
    """Tie-corrected H over groups of at least the given size."""
    sized = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(*keys, group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n")
    x = df.where(F.col(value).isNotNull()).join(sized, [*keys, group], "left_semi")
    v = value_counts(x, keys, value, {})
    per = x.groupBy(*keys, F.col(value).cast("double").alias("v"), group).agg(F.count(F.lit(1)).alias("k"))
    sums = per.join(v, [*keys, "v"]).groupBy(*keys, group).agg(F.sum("k").alias("n_g"), F.sum(F.col("k") * mid_rank()).alias("r_g"))
    ties = v.groupBy(*keys).agg(F.sum(F.pow(F.col("c").cast("double"), 3) - F.col("c")).alias("ties"))
    h = sums.groupBy(*keys).agg(F.sum("n_g").cast("double").alias("n"), F.count(F.lit(1)).alias("n_groups"), F.sum(F.pow("r_g", F.lit(2)) / F.col("n_g")).alias("q")).join(ties, keys)
    n = F.col("n")
    raw = 12.0 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)
    adjust = 1 - F.col("ties") / (n * n * n - n)
    return h.select(*keys, "n_groups", n.cast("long").alias("n"), F.when(F.col("n_groups") > 1, raw / F.nullif(adjust, F.lit(0.0))).alias("h"))


def anderson_darling(df: DataFrame, keys: list[str], value: str, group: str) -> DataFrame:
    """The k-sample statistic for tied values (midranks), not standardised, with groups and rows; null for one group or
    one distinct value. Sums run over counts of distinct values, so a hot key is spread."""
    if not keys:
        return anderson_darling(df.withColumn("_all", F.lit(1)), ["_all"], value, group).drop("_all")
    x = df.where(F.col(value).isNotNull() & ~F.isnan(value) & F.col(group).isNotNull())
    sizes = x.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("n_i"))
    total = sizes.groupBy(*keys).agg(F.sum("n_i").alias("n"), F.count(F.lit(1)).alias("n_groups"))
    pooled = value_counts(x, keys, value, {})
    own = x.groupBy(*keys, group, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("f"))
    # groups of a key are few: every group meets the key's distinct values
    grid = pooled.join(sizes, keys).join(own, [*keys, group, "v"], "left").withColumn("f", F.coalesce("f", F.lit(0)))
    ran = running(grid, [*keys, group], "v", ["f"])
    n, b, m = F.col("n"), F.col("c_before") + F.col("c") / 2, F.col("f_before") + F.col("f") / 2
    under = b * (n - b) - n * F.col("c") / 4
    term = F.when(under > 0, F.col("c") / n * F.pow(n * m - F.col("n_i") * b, 2) / under)
    per = ran.join(total, keys).groupBy(*keys, group).agg((F.sum(term) / F.max("n_i")).alias("a"), F.max("n").alias("n"), F.max("n_groups").alias("n_groups"))
    return per.groupBy(*keys).agg(F.max("n").alias("n"), F.max("n_groups").alias("n_groups"), F.when(F.max("n_groups") > 1, (F.max("n") - 1) / F.max("n") * F.sum("a")).alias("a2"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, least: int = 10) -> DataFrame:
    """Correlation of mid-ranks over the rows where both are there; null below the least size or without variation."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    pairs = both.groupBy(*keys, "_x", "_y").agg(F.count(F.lit(1)).alias("w"))
    rank = lambda c: value_counts(both, keys, c, {}).select(*keys, F.col("v").alias(c), mid_rank().alias(f"r{c}"))
    r = pairs.join(rank("_x"), [*keys, "_x"]).join(rank("_y"), [*keys, "_y"])
    w, a, b = F.col("w"), F.col("r_x"), F.col("r_y")
    m = r.groupBy(*keys).agg(F.sum("w").alias("n"), F.sum(w * a).alias("sa"), F.sum(w * b).alias("sb"), F.sum(w * a * a).alias("saa"), F.sum(w * b * b).alias("sbb"), F.sum(w * a * b).alias("sab"))
    n = F.col("n").cast("double")
    va, vb = F.col("saa") - F.col("sa") * F.col("sa") / n, F.col("sbb") - F.col("sb") * F.col("sb") / n
    rho = (F.col("sab") - F.col("sa") * F.col("sb") / n) / F.sqrt(F.nullif(va * vb, F.lit(0.0)))
    return m.select(*keys, F.col("n").alias("n"), F.when(F.col("n") >= least, rho).alias("rho"))


def adjust_bh(df: DataFrame, scope: list[str], p: str, key: list[str], alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg q over the tested rows of each scope. A scope holds one row per test, not per measurement."""
    asc = Window.partitionBy(*scope).orderBy(F.col(p), *key)
    tested = df.where(F.col(p).isNotNull()).withColumn("_i", F.row_number().over(asc)).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(*scope)))
    down = Window.partitionBy(*scope).orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_i")).over(down))
    out = tested.withColumn("q_value", q).withColumn("significant", F.col("q_value") < alpha).drop("_i", "_m")
    rest = df.where(F.col(p).isNull()).withColumns({"q_value": F.lit(None).cast("double"), "significant": F.lit(False)})
    return out.unionByName(rest)


def exact_u_sf(u: float, n1: int, n2: int) -> float:
    """Two-sided exact p of U without ties, by counting arrangements; time and room grow with the product of the sizes
    and the smaller one."""
    n1, n2 = min(n1, n2), max(n1, n2)
    size = n1 * n2 + 1
    ways = np.zeros(size)
    ways[0] = 1.0
    for i in range(1, n1 + 1):
        if n2 + i < size:
            ways[n2 + i :] -= ways[: size - n2 - i].copy()
        # running sums over every i-th place
        ways = np.pad(ways, (0, -size % i)).reshape(-1, i).cumsum(axis=0).ravel()[:size]
    top = math.ceil(max(u, n1 * n2 - u))
    return min(1.0, 2 * float(ways[top:].sum()) / math.comb(n1 + n2, n1))


def exact_w_sf(w: float, n: int) -> float:
    """Two-sided exact p of the signed-rank statistic without ties."""
    ways = [1.0] + [0.0] * (n * (n + 1) // 2)
    for i in range(1, n + 1):
        for s in range(len(ways) - 1, i - 1, -1):
            ways[s] += ways[s - i]
    return min(1.0, 2 * sum(ways[: int(math.floor(w)) + 1]) / 2**n)


@F.pandas_udf(T.DoubleType())
def p_of_u(u: pd.Series, z: pd.Series, n1: pd.Series, n2: pd.Series, tied: pd.Series) -> pd.Series:
    """Exact for a group of at most 8 without ties, else from z."""
    out = []
    for a, b, c, d, e in zip(u, z, n1, n2, tied, strict=True):
        if a is None or a != a:
            out.append(None)
        elif min(c, d) <= 8 and not e:
            out.append(exact_u_sf(a, int(c), int(d)))
        else:
            out.append(min(1.0, 2 * tails.normal_sf(max(b, 0.0))) if b == b else 1.0)
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def p_of_w(w: pd.Series, z: pd.Series, n: pd.Series, tied: pd.Series) -> pd.Series:
    """Exact for at most 50 pairs without ties, else from z."""
    exact = lambda a, c, e: a == a and c <= 50 and not e
    return pd.Series([None if a is None or a != a else exact_w_sf(a, int(c)) if exact(a, c, e) else min(1.0, 2 * tails.normal_sf(abs(b))) if b == b else 1.0 for a, b, c, e in zip(w, z, n, tied, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def p_of_z(z: pd.Series) -> pd.Series:
    return z.map(lambda x: min(1.0, 2 * tails.normal_sf(abs(x))) if x == x else None).astype("float64")


@F.pandas_udf(T.DoubleType())
def p_of_chi2(h: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([tails.chi2_sf(a, b) if a == a and b >= 1 else None for a, b in zip(h, df, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def p_of_f(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([tails.f_sf(a, b, c) if a == a and b >= 1 and c >= 1 else None for a, b, c in zip(f, d1, d2, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def p_of_t(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([min(1.0, 2 * tails.t_sf(abs(a), b)) if a == a and b > 0 else None for a, b in zip(t, df, strict=True)], dtype="float64")
