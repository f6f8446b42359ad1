"""Joins, set operations and reshaping that several families share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_coalesce(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys; a column of both sides takes the left value and, where that is null, the right one."""
    both = [c for c in a.columns if c in b.columns and c not in keys]
    x = a.join(b.withColumnsRenamed({c: f"_right_{c}" for c in both}), keys, how)
    return x.select(*keys, *(F.coalesce(c, f"_right_{c}").alias(c) if c in both else F.col(c) for c in a.columns if c not in keys), *(c for c in b.columns if c not in keys and c not in both))


def with_totals(df: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Add aggregates over all rows to every row: one aggregated row is read by scalar subquery, nothing is shuffled but it."""
    one = df.agg(*(c.alias(k) for k, c in totals.items()))
    return df.withColumns({k: one.select(k).scalar() for k in totals})


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def pair_by_occurrence(a: DataFrame, b: DataFrame, keys: list[str], order_a: list, order_b: list, how: str = "inner") -> DataFrame:
    """The k-th occurrence of a key on one side meets the k-th on the other."""
    n = lambda d, o: d.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(*o)) - 1)
    return n(a, order_a).join(n(b, order_b), [*keys, "occurrence"], how)


def join_all(parts: list[DataFrame], key: str, how: str = "full") -> DataFrame:
    """Chain of joins on one key."""
    return reduce(lambda a, b: a.join(b, key, how), parts)


def union_aligned(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def reindexed(df: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """df's row for every key of the index, null where it has none; keys of df that are not in the index leave."""
    return index.select(key).join(df, key, "left")


def adjacent_deltas(df: DataFrame, subject: str, feature: str, timepoint: str, value: str) -> DataFrame:
    """value at each timepoint less that at the one before in the alphabet; gaps give no delta."""
    a = df.select(subject, feature, F.col(timepoint).alias("_t0"), F.col(value).alias("_v0"), (F.ascii(timepoint) + 1).alias("_next"))
    b = df.select(F.col(subject).alias("_s"), F.col(feature).alias("_f"), F.col(timepoint).alias("_t1"), F.col(value).alias("_v1"), F.ascii(timepoint).alias("_at"))
    x = a.join(b, (F.col(subject) == F.col("_s")) & (F.col(feature) == F.col("_f")) & (F.col("_next") == F.col("_at")))
    return x.select(subject, feature, F.concat("_t1", F.lit("_minus_"), "_t0").alias("comparison"), (F.col("_v1") - F.col("_v0")).alias("delta"))


#: Cells of a grid are wider than the tolerance by this factor, so that no rounding puts a pair two cells apart.
WIDER = 1.001
#: The outermost cells hold all values beyond.
LAST_CELL = 1e12


def finite(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a number in every column; null, NaN and infinite values are near nothing."""
    for c in columns:
        df = df.where(F.abs(F.col(c)) < float("inf"))
    return df


def band_join(df: DataFrame, key: str, x: str, y: str, x_tol: float, y_tol: float) -> DataFrame:
    """Pairs of different rows near each other in x and y, smaller key first.

    Rows meet in cells of a grid a little wider than the tolerances: an equi-join on the cell in place of a join of all
    with all. A row stays in its own cell on one side; on the other it is sent to its own and to four of the eight around
    it, so that any two cells meet once. Sizes that are estimated for a plan know nothing of rows sent to several
    cells; the join is therefore never a broadcast.
    """
    cell = lambda c, tol: F.floor(F.least(F.greatest(F.col(c).cast("double") / (tol * WIDER), F.lit(-LAST_CELL)), F.lit(LAST_CELL)))
    df = finite(df, x, y)
    a = df.select(F.col(key).alias("a"), F.col(x).alias("ax"), F.col(y).alias("ay"), cell(x, x_tol).alias("_cx"), cell(y, y_tol).alias("_cy"))
    sent = F.array(*(F.struct((cell(x, x_tol) + i).alias("i"), (cell(y, y_tol) + j).alias("j"), F.lit(i == j == 0).alias("own")) for i, j in ((0, 0), (0, -1), (-1, -1), (-1, 0), (-1, 1))))
    b = df.select(F.col(key).alias("b"), F.col(x).alias("bx"), F.col(y).alias("by"), F.explode(sent).alias("c")).select("b", "bx", "by", F.col("c.i").alias("_cx"), F.col("c.j").alias("_cy"), F.col("c.own").alias("_own"))
    near = a.join(b.hint("merge"), ["_cx", "_cy"]).where(
        ((F.col("a") < F.col("b")) | (~F.col("_own") & (F.col("a") > F.col("b")))) & (F.abs(F.col("ax") - F.col("bx")) <= x_tol) & (F.abs(F.col("ay") - F.col("by")) <= y_tol))
    first = F.col("a") < F.col("b")
    return near.select(*(F.when(first, F.col(p)).otherwise(F.col(q)).alias(p) for p, q in (("a", "b"), ("b", "a"), ("ax", "bx"), ("bx", "ax"), ("ay", "by"), ("by", "ay"))))
