"""Daily wearable metrics: validity, wear, bounds, consistency, coverage and gaps.

A null comparison keeps the row or value, as in the rules that these operators state.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: First week of each gestational bucket (buckets are closed on the left).
BUCKETS = (("first", None), ("early_second", 14), ("late_second_early_third", 22), ("mid_third", 32), ("late_third", 37))
#: Words that are no reading.
NO_VALUE = ("", "nan", "none", "null", "no value", "-1", "-1.0")
#: Wear and sleep rules.
LEAST_STEPS, SEDENTARY_DAY, SHORT_SLEEP, SHORT_SHARE = 100, 1400, 240, 0.30


def sure(c: Column) -> Column:
    """False where unknown."""
    return F.coalesce(c, F.lit(False))


def bucket(weeks: Column) -> Column:
    """Gestational bucket of a week; null where the week is unknown."""
    out = F.when(weeks.isNull() | F.isnan(weeks), None)
    for name, start in reversed(BUCKETS[1:]):
        out = out.when(weeks >= start, name)
    return out.otherwise(BUCKETS[0][0])


def within_pregnancy(week: Column, delivery: Column, inclusive: bool = True) -> Column:
    """Weeks up to delivery, or up to 40 where delivery is unknown."""
    before = week <= delivery if inclusive else week < delivery
    return sure(before) | sure(delivery.isNull() & (week <= 40))


def keep_uploaded(df: DataFrame, streams: dict[str, list[str]]) -> DataFrame:
    """Metrics of a stream only on days on which its upload flag says yes."""
    new = {c: F.when(F.lower(F.trim(flag)) == "yes", F.col(c)) for flag, cols in streams.items() for c in cols}
    return df.withColumns(new)


def drop_unworn(df: DataFrame, steps: str, sedentary: str, pulse: str) -> DataFrame:
    """Leave out days with few steps, an all but full day of sitting and no pulse."""
    unworn = (F.col(steps) < LEAST_STEPS) & (F.col(sedentary) >= SEDENTARY_DAY) & F.col(pulse).isNull()
    return df.where(~sure(unworn))


def null_poor_sleepers(df: DataFrame, person: str, asleep: str, sleep_columns: list[str]) -> DataFrame:
    """Null all sleep of persons of whose nights more than the given share are short.

    The share is computed per person first and joined back, so that one person's days need not sit in one task.
    """
    share = df.where(F.col(asleep).isNotNull()).groupBy(person).agg(F.avg((F.col(asleep) < SHORT_SLEEP).cast("double")).alias("_share"))
    x = df.join(share, person, "left")
    poor = sure(F.col("_share") > SHORT_SHARE)
    return x.withColumns({c: F.when(~poor, F.col(c)) for c in sleep_columns}).drop("_share")


def null_outside(df: DataFrame, bounds: dict[str, tuple[float, float]], zero_is_missing: list[str] = ()) -> DataFrame:
    """Null values outside their bounds, and zeros of some columns."""
    new = {}
    for c, (low, high) in bounds.items():
        v = F.when(~sure((F.col(c) < low) | (F.col(c) > high)), F.col(c))
        new[c] = F.when(v != 0, v) if c in zero_is_missing else v
    return df.withColumns(new)


def violations(df: DataFrame, keys: list[str], rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row per broken rule: keys, rule and the text that says how."""
    each = F.array_compact(F.array(*(F.when(sure(broken), F.struct(F.lit(rule).alias("rule"), said.alias("said"))) for rule, (broken, said) in rules.items())))
    return df.select(*keys, F.explode(each).alias("v")).select(*keys, "v.rule", "v.said")


def sum_if_any(columns: list[str]) -> Column:
    """Sum over columns, null only if all are null."""
    some = reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in columns))
    return F.when(some, reduce(lambda a, b: a + b, (F.coalesce(F.col(c), F.lit(0)) for c in columns)))


def valid_people(df: DataFrame, person: str, columns: list[str]) -> DataFrame:
    """Persons with at least one cell that is a reading."""
    real = reduce(lambda a, b: a | b, (sure(~F.lower(F.trim(F.col(c).cast("string"))).isin(*NO_VALUE)) for c in columns))
    return df.where(real & F.col(person).isNotNull()).select(person).distinct()


def coverage(df: DataFrame, keys: list[str], metrics: list[str], least_days: int = 5, least_share: float = 0.5) -> DataFrame:
    """Mean per key where enough days are valid, in number and share; null otherwise."""
    long = df.unpivot([*keys], metrics, "metric", "value")
    return long.groupBy(*keys, "metric").agg(F.count("value").alias("n_valid"), F.count(F.lit(1)).alias("n_days"), F.avg("value").alias("m")).select(
        *keys, "metric", "n_valid", "n_days", F.when((F.col("n_valid") >= least_days) & (F.col("n_valid") >= least_share * F.col("n_days")), F.col("m")).alias("mean_value"))


def longest_gap(df: DataFrame, person: str, day: str, value: str) -> DataFrame:
    """Longest run of calendar days without a value between two days with one, per person."""
    days = df.where(F.col(value).isNotNull() & F.col(day).isNotNull()).select(person, day).distinct()
    w = Window.partitionBy(person).orderBy(day)
    return days.withColumn("_gap", F.datediff(day, F.lag(day).over(w)) - 1).groupBy(person).agg(F.coalesce(F.max("_gap"), F.lit(0)).cast("long").alias("longest_gap"))


def longest_missing_run(df: DataFrame, person: str, order: list[str], value: str) -> DataFrame:
    """Most rows in a row without a value, per person, in the given order."""
    w = Window.partitionBy(person).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    island = df.select(person, F.col(value).isNull().alias("_no"), F.sum(F.col(value).isNotNull().cast("long")).over(w).alias("_block"))
    runs = island.groupBy(person, "_block").agg(F.sum(F.col("_no").cast("long")).alias("_n"))
    return runs.groupBy(person).agg(F.max("_n").alias("longest_run"))


def density(df: DataFrame, person: str, day: str, metrics: list[str], enough: float = 0.8) -> DataFrame:
    """Days with a value over the days between first and last, at most 1, per person and metric."""
    span = df.groupBy(person).agg((F.datediff(F.max(day), F.min(day)) + 1).alias("n_span"))
    there = df.unpivot([person, day], metrics, "metric", "value").groupBy(person, "metric").agg(F.countDistinct(F.when(F.col("value").isNotNull(), F.col(day))).alias("n_days"))
    share = F.least(F.lit(1.0), F.col("n_days") / F.col("n_span"))
    return there.join(span, person).select(person, "metric", "n_days", share.alias("density"), (share >= enough).alias("dense"))
