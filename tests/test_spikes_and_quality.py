"""Problems 5 and 7, exact quantiles."""

import numpy as np
import pandas as pd

from cohortloom.operators import quality, spikes
from cohortloom.operators.quantiles import exact_quantiles
from pyspark.sql import functions as F

CEIL = {"a": 1440.0, "b": 1440.0}


def series(spark, a, b, source="x"):
    rows = [(source, d, d + 1, None if x is None else float(x), None if y is None else float(y)) for d, (x, y) in enumerate(zip(a, b))]
    return spark.createDataFrame(rows, "source string, day int, row_id long, a double, b double")


def flags(spark, a, b, source="x"):
    out = spikes.flag_readings(series(spark, a, b, source), ["a", "b"], set(), CEIL, [("a", "b")]).collect()
    return {(r["row_id"] - 1, r["field_name"], k) for r in out for k in ("impossible", "spike", "stuck", "inconsistent") if r[k]}


def test_spikes_runs_ranges_and_pairs(spark):
    rng = np.random.default_rng(0)
    a = [int(400 + 30 * (d % 7 == 5) + rng.normal(0, 12)) for d in range(120)]
    b = [x + 30 + int(rng.integers(0, 12)) for x in a]
    a[60:] = [x - 150 for x in a[60:]]  # a lasting change of level
    b[60:] = [x - 150 for x in b[60:]]
    a[20], b[35], a[80] = 90, 900, -5
    b[90:94] = [b[90]] * 4
    a[100], b[100] = b[100], a[100]
    assert flags(spark, a, b) - {(100, "a", "spike")} == {(20, "a", "spike"), (35, "b", "spike"), (80, "a", "impossible"), *((d, "b", "stuck") for d in range(90, 94)), (100, "a", "inconsistent"), (100, "b", "inconsistent")}


def test_short_null_and_empty_series(spark):
    assert flags(spark, [1, 2, None], [5, 5, 5]) == set()
    assert flags(spark, [None] * 3, [None] * 3) == set()
    assert flags(spark, [2000], [5], None) == {(0, "a", "impossible"), (0, "a", "inconsistent")}
    assert spikes.flag_readings(series(spark, [], []), ["a", "b"], set(), CEIL, []).count() == 0


def test_day_sent_twice_counts_twice(spark):
    rng = np.random.default_rng(1)
    a = [int(400 + rng.normal(0, 8)) for _ in range(40)]
    a[10] = 900
    df = series(spark, a, [None] * 40)
    twice = df.unionByName(df.where("day = 10").withColumn("row_id", F.lit(1000).cast("long")))
    out = spikes.flag_readings(twice, ["a"], set(), CEIL, []).where("spike").collect()
    assert {r["row_id"] for r in out} == {11, 1000}


def test_critical_values_match_published_table():
    # generalised ESD of Rosner, n = 54, alpha = 0.05: 3.159, 3.151, 3.144
    assert [round(spikes.critical(54, i, 0.05), 3) for i in (1, 2, 3)] == [3.159, 3.151, 3.144]


def test_exact_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(0, 3, 500), rng.normal(0, 1e5, 20), np.repeat(1.5, 200)])
    g = rng.integers(0, 3, len(v))
    df = spark.createDataFrame(pd.DataFrame({"g": g, "v": v}))
    for r in exact_quantiles(df, ["g"], "v", {"q1": 0.25, "m": 0.5, "q9": 0.9}).collect():
        x = v[g == r["g"]]
        assert np.allclose([r["q1"], r["m"], r["q9"]], np.quantile(x, [0.25, 0.5, 0.9])) and r["n"] == len(x)
    assert exact_quantiles(df.limit(0), ["g"], "v", {"m": 0.5}).count() == 0


def test_two_sample_test_sees_a_shift_and_its_column(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "lab", f"L{i % 4}", int(rng.integers(0, 4) + (3 if i % 4 == 0 else 0)), int(rng.integers(0, 2))) for i in range(4000)]
    df = spark.createDataFrame(rows, "row_id long, lab string, load string, x int, y int")
    got = {(r["load"], r["column_name"]): r for r in quality.two_sample_test(df, "lab", "load", {"x": F.col("x"), "y": F.col("y")}, "row_id").collect()}
    assert got["L0", "x"]["auc"] > 0.9 and got["L0", "x"]["loss"] > 0.3 and abs(got["L0", "y"]["loss"]) < 0.05
    assert 0.45 < got["L1", "y"]["auc"] < 0.75
    one = df.where("load = 'L0'")
    assert all(r["auc"] is None for r in quality.two_sample_test(one, "lab", "load", {"x": F.col("x")}, "row_id").collect())


def test_profile_of_awkward_tables(spark):
    df = spark.createDataFrame([("l", None, "", [1]), ("l", 1.5, "ab12", None), (None, float("nan"), "ab99", [2])], "load string, n double, t string, a array<int>")
    p = {(r["load_id"], r["column_name"]): r for r in quality.profile(df, "load").collect()}
    assert p["l", "t"]["common_form"] in ("a9", "") and p["l", "n"]["n_null"] == 1 and p[None, "t"]["n_distinct"] == 1
    assert quality.profile(df.limit(0), "load").count() == 0


def test_profile_has_the_change_of_every_column_by_lab_and_load(spark):
    from cohortloom.plans import cohort_queries as cq

    rng = np.random.default_rng(5)
    rows = [(i, f"DP3-{i:07d}A", "DP3-1", "Control", ["Control", "PPROM", "FGR"][int(rng.integers(0, 3))] if i % 4 else "late", "1", float(rng.normal(38, 2)), float(rng.normal(39 + 9 * (i % 4 == 1), 2)), "DP3-1A", "lab", f"L{i % 4}", None) for i in range(2000)]
    samples = spark.createDataFrame(rows, "row_id long, sample_id string, subject_id string, group_label string, subgroup string, batch string, gest_age_delivery double, sample_gest_age double, metadata_canonical_id string, lab_code string, load_id string, loaded_at timestamp")
    names = ("row_id long, sample_id string, assay string, panel string, npx string, qc_warning string, assay_warning string, source_file string, lab_code string, load_id string, loaded_at timestamp")
    readings = spark.createDataFrame([], names)
    empty = readings.select("row_id", "lab_code", "load_id", F.lit(False).alias("missing"), F.lit(1.0).alias("v"), *(c.alias(f"{k}_code") for k, c in cq._reading_codes().items()))
    moved = cq._drift(empty, samples)[1]
    p = {(r["lab_code"], r["load_id"], r["column_name"]): r for r in quality.profile(samples, "load_id", group="lab_code", drift=moved).collect()}
    assert {k[2] for k in p} == set(samples.columns) - {"lab_code", "load_id"} and len(p) == 4 * 10
    assert p["lab", "L0", "subgroup"]["loss"] > 0.2 and p["lab", "L0", "subgroup"]["gap"] > 0.9 and p["lab", "L0", "batch"]["gap"] == 0
    assert p["lab", "L1", "sample_gest_age"]["loss"] > 0.1 and p["lab", "L1", "sample_gest_age"]["gap"] > 0.7
    assert abs(p["lab", "L2", "gest_age_delivery"]["loss"]) < 0.05 and all(r["auc"] is not None for r in p.values())


def test_shift_follows_the_rule_whatever_the_classifier_says(spark):
    rows = [("lab", f"L{k}", float(9 + 2 * (k == 0) + i / 100)) for k in range(4) for i in range(50)]
    df = spark.createDataFrame(rows, "lab string, load string, v double")
    blind = spark.createDataFrame([("lab", f"L{k}", "v", 0.5, 0.0) for k in range(4)], "lab string, load string, column_name string, auc double, loss double")
    rules = dict(missing_over=0.15, bad_over=0.05, low=-10, high=30, outside_over=0.02, distinct_under=0.2, median_off=1.2, spread_over=2)
    for drift in (blind, None):
        got = quality.number_issues(df, "lab", "load", "v", F.col("v").isNull(), F.lit(True), F.col("v"), drift, **rules).collect()
        assert {r["load_id"]: r["issues"] for r in got} == {"L0": ["shift"], "L1": [], "L2": [], "L3": []}


def test_buckets_follow_the_data(spark):
    """Quantiles of scores and of intensities up to billions; no bucket holds much of either, and order is kept."""
    from cohortloom.operators.quantiles import bucket

    rng = np.random.default_rng(5)
    for v in (rng.random(20000), np.exp(rng.normal(14, 2.5, 20000)), np.r_[-np.exp(rng.normal(3, 2, 10000)), np.exp(rng.normal(3, 2, 10000)), np.zeros(5), 5e-324, -5e-324, np.inf, -np.inf]):
        df = spark.createDataFrame(pd.DataFrame({"v": v}))
        b = df.select("v", bucket(F.col("v")).alias("b")).toPandas().sort_values("v")
        assert b["b"].is_monotonic_increasing and b["b"].value_counts().iloc[0] < 0.01 * len(v)
        q = exact_quantiles(df.where("abs(v) < 1e300"), [], "v", {"a": 0.25, "b": 0.5, "c": 0.9}).first()
        assert np.allclose([q["a"], q["b"], q["c"]], np.quantile(v[np.abs(v) < 1e300], [0.25, 0.5, 0.9]))
