"""Joins of near rows: every pair once, and never by broadcast, whatever the estimated size."""

import random

from cohortloom.operators import relational as rel


def test_band_join_finds_every_pair_once(spark):
    rnd = random.Random(1)
    rows = [(1, -1e-18, 1.0), (2, 0.02, 1.0), (3, float("nan"), 1.0), (4, float("inf"), 1.0), (5, float("inf"), 1.0), (6, None, 1.0), (7, 1e300, 1.0), (8, 1e300, 1.0), (9, 0.03, 1.15), (9, 0.031, 1.2)]
    rows += [(10 + i, 90 + 0.01 * rnd.randrange(300), 0.1 * rnd.randrange(20)) for i in range(300)]
    real = [r for r in rows if r[1] is not None and abs(r[1]) < float("inf")]
    want = sorted((a[0], b[0]) for a in real for b in real if a[0] < b[0] and abs(a[1] - b[1]) <= 0.02 and abs(a[2] - b[2]) <= 0.2)
    got = rel.band_join(spark.createDataFrame(rows, "id long, x double, y double"), "id", "x", "y", 0.02, 0.2)
    assert sorted((r["a"], r["b"]) for r in got.collect()) == want and (1, 2) in want and (7, 8) in want


def test_band_join_is_no_broadcast(spark):
    """The plan takes rows sent to several cells for as many as were read."""
    df = spark.range(200).selectExpr("id", "id % 40 / 10.0D as x", "id % 7 / 10.0D as y")
    pairs = rel.band_join(df, "id", "x", "y", 0.02, 0.2)
    assert pairs.count() > 0 and "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_near_components_list_no_pairs_within_a_point(spark, tmp_path):
    """20,000 rows at 40 points have five million pairs; the labels need one edge per two points only."""
    from unittest import mock

    from cohortloom.operators import dedup
    from cohortloom.plans import stats_queries

    rnd = random.Random(2)
    spot = [(90 + 0.1 * rnd.randrange(40), rnd.randrange(1, 9)) for _ in range(40)]
    rows = [(i, *spot[i % 40]) for i in range(20_000)]
    path = str(tmp_path / "part.parquet")
    spark.createDataFrame(rows, "p_partkey long, p_retailprice double, p_size int").selectExpr("*", "'b' as p_brand").write.parquet(path)
    seen = []
    with mock.patch.object(dedup, "components", side_effect=lambda n, e, *a, f=dedup.components: seen.append(e.count()) or f(n, e, *a)):
        got = {r["id"]: r["component"] for r in stats_queries.R.queries["q_gr_03"](spark, str(tmp_path)).collect()}
    assert seen[0] <= 40 * 39 / 2
    least = {s: spot.index(s) for s in spot}
    near = lambda s, t: abs(s[0] / 10.0 - t[0] / 10.0) <= 0.02 and abs(s[1] / 10.0 - t[1] / 10.0) <= 0.2
    for _ in spot:
        least = {s: min(least[t] for t in least if near(s, t)) for s in least}
    assert got == {i: least[(p, z)] for i, p, z in rows} and len(set(least.values())) > 1


def test_near_components_of_odd_keys(spark):
    """A key at two points connects them; rows without a number, and the null key, stand alone."""
    from cohortloom.operators import dedup

    rows = [(5, 1.0, 1.0), (3, 1.0, 1.0), (5, 9.0, 1.0), (7, 9.01, 1.0), (8, None, 1.0), (9, float("nan"), 1.0), (10, float("nan"), 1.0), (None, 1.0, 1.0)]
    got = dedup.near_components(spark.createDataFrame(rows, "id long, x double, y double"), "id", "x", "y", 0.02, 0.2).collect()
    assert {r["id"]: r["component"] for r in got} == {3: 3, 5: 3, 7: 3, 8: 8, 9: 9, 10: 10, None: None} and len(got) == 7
