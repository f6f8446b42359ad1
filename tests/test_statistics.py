"""Rank tests, tails, batch correction, clusters and components against plain NumPy."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortloom.functions import tails
from cohortloom.operators import contingency, dedup, modelling, normalize, ranks
from cohortloom.operators import relational as rel


def test_tails_against_known_values():
    assert tails.t_sf(2.228, 10) == pytest.approx(0.025, abs=1e-4)
    assert tails.chi2_sf(3.841, 1) == pytest.approx(0.05, abs=1e-4)
    assert tails.f_sf(4.965, 1, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.normal_sf(1.959964) == pytest.approx(0.025, abs=1e-7)


def test_exact_rank_p_by_enumeration():
    n1, n2 = 3, 4
    us = [sum(x > y for x in c for y in set(range(7)) - set(c)) for c in itertools.combinations(range(7), n1)]
    for u in range(n1 * n2 + 1):
        top = max(u, n1 * n2 - u)
        assert ranks.exact_u_sf(u, n1, n2) == pytest.approx(min(1, 2 * sum(x >= top for x in us) / len(us)))
    ws = [sum(i + 1 for i in range(5) if m >> i & 1) for m in range(32)]
    for w in range(8):
        assert ranks.exact_w_sf(w, 5) == pytest.approx(min(1, 2 * sum(x <= w for x in ws) / 32))


def test_rank_tests_with_ties_nulls_and_small_groups(spark):
    df = spark.createDataFrame([("a", float(v), v % 2 == 0) for v in [1, 2, 2, 3, 3, 3, 4, 5, 6, 7, 8, 8]] + [("b", 1.0, True), ("b", None, False), ("c", 1.0, None)], "f string, v double, g boolean")
    r = {x["f"]: x for x in ranks.mann_whitney(df, ["f"], "v", F.col("g")).collect()}
    a, b = [1, 3, 3, 3, 5, 7], [2, 2, 4, 6, 8, 8]
    assert r["a"]["u"] == sum((x > y) + (x == y) / 2 for x in a for y in b) and r["b"]["excluded"] and r["b"]["u"] is None
    assert ranks.kolmogorov(df.limit(0), ["f"], "v", F.col("g")).count() == 0


def test_fisher_matches_enumeration():
    p = lambda a: math.comb(8, a) * math.comb(12, 7 - a) / math.comb(20, 7)
    assert contingency.hypergeometric(6, 1, 2, 11, "greater") == pytest.approx(p(6) + p(7))
    assert contingency.hypergeometric(6, 1, 2, 11, "two") == pytest.approx(sum(p(a) for a in range(8) if p(a) <= p(6) * (1 + 1e-7)))


def test_batch_correction(spark):
    rng = np.random.default_rng(0)
    rows = [(s, f"f{f}", s % 3, float(f + (s % 3) * 2 + rng.normal(0, 1 + (s % 3)))) for s in range(90) for f in range(20)] + [(91, "f0", 0, None)]
    df = spark.createDataFrame(rows, "s int, f string, b int, v double")
    out = normalize.combat(df, "s", "f", "b", "v").toPandas()
    m = out.groupby(["f", "b"]).v.mean().unstack()
    assert (m.max(axis=1) - m.min(axis=1)).mean() < 0.5 and out.v.isna().sum() == 1 and len(out) == len(rows)
    one = df.where("b = 0")
    same = normalize.combat(one, "s", "f", "b", "v").toPandas().merge(one.toPandas(), on=["s", "f"])
    assert np.allclose(same.v_x.dropna(), same.v_y.dropna())


def test_zero_replacement_sums_to_one(spark):
    df = spark.createDataFrame([(s, f"t{i}", float(c)) for s, cs in enumerate([[0, 3, 5, 0], [10, 0, 0, 1], [2, 2, 2, 2]]) for i, c in enumerate(cs)], "s int, t string, c double")
    x = normalize.zeros_replaced(df, "s", "c").toPandas()
    assert (x.share > 0).all() and np.allclose(x.groupby("s").share.sum(), 1)


def test_band_join_clusters_components(spark):
    rng = np.random.default_rng(4)
    p = pd.DataFrame({"id": range(200), "mz": rng.uniform(100, 101, 200), "rt": rng.uniform(0, 3, 200)})
    df = spark.createDataFrame(p)
    near = {(i, j) for i in range(200) for j in range(i + 1, 200) if abs(p.mz[i] - p.mz[j]) <= 0.02 and abs(p.rt[i] - p.rt[j]) <= 0.2}
    e = rel.band_join(df, "id", "mz", "rt", 0.02, 0.2)
    assert {(r["a"], r["b"]) for r in e.collect()} == near
    parent = list(range(200))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in near:
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    assert {r["id"]: r["component"] for r in dedup.components(df, e, "id").collect()} == {i: root(i) for i in range(200)}
    order, seed = p.sort_values(["rt", "mz", "id"]).id.tolist(), {}
    for k, i in enumerate(order):
        if i not in seed:
            for j in order[k:]:
                if j not in seed and abs(p.mz[i] - p.mz[j]) <= 0.02 and p.rt[j] - p.rt[i] <= 0.2:
                    seed[j] = i
    assert {r["id"]: r["seed"] for r in dedup.greedy_clusters(df, "id", "rt", "mz").collect()} == seed


def test_split_and_permutation(spark):
    df = spark.createDataFrame([(i, i % 4 == 0, float(i % 4 == 0) * 3 + (i * 7919 % 101) / 50) for i in range(400)], "id long, y boolean, v double")
    n = {(r["y"], r["split"]): r["count"] for r in modelling.split(df, "id", "y").groupBy("y", "split").count().collect()}
    assert n[False, "train"] == 210 and n[True, "train"] == 70 and n[False, "test"] == 45
    rep = modelling.resampled_means(df, "id", "v", F.col("y"), 50)
    assert modelling.permutation_p(rep).first()["p_value"] == 0.0
    b = modelling.bootstrap_means(df, "id", "v", 100).first()
    assert b["low"] < df.agg(F.avg("v")).first()[0] < b["high"]


def test_interval_of_the_roc_area(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 400)
    v = np.round(y + rng.normal(0, 1.5, 400), 1)  # with ties
    df = spark.createDataFrame([(i, float(a), bool(b)) for i, (a, b) in enumerate(zip(v, y))], "id long, s double, y boolean")
    b = modelling.bootstrap_auc(df, "id", "s", F.col("y")).first()
    auc = lambda s, t: np.mean((np.sign(s[t == 1][:, None] - s[t == 0]) + 1) / 2)
    assert b["n_replicates"] == 1000 and b["roc_auc"] == pytest.approx(auc(v, y))
    drawn = [auc(v[i], y[i]) for i in (rng.integers(0, 400, 400) for _ in range(200))]
    assert np.allclose([b["low"], b["high"]], np.percentile(drawn, [2.5, 97.5]), atol=0.02)
    one = modelling.bootstrap_auc(df.where("y"), "id", "s", F.col("y")).first()
    assert one["low"] is None and one["n_replicates"] == 0


def test_folds_are_stratified_and_capped(spark):
    df = spark.createDataFrame([(i, i % 5 == 0) for i in range(500)], "id long, y boolean")
    x, n = modelling.stratified_folds(df, "id", "y")
    assert n == 10 and {(r["fold"], r["y"]): r["count"] for r in x.groupBy("fold", "y").count().collect()} == {(k, y): 10 if y else 40 for k in range(10) for y in (True, False)}
    assert modelling.stratified_folds(df.where("not y or id < 15"), "id", "y")[1] == 3


def test_exact_tails_by_listing_all_arrangements(spark):
    import itertools

    for n1, n2 in ((3, 4), (5, 2), (1, 6)):
        us = [sum(a) - n1 * (n1 - 1) / 2 for a in itertools.combinations(range(n1 + n2), n1)]
        for u in range(n1 * n2 + 1):
            top = max(u, n1 * n2 - u)
            assert abs(ranks.exact_u_sf(u, n1, n2) - min(1.0, 2 * sum(x >= top for x in us) / len(us))) < 1e-12
    assert abs(ranks.exact_u_sf(0, 2, 3000) - 2 / (3002 * 3001 / 2)) < 1e-12
    ws = [sum(i for i, b in enumerate(s, 1) if b) for s in itertools.product((0, 1), repeat=6)]
    got = spark.createDataFrame([(float(w), 0.5, 6, False) for w in range(11)] + [(3.0, 0.0, 6, True), (None, None, 2, False)], "w double, z double, n int, tied boolean").select("w", "tied", ranks.p_of_w("w", "z", "n", "tied").alias("p")).collect()
    assert all(abs(r["p"] - min(1.0, 2 * sum(x <= r["w"] for x in ws) / 64)) < 1e-12 for r in got[:11]) and got[11]["p"] == 1.0 and got[12]["p"] is None
