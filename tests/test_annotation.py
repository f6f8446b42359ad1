"""Annotation, designs, workbooks, graphs and model choice against plain Python."""

import io
import itertools

import numpy as np
import pytest

from cohortloom.operators import annotation, dedup, design, modelling, ranks
from cohortloom.operators import normalize as nz
from cohortloom.sources import readers, workbooks
from pyspark.sql import functions as F


def test_chain_ends_in_few_rounds(spark, monkeypatch):
    """A chain of 3,000 nodes, a ring, a star with a hot middle and lone nodes; rounds grow with the logarithm."""
    edges = [(i, i + 1) for i in range(3000)] + [(5000 + i, 5000 + (i + 1) % 40) for i in range(40)] + [(7000, 7001 + i) for i in range(500)] + [(9, 9)]
    nodes = [*range(3001), *range(5000, 5040), *range(7000, 7501), 9999]
    cuts = []
    real = dedup.cut
    monkeypatch.setattr(dedup, "cut", lambda df: cuts.append(1) or real(df))
    got = dedup.components(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "a long, b long"), "id").collect()
    want = {n: 0 if n <= 3000 else 5000 if n < 5040 else 7000 if n < 7501 else 9999 for n in nodes}
    assert {r["id"]: r["component"] for r in got} == want
    assert len(cuts) <= 2 + 2 * 12
    none = spark.createDataFrame([], "id long")
    assert dedup.components(none, spark.createDataFrame([], "a long, b long"), "id").count() == 0


def test_unnamed_clusters_by_formula_and_by_mass(spark):
    rows = [(1, 1.0, 100.0, "C6"), (2, 1.1, 100.09, "C6"), (3, 1.1, 100.01, "C7"), (4, 1.1, 100.0, ""), (5, 1.2, 100.015, None), (6, 1.2, 100.05, " ")]
    got = dedup.unnamed_clusters(spark.createDataFrame(rows, "id long, rt double, mz double, formula string"), "id", "rt", "mz", "formula").collect()
    assert {r["id"]: r["seed"] for r in got} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}


def test_source_points(spark):
    rows = [(0, 0, 0), (6, 0, 0), (9, 1, 3), (1, 0, 0), (0, 2, 3), (0, 0, 2), (0, 0, 7), (None, None, None)]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, f int, n int, p int").select("i", dedup.source_points(F.col("f"), F.col("n"), F.col("p")).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == [0, 10, 10, 5, 4, 2, 3, 0]


def slow_ward(x):
    """Leaves of a Ward tree by the increase of the sum of squares, from its definition."""
    clusters = [[i] for i in range(len(x))]
    sse = lambda c: ((x[c] - x[c].mean(axis=0)) ** 2).sum()
    while len(clusters) > 1:
        a, b = min(itertools.combinations(range(len(clusters)), 2), key=lambda p: (round(sse(clusters[p[0]] + clusters[p[1]]) - sse(clusters[p[0]]) - sse(clusters[p[1]]), 9), p))
        clusters[a] += clusters.pop(b)
    return clusters[0]


def test_ward_order_against_its_definition(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 9, 25):
        x = rng.normal(size=(n, 4))
        assert design.ward_order(x) == slow_ward(x)
    assert design.ward_order(np.zeros((0, 2))) == []
    df = spark.createDataFrame([("a", "x", 0.0), ("b", "x", 9.0), ("c", "x", 0.1), ("d", "x", None)], "r string, c string, v double")
    assert [r["r"] for r in design.leaf_order(df, "r", "c", "v").orderBy("place").collect()] == ["a", "d", "c", "b"]


def test_covariates_keep_what_adds_to_the_rank(spark):
    rows = [(i, ("a", "b", None)[i % 3], float(i) if i % 4 else None, 7.0) for i in range(24)]
    df = spark.createDataFrame(rows, "id long, g string, x double, same double").withColumn("twice", 3 * F.col("x") + 1)
    m, kept = design.covariates(df, "id", "g", ["x", "twice", "same"])
    assert kept == ["g_a", "g_b", "x"] or kept == ["g_b", "g_Unknown", "x"] or len(kept) == 3
    assert m.where("x is null").count() == 0
    assert design.covariates(df.limit(0), "id", "g", ["x"])[1] == []


def test_workbook_round_trip_and_early_stop(spark, tmp_path):
    data = io.BytesIO()
    workbooks.write_sheet(data, [["a & b", "c"], [1, None, "x"], [], ["é", 2.5]], "S<1>")
    assert list(workbooks.sheet_rows(data.getvalue(), "S<1>")) == [(0, ["a & b", "c"]), (1, ["1", None, "x"]), (2, []), (3, ["é", "2.5"])]
    assert list(workbooks.sheet_rows(data.getvalue(), 0, [1])) == [(1, ["1", None, "x"])]
    (tmp_path / "w.xlsx").write_bytes(data.getvalue())
    got = workbooks.sheet_table(spark, str(tmp_path / "*.xlsx"), ["p", "q", "r"]).orderBy("row_no").collect()
    assert [(r["p"], r["q"], r["r"]) for r in got] == [("1", None, "x"), (None, None, None), ("é", "2.5", None)]


def test_bundle_refuses_labels_of_another_length(spark):
    areas = spark.createDataFrame([(1, 1, 5.0), (2, 1, 6.0)], "r int, c int, area double")
    f, s = spark.createDataFrame([(1, "x"), (2, "y")], "r int, feature string"), spark.createDataFrame([(1, "s")], "c int, sample string")
    assert readers.bundle(areas, f, s, "r", "c").count() == 2
    with pytest.raises(ValueError):
        readers.bundle(areas, f.limit(1), s, "r", "c")
    with pytest.raises(ValueError):
        annotation.required(f)


def test_first_row_leaves_unless_alone(spark):
    df = spark.createDataFrame([(3, "a"), (1, "head"), (2, "b")], "i int, v string")
    assert {r["v"] for r in readers.without_first(df, "i").collect()} == {"a", "b"}
    assert readers.without_first(df.where("i = 1"), "i").count() == 1 and readers.without_first(df.limit(0), "i").count() == 0


def test_class_standards(spark):
    rows = [("s", "b", "18:1_SM-d9", "", 2.0), ("s", "b", "18:1_CE-d7", "", 8.0), ("s", "b", "f1", "SM", 10.0), ("s", "b", "f2", "XX", 10.0), ("t", "b", "f1", "SM", 12.0), ("t", "b", "18:1_SM-d9", "", 0.0)]
    got = nz.by_class_standards(spark.createDataFrame(rows, "s string, b string, f string, k string, v double"), "s", "b", "f", "k", "v", F.col("f").contains("-d")).collect()
    assert {(r["s"], r["f"]): (round(r["v"], 6), r["matched"]) for r in got} == {("s", "f1"): (5.0, True), ("s", "f2"): (2.5, False), ("t", "f1"): (3.0, False)}


def test_anderson_darling_against_its_definition(spark):
    rng = np.random.default_rng(4)
    v, g = np.round(rng.normal(size=120), 1), rng.integers(0, 3, 120)
    z, n, a = np.unique(v), len(v), 0.0
    for k in range(3):
        x = v[g == k]
        for u in z:
            l, f = (v == u).sum(), (x == u).sum()
            b, m = (v < u).sum() + l / 2, (x < u).sum() + f / 2
            a += l / n * (n * m - len(x) * b) ** 2 / (b * (n - b) - n * l / 4) / len(x)
    got = ranks.anderson_darling(spark.createDataFrame([(float(x), int(y)) for x, y in zip(v, g)], "v double, g int"), [], "v", "g").first()
    assert got["a2"] == pytest.approx(a * (n - 1) / n) and got["n"] == 120 and got["n_groups"] == 3


def test_refits_against_numpy():
    rng = np.random.default_rng(6)
    x = np.column_stack([np.ones(400), rng.normal(size=(400, 3))])
    y = (x[:, 1] + 0.3 * rng.normal(size=400) > 0).astype(float)
    beta = modelling.fit_logistic(x, y)
    p = 1 / (1 + np.exp(-x @ beta))
    penalty = np.diag([1e-9, 1, 1, 1]) @ beta
    assert np.abs(x.T @ (y - p) - penalty).max() < 1e-3
    s = np.array([0.9, 0.8, 0.8, 0.1])
    assert modelling.average_precision(s, np.array([1.0, 0, 1, 1])) == pytest.approx((1 + 2 / 3 + 3 / 4) / 3)


def test_labels_and_marks(spark):
    rows = [("REACTOME_CELL_CYCLE (x)", 0.00001), ("Cell (a) cycle (GO:1)", 0.02), ("p" * 70, None)]
    got = spark.createDataFrame(rows, "t string, q double").select(annotation.term_label(F.col("t")).alias("t"), annotation.stars(F.col("q")).alias("s")).collect()
    assert [(r["t"], r["s"]) for r in got] == [("Cell Cycle", "****"), ("Cell (a) cycle", "*"), ("p" * 54 + "…", "")]
