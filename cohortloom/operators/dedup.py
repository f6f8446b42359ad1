"""Deduplication of measured features: quality score, classification, best of group, greedy clusters and components."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.operators.relational import band_join, finite
from cohortloom.session import cut

#: Tolerances and the proton's mass.
PARENT_TOL, OTHER_TOL, RT_TOL, PROTON = 0.02, 0.10, 0.20, 1.007276
#: Mass shifts as (type, name, shift), in order of preference.
MODIFICATIONS = (
    ("Isotope", "13C", 1.003355), ("Isotope", "2x13C", 2.006710), ("Isotope", "15N", 0.997035), ("Isotope", "18O", 2.004245), ("Isotope", "34S", 1.995796),
    ("Adduct", "M+Na", 21.981943), ("Adduct", "M+NH4", 17.026549), ("Adduct", "M+K", 37.955882), ("Adduct", "M+H-H2O", -18.010565), ("Adduct", "M+Cl", 34.969402),
    ("Adduct", "M+FA-H", 44.998201), ("Adduct", "M+Ac-H", 59.013851), ("Adduct", "M+HCOO", 44.998201),
    ("Fragment", "H2O loss", -18.010565), ("Fragment", "CO2 loss", -43.989830), ("Fragment", "NH3 loss", -17.026549), ("Fragment", "CH3 loss", -15.023475),
    ("Fragment", "phosphate loss", -79.966331), ("Fragment", "hexose loss", -162.052824),
)
#: Points by peak rating, by dispersion and by match confidence.
PEAK_POINTS, RSD_POINTS, MATCH_POINTS = ((7, 10), (5, 7), (3, 4)), ((10, 10), (15, 8), (20, 6), (25, 4), (30, 2)), ((90, 10), (80, 9), (70, 8))
#: Points by what fragment spectra there are.
MS2_POINTS = {"DDA for preferred ion": 10, "DDA for other ion": 6, "DDA available": 4}


def _ladder(c: Column, steps: tuple, above: bool, rest: int) -> Column:
    out = F.when(c.isNull(), rest)
    for edge, points in steps:
        out = out.when(c >= edge if above else c < edge, points)
    return out.otherwise(rest)


def source_points(full: Column, not_top: Column, partial: Column) -> Column:
    """Points by annotation sources, where there is no match confidence: 5 to 10 for one to six full matches, else 4
    for any that is not the top hit, else up to 3 for partial ones."""
    n = lambda c: F.coalesce(c, F.lit(0))
    return F.when(n(full) >= 1, F.least(n(full), F.lit(6)) + 4).when(n(not_top) >= 1, 4).otherwise(F.least(n(partial), F.lit(3)))


def quality_score(df: DataFrame, peak: Column, rsd: Column, intensity: Column, match: Column, ms2: Column | None = None, sources: Column | None = None) -> DataFrame:
    """Sum of the ladders, of the points for fragment spectra and of the intensity scaled to 0-10 over all features (10
    if all are alike). sources: points that stand in where the match confidence is missing."""
    i = F.coalesce(intensity, F.lit(0.0))
    lo, hi = df.agg(F.min(i)).scalar(), df.agg(F.max(i)).scalar()
    scaled = F.when(hi > lo, (i - lo) / F.nullif(hi - lo, F.lit(0.0)) * 10).otherwise(10.0)
    spectra = F.lit(0)
    for says, points in MS2_POINTS.items():
        spectra = F.when(ms2 == says, points).otherwise(spectra) if ms2 is not None else spectra
    matched = _ladder(match, MATCH_POINTS, True, 0)
    if sources is not None:
        matched = F.when(match.isNull(), sources).otherwise(matched)
    return df.withColumn("quality_score", _ladder(peak, PEAK_POINTS, True, 1) + _ladder(rsd, RSD_POINTS, False, 0) + scaled + matched + spectra)


def classified(mass: Column, mz: Column, positive: bool = True) -> dict[str, Column]:
    """Parent if the ion's mass is as expected, else the first listed modification within tolerance."""
    delta = mz - (mass + PROTON if positive else mass - PROTON)
    kind, name = F.lit("Unknown/Measurement Error"), F.lit("")
    for t, n, shift in reversed(MODIFICATIONS):
        near = F.abs(F.lit(shift) - delta) <= OTHER_TOL
        kind, name = F.when(near, t).otherwise(kind), F.when(near, n).otherwise(name)
    parent = F.abs(delta) <= PARENT_TOL
    return {"classification": F.when(mass.isNull(), "Unclassified").when(parent, "Parent").otherwise(kind), "modification_name": F.when(mass.isNull() | parent, "").otherwise(name)}


def rt_flag(n: Column, spread: Column) -> Column:
    return F.when((n < 2) | spread.isNull(), "single_candidate").when(spread < 0.5, "chromatographic_artifact").when(spread <= 3.0, "potential_structural_isomers").otherwise("likely_annotation_error")


def best_of_group(df: DataFrame, group: str, key: str) -> DataFrame:
    """Winner of each group among its best class of candidates, and the spread of their retention times.

    Needs ``classification, quality_score, area, rsd, rt``. Parents go before other known ions, these before all else.
    """
    tier = F.when(F.col("classification") == "Parent", 0).when(F.col("classification") != "Unknown/Measurement Error", 1).otherwise(2)
    x = df.withColumn("_tier", tier)
    top = x.groupBy(group).agg(F.min("_tier").alias("_top"))
    cand = x.join(top, group).where("_tier = _top")
    order = F.struct(-F.col("quality_score"), -F.coalesce("area", F.lit(float("-inf"))), F.coalesce("rsd", F.lit(float("inf"))), F.coalesce("rt", F.lit(float("inf"))), F.col(key))
    return cand.groupBy(group).agg(F.min_by(key, order).alias("winner"), F.count(F.lit(1)).alias("n_candidates"), (F.max("rt") - F.min("rt")).alias("rt_spread")).withColumn("rt_flag", rt_flag(F.col("n_candidates"), F.col("rt_spread")))


def greedy_clusters(df: DataFrame, key: str, rt: str, mz: str, rt_tol: float = RT_TOL, mz_tol: float = PARENT_TOL, within: str | None = None) -> DataFrame:
    """Cluster of each feature: in order of rt, mz and key, a free feature takes all free ones near it (of the same
    value of within, if named).

    Order matters, so islands are built first: features further apart in mz than the tolerance cannot touch, directly
    or through others. Masses are cut where neighbours in mz lie too far apart; each island is then a group of its own.
    Islands are found over coarse cells of mz, so that no sort runs over all features. An island is swept by one
    task: it is bounded by how many features an instrument tells apart without a gap, not by the number of samples.
    """
    cell = F.floor(F.col(mz) / (mz_tol * 50))
    x = df.select(key, F.col(rt).alias("rt"), F.col(mz).alias("mz"), cell.alias("cell"), (F.col(within) if within else F.lit(0)).alias("_within"))
    ends = x.groupBy("_within", "cell").agg(F.max("mz").alias("top"), F.min("mz").alias("low"))
    over = Window.partitionBy("_within").orderBy("cell")  # one row per occupied cell
    island = ends.withColumn("_new", F.when(F.col("low") - F.lag("top").over(over) <= mz_tol, 0).otherwise(1)).withColumn("island", F.sum("_new").over(over)).select("_within", "cell", "island")

    def sweep(p: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        p = p.sort_values(["rt", "mz", key]).reset_index(drop=True)
        r, m, out = p["rt"].to_numpy(), p["mz"].to_numpy(), np.full(len(p), -1)
        for i in range(len(p)):
            if out[i] < 0:
                end = np.searchsorted(r, r[i] + rt_tol + 1e-12, side="right")
                near = np.flatnonzero((out[i:end] < 0) & (np.abs(m[i:end] - m[i]) <= mz_tol) & (r[i:end] - r[i] <= rt_tol)) + i
                out[near] = i
        return pd.DataFrame({key: p[key], "seed": p[key].to_numpy()[out]})

    kind = df.schema[key].dataType.simpleString()
    return x.join(island, ["_within", "cell"]).drop("cell").groupBy("_within", "island").applyInPandas(sweep, f"{key} {kind}, seed {kind}")


def unnamed_clusters(df: DataFrame, key: str, rt: str, mz: str, formula: str) -> DataFrame:
    """Clusters of features without a name: those with a formula among features of the same formula and the wider mass
    tolerance, those without among themselves and the narrower one. Blank and null formulas are none."""
    has = F.coalesce(F.trim(formula) != "", F.lit(False))
    return greedy_clusters(df.where(has), key, rt, mz, mz_tol=OTHER_TOL, within=formula).unionByName(greedy_clusters(df.where(~has), key, rt, mz))


def components(nodes: DataFrame, edges: DataFrame, node: str, a: str = "a", b: str = "b") -> DataFrame:
    """Least node of each node's connected component. Null nodes and loops have no edges; ends of edges that are no
    nodes still connect.

    Each round every label hooks onto the neighbour that comes first in an order that is drawn anew by hash, hooks are
    followed four deep, and edges are drawn between the labels that are left. In a random order a label comes before
    all its neighbours with a chance below one half, so labels with edges at least halve, by expectation, whatever the
    graph's shape; a chain of n nodes takes about log n rounds. Two checkpoints cut a round; it ends without edges.
    Hooks and labels may be as many as nodes, so no join is a broadcast, whatever size is estimated.
    """
    links = cut(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b), F.col(a))).where("x <> y").distinct())
    hooks: list[DataFrame] = []
    while links.limit(1).count():
        place = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(hooks))).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        hook = links.groupBy("x").agg(F.min(place("y")).alias("m")).select("x", F.when(F.col("m") < place("x"), F.col("m.v")).otherwise(F.col("x")).alias("p"))
        for _ in range(2):
            up = hook.select(F.col("x").alias("_x"), F.col("p").alias("_p"))
            hook = hook.join(up.hint("merge"), F.col("p") == F.col("_x")).select("x", F.col("_p").alias("p"))
        hook = cut(hook)
        hooks.append(hook)
        left, right = hook.select(F.col("x").alias("_a"), F.col("p").alias("_pa")), hook.select(F.col("x").alias("_b"), F.col("p").alias("_pb"))
        links = cut(links.join(left.hint("merge"), F.col("x") == F.col("_a")).join(right.hint("merge"), F.col("y") == F.col("_b")).select(F.col("_pa").alias("x"), F.col("_pb").alias("y")).where("x <> y").distinct())
    label = nodes.select(F.col(node).alias("n"), F.col(node).alias("c")).distinct()
    for hook in hooks:
        label = label.join(hook.hint("merge"), F.col("c") == F.col("x"), "left").select("n", F.coalesce("p", "c").alias("c"))
    label = cut(label)
    least = label.groupBy("c").agg(F.min("n").alias("least"))
    return label.join(least.withColumnRenamed("c", "_c").hint("merge"), F.col("c").eqNullSafe(F.col("_c"))).select(F.col("n").alias(node), F.col("least").alias("component"))


def near_components(df: DataFrame, key: str, x: str, y: str, x_tol: float, y_tol: float) -> DataFrame:
    """Components of the rows that band_join pairs, without listing all pairs: ``key, component``.

    Rows at one point are all near each other, so only points are paired and labelled, each under its least key; a key
    that stands at several points connects them. Two points have one edge, however many rows stand at either.
    """
    at = finite(df, x, y).where(F.col(key).isNotNull()).select(F.col(key).alias("n"), F.col(x).alias("x"), F.col(y).alias("y"))
    at = at.withColumn("least", F.min("n").over(Window.partitionBy("x", "y"))).withColumn("first", F.min("least").over(Window.partitionBy("n")))
    at = cut(at)
    points = at.select("least", "x", "y").distinct()
    edges = band_join(points, "least", "x", "y", x_tol, y_tol).select("a", "b").union(at.where("first <> least").select("first", "least"))
    label = components(points, edges, "least")
    known = at.select("n", "first").distinct().join(label.hint("merge"), F.col("first") == F.col("least")).select("n", "component")
    own = df.select(F.col(key).alias("_key")).distinct()
    return own.join(known.hint("merge"), F.col("_key") == F.col("n"), "left").select(F.col("_key").alias(key), F.coalesce("component", "_key").alias("component"))
