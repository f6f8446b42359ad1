"""Design matrices of covariates, matrices by visit, and the order of leaves for heat maps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: More levels or leaves than this are refused: the matrices of their pairs are made in one place.
MOST_LEVELS, MOST_LEAVES = 1000, 2000


def covariates(df: DataFrame, key: str, label: str, numbers: list[str]) -> tuple[DataFrame, list[str]]:
    """(key and columns, names kept): indicators of the label without its first level, and numbers with their median
    for missing ones; only columns that vary and are no linear combination of those before.

    Null labels are Unknown. The rank is read off the cross products, which Spark adds up; their size is that of the
    columns, whatever the rows.
    """
    levels = sorted(r[0] for r in df.select(F.coalesce(label, F.lit("Unknown"))).distinct().limit(MOST_LEVELS + 1).collect())
    if len(levels) > MOST_LEVELS:
        raise ValueError(f"more than {MOST_LEVELS} levels")
    cols: dict[str, Column] = {f"{label}_{v}": (F.coalesce(label, F.lit("Unknown")) == v).cast("double") for v in levels[1:]}
    if numbers:
        facts = df.agg(*(x for c in numbers for x in (F.median(c).alias(f"{c}_m"), F.count(c).alias(f"{c}_n"), F.min(c).alias(f"{c}_a"), F.max(c).alias(f"{c}_b")))).first()
        cols |= {c: F.coalesce(F.col(c).cast("double"), F.lit(float(facts[f"{c}_m"]))) for c in numbers if facts[f"{c}_n"] >= 2 and facts[f"{c}_a"] != facts[f"{c}_b"]}
    x = df.select(key, *(c.alias(n) for n, c in cols.items()))
    kept = independent(x, list(cols))
    return x.select(key, *kept), kept


def independent(x: DataFrame, columns: list[str]) -> list[str]:
    """The columns that add to the rank of those before, from left to right, with a constant in front."""
    if not columns:
        return []
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    r = x.agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    if not r["n"]:
        return []
    cov = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    kept: list[int] = []
    for i in range(len(columns)):
        if cov[i, i] <= 1e-12 * (1 + r[f"m{i}"] ** 2):
            continue
        trial = [*kept, i]
        corr = cov[np.ix_(trial, trial)] / np.outer(scale[trial], scale[trial])
        if np.linalg.matrix_rank(corr, tol=1e-8, hermitian=True) == len(trial):
            kept.append(i)
    return [columns[i] for i in kept]


def visit_matrix(df: DataFrame, subject: str, visit: str, at: str, first: list[str], numbers: list[str]) -> DataFrame:
    """One row per subject of a visit: sample id, first non-null labels, means of the numbers."""
    x = df.where(F.col(visit) == at).groupBy(subject).agg(*(F.first(c, ignorenulls=True).alias(c) if c not in numbers else F.avg(c).alias(c) for c in first + numbers))
    return x.select(F.concat(F.col(subject).cast("string"), F.lit(at)).alias("sample_id"), subject, *first, *numbers)


def ward_order(points: np.ndarray) -> list[int]:
    """Leaves in the order of a Ward tree under Euclidean distance; of two branches the one with the smaller first leaf comes first."""
    n = len(points)
    if n > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} leaves")
    centre, size, leaves, alive = points.astype(float).copy(), np.ones(n), [[i] for i in range(n)], np.ones(n, bool)
    gap = ((centre[:, None] - centre[None]) ** 2).sum(axis=2) / 2 if n else np.zeros((0, 0))
    np.fill_diagonal(gap, np.inf)
    for _ in range(n - 1):
        i, j = divmod(int(gap.argmin()), n)
        i, j = min(i, j), max(i, j)
        centre[i] = (centre[i] * size[i] + centre[j] * size[j]) / (size[i] + size[j])
        size[i] += size[j]
        leaves[i], alive[j] = leaves[i] + leaves[j], False
        d = ((centre - centre[i]) ** 2).sum(axis=1) * size * size[i] / (size + size[i])
        d[~alive] = np.inf
        d[i] = np.inf
        gap[i], gap[:, i], gap[j], gap[:, j] = d, d, np.inf, np.inf
    return leaves[0] if n else []


def leaf_order(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Rows of a long matrix with their place in a Ward tree; missing cells are zero. At most MOST_LEAVES rows."""
    rows = df.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(column, value))).alias("v")).limit(MOST_LEAVES + 1).collect()
    names = sorted({c for r in rows for c in r["v"]})
    rows = sorted(rows, key=lambda r: r[row])
    m = np.array([[r["v"].get(c) or 0.0 for c in names] for r in rows]).reshape(len(rows), len(names))
    return df.sparkSession.createDataFrame([(rows[k][row], i) for i, k in enumerate(ward_order(m))], T.StructType([df.schema[row], T.StructField("place", T.IntegerType())]))
