"""Filling missing values by a mixture model for mixed data (problem 3).

Method: expectation-maximisation for a mixture whose classes hold a Gaussian over the numeric fields (full covariance)
and independent distributions over the categorical ones, all their levels included. Missing numeric fields enter by
their conditional moments, missing categories are left out. Each round every partition adds up its sufficient
statistics, which are summed by Spark; only these numbers reach the driver, classes times levels, whatever the number
of rows. Rounds end when the likelihood of a row no longer grows. Afterwards missing numbers become their conditional
expectation and missing categories their conditional mode, and every cell says what happened to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.session import cut

CLASSES, SEED = 4, 7
#: The most rounds, and the gain in log-likelihood per row below which they end.
ROUNDS, GAIN = 30, 1e-2
#: A categorical field with more levels than this is refused: its shares per class could not be sent to every task.
MOST_LEVELS = 100_000
#: Readings count as at most this many spreads from their field's mean, so that a wild one carries no class away.
REACH = 8.0
#: Weight of the common covariance and of even level shares in each class.
PRIOR_ROWS, PRIOR_LEVEL, FLOOR = 5.0, 0.5, 1e-3


@dataclass
class Mixture:
    """Parameters in standard units; levels per categorical field in order of their code."""

    center: np.ndarray
    spread: np.ndarray
    weight: np.ndarray
    mean: np.ndarray
    cov: np.ndarray
    share: list[np.ndarray]
    levels: list[list[str]]


def _posterior(x: np.ndarray, codes: np.ndarray, m: Mixture) -> tuple[np.ndarray, np.ndarray, dict[int, list[np.ndarray]], np.ndarray, float]:
    """Class probabilities, filled x per class, conditional covariances by missing pattern, pattern of each row, log-likelihood."""
    n, d = x.shape
    k = len(m.weight)
    logp = np.tile(np.log(m.weight), (n, 1))
    for j, share in enumerate(m.share):
        known = codes[:, j] >= 0
        logp[known] += np.log(share[:, codes[known, j]]).T
    filled = np.repeat(x[:, None, :], k, axis=1)
    pattern = (np.isnan(x) * (1 << np.arange(d))).sum(axis=1).astype(int)
    extra: dict[int, list[np.ndarray]] = {}
    for p in np.unique(pattern):
        rows = np.flatnonzero(pattern == p)
        mis = np.array([(p >> a) & 1 for a in range(d)], bool)
        obs, covs = ~mis, []
        for c in range(k):
            full = np.zeros((d, d))
            if obs.any():
                s = m.cov[c][np.ix_(obs, obs)]
                inv = np.linalg.inv(s)
                diff = x[np.ix_(rows, obs)] - m.mean[c][obs]
                logp[rows, c] -= 0.5 * (((diff @ inv) * diff).sum(axis=1) + np.linalg.slogdet(s)[1])
                if mis.any():
                    gain = m.cov[c][np.ix_(mis, obs)] @ inv
                    filled[np.ix_(rows, [c], mis)] = (m.mean[c][mis] + diff @ gain.T)[:, None, :]
                    full[np.ix_(mis, mis)] = m.cov[c][np.ix_(mis, mis)] - gain @ m.cov[c][np.ix_(obs, mis)]
            else:
                filled[np.ix_(rows, [c], mis)] = m.mean[c][mis]
                full = m.cov[c].copy()
            covs.append(full)
        extra[p] = covs
    top = logp.max(axis=1, keepdims=True)
    g = np.exp(logp - top)
    whole = g.sum(axis=1, keepdims=True)
    return g / whole, filled, extra, pattern, float((np.log(whole) + top).sum())


def _statistics(x: np.ndarray, codes: np.ndarray, m: Mixture) -> np.ndarray:
    g, filled, extra, pattern, likelihood = _posterior(x, codes, m)
    k, d = m.mean.shape
    out = [g.sum(axis=0)]
    weighted = g[:, :, None] * filled
    out.append(weighted.sum(axis=0).ravel())
    second = np.stack([weighted[:, c].T @ filled[:, c] for c in range(k)])
    for p, covs in extra.items():
        mass = g[pattern == p].sum(axis=0)
        for c in range(k):
            second[c] += mass[c] * covs[c]
    out.append(second.ravel())
    for j, share in enumerate(m.share):
        known = codes[:, j] >= 0
        out.append(np.stack([np.bincount(codes[known, j], g[known, c], share.shape[1]) for c in range(k)]).ravel())
    out.append(np.array([likelihood, len(x)]))
    return np.concatenate(out)


def _updated(stats: np.ndarray, m: Mixture) -> Mixture:
    k, d = m.mean.shape
    mass = stats[:k] + 1e-9
    mean = stats[k : k + k * d].reshape(k, d) / mass[:, None]
    second = stats[k + k * d : k + k * d + k * d * d].reshape(k, d, d)
    scatter = second - np.einsum("k,kd,ke->kde", mass, mean, mean)
    common = scatter.sum(axis=0) / mass.sum()
    cov = (scatter + PRIOR_ROWS * common) / (mass + PRIOR_ROWS)[:, None, None] + FLOOR * np.eye(d)
    at, share = k + k * d + k * d * d, []
    for s in m.share:
        c = stats[at : at + s.size].reshape(s.shape) + PRIOR_LEVEL
        share.append(c / c.sum(axis=1, keepdims=True))
        at += s.size
    return Mixture(m.center, m.spread, mass / mass.sum(), mean, cov, share, m.levels)


def _matrix(batch: pa.RecordBatch, numerics: list[str], categoricals: list[str], m: Mixture) -> tuple[np.ndarray, np.ndarray]:
    x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in numerics])
    x = np.clip((x - m.center) / m.spread, -REACH, REACH)
    codes = np.column_stack([batch.column(f"_c_{c}").to_numpy(zero_copy_only=False).astype(float) for c in categoricals]) if categoricals else np.zeros((len(x), 0))
    return x, np.where(np.isnan(codes), -1, codes).astype(int)


def _coded(df: DataFrame, categoricals: list[str]) -> tuple[DataFrame, list[list[str]]]:
    """The rows with a code 0.. for every level of each categorical field, null for null, and the levels in order."""
    out, levels = df, []
    for c in categoricals:
        names = [r[0] for r in df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(MOST_LEVELS + 1).collect()]
        if len(names) > MOST_LEVELS:
            raise ValueError(f"{c} has more than {MOST_LEVELS} levels")
        listed = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(names)], "_v string, _i int")
        out = out.join(F.broadcast(listed), F.col(c) == F.col("_v"), "left").withColumn(f"_c_{c}", F.col("_i")).drop("_v", "_i")
        levels.append(names)
    return out, levels


def fit_mixture(df: DataFrame, numerics: list[str], categoricals: list[str], classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[Mixture | None, DataFrame]:
    """Fit on all rows of a table that is cheap to read again. Returns the parameters (None if a numeric field has no value at all) and the coded rows."""
    coded, levels = _coded(df, categoricals)
    base = coded.agg(*(f(c).alias(f"{c}_{k}") for c in numerics for k, f in (("m", F.avg), ("s", F.stddev_samp)))).first()
    if any(base[f"{c}_m"] is None for c in numerics):
        return None, coded
    d, rng = len(numerics), np.random.default_rng(SEED)
    center = np.array([base[f"{c}_m"] for c in numerics], float)
    spread = np.array([s if (s := base[f"{c}_s"]) and np.isfinite(s) and s > 0 else 1.0 for c in numerics], float)
    share = [(s := np.ones((classes, max(len(names), 1))) + 0.2 * rng.random((classes, max(len(names), 1)))) / s.sum(axis=1, keepdims=True) for names in levels]
    place = np.linspace(-1, 1, classes)[:, None] if classes > 1 else np.zeros((1, 1))
    m = Mixture(center, spread, np.full(classes, 1 / classes), place + 0.1 * rng.standard_normal((classes, d)), np.stack([np.eye(d)] * classes), share, levels)
    need = coded.select(*numerics, *(f"_c_{c}" for c in categoricals))
    before = -np.inf
    for _ in range(rounds):
        now = m

        def add_up(batches: Iterator[pa.RecordBatch], now: Mixture = now) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                if b.num_rows:
                    s = _statistics(*_matrix(b, numerics, categoricals, now), now)
                    total = s if total is None else total + s
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total, pa.float64())], ["i", "v"])

        sums = need.mapInArrow(add_up, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        stats = np.zeros(len(sums))
        for r in sums:
            stats[r["i"]] = r["v"]
        if not len(stats):
            return None, coded
        m = _updated(stats, m)
        likelihood = stats[-2] / stats[-1]
        if likelihood - before < GAIN:
            break
        before = likelihood
    return m, coded


def fill_mixed(df: DataFrame, numerics: list[str], categoricals: list[str], classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """The rows with every missing cell filled and a column ``<field>_filled`` of truth values beside each field.

    Null and NaN numbers and null categories are missing. A field without any value stays open, and so does all else
    where no model can be fitted. Repeated rows are filled alike; further columns pass through unless they clash with
    the marks, in which case the call is refused.
    """
    marks = {f"{c}_filled" for c in numerics + categoricals} | {f"_c_{c}" for c in categoricals}
    if marks & set(df.columns):
        raise ValueError(f"columns {sorted(marks & set(df.columns))} are used for marks")
    clean = df.select(*(F.when(~F.isnan(c), F.col(c).cast("double")).alias(c) if c in numerics else F.col(c).cast("string").alias(c) if c in categoricals else F.col(c) for c in df.columns))
    clean = cut(clean)  # read by every round
    some = clean.agg(*(F.count(c).alias(c) for c in numerics)).first()
    usable = [c for c in numerics if some[c]]
    m, coded = fit_mixture(clean, usable, categoricals, classes, rounds) if usable else (None, clean)
    if m is None:
        return coded.select(*df.columns, *(F.lit(False).alias(f"{c}_filled") for c in numerics + categoricals))
    schema = T.StructType([*(f for f in coded.schema.fields if not f.name.startswith("_c_")), *(T.StructField(f"{c}_filled", T.BooleanType()) for c in numerics + categoricals)])
    names, given = [f.name for f in schema.fields], list(df.columns)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, codes = _matrix(b, usable, categoricals, m)
            g, filled, *_ = _posterior(x, codes, m)
            value = np.einsum("nk,nkd->nd", g, filled) * m.spread + m.center
            cols = {c: b.column(c) for c in given}
            for c in numerics + categoricals:
                cols[f"{c}_filled"] = pa.array(np.zeros(b.num_rows, bool))
            for j, c in enumerate(usable):
                gap = np.isnan(x[:, j])
                old = b.column(c).to_numpy(zero_copy_only=False).astype(float)
                cols[c], cols[f"{c}_filled"] = pa.array(np.where(gap, value[:, j], old), pa.float64()), pa.array(gap)
            for j, c in enumerate(categoricals):
                names_j = m.levels[j]
                gap = pa.array((codes[:, j] < 0) & (len(names_j) > 0))
                mode = (g @ m.share[j]).argmax(axis=1)
                if names_j:
                    cols[c] = pc.if_else(gap, pa.array(names_j, pa.string()).take(pa.array(mode)), b.column(c))
                cols[f"{c}_filled"] = gap
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names)

    return coded.mapInArrow(fill, schema)
