"""Implausible spikes, stuck values and impossible readings per source (problem 5).

Method: per source and field a robust seasonal-trend decomposition (weekday medians and a running median), residuals
tested by the generalised extreme studentised deviate procedure: the most extreme deviate is taken out, centre and
scale (median and median deviation) are estimated anew, and so on; where spikes were found, season and trend are
estimated once more without them and the test is repeated. Constant runs, ranges and the order of related fields are
separate checks. A source's series is first reduced to one reading a day, so that a series is never longer than its
calendar, however many rows a source sends; only days that are outside their limits or stuck leave the workers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.tails import t_sf

#: Days in the running median, days at either side that a single spike must stand out from, least length of a series.
TREND_DAYS, SIDE_DAYS, LEAST_DAYS = 21, 5, 8
#: Error rate of the deviate test over a whole series; small, as every participant and field is tested.
ALPHA = 1e-5
#: What a day says about a scale when it is read off median deviations, against the usual deviation; and how many such
#: days the scatter that is typical of all sources counts.
MEDIAN_EFFICIENCY, PRIOR_DAYS = 0.37, 5.0
#: A run of this many recorded days with one reading is stuck.
RUN_DAYS = 4


def _t_quantile(q: float, df: float) -> float:
    """Upper quantile of Student's t: tail probability q, by bisection of the incomplete beta function."""
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        if t_sf(mid, df) > q:
            lo = mid
        else:
            hi = mid
        if hi - lo < 1e-9 * max(1.0, hi):
            break
    return (lo + hi) / 2


_LAMBDA: dict[tuple[int, int, float], float] = {}


def critical(n: int, i: int, alpha: float = ALPHA) -> float:
    """The i-th critical value of the generalised extreme studentised deviate test on n values."""
    key = (n, i, alpha)
    if key not in _LAMBDA:
        left = n - i + 1
        df = max(left - 2, 1)
        t = _t_quantile(alpha / (2 * left), df)
        _LAMBDA[key] = (left - 1) * t / math.sqrt((df + t * t) * left)
    return _LAMBDA[key]


def _running_median(y: np.ndarray, width: int) -> np.ndarray:
    h = min(width // 2, len(y) - 1)
    padded = np.concatenate([y[1 : h + 1][::-1], y, y[-h - 1 : -1][::-1]])
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, 2 * h + 1), axis=1)


def _median_before(y: np.ndarray, days: int) -> np.ndarray:
    """Median of the days before each one; nan for the first."""
    out = np.full(len(y), np.nan)
    for k in range(1, min(days, len(y))):
        out[k] = np.median(y[:k])
    if len(y) > days:
        out[days:] = np.median(np.lib.stride_tricks.sliding_window_view(y, days)[:-1], axis=1)
    return out


def decompose(y: np.ndarray, weekday: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(season, trend) of a series."""
    season = np.zeros(7)
    for _ in range(2):
        rest = y - _running_median(y - season[weekday], TREND_DAYS)
        for d in range(7):
            of_day = rest[weekday == d]
            season[d] = np.median(of_day) * len(of_day) / (len(of_day) + 2) if len(of_day) >= 3 else 0.0
        season -= np.median(season)
    return season[weekday], _running_median(y - season[weekday], TREND_DAYS)


def centre_and_scale(rest: np.ndarray, a: np.ndarray, typical: float, least: float) -> tuple[float, float]:
    """Median of the residuals, and the larger of their and the differences' spread, drawn towards the typical one.

    The first spread is corrected for what season and trend take up; the second does not depend on the trend's window.
    A short series' spread may be small by chance, so it is averaged with the typical spread by what both are worth.
    """
    n = len(rest)
    centre = float(np.median(rest))
    own = 1.4826 * float(np.median(np.abs(rest - centre))) * math.sqrt(n / max(n - 7 - n / 10, n / 3))
    steps = 1.4826 * float(np.median(np.abs(np.diff(a)))) / math.sqrt(2) if n > 1 else 0.0
    worth = MEDIAN_EFFICIENCY * n
    return centre, max(math.sqrt((worth * max(own, steps) ** 2 + PRIOR_DAYS * typical**2) / (worth + PRIOR_DAYS)), least)


def extreme_deviates(low: np.ndarray, high: np.ndarray, a: np.ndarray, trend: np.ndarray, typical: float, least: float, alpha: float) -> tuple[list[int], float, float]:
    """The days that the generalised procedure finds, most extreme first, the residuals' centre, and the distance from
    low and high beyond which a reading is one of them.

    A deviate is measured from low or high, each moved by the centre. At most a fifth of the days is taken out; the
    number found is the last step at which the deviate exceeded its critical value. The test ends early where even the
    scale without all candidates could not make the next deviate exceed the least critical value.
    """
    n, rest = len(a), a - trend
    most = max(1, n // 5)
    centre, scale = centre_and_scale(rest, a, typical, least)
    distance = lambda c: np.maximum(np.maximum(low + c - a, a - high - c), 0)
    order = np.argsort(-distance(centre), kind="stable")
    inner = np.sort(order[most:])
    floor = min(scale, centre_and_scale(rest[inner], a[inner], typical, least)[1])
    weakest = critical(n, most, alpha) * floor
    there = np.ones(n, bool)
    taken: list[int] = []
    found, edge = 0, critical(n, 1, alpha) * scale
    for i in range(1, most + 1):
        d = np.where(there, distance(centre), -1.0)
        k = int(d.argmax())
        if found == i - 1 and found:
            edge = (edge + max(float(d[k]), 0.0)) / 2  # halfway to the next one
        if d[k] <= weakest:
            break
        taken.append(k)
        if d[k] > critical(n, i, alpha) * scale:
            found, edge = i, float(d[k])
        there[k] = False
        centre, scale = centre_and_scale(rest[there], a[there], typical, least)
    return taken[:found], centre, edge


def limits(y: np.ndarray, weekday: np.ndarray, typical: float, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """Per day the lowest and highest reading that is no spike.

    A spike must stand out from the trend and from the days before and after alike, so that the first days of a new
    level are none. typical: the scatter of most sources.
    """
    least = 1e-3 * max(1.0, abs(float(np.median(y))))
    season, trend = decompose(y, weekday)
    for again in (True, False):
        a = y - season
        before, after = _median_before(a, SIDE_DAYS), _median_before(a[::-1], SIDE_DAYS)[::-1]
        low, high = np.fmin(trend, np.fmin(before, after)), np.fmax(trend, np.fmax(before, after))
        found, centre, edge = extreme_deviates(low, high, a, trend, typical, least, alpha)
        if not (found and again):
            break
        calm = y.copy()
        calm[found] = trend[found] + season[found]
        season, trend = decompose(calm, weekday)
    return low + centre + season - edge, high + centre + season + edge


def _series_limits(batches: Iterator[pa.RecordBatch], fields: list[str], logs: set[str], ceilings: dict[str, float], typical: dict[str, float], alpha: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("source", "day", "field", "reading", "lo", "hi", "stuck")}
        days_col, sources = batch.column("days"), batch.column("source").to_pylist()
        get = lambda c, r: batch.column(c)[r].values.to_numpy(zero_copy_only=False).astype(float)  # noqa: B023, E731
        for r, source in enumerate(sources):
            days = days_col[r].values.to_numpy(zero_copy_only=False).astype(np.int64)
            for f in fields:
                y = get(f, r)
                there = np.isfinite(y)
                d, y = days[there], y[there]
                if not len(y):
                    continue
                cuts = np.flatnonzero(np.diff(y) != 0) + 1
                starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(y)]])
                stuck = np.repeat(ends - starts >= RUN_DAYS, ends - starts)
                fair = (y >= 0) & (y <= ceilings[f])
                lo, hi = np.full(len(y), np.nan), np.full(len(y), np.nan)
                if fair.sum() >= LEAST_DAYS:
                    z = np.log(np.maximum(y[fair], 1.0)) if f in logs else y[fair]
                    b = limits(z, (d[fair] + 3) % 7, typical[f], alpha)
                    lo[fair], hi[fair] = [np.exp(np.minimum(x, 700)) for x in b] if f in logs else b
                    if f in logs:  # the logarithm starts at one
                        lo[fair] = np.where(lo[fair] <= 1, -np.inf, lo[fair])
                told = stuck | (get(f"{f}__min", r)[there] < lo) | (get(f"{f}__max", r)[there] > hi)
                k = int(told.sum())
                out["source"] += [source] * k
                out["field"] += [f] * k
                for c, v in (("day", d), ("stuck", stuck), ("reading", y), ("lo", lo), ("hi", hi)):
                    out[c].append(v[told])
        if out["source"]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["source"], pa.string()), pa.array(np.concatenate(out["day"]).astype(np.int32), pa.int32()), pa.array(out["field"], pa.string()),
                 *(pa.array(v := np.concatenate(out[k]), pa.float64(), mask=np.isnan(v)) for k in ("reading", "lo", "hi")), pa.array(np.concatenate(out["stuck"]), pa.bool_())],
                ["source", "day", "field", "reading", "lo", "hi", "stuck"])


def typical_scatter(readings: DataFrame, fields: list[str], logs: set[str], ceilings: dict[str, float]) -> dict[str, float]:
    """Per field the median over sources of the deviation of their possible readings; 0 without any."""
    z = {f: F.when((F.col(f) >= 0) & (F.col(f) <= ceilings[f]), F.log(F.greatest(F.col(f), F.lit(1.0))) if f in logs else F.col(f).cast("double")) for f in fields}
    per = readings.where(F.col("source").isNotNull()).groupBy("source").agg(*(F.when(F.count(z[f]) >= LEAST_DAYS, F.stddev_samp(z[f])).alias(f) for f in fields))
    got = per.agg(*(F.percentile_approx(f, 0.5).alias(f) for f in fields)).first()
    return {f: float(got[f] or 0.0) for f in fields}


def odd_days(readings: DataFrame, fields: list[str], logs: set[str], ceilings: dict[str, float], alpha: float = ALPHA) -> DataFrame:
    """Per source, day and field with a reading outside its limits or in a stuck run: limits, reading and ``stuck``.

    readings: ``source, day (days since 1970), row_id`` and the fields. Of a day sent several times the reading with
    the lowest row_id stands for the day. One row per source is built: at most one entry per calendar day.
    """
    real = lambda f: F.when(F.col(f).isNotNull() & ~F.isnan(f), F.col(f))
    each = [x for f in fields for x in (F.min_by(real(f), F.when(real(f).isNotNull(), F.col("row_id"))).alias(f), F.min(real(f)).alias(f"{f}__min"), F.max(real(f)).alias(f"{f}__max"))]
    daily = readings.where(F.col("source").isNotNull() & F.col("day").isNotNull()).groupBy("source", "day").agg(*each)
    names = [n for f in fields for n in (f, f"{f}__min", f"{f}__max")]
    series = daily.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("day", *names))).alias("s")).select(
        "source", F.col("s.day").alias("days"), *(F.transform(F.col(f"s.{n}"), lambda x: F.coalesce(x, F.lit(float("nan")))).alias(n) for n in names))
    typical = typical_scatter(readings, fields, logs, ceilings)
    schema = "source string, day int, field string, reading double, lo double, hi double, stuck boolean"
    return series.mapInArrow(lambda it: _series_limits(it, fields, logs, ceilings, typical, alpha), schema)


def flag_readings(readings: DataFrame, fields: list[str], logs: set[str], ceilings: dict[str, float], within: list[tuple[str, str]], alpha: float = ALPHA) -> DataFrame:
    """One row per flagged reading: ``row_id, field_name, value, impossible, spike, stuck, inconsistent, lo, hi``.

    within: pairs (part, whole) of fields where the part cannot exceed the whole. If it does, the one that is
    impossible or a spike in its own series is flagged; if neither is, both are. Null and NaN readings are none and never
    flagged; rows without source or day are checked for ranges and pairs only; short series have no limits. Repeated
    rows are all flagged.
    """
    real = {f: F.when(F.col(f).isNotNull() & ~F.isnan(f), F.col(f)) for f in fields}
    rows = readings.select("row_id", "source", "day", *(real[f].alias(f) for f in fields))
    cols = ("reading", "lo", "hi", "stuck")
    lim = odd_days(readings, fields, logs, ceilings, alpha).groupBy("source", "day").agg(
        *(F.max(F.when(F.col("field") == f, F.struct(*cols))).alias(f"{f}__l") for f in fields))
    x = rows.join(lim, ["source", "day"], "left")
    off = {f: F.coalesce((F.col(f) < F.col(f"{f}__l.lo")) | (F.col(f) > F.col(f"{f}__l.hi")) | (F.col(f) < 0) | (F.col(f) > ceilings[f]), F.lit(False)) for f in fields}
    crossed = {f: F.lit(False) for f in fields}
    for part, whole in within:
        bad = F.coalesce(F.col(part) > F.col(whole), F.lit(False))
        neither = ~off[part] & ~off[whole]
        crossed[part] = crossed[part] | (bad & (off[part] | neither))
        crossed[whole] = crossed[whole] | (bad & (off[whole] | neither))
    each = F.array(*(F.struct(
        F.lit(f).alias("field_name"), F.col(f).alias("value"),
        F.coalesce((F.col(f) < 0) | (F.col(f) > ceilings[f]), F.lit(False)).alias("impossible"),
        F.coalesce((F.col(f) < F.col(f"{f}__l.lo")) | (F.col(f) > F.col(f"{f}__l.hi")), F.lit(False)).alias("spike"),
        F.coalesce(F.col(f"{f}__l.stuck") & (F.col(f"{f}__l.reading") == F.col(f)), F.lit(False)).alias("stuck"), crossed[f].alias("inconsistent"),
        F.col(f"{f}__l.lo").alias("lo"), F.col(f"{f}__l.hi").alias("hi")) for f in fields))
    flat = x.select("row_id", F.explode(each).alias("r")).select("row_id", "r.*")
    return flat.where(F.col("value").isNotNull() & (F.col("impossible") | F.col("spike") | F.col("stuck") | F.col("inconsistent")))
