"""References to records that do not exist (problem 1).

Method: references are first pre-aggregated per key and period. From these counts come the heavy keys: the few most
frequent ones of either side, however frequent, so that no other key holds more than a known share of the rows.
References of heavy keys meet the live spans of those keys by broadcast if the spans are counted and few, else by a
scan over slices of time; all other references go through a shuffled anti-join. The union of both is the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Heavy keys of either side: any other key holds at most one in so many and one of its side's rows.
HEAVY_KEYS = 256
#: Live spans of heavy keys are broadcast up to this number (16 bytes and a key each).
BROADCAST_SPANS = 200_000
#: Slices of about equal numbers of times that the scan cuts a heavy key into, and parts its references are dealt to.
SLICES, PARTS = 256, 32


def per_key_and_period(refs: DataFrame, *beside: str) -> DataFrame:
    """Counts of references per kind, key and month, and further columns if named; null keys are no references."""
    return refs.where(F.col("key").isNotNull()).groupBy("kind", "key", "period", *beside).agg(F.count(F.lit(1)).alias("n_refs"))


def heavy_keys(counts: DataFrame, spans: DataFrame, most: int) -> list[tuple[str, str]]:
    """The (kind, key) pairs with most references and those with most spans, at most ``most`` of each."""
    if most <= 0:
        return []
    top = lambda x: x.orderBy(F.desc("n"), "kind", "key").limit(most)
    found = top(counts.groupBy("kind", "key").agg(F.sum("n_refs").alias("n"))).unionByName(top(spans.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")))).collect()
    return sorted({(r["kind"], r["key"]) for r in found})


def _alive(ref_at: str, start: str, end: str):
    return (F.col(start) <= F.col(ref_at)) & (F.col(end).isNull() | (F.col(end) > F.col(ref_at)))


def _scan(refs: DataFrame, spans: DataFrame) -> DataFrame:
    """Orphans among refs without pairing refs and spans: a running latest end, carried over slices of time.

    One row per key and distinct time is scanned, so that a bulk load of one moment is one row; a key's times are cut
    into slices at their own quantiles, and what a slice inherits is one value. The times without a live target then
    find their references, dealt into parts.
    """
    open_end = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    timed = refs.where(F.col("at").isNotNull())
    events = timed.select("kind", "key", "at", F.lit(None).cast("timestamp_ntz").alias("until"), F.lit(True).alias("is_ref")).unionByName(
        spans.select("kind", "key", F.col("start").alias("at"), F.coalesce("end", open_end).cast("timestamp_ntz").alias("until"), F.lit(False).alias("is_ref"))).groupBy("kind", "key", "at").agg(F.max("until").alias("until"), F.max("is_ref").alias("is_ref"))
    edges = events.groupBy("kind", "key").agg(F.array_distinct(F.percentile_approx("at", [i / SLICES for i in range(1, SLICES)], 10_000)).alias("edges"))
    # the edges are at most SLICES times of fewer than 2 * HEAVY_KEYS keys
    events = events.join(F.broadcast(edges), ["kind", "key"]).withColumn("slice", F.size(F.filter("edges", lambda e: e < F.col("at")))).drop("edges")
    by_slice = Window.partitionBy("kind", "key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = events.groupBy("kind", "key", "slice").agg(F.max("until").alias("top")).withColumn("carry", F.max("top").over(by_slice)).drop("top")
    running = Window.partitionBy("kind", "key", "slice").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = events.withColumn("until_now", F.max("until").over(running)).join(F.broadcast(carry), ["kind", "key", "slice"])  # as many as edges
    last = F.greatest("until_now", "carry")  # ignores nulls
    dead = seen.where(F.col("is_ref") & (last.isNull() | (last <= F.col("at")))).select("kind", "key", "at", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    dealt = timed.withColumn("part", F.pmod(F.xxhash64(*refs.columns), F.lit(PARTS)).cast("int"))
    return dealt.join(dead, ["kind", "key", "at", "part"], "left_semi").select(*refs.columns).unionByName(refs.where(F.col("at").isNull()))


def find_orphans(refs: DataFrame, spans: DataFrame, heavy: int = HEAVY_KEYS, broadcast_spans: int = BROADCAST_SPANS, counts: DataFrame | None = None) -> DataFrame:
    """References without a live target.

    refs: ``kind, key, at, period`` and any further columns, one row per reference; a null key is no reference.
    spans: ``kind, key, start, end``, the times at which a target of this key lives (start included, end not; a null
    end is open, a null start never lives). A reference is live if any span of its kind and key holds its time; one
    with a null time has no live target. Repeated references stay repeated; empty inputs give an empty result.
    counts: per_key_and_period of refs, if at hand.
    """
    refs = refs.where(F.col("key").isNotNull())
    spans = spans.where(F.col("key").isNotNull() & F.col("start").isNotNull() & (F.col("end").isNull() | (F.col("end") > F.col("start")))).select("kind", "key", "start", "end").distinct()
    found = heavy_keys(per_key_and_period(refs) if counts is None else counts, spans, heavy)
    if not found:
        return _anti(refs, spans)
    listed = F.broadcast(refs.sparkSession.createDataFrame(found, "kind string, key string"))  # at most 2 * heavy
    parts = [_anti(refs.join(listed, ["kind", "key"], "left_anti"), spans.join(listed, ["kind", "key"], "left_anti"))]
    hot_refs, hot_spans = (x.join(listed, ["kind", "key"], "left_semi") for x in (refs, spans))
    if hot_spans.limit(broadcast_spans + 1).count() <= broadcast_spans:
        parts.append(_anti(hot_refs, F.broadcast(hot_spans)))
    else:
        parts.append(_scan(hot_refs, hot_spans).select(*refs.columns))
    return reduce(DataFrame.unionByName, parts)


def _anti(refs: DataFrame, spans: DataFrame) -> DataFrame:
    s = spans.select(F.col("kind").alias("_k"), F.col("key").alias("_key"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return refs.join(s, (F.col("kind") == F.col("_k")) & (F.col("key") == F.col("_key")) & _alive("at", "_s", "_e"), "left_anti")


def orphan_report(counts: DataFrame, orphans: DataFrame) -> DataFrame:
    """References and orphans per table, column and month of loading (null: no time given).

    counts: per_key_and_period of the references with table_name and ref_field beside.
    """
    by = ["table_name", "ref_field", "period"]
    total = counts.groupBy(*by).agg(F.sum("n_refs").alias("n_refs"))
    lost = orphans.groupBy(*by).agg(F.count(F.lit(1)).alias("n_orphans"), F.countDistinct("key").alias("n_orphan_keys"))
    on = [total[c].eqNullSafe(lost[c]) for c in by]
    return total.join(lost, on, "left").select(*(total[c] for c in by), "n_refs", F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"), F.coalesce("n_orphan_keys", F.lit(0)).alias("n_orphan_keys"))
