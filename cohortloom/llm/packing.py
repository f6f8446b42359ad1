"""Filling fixed-capacity containers with items (problem 8).

Method: a configuration linear program over the histogram of item sizes. Sizes are rounded up to classes finer than
1/256 of their size; multiplicative weights price the classes, an unbounded knapsack by dynamic programming finds the
most valuable configuration of each round. The rounds' fractions are rounded to whole containers: down first, then, by
the largest remainder, up as long as the items suffice; so the program decides at any size, also where all fractions
are below one. What is left is laid out class by class, each step using up at least one class. The histogram has at most one entry per
unit of capacity, so that the driver's share does not grow with the data. Items then find their containers by their
rank within their class.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.session import cut

CAPACITY, ROUNDS, RATE = 8192, 80, 1.0
#: Steps that would cover all demand at the start, and the fill a configuration must have to be taken, at the last step less.
FIRST_STEPS, NEARLY_FULL, LAST_FULL = 32, 0.998, 0.95
#: Power of its size that a class is worth: above one, as small items find a place later on.
LARGE_FIRST = 1.1
#: Items per bucket when ranks are counted, by expectation.
BUCKET_ITEMS = 50_000


def size_class(size, capacity: int):
    """Size rounded up to a multiple of a step that is at most 1/256 of it; never above the capacity."""
    size = np.asarray(size, np.int64)
    step = 2 ** np.maximum(np.floor(np.log2(np.maximum(size, 1))).astype(np.int64) - 8, 0)
    return np.minimum(-(-size // step) * step, capacity)


def best_configuration(sizes: np.ndarray, values: np.ndarray, most: np.ndarray, capacity: int) -> dict[int, int]:
    """Most valuable configuration within the capacity, class index -> copies, with at most ``most`` copies of a class.

    Knapsack by dynamic programming: copies are bundled by powers of two, so that each bundle is taken or not.
    """
    bundles: list[tuple[int, int, int, float]] = []
    for j in np.flatnonzero((most > 0) & (values > 0)):
        left, k = int(min(most[j], capacity // sizes[j])), 1
        while left > 0:
            k = min(k, left)
            bundles.append((int(j), k, k * int(sizes[j]), k * float(values[j])))
            left, k = left - k, 2 * k
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(bundles), capacity + 1), bool)
    for i, (_, _, size, value) in enumerate(bundles):
        gain = best[: capacity + 1 - size] + value
        better = gain > best[size:]
        taken[i, size:] = better
        best[size:] = np.where(better, gain, best[size:])
    out: dict[int, int] = {}
    c = capacity
    for i in range(len(bundles) - 1, -1, -1):
        if taken[i, c]:
            j, k, size, _ = bundles[i]
            out[j] = out.get(j, 0) + k
            c -= size
    return out


def fractions(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int) -> dict[tuple, float]:
    """The program's solution: configurations, as sorted (class index, copies), and how many containers take each.

    Every round prices the classes by multiplicative weights, asks for the most valuable configuration that can be
    taken a whole step, and covers demand by it. When no such configuration is nearly full the step is halved, down to
    one container, or a fraction of one where there are few; so the number of rounds does not grow with the counts.
    """
    least = float((sizes * counts).sum()) / capacity
    cover, share = np.zeros(len(sizes)), {}
    step, smallest = least / FIRST_STEPS, min(1.0, least / rounds)
    if step > 1:
        step = float(np.floor(step))
    while True:
        most = np.minimum(np.floor((counts - cover) / step + 1e-9).astype(np.int64), counts)
        # a class is worth its size at first, large ones a little more, and exponentially less the more of its demand is covered
        conf = best_configuration(sizes, sizes**LARGE_FIRST * np.exp(-RATE * cover / counts), most, capacity)
        if sum(a * int(sizes[j]) for j, a in conf.items()) >= (NEARLY_FULL if step > smallest else LAST_FULL) * capacity:
            for j, a in conf.items():
                cover[j] += a * step
            key = tuple(sorted(conf.items()))
            share[key] = share.get(key, 0.0) + step
        elif step <= smallest:
            return share
        else:
            step = max(step / 2 if step < 2 else float(np.floor(step / 2)), smallest)


def solve(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """Whole configurations (class index -> copies) and how many containers take each; every item gets a place."""
    left = counts.astype(np.int64).copy()
    plan: list[tuple[dict[int, int], int]] = []

    def use(conf: dict[int, int], times: int) -> None:
        plan.append((conf, times))
        for j, a in conf.items():
            left[j] -= a * times

    least = float((sizes * counts).sum()) / capacity
    share = fractions(sizes, counts, capacity, rounds)
    fits = lambda conf: int(min(left[j] // a for j, a in conf.items()))
    for key, x in share.items():
        times = min(int(np.floor(x)), fits(dict(key)))
        if times > 0:
            use(dict(key), times)
    whole = sum(times for _, times in plan)
    for key, _ in sorted(share.items(), key=lambda c: (-(c[1] - np.floor(c[1])), c[0])):
        if whole < np.floor(least) and fits(dict(key)) > 0:
            use(dict(key), 1)
            whole += 1
    by_size = np.argsort(-sizes, kind="stable")
    while (left > 0).any():
        room, conf = capacity, {}
        for j in by_size:
            if left[j] > 0 and sizes[j] <= room:
                a = int(min(left[j], room // sizes[j]))
                conf[int(j)] = a
                room -= a * int(sizes[j])
                if room < sizes[by_size[-1]]:
                    break
        use(conf, int(min(left[j] // a for j, a in conf.items())))
    return plan


def pieces_of(items: DataFrame, item: str, size: str, capacity: int) -> DataFrame:
    """Items cut only where they exceed the capacity: full pieces and a rest. Empty items give no piece."""
    n = F.ceil(F.col(size) / capacity).cast("long")
    first = F.col("piece_no") * capacity
    return items.where(F.col(size) > 0).select(F.col(item), F.col(size).alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("piece_no")).select(
        item, "piece_no", first.alias("token_start"), F.least(F.col("_n"), first + capacity).alias("token_end"), (F.least(F.col("_n"), first + capacity) - first).alias("n_tokens"), (F.col("_n") > capacity).alias("was_cut"))


def pack(items: DataFrame, item: str, size: str, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """One row per piece with its container and the place within it.

    items: a unique id and a whole size. Null or non-positive sizes take no room and get no row; an item above the
    capacity is cut into full pieces and a rest, no other is cut. An empty input gives an empty result. Containers are
    numbered from 0 without gaps.
    """
    spark = items.sparkSession
    pieces = cut(pieces_of(items.select(item, F.col(size).cast("long").alias(size)), item, size, capacity))
    hist = pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()  # at most one row per unit of capacity
    schema = "piece_class long, from_rank long, to_rank long, copies long, first_container long"
    if not hist:
        table, cls = [], {}
    else:
        raw = np.array([r["n_tokens"] for r in hist], np.int64)
        cls = dict(zip(raw.tolist(), size_class(raw, capacity).tolist(), strict=True))
        sizes = np.array(sorted(set(cls.values())), np.int64)
        at = {s: i for i, s in enumerate(sizes.tolist())}
        counts = np.zeros(len(sizes), np.int64)
        for r in hist:
            counts[at[cls[r["n_tokens"]]]] += r["n"]
        table, used, container = [], np.zeros(len(sizes), np.int64), 0
        for conf, times in solve(sizes, counts, capacity, rounds):
            for j, a in conf.items():
                table.append((int(sizes[j]), int(used[j]), int(used[j] + a * times), a, container))
                used[j] += a * times
            container += times
    slots = spark.createDataFrame(table, schema)
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.col("n_tokens").cast("double"))) - 8, F.lit(0))).cast("long")
    klass = F.least(F.ceil(F.col("n_tokens") / step).cast("long") * step, F.lit(capacity))
    buckets = max(1, sum(r["n"] for r in hist) // BUCKET_ITEMS)
    placed = pieces.withColumn("piece_class", klass).withColumn("_h", F.xxhash64(item, "piece_no")).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    per = placed.groupBy("piece_class", "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = per.select("piece_class", "_b", (F.sum("_c").over(Window.partitionBy("piece_class").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("piece_class", "_b").orderBy("_h", item, "piece_no")) - 1
    ranked = placed.withColumn("_r", rank).join(before, ["piece_class", "_b"]).withColumn("rank", F.col("_r") + F.col("_before"))
    # the slots are bounded by the histogram: configurations times the classes in one
    s = F.broadcast(slots.withColumnRenamed("piece_class", "_class"))
    hit = ranked.join(s, (F.col("piece_class") == F.col("_class")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")))
    boxed = hit.withColumn("container_id", F.col("first_container") + F.floor((F.col("rank") - F.col("from_rank")) / F.col("copies")))
    inside = Window.partitionBy("container_id").orderBy(F.desc("n_tokens"), item, "piece_no").rowsBetween(Window.unboundedPreceding, 0)
    return boxed.select(item, "piece_no", "token_start", "token_end", "n_tokens", "was_cut", "container_id", (F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("offset"))


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers by tenths of room left, with their number and tokens."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    return per.groupBy(F.least(F.floor((capacity - F.col("n")) * 10 / capacity), F.lit(9)).alias("tenths_left")).agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"))
