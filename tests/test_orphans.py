"""Problem 1 against brute force, on both skew paths."""

import random
from datetime import datetime, timedelta

import pytest

from cohortloom.operators.orphans import find_orphans, heavy_keys, orphan_report, per_key_and_period

REFS = "kind string, key string, at timestamp_ntz, period string, table_name string, row_id long, ref_field string"
SPANS = "kind string, key string, start timestamp_ntz, end timestamp_ntz"
T0 = datetime(2024, 1, 1)


def fixture(n=400, seed=3):
    rng = random.Random(seed)
    day = lambda: T0 + timedelta(hours=rng.randrange(24 * 60))
    key = lambda: "HOT" if rng.random() < 0.4 else rng.choice(["A", "B", "C", "D", None, "E1"])
    refs = [(rng.choice("ps"), key(), day() if rng.random() > 0.05 else None, "2024-01", "t", i, "id") for i in range(n)]
    spans = []
    for _ in range(60):
        a = day()
        spans.append((rng.choice("ps"), key(), a if rng.random() > 0.1 else None, None if rng.random() < 0.2 else a + timedelta(hours=rng.randrange(-5, 200))))
    return refs, spans


def brute(refs, spans):
    live = lambda k, x, t: t is not None and any(s[0] == k and s[1] == x and s[2] is not None and s[2] <= t and (s[3] is None or s[3] > t) for s in spans)
    return sorted(r[5] for r in refs if r[1] is not None and not live(r[0], r[1], r[2]))


@pytest.mark.parametrize("how", [{"heavy": 0}, {}, {"heavy": 1}, {"heavy": 2, "broadcast_spans": 0}, {"broadcast_spans": 0}])
def test_all_paths_agree_with_brute_force(spark, how):
    refs, spans = fixture()
    got = find_orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(spans, SPANS), **how)
    assert sorted(r["row_id"] for r in got.collect()) == brute(refs, spans)


def test_the_split_takes_the_most_frequent_keys(spark):
    refs, spans = (spark.createDataFrame(x, k) for x, k in zip(fixture(), (REFS, SPANS), strict=True))
    assert {k for _, k in heavy_keys(per_key_and_period(refs), spans.where("key is not null"), 2)} == {"HOT"}
    plan = find_orphans(refs, spans)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan


def test_bulk_load_of_one_moment_is_scanned_as_one_time(spark):
    """A hot key whose references share two moments, and more spans than may be broadcast."""
    spans = [("p", "HOT", T0 + timedelta(hours=2 * i), T0 + timedelta(hours=2 * i + 1)) for i in range(500)]
    refs = [("p", "HOT", T0 + timedelta(hours=400, minutes=30 if i % 3 else 90), "2024-01", "t", i, "id") for i in range(3000)]
    got = find_orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(spans, SPANS), broadcast_spans=10)
    assert sorted(r["row_id"] for r in got.collect()) == [i for i in range(3000) if i % 3 == 0]


def test_touching_and_empty_spans(spark):
    spans = [("p", "A", T0, T0 + timedelta(days=1)), ("p", "A", T0 + timedelta(days=1), None), ("p", "B", T0, T0)]
    refs = [("p", "A", T0 + timedelta(days=1), "m", "t", 1, "id"), ("p", "B", T0, "m", "t", 2, "id"), ("p", "A", T0 - timedelta(seconds=1), "m", "t", 3, "id")]
    r, s = spark.createDataFrame(refs, REFS), spark.createDataFrame(spans, SPANS)
    assert sorted(x["row_id"] for x in find_orphans(r, s).collect()) == [2, 3]
    rep = orphan_report(per_key_and_period(r, "table_name", "ref_field"), find_orphans(r, s)).collect()
    assert [(x["n_refs"], x["n_orphans"], x["n_orphan_keys"]) for x in rep] == [(3, 2, 2)]


def test_empty_tables(spark):
    r, s = spark.createDataFrame([], REFS), spark.createDataFrame([], SPANS)
    assert find_orphans(r, s).count() == 0
    one = spark.createDataFrame([("p", "A", T0, "m", "t", 1, "id")], REFS)
    assert find_orphans(one, s).count() == 1
