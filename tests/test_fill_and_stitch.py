"""Problems 3 and 4."""

import os
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cohortloom.operators import mixfill, stitch
from cohortloom.plans import cohort_queries

DATA = "/root/testdata/sf0.001"

T0 = datetime(2024, 1, 1)


def test_fill_beats_the_mean_on_held_out_cells(spark):
    rng = np.random.default_rng(0)
    rows, truth = [], {}
    for i in range(3000):
        z = i % 3
        x = rng.normal((-3, 0, 4)[z], 0.5)
        y = 2 * x + rng.normal(0, 0.3)
        hide = i % 7 == 0
        truth[i] = y
        rows.append((i, float(x), None if hide else float(y), "abc"[z] if i % 5 else None))
    df = spark.createDataFrame(rows, "id long, x double, y double, g string")
    got = mixfill.fill_mixed(df, ["x", "y"], ["g"], classes=3, rounds=12).collect()
    assert len(got) == 3000
    hidden = [r for r in got if r["y_filled"]]
    assert {r["id"] for r in hidden} == {i for i in truth if i % 7 == 0}
    assert np.mean([abs(r["y"] - truth[r["id"]]) for r in hidden]) < 0.4
    modes = [r for r in got if r["g_filled"]]
    assert len(modes) == 600 and np.mean([r["g"] == "abc"[r["id"] % 3] for r in modes]) > 0.9
    assert all(r["x"] == pytest.approx(rows[r["id"]][1]) and not r["x_filled"] for r in got)


def test_fill_leaves_open_what_nothing_supports(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, "a")], "id long, x double, g string")
    assert all(r["x"] is None and not r["x_filled"] for r in mixfill.fill_mixed(df, ["x"], ["g"]).collect())
    assert mixfill.fill_mixed(df.limit(0), ["x"], ["g"]).count() == 0
    same = spark.createDataFrame([(i, 5.0 if i else None, "a") for i in range(4)], "id long, x double, g string")
    assert {round(r["x"], 3) for r in mixfill.fill_mixed(same, ["x"], ["g"]).collect()} == {5.0}
    with pytest.raises(ValueError):
        mixfill.fill_mixed(df.withColumnRenamed("id", "x_filled"), ["x"], ["g"])


def test_every_level_is_known_to_the_model(spark):
    """Forty even levels, each with its own number: a hidden level is told from its number."""
    rows = [(i, float(10 * (i % 40)), f"level {i % 40:02d}" if i % 9 else None) for i in range(4000)]
    got = mixfill.fill_mixed(spark.createDataFrame(rows, "id long, x double, g string"), ["x"], ["g"], classes=40, rounds=60).where("g_filled").collect()
    assert len(got) == 445 and len({r["g"] for r in got}) > 24


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_filled_readings_beat_the_assay_median_on_hidden_ones(spark, tmp_path):
    """Every 29th readable reading of a study sample is hidden; all hidden ones come out filled, nearer than the median of their assay."""
    for f in os.listdir(DATA):
        if f != "olink_long.parquet":
            os.symlink(f"{DATA}/{f}", tmp_path / f)
    x = pq.read_table(f"{DATA}/olink_long.parquet").to_pandas()
    number = pd.to_numeric(x["npx"].str.strip().str.replace(",", "."), errors="coerce")
    study = ~x["sample_id"].fillna("").str.strip().str.upper().str.match("CONTROL|NEG|PLATE")
    hide = study & number.between(-8, 15) & (number != 0) & (x["row_id"] % 29 == 0)
    middle = number.where(study & ~hide & (number != 0)).groupby([x["panel"].fillna(""), x["assay"].fillna("")]).transform("median")
    truth, plain = dict(zip(x["row_id"][hide], number[hide], strict=True)), dict(zip(x["row_id"][hide], middle[hide], strict=True))
    x.loc[hide, "npx"] = None
    pq.write_table(pa.Table.from_pandas(x, preserve_index=False), tmp_path / "olink_long.parquet", coerce_timestamps="us")
    got = {r["row_id"]: r for r in cohort_queries.filled_readings(spark, str(tmp_path)).where("was_missing").collect()}
    assert set(truth) <= set(got)
    told = [i for i in truth if got[i]["filled"]]
    model, median = np.mean([abs(got[i]["value"] - truth[i]) for i in told]), np.mean([abs(plain[i] - truth[i]) for i in told])
    assert len(told) > 0.95 * len(truth) and model < 0.85 * median, (model, median)


CELLS = "entity string, file string, panel string, assay string, value double, usable boolean, qc_warning string, assay_warning string, loaded_at timestamp_ntz, row_id long"


def cell(e, a, v, usable=True, qc=None, i=0, panel="P", f="f"):
    return (e, f, panel, a, v, usable, qc, None, T0, i)


def test_wide_round_trip_and_conflicts(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for e in range(60):
        for a in range(7):
            if rng.random() < 0.7:
                v = float(np.round(rng.normal(), 4))
                want[(f"S{e}", f"a{a}")] = v
                rows += [cell(f"S{e}", f"A{a}", v, i=len(rows))] * (1 + (a == 0))
    rows += [cell("S0", "A1", 99.0, i=10**6), cell("S0", "A1", 98.0, i=10**6 + 1), cell("S1", "A2", 7.0, usable=False, qc="WARN", i=10**6 + 2)]
    df = spark.createDataFrame(rows, CELLS)
    wide = stitch.wide_table(df).collect()
    assert sorted(r["entity_ordinal"] for r in wide) == list(range(len(wide)))
    got = {(r["sample_id"], a): r[f"p_{a}"] for r in wide for a in [f"a{k}" for k in range(7)] if r[f"p_{a}"] is not None}
    want[("S0", "a1")] = 98.0
    want.setdefault(("S1", "a2"), 7.0)
    assert got == want
    assert {(r["sample_id"], r["assay"]) for r in stitch.conflicting_cells(df).collect()} == {("S0", "A1")}
    assert [r["conflicts"] for r in wide if r["sample_id"] == "S0"] == [["p_a1"]]


def test_wide_edge_cases(spark):
    df = spark.createDataFrame([cell("S", None, 1.0, panel=None), cell("S", "a B", 2.0), cell("S", "A b", 3.0), cell("T", "a B", None, usable=False, qc="NA", f=None)], CELLS)
    wide = stitch.wide_table(df)
    assert {"no_panel_no_assay", "p_a_b", "p_a_b_2"} <= set(wide.columns) and wide.count() == 2
    assert stitch.wide_table(df.limit(0)).count() == 0 and stitch.conflicting_cells(df.limit(0)).count() == 0
