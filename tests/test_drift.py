"""Problem 2: renames proved by values, type changes, one table."""

import json
from datetime import datetime

from cohortloom.operators import drift

SCHEMA = "raw_id long, export_name string, site_code string, file_name string, exported_at timestamp_ntz, line_no int, payload string"


def lines_of(files):
    out, i = [], 0
    for k, (name, rows) in enumerate(files):
        for n, r in enumerate(rows):
            i += 1
            out.append((i, "E", "S", name, datetime(2024, 1, k + 1), n, r if isinstance(r, str) or r is None else json.dumps(r)))
    return out


def first(n, start=0):
    return [{"record_id": f"DP3-{i:07d}", "day": f"2024-01-{i % 28 + 1:02d}", "steps": 4000 + 37 * i, "device": f"Strap {i}", "worn": i % 2 == 0} for i in range(start, start + n)]


def second(rows):
    return [{"participant": int(r["record_id"][4:]), "day": r["day"], "steps": f"{r['steps']:,}", "worn": r["worn"], "deep": 60 + i} for i, r in enumerate(rows)]


def test_changes_between_two_files(spark):
    a = first(30)
    df = spark.createDataFrame(lines_of([("f1", a + a[-1:]), ("f2", second(a[-10:] + first(20, 30)))]), SCHEMA)
    got = {(r["file_name"], r["change_kind"], r["old_field"], r["new_field"]) for r in drift.changes(df).collect()}
    assert got == {("f2", "renamed", "record_id", "participant"), ("f2", "type_changed", "record_id", "participant"), ("f2", "type_changed", "steps", "steps"), ("f2", "removed", "device", ""), ("f2", "added", "", "deep")}


def test_coming_field_with_other_values_is_no_rename(spark):
    a = first(20)
    b = [{k: v for k, v in r.items() if k != "device"} | {"pulse": 50 + i} for i, r in enumerate(a[-8:])]
    df = spark.createDataFrame(lines_of([("f1", a), ("f2", b)]), SCHEMA)
    assert {(r["change_kind"], r["old_field"], r["new_field"]) for r in drift.changes(df).collect()} == {("removed", "device", ""), ("added", "", "pulse")}


def test_one_table_reads_all_files_alike(spark):
    a = first(30)
    df = spark.createDataFrame(lines_of([("f1", a), ("f2", second(a[-10:])), ("f3", [None, "not json", {"file_name": "x", "line_no": 3}])]), SCHEMA)
    t = drift.one_table(df)
    rows = t.collect()
    assert len(rows) == 43 and "file_name_field" in t.columns and dict(t.dtypes)["steps"] == "double" and dict(t.dtypes)["day"] == "date"
    moved = [r for r in rows if r["file_name"] == "f2"]
    name = "record_id" if "record_id" in t.columns else "participant"
    assert [r[name] for r in moved] == [r["record_id"] for r in a[-10:]] and [r["steps"] for r in moved] == [float(r["steps"]) for r in a[-10:]]
    assert sum(not r["readable"] for r in rows) == 2


def test_versions_and_empty(spark):
    a = first(5)
    df = spark.createDataFrame(lines_of([("f1", a), ("f2", a), ("f3", second(a)), ("f4", a)]), SCHEMA)
    assert [r["version"] for r in drift.versions(df).orderBy("seq").collect()] == [1, 1, 2, 3]
    none = spark.createDataFrame([], SCHEMA)
    assert drift.changes(none).count() == 0 and drift.one_table(none).count() == 0


def test_small_values_prove_a_rename(spark):
    a = [{"id": i, "p": i % 4 + 1, "q": i % 3} for i in range(10)]
    b = [{"id": r["id"], "pp": r["p"], "q": r["q"]} for r in a]
    df = spark.createDataFrame(lines_of([("f1", a), ("f2", b)]), SCHEMA)
    assert {(r["change_kind"], r["old_field"], r["new_field"]) for r in drift.changes(df).collect()} == {("renamed", "p", "pp")}


def test_all_names_changed_at_once(spark):
    a = first(30)
    b = [{k.upper() + "_2": v for k, v in r.items()} for r in a[-10:] + first(15, 30)]
    df = spark.createDataFrame(lines_of([("f1", a), ("f2", b)]), SCHEMA)
    got = {(r["change_kind"], r["old_field"], r["new_field"]) for r in drift.changes(df).collect()}
    assert got == {("renamed", k, k.upper() + "_2") for k in a[0]}


def test_renames_hold_in_their_own_series_only(spark):
    """Series A renames steps to total; series B has both fields at once and keeps both."""
    a = first(20)
    moved = [{("total" if k == "steps" else k): v for k, v in r.items()} for r in a[-10:]]
    rows = lines_of([("a1", a), ("a2", moved)])
    both = lines_of([("b1", [r | {"total": 7 * i} for i, r in enumerate(first(12, 50))])])
    rows += [(100 + r[0], "E", "T", *r[3:]) for r in both]
    t = drift.one_table(spark.createDataFrame(rows, SCHEMA))
    got = t.collect()
    assert "steps" in t.columns and "total" in t.columns
    assert [r["total"] for r in got if r["site_code"] == "S"] == [float(x["steps"]) for x in a + a[-10:]]
    assert [(r["steps"], r["total"]) for r in got if r["site_code"] == "T"] == [(float(r["steps"]), 7.0 * i) for i, r in enumerate(first(12, 50))]
    assert not any(r["clashes"] for r in got)


def test_failed_casts_are_recorded(spark):
    a = first(20)
    a[3]["steps"] = "No Value"
    rows = drift.one_table(spark.createDataFrame(lines_of([("f1", a)]), SCHEMA)).orderBy("line_no").collect()
    assert rows[3]["steps"] is None and [r["failed_casts"] for r in rows] == [["steps"] if i == 3 else [] for i in range(20)]


def test_names_of_one_file_are_never_pooled():
    names = {"steps": 5, "Steps": 2, "total": 3, "sum": 1}
    to = drift.pooled_names(names, [("steps", "total"), ("total", "sum")], {("steps", "total")})
    assert to["steps"] == to["Steps"] == "steps" and to["total"] == to["sum"] != "steps"


def test_short_values_prove_a_rename_beside_many_long_ones(spark):
    """All long values are the same in every record, and a kept field names the export: only the shortest values tell."""
    long_ = {f"t{k}": f"the same long remark in every record, number {k}" for k in range(9)}
    a = [long_ | {"export": "first", "id": 700 + i, "n": 41 + 3 * i} for i in range(12)]
    b = [long_ | {"export": "second", "participant": r["id"], "total": r["n"]} for r in a]
    df = spark.createDataFrame(lines_of([("f1", a), ("f2", b)]), SCHEMA)
    assert {(r["change_kind"], r["old_field"], r["new_field"]) for r in drift.changes(df).collect()} == {("renamed", "id", "participant"), ("renamed", "n", "total")}
