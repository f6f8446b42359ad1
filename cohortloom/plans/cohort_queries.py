"""Queries of the general problems (p1 to p5 and p7), each over its whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.text import is_control_sample, is_missing_word, norm_id, passes, read_number, read_plain_number, regular_sample_id, trimmed
from cohortloom.operators import drift, mixfill, orphans, quality, spikes, stitch
from cohortloom.operators.quantiles import exact_quantiles
from cohortloom.session import broadcast_up_to, cut
from cohortloom.sources.tables import live_spans, reference_rows, table

# ---- problem 1


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.find_orphans(reference_rows(spark, d), live_spans(spark, d)).select("table_name", "row_id", "ref_field")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    refs = reference_rows(spark, d)
    counts = cut(orphans.per_key_and_period(refs, "table_name", "ref_field"))
    return orphans.orphan_report(counts, orphans.find_orphans(refs, live_spans(spark, d), counts=counts))


# ---- problem 2


def _export_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fitbit_raw_records").select("raw_id", "export_name", "site_code", "file_name", "exported_at", "line_no", "payload")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(_export_lines(spark, d)).select("file_name", "change_kind", "old_field", "new_field")


def p2_changes(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(_export_lines(spark, d))


def p2_versions(spark: SparkSession, d: str) -> DataFrame:
    return drift.versions(_export_lines(spark, d))


def p2_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.one_table(_export_lines(spark, d))


# ---- problem 3

AGE, BMI = "maternal_age", "prepregnancy_bmi_self_or_record"


#: Assays whose levels are broadcast.
BROADCAST_ASSAYS = 200_000


def _study_groups(spark: SparkSession, d: str) -> DataFrame:
    """Group per sample, as the first loaded row with a valid label has it."""
    g = _group()
    return table(spark, d, "sample_metadata").select(norm_id(F.col("sample_id")).alias("_sample"), g.alias("g"), "loaded_at", "row_id").where("_sample is not null and g is not null").groupBy(F.xxhash64("_sample").alias("_s")).agg(
        F.min_by("g", F.struct("loaded_at", "row_id")).alias("study_group"))


def _study_readings(spark: SparkSession, d: str) -> DataFrame:
    """Readings of study samples, read and parsed once. Assay, run (sample and file), participant's assay and sample are
    carried as 64-bit hashes: they only decide which readings a feature of the model is averaged over."""
    number, sample = read_number(F.col("npx")), norm_id(F.col("sample_id"))
    x = table(spark, d, "olink_long").where(~is_control_sample(F.col("sample_id"))).select("row_id", sample.alias("s"), "source_file", F.coalesce("panel", F.lit("")).alias("panel"), F.coalesce("assay", F.lit("")).alias("assay"), F.when(number != 0, number).alias("value"))
    person, letter = F.regexp_extract("s", "^(DP3[0-9]{7})", 1), F.regexp_extract("s", "([A-E])$", 1)
    return cut(x.select("row_id", "value", "panel", F.when(letter != "", letter).alias("timepoint"), F.xxhash64("panel", "assay").alias("attr"), F.xxhash64("s", "source_file").alias("run"), F.xxhash64("s").alias("sample"),
                        F.when(person != "", F.xxhash64(person, "panel", "assay")).alias("own")))


def filled_readings(spark: SparkSession, d: str) -> DataFrame:
    """npx of study samples, missing ones filled: from the assay's level, the run's and the participant's other readings, group and timepoint."""
    x = _study_readings(spark, d)
    q = F.percentile_approx("value", [0.25, 0.5, 0.75], 10_000)
    level = cut(x.groupBy("attr").agg(q.alias("q")).select(F.col("attr").alias("_a"), F.get("q", F.lit(1)).alias("mid"), F.greatest((F.get("q", F.lit(2)) - F.get("q", F.lit(0))) / 1.349, F.lit(1e-3)).alias("unit")))
    reach = mixfill.REACH  # in units of the assay; a wild reading must not carry its run's mean away
    x = x.join(broadcast_up_to(level, BROADCAST_ASSAYS), F.col("attr") == F.col("_a"), "left").withColumn("npx", F.when(F.col("value").isNotNull(), F.greatest(F.lit(-reach), F.least(F.lit(reach), (F.col("value") - F.col("mid")) / F.col("unit")))))
    # sums are made map-side: neither the sample on every plate nor its participant is a group that one task must hold
    run = x.groupBy(F.col("run").alias("_r"), "sample").agg(F.sum("npx").alias("run_sum"), F.count("npx").alias("run_n")).join(_study_groups(spark, d), F.col("sample") == F.col("_s"), "left").select("_r", "run_sum", "run_n", "study_group")
    own = x.where("own is not null and npx is not null").groupBy(F.col("own").alias("_o")).agg(F.sum("npx").alias("own_sum"), F.count("npx").alias("own_n"))
    x = x.join(run, F.col("run") == F.col("_r"), "left").join(own, F.col("own") == F.col("_o"), "left")
    here, mine = F.col("npx").isNotNull().cast("int"), F.coalesce("npx", F.lit(0.0))
    mean = lambda s, n: F.when(F.col(n) - here > 0, (F.col(s) - mine) / (F.col(n) - here))
    x = x.select("row_id", "value", "mid", "unit", "npx", mean("run_sum", "run_n").alias("run_level"), mean("own_sum", "own_n").alias("own_level"), "study_group", "timepoint", "panel")
    done = mixfill.fill_mixed(x, ["npx", "run_level", "own_level"], ["study_group", "timepoint", "panel"])
    # what the model filled or had to leave open is what was missing; an assay without any reading has no level to fill from
    filled = F.col("npx_filled") & F.col("mid").isNotNull()
    return done.select(F.lit("olink_long").alias("table_name"), "row_id", F.lit("npx").alias("field_name"), F.coalesce("value", F.when(filled, F.col("mid") + F.col("unit") * F.col("npx"))).alias("value"),
                       (F.col("npx_filled") | F.col("npx").isNull()).alias("was_missing"), filled.alias("filled"))


def filled_clinical(spark: SparkSession, d: str) -> DataFrame:
    """maternal_age and BMI: from the participant's other rows, else by the mixture over the clinical fields."""
    age = F.when(F.col(AGE).between(12, 60), F.col(AGE))
    found = F.regexp_extract(F.regexp_replace(F.col(BMI), ",", "."), r"([0-9]+([.][0-9]+)?)", 1).try_cast("double")
    bmi = F.when(found.between(10, 90) & ~F.coalesce(F.col(BMI).rlike(r"^\s*-"), F.lit(False)), found)
    real = lambda c: F.when(~F.isnan(c), F.col(c).cast("double"))
    flag = lambda c: F.when(F.trim(c).isin("0", "1", "2"), F.trim(c))
    x = table(spark, d, "processed_clinical_data").select(
        "row_id", norm_id(F.col("id")).alias("person"), F.when(~F.isnan(age), age).alias("age"), bmi.alias("bmi"), F.col("gravida").cast("double").alias("gravida"), real("gest_age_del").alias("ga"), F.log(F.when(real("birthweight") > 0, real("birthweight"))).alias("weight"),
        _group().alias("study_group"), flag("diabetes").alias("diabetes"), flag("chtn").alias("chtn"), flag("route_of_delivery").alias("route"))
    own = x.where("person is not null").groupBy("person").agg(F.avg("age").alias("own_age"), F.avg("bmi").alias("own_bmi"))
    x = x.join(own, "person", "left").withColumns({"age0": F.col("age"), "bmi0": F.col("bmi"), "age": F.coalesce("age", "own_age"), "bmi": F.coalesce("bmi", "own_bmi")})
    done = mixfill.fill_mixed(x, ["age", "bmi", "gravida", "ga", "weight"], ["study_group", "diabetes", "chtn", "route"])
    cell = lambda name, new, old: F.struct(F.lit(name).alias("field_name"), F.col(new).alias("value"), F.col(old).isNull().alias("was_missing"), (F.col(old).isNull() & F.col(new).isNotNull()).alias("filled"))
    return done.select("row_id", F.explode(F.array(cell(AGE, "age", "age0"), cell(BMI, "bmi", "bmi0"))).alias("c")).select(F.lit("processed_clinical_data").alias("table_name"), "row_id", "c.*")


def p3_filled(spark: SparkSession, d: str) -> DataFrame:
    return filled_readings(spark, d).unionByName(filled_clinical(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_filled(spark, d).where("was_missing").select("table_name", "row_id", "field_name")


# ---- problem 4


def plate_readings(spark: SparkSession, d: str) -> DataFrame:
    """Readings of study samples with their number, whether it is usable, and warnings other than PASS."""
    number = read_number(F.col("npx"))
    value = F.when(number != 0, number)
    odd = lambda c: F.when(~passes(F.col(c)), F.coalesce(trimmed(F.col(c)), F.lit("missing")))
    return table(spark, d, "olink_long").where(~is_control_sample(F.col("sample_id"))).select(
        regular_sample_id(norm_id(F.col("sample_id"))).alias("entity"), F.col("source_file").alias("file"), "panel", "assay", value.alias("value"),
        (value.isNotNull() & passes(F.col("qc_warning")) & passes(F.col("assay_warning"))).alias("usable"),
        odd("qc_warning").alias("qc_warning"), odd("assay_warning").alias("assay_warning"), "loaded_at", "row_id").where("entity is not null")


def p4_wide(spark: SparkSession, d: str) -> DataFrame:
    return stitch.wide_table(plate_readings(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return stitch.conflicting_cells(plate_readings(spark, d))


# ---- problem 5

STEPS, ASLEEP, BED, DEEP = "activities_summary_steps", "sleep_summary_total_minutes_asleep", "sleep_summary_total_time_in_bed", "sleep_summary_stages_deep"
#: Minutes in a day; steps beyond what a day of running gives.
CEILINGS = {STEPS: 100_000.0, ASLEEP: 1440.0, BED: 1440.0, DEEP: 1440.0}


def wearable_readings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "processed_fitbit_data").select(
        norm_id(F.col("id")).alias("source"), F.unix_date("log_date").alias("day"), "row_id", STEPS, ASLEEP, BED, DEEP)


def p5_flags(spark: SparkSession, d: str) -> DataFrame:
    return spikes.flag_readings(wearable_readings(spark, d), [STEPS, ASLEEP, BED, DEEP], {STEPS}, CEILINGS, [(ASLEEP, BED), (DEEP, ASLEEP)])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_flags(spark, d).select("row_id", "field_name")


# ---- problem 7

GROUPS = ("control", "fgr", "hdp", "sptb")


def _reading_rows(spark: SparkSession, d: str) -> DataFrame:
    """What problem 7 needs of each reading, read and parsed once."""
    missing = is_missing_word(F.col("npx")) | F.coalesce(read_number(F.col("npx")) == 0, F.lit(False))
    return cut(table(spark, d, "olink_long").select("row_id", "lab_code", "load_id", missing.alias("missing"), read_plain_number(F.col("npx")).alias("v"), *(c.alias(f"{k}_code") for k, c in _reading_codes().items())))


def _sample_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sample_metadata")


def _group():
    g = F.lower(trimmed(F.col("group_label")))
    return F.when(g.isin(*GROUPS), g)


#: Bins of a number, each lab's own quantiles, and buckets of a column of labels.
READING_BINS, AGE_BINS, BUCKETS = 16, 8, 8


def _bucket(c: Column) -> Column:
    """One of a few buckets of labels by hash, 0 for missing."""
    return F.when(is_missing_word(c), 0).otherwise(F.pmod(F.xxhash64(F.lower(trimmed(c))), F.lit(BUCKETS)).cast("int") + 1)


def _id_form(c: Column) -> Column:
    return F.when(is_missing_word(c), 0).when(is_control_sample(c), 1).when(c.rlike("^DP3-[0-9]+[A-Z]?$"), 2).otherwise(3)


def _warning(c: Column) -> Column:
    return F.when(passes(c), 0).when(is_missing_word(c), 2).otherwise(1)


def _reading_codes() -> dict[str, Column]:
    """A small whole number for each column of olink_long but npx.

    Ids, files and times name the load itself, so their form or presence is compared and not their values.
    """
    c = F.col
    return {"row_id": c("row_id").isNull().cast("int"), "sample_id": _id_form(c("sample_id")), "assay": _bucket(c("assay")), "panel": _bucket(c("panel")), "qc_warning": _warning(c("qc_warning")),
            "assay_warning": _warning(c("assay_warning")), "source_file": _bucket(F.regexp_replace(c("source_file"), "[0-9]+", "9")), "loaded_at": c("loaded_at").isNull().cast("int")}


def _sample_codes(ages: bool) -> dict[str, Column]:
    """As _reading_codes, for sample_metadata; ages: with the bins of the two ages."""
    c = F.col
    group = F.coalesce(sum(F.when(_group() == g, i + 1).otherwise(0) for i, g in enumerate(GROUPS)), F.when(is_missing_word(c("group_label")), -1).otherwise(0))
    batch = F.when(is_missing_word(c("batch")), 0).when(trimmed(c("batch")).rlike("^[0-9]+$"), 1).otherwise(2)
    return {"row_id": c("row_id").isNull().cast("int"), **{k: _id_form(c(k)) for k in ("sample_id", "subject_id", "metadata_canonical_id")}, "group_label": group, "subgroup": _bucket(c("subgroup")), "batch": batch,
            **({k: c(f"{k}_bin") for k in AGES} if ages else {}), "loaded_at": c("loaded_at").isNull().cast("int")}


AGES = ("gest_age_delivery", "sample_gest_age")


#: Columns whose issues are looked for, with those that may explain them: the classifier behind p7_loads and p7_found.
WATCHED = (("npx", "qc_warning", "assay_warning"), ("group_label", "batch"))


def _drift(readings: DataFrame, samples: DataFrame, watched: bool = False) -> tuple[DataFrame, DataFrame]:
    """The classifier test over a feature of every column of both tables, or of the watched ones."""
    v = F.col("v")
    levels = quality.binned(readings, "lab_code", {"v": F.when(~F.col("missing"), v)}, READING_BINS)
    npx = F.when(F.col("missing"), -1).when(v.isNull(), -2).otherwise(F.col("v_bin"))
    of_readings = {"npx": npx} | {k: F.col(f"{k}_code") for k in _reading_codes()}
    if not watched:
        samples = quality.binned(samples, "lab_code", {k: F.col(k) for k in AGES}, AGE_BINS)
    of_samples = _sample_codes(ages=not watched)
    if watched:
        of_readings, of_samples = ({k: f[k] for k in w} for f, w in zip((of_readings, of_samples), WATCHED, strict=True))
    return quality.two_sample_test(levels, "lab_code", "load_id", of_readings, "row_id"), quality.two_sample_test(samples, "lab_code", "load_id", of_samples, "row_id")


def p7_drift(spark: SparkSession, d: str) -> DataFrame:
    """Classifier two-sample test of every load against its lab's other loads, for both large tables."""
    npx, samples = _drift(_reading_rows(spark, d), _sample_rows(spark, d))
    return quality.with_table("olink_long", [npx]).unionByName(quality.with_table("sample_metadata", [samples]))


def p7_loads(spark: SparkSession, d: str) -> DataFrame:
    """Figures and issues of npx, batch and group_label per load, the classifier's figures beside them."""
    readings, rows = _reading_rows(spark, d), _sample_rows(spark, d)
    in_readings, in_samples = (cut(x) for x in _drift(readings, rows, watched=True))  # a few rows per load
    v, b, g = F.col("v"), F.col("batch"), F.col("group_label")
    npx = quality.number_issues(readings, "lab_code", "load_id", "npx", F.col("missing"), v.isNotNull(), F.when(v != 0, v), in_readings,
                                missing_over=0.15, bad_over=0.05, low=-10, high=30, outside_over=0.02, distinct_under=0.2, median_off=1.2, spread_over=2)
    batch = quality.label_issues(rows, "lab_code", "load_id", "batch", is_missing_word(b), trimmed(b).rlike("^[0-9]+$"), None, in_samples, 0.25, 0.25, 25, 0.45)
    group = quality.label_issues(rows, "lab_code", "load_id", "group_label", is_missing_word(g), _group().isNotNull(), _group(), in_samples, 0.25, 0.25, 25, 0.45)
    return quality.with_table("olink_long", [npx]).unionByName(quality.with_table("sample_metadata", [batch, group]))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The issues of p7_loads: the classifier runs over every load, the exact rules decide."""
    return p7_loads(spark, d).select("table_name", "column_name", "load_id", F.explode("issues").alias("issue"))


def p7_profile(spark: SparkSession, d: str) -> DataFrame:
    """Every column of the tables that come in loads, with its change against the lab's other loads."""
    out = None
    for name, drift in zip(("olink_long", "sample_metadata"), _drift(_reading_rows(spark, d), _sample_rows(spark, d)), strict=True):
        x = quality.with_table(name, [quality.profile(table(spark, d, name), "load_id", group="lab_code", drift=cut(drift))])
        out = x if out is None else out.unionByName(x)
    return out


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_changes, p2_versions, p2_table, p3_filled, p3_found, p4_wide, p4_found, p5_flags, p5_found, p7_drift, p7_loads, p7_found, p7_profile)}

_KEY = "nullif(regexp_replace(upper({}), '[^A-Z0-9]', '', 'g'), '')"
_REFS = f"""refs as (
  select 'processed_clinical_data' as table_name, row_id, 'id' as ref_field, 'p' as kind, {_KEY.format('id')} as key, loaded_at as ts from processed_clinical_data
  union all select 'processed_placental_data', row_id, 'id', 'p', {_KEY.format('id')}, loaded_at from processed_placental_data
  union all select 'sample_metadata', row_id, 'subject_id', 'p', {_KEY.format('subject_id')}, loaded_at from sample_metadata
  union all select 'sample_metadata', row_id, 'metadata_canonical_id', 's', {_KEY.format('metadata_canonical_id')}, loaded_at from sample_metadata),
live as (
  select 'p' as kind, {_KEY.format('id')} as key, registered_at as s, deleted_at as e from cohort_registry
  union all select 's', {_KEY.format('sample_id')}, loaded_at, null from sample_metadata),
lost as (
  select * from refs r where key is not null and not exists (
    select 1 from live l where l.kind = r.kind and l.key = r.key and l.s <= r.ts and (l.e is null or l.e > r.ts)))"""

_NUMBER = r"case when regexp_full_match(trim(npx, e' \\t\\n\\r'), '[+-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+-]?[0-9]+)?') then try_cast(replace(trim(npx, e' \\t\\n\\r'), ',', '.') as double) end"
_STUDY = "not coalesce(regexp_matches(upper(trim(sample_id, e' \\t\\n\\r')), '^(CONTROL|NEG|PLATE)'), false)"
_PASS = "upper(trim({}, e' \\t\\n\\r')) = 'PASS'"

_BLANK = "e' \\t\\n\\r'"
_MISSING = "({0} is null or lower(trim({0}, " + _BLANK + ")) in ('', 'na', 'n/a', 'nan', 'null', 'none', 'unknown'))"
_PLAIN = f"case when regexp_full_match(trim(npx, {_BLANK}), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') then try_cast(trim(npx, {_BLANK}) as double) end"

SQL = {
    "p3_found": f"""select 'olink_long' as table_name, row_id, 'npx' as field_name from olink_long where {_STUDY} and coalesce({_NUMBER}, 0) = 0
union all select 'processed_clinical_data', row_id, 'maternal_age' from processed_clinical_data where maternal_age is null or isnan(maternal_age) or maternal_age < 12 or maternal_age > 60
union all select 'processed_clinical_data', row_id, 'prepregnancy_bmi_self_or_record' from processed_clinical_data
  where not coalesce(try_cast(regexp_extract(replace(prepregnancy_bmi_self_or_record, ',', '.'), '-?[0-9]+([.][0-9]+)?') as double) between 10 and 90, false)""",
    "p7_found": f"""with n as (select lab_code, load_id, coalesce({_MISSING.format('npx')} or ({_NUMBER}) = 0, false) as miss, {_PLAIN} as v from olink_long where lab_code is not null and load_id is not null),
nl as (select lab_code, load_id, avg(miss::int) as mr, sum((not miss and v is null)::int) / nullif(sum((not miss)::int), 0) as br,
  count(v) filter (where v <> 0) as k, count(distinct v) filter (where v <> 0) as kd, count(v) filter (where v <> 0 and (v < -10 or v > 30)) as ko,
  quantile_cont(v, 0.5) filter (where v <> 0) as med, quantile_cont(v, 0.75) filter (where v <> 0) - quantile_cont(v, 0.25) filter (where v <> 0) as iqr from n group by all),
nm as (select *, median(mr) over (partition by lab_code) as mmr, median(med) over (partition by lab_code) as mmed, median(iqr) over (partition by lab_code) as miqr from nl),
s as (select lab_code, load_id, {_MISSING.format('batch')} as bm, not regexp_full_match(trim(batch, {_BLANK}), '[0-9]+') as bb, {_MISSING.format('group_label')} as gm,
  case when lower(trim(group_label, {_BLANK})) in ('control', 'fgr', 'hdp', 'sptb') then lower(trim(group_label, {_BLANK})) end as g from sample_metadata where lab_code is not null and load_id is not null),
sl as (select lab_code, load_id, avg(bm::int) as bmr, sum((not bm and bb)::int) / nullif(sum((not bm)::int), 0) as bbr, avg(gm::int) as gmr, sum((not gm and g is null)::int) / nullif(sum((not gm)::int), 0) as gbr from s group by all),
sm as (select *, median(bmr) over (partition by lab_code) as mb, median(gmr) over (partition by lab_code) as mg from sl),
c as (select lab_code, load_id, g, count(*) as c from s where g is not null group by all),
ll as (select lab_code, load_id, sum(c) as nl from c group by all), lg as (select lab_code, sum(c) as ng from c group by all), lt as (select lab_code, g, sum(c) as t from c group by all),
d as (select ll.lab_code, ll.load_id, max(nl) as nl, sum(abs(coalesce(c.c, 0) / nl - (t - coalesce(c.c, 0)) / nullif(ng - nl, 0))) / 2 as tv
  from ll join lt on ll.lab_code = lt.lab_code join lg on ll.lab_code = lg.lab_code left join c on c.lab_code = ll.lab_code and c.load_id = ll.load_id and c.g = lt.g group by all)
select 'olink_long' as table_name, 'npx' as column_name, load_id, 'missing_rate' as issue from nm where mr - mmr > 0.15
union all select 'olink_long', 'npx', load_id, 'bad_pattern' from nm where br > 0.05
union all select 'olink_long', 'npx', load_id, 'out_of_range' from nm where ko / k > 0.02
union all select 'olink_long', 'npx', load_id, 'few_distinct' from nm where kd / k < 0.2
union all select 'olink_long', 'npx', load_id, 'shift' from nm where abs(med - mmed) > 1.2 or iqr > 2 * miqr
union all select 'sample_metadata', 'batch', load_id, 'missing_rate' from sm where bmr - mb > 0.25
union all select 'sample_metadata', 'batch', load_id, 'bad_pattern' from sm where bbr > 0.25
union all select 'sample_metadata', 'group_label', load_id, 'missing_rate' from sm where gmr - mg > 0.25
union all select 'sample_metadata', 'group_label', load_id, 'bad_pattern' from sm where gbr > 0.25
union all select 'sample_metadata', 'group_label', load_id, 'shift' from d where nl >= 25 and tv > 0.45""",
    "p4_found": f"""with r as (select {_KEY.format('sample_id')} as k, source_file, panel, assay, {_NUMBER} as v from olink_long
  where {_STUDY} and {_PASS.format('qc_warning')} and {_PASS.format('assay_warning')})
select case when regexp_matches(k, '^DP3[0-9]') then 'DP3-' || substr(k, 4) else k end as sample_id, source_file, panel, assay
from r where k is not null and v <> 0 group by k, source_file, panel, assay having min(v) <> max(v)""",
    "p2_versions": """with l as (select *, case when json_valid(payload) and json_type(payload) = 'OBJECT' then payload end as j from fitbit_raw_records),
k as (select export_name, site_code, file_name, j, unnest(json_keys(j)) as f from l where j is not null),
t as (select export_name, site_code, file_name, f, case json_type(j, '$."' || f || '"') when 'NULL' then null when 'VARCHAR' then 'text' when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' when 'ARRAY' then 'object' else 'number' end as kind from k),
n as (select export_name, site_code, file_name, f, kind, count(*) as n from t group by all),
b as (select export_name, site_code, file_name, f, arg_min(kind, (-n, kind)) filter (where kind is not null) as kind from n group by all),
p as (select export_name, site_code, file_name, sha256(string_agg(f || ':' || coalesce(kind, 'none'), '|' order by f)) as fingerprint from b group by all),
a as (select export_name, site_code, file_name, min(exported_at) as exported_at, count(*) as n_lines from fitbit_raw_records group by all),
s as (select a.*, row_number() over (partition by a.export_name, a.site_code order by exported_at nulls first, a.file_name) as seq, coalesce(fingerprint, '') as fingerprint from a left join p on a.export_name is not distinct from p.export_name and a.site_code is not distinct from p.site_code and a.file_name is not distinct from p.file_name),
w as (select *, (lag(fingerprint) over (partition by export_name, site_code order by seq) is distinct from fingerprint)::int as new from s)
select export_name, site_code, file_name, exported_at, n_lines, seq, fingerprint, sum(new) over (partition by export_name, site_code order by seq rows unbounded preceding)::bigint as version from w""",
    "p1_found": f"with {_REFS} select table_name, row_id, ref_field from lost",
    "p1_report": f"""with {_REFS},
t as (select table_name, ref_field, strftime(ts, '%Y-%m') as period, count(*) as n_refs from refs where key is not null group by all),
o as (select table_name, ref_field, strftime(ts, '%Y-%m') as period, count(*) as n_orphans, count(distinct key) as n_orphan_keys from lost group by all)
select t.table_name, t.ref_field, t.period, n_refs, coalesce(n_orphans, 0) as n_orphans, coalesce(n_orphan_keys, 0) as n_orphan_keys
from t left join o on t.table_name = o.table_name and t.ref_field = o.ref_field and t.period is not distinct from o.period""",
}
