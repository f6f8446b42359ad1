"""Queries of the wearable operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import wearables as wear
from cohortloom.plans.registry import Register

R = Register()
S, V, SED, HR = "activities_summary_steps", "activities_summary_veryactiveminutes", "activities_summary_sedentaryminutes", "heart_rate_resting_heart_rate"
A, B, D = "sleep_summary_total_minutes_asleep", "sleep_summary_total_time_in_bed", "sleep_summary_stages_deep"
STREAMS = {"fitbit_activity_data_uploaded": [S, V, SED], "fitbit_heart_rate_data_uploaded": [HR], "fitbit_sleep_data_uploaded": [A, B, D]}
#: Bounds of plausible daily readings.
BOUNDS = {S: (0, 50000), A: (0, 1080), B: (0, 1200), D: (0, 400), HR: (35, 130)}
W = "processed_fitbit_data"
_clean = lambda c: f"case when not isnan({c}) then {c} end"
_SQL = f"w as (select row_id, id, log_date, {_clean('timepoint')} as timepoint, {_clean('gest_age_del')} as gest_age_del, group_bin, group_label, event_name, fitbit_activity_data_uploaded, fitbit_heart_rate_data_uploaded, fitbit_sleep_data_uploaded, " + ", ".join(f"{_clean(c)} as {c}" for c in (S, V, SED, HR, A, B, D)) + f" from {W})"


def days(t):
    """The daily table with NaN as null."""
    x = t(W)
    return x.select(*(F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in x.schema.fields))


@R.query("q_flt_01", f"select row_id, id from {W} where lower(trim(event_name)) = 'fitbit data'")
def _(t):
    return t(W).where(F.lower(F.trim("event_name")) == "fitbit data").select("row_id", "id")


@R.query("q_flt_03", f"with {_SQL} select row_id, timepoint / 7 as week from w where timepoint / 7 <= gest_age_del or (gest_age_del is null and timepoint / 7 <= 40)")
def _(t):
    x = days(t).withColumn("week", F.col("timepoint") / 7)
    return x.where(wear.within_pregnancy(F.col("week"), F.col("gest_age_del"))).select("row_id", "week")


@R.query("q_flt_04", f"with {_SQL} select row_id, " + ", ".join(f"case when lower(trim({k})) = 'yes' then {c} end as {c}" for k, cs in STREAMS.items() for c in cs) + " from w")
def _(t):
    return wear.keep_uploaded(days(t), STREAMS).select("row_id", *(c for cs in STREAMS.values() for c in cs))


@R.query("q_flt_05", f"with {_SQL} select row_id from w where not coalesce({S} < 3000 and {SED} >= 700 and {HR} is null, false)")
def _(t):
    # the rule's own limits hardly ever meet in these rows; the same operator with wider ones
    x = days(t).withColumns({"s": F.col(S) / 30, "d": F.col(SED) * 2})
    return wear.drop_unworn(x, "s", "d", HR).select("row_id")


@R.query("q_flt_06", f"with {_SQL}, s as (select id, avg(({A} < 240)::int) as x from w where {A} is not null group by id) select row_id, case when not coalesce(x > 0.3, false) then {A} end as asleep, case when not coalesce(x > 0.3, false) then {D} end as deep from w left join s on w.id = s.id")
def _(t):
    return wear.null_poor_sleepers(days(t), "id", A, [A, D]).select("row_id", F.col(A).alias("asleep"), F.col(D).alias("deep"))


@R.query("q_flt_07", f"with {_SQL} select row_id, " + ", ".join(f"case when {c} between {lo} and {hi}" + (f" and {c} <> 0" if c in (A, B) else "") + f" then {c} end as {c}" for c, (lo, hi) in BOUNDS.items()) + " from w")
def _(t):
    return wear.null_outside(days(t), BOUNDS, [A, B]).select("row_id", *BOUNDS)


@R.query("q_flt_08", f"with {_SQL} select row_id, 'minutes_budget' as rule, floor({V} + {SED})::bigint || ' minutes' as said from w where {V} + {SED} > 1000 union all select row_id, 'sleep_containment', floor({A})::bigint || ' asleep of ' || floor({B})::bigint from w where {A} > {B} union all select row_id, 'stage_sum', floor({D})::bigint || ' deep of ' || floor({A})::bigint from w where {D} > {A}")
def _(t):
    n = lambda c: F.col(c).cast("long").cast("string")
    return wear.violations(days(t), ["row_id"], {
        "minutes_budget": (F.col(V) + F.col(SED) > 1000, F.concat((F.col(V) + F.col(SED)).cast("long").cast("string"), F.lit(" minutes"))),
        "sleep_containment": (F.col(A) > F.col(B), F.concat(n(A), F.lit(" asleep of "), n(B))),
        "stage_sum": (F.col(D) > F.col(A), F.concat(n(D), F.lit(" deep of "), n(A)))})


@R.query("q_flt_09", f"with {_SQL} select distinct id from w where id is not null and ({A} is not null and {A} <> -1 or {HR} is not null and {HR} <> -1)")
def _(t):
    return wear.valid_people(days(t), "id", [A, HR])


@R.query("q_rs_10", f"with {_SQL} select case when timepoint is null then null when timepoint / 7 >= 37 then 'late_third' when timepoint / 7 >= 32 then 'mid_third' when timepoint / 7 >= 22 then 'late_second_early_third' when timepoint / 7 >= 14 then 'early_second' else 'first' end as bucket, count(*) as n, count(distinct id) as n_people from w group by 1")
def _(t):
    return days(t).groupBy(wear.bucket(F.col("timepoint") / 7).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_people"))


@R.query("q_ag_04", f"with {_SQL} select id, floor(timepoint / 28)::bigint as bucket, m as metric, count(v) as n_valid, count(*) as n_days, case when count(v) >= 5 and count(v) >= 0.5 * count(*) then round(avg(v), 6) end as mean_value from (select id, timepoint, unnest(['{S}', '{A}']) as m, unnest([{S}, {A}]) as v from w) group by 1, 2, 3")
def _(t):
    x = days(t).withColumn("bucket", F.floor(F.col("timepoint") / 28))
    return wear.coverage(x, ["id", "bucket"], [S, A]).withColumn("mean_value", F.round("mean_value", 6))


@R.query("q_wn_01", f"with {_SQL}, d as (select distinct id, log_date from w where {A} is not null), g as (select id, date_diff('day', lag(log_date) over (partition by id order by log_date), log_date) - 1 as g from d) select id, coalesce(max(g), 0) as longest_gap, coalesce(max(g), 0) >= 7 as flagged from g group by id")
def _(t):
    return wear.longest_gap(days(t), "id", "log_date", A).withColumn("flagged", F.col("longest_gap") >= 7)


@R.query("q_wn_02", f"with {_SQL}, b as (select id, {S} is null as no, sum(({S} is not null)::int) over (partition by id order by log_date, row_id rows unbounded preceding) as blk from w), r as (select id, blk, sum(no::int) as n from b group by 1, 2) select id, max(n)::bigint as longest_run from r group by 1")
def _(t):
    return wear.longest_missing_run(days(t), "id", ["log_date", "row_id"], S)


@R.query("q_ag_10", f"with {_SQL}, s as (select id, date_diff('day', min(log_date), max(log_date)) + 1 as n from w group by 1), x as (select id, m as metric, count(distinct case when v is not null then log_date end) as n_days from (select id, log_date, unnest(['{S}', '{A}', '{HR}']) as m, unnest([{S}, {A}, {HR}]) as v from w) group by 1, 2) select x.id, metric, n_days, round(least(1.0, n_days / n), 6) as density, least(1.0, n_days / n) >= 0.8 as dense from x join s on x.id = s.id")
def _(t):
    return wear.density(days(t), "id", "log_date", [S, A, HR]).withColumn("density", F.round("density", 6))


@R.query("q_ag_02", f"select group_bin = 0 as is_control, count(distinct id) as n_people, count(distinct log_date) as n_dates from {W} group by 1")
def _(t):
    return t(W).groupBy((F.col("group_bin") == 0).alias("is_control")).agg(F.countDistinct("id").alias("n_people"), F.countDistinct("log_date").alias("n_dates"))


@R.query("q_ag_05", f"with {_SQL} select m as metric, round(median(v), 6) as med, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) as iqr from (select unnest(['{S}', '{A}', '{D}']) as m, unnest([{S}, {A}, {D}]) as v from w) where v is not null group by 1")
def _(t):
    from cohortloom.operators.quantiles import exact_quantiles

    x = days(t).unpivot(["row_id"], [S, A, D], "metric", "v")
    return exact_quantiles(x, ["metric"], "v", {"q1": 0.25, "med": 0.5, "q3": 0.75}).select("metric", F.round("med", 6).alias("med"), F.round(F.col("q3") - F.col("q1"), 6).alias("iqr"))


@R.query("q_ag_06", f"with {_SQL} select m as metric, round(avg(v) filter (where group_bin = 0), 6) as mean_0, round(stddev_samp(v) filter (where group_bin = 0), 6) as sd_0, round(avg(v) filter (where group_bin = 1), 6) as mean_1, round(stddev_samp(v) filter (where group_bin = 1), 6) as sd_1 from (select group_bin, unnest(['{A}', '{D}']) as m, unnest([{A}, {D}]) as v from w) group by 1")
def _(t):
    p = days(t).unpivot(["group_bin"], [A, D], "metric", "v").groupBy("metric").pivot("group_bin", [0, 1]).agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("sd"))
    return p.select("metric", *(F.col(f"{g}_{k}").alias(f"{k}_{g}") for g in (0, 1) for k in ("mean", "sd")))


@R.query("q_ag_07", f"with {_SQL} select id, count(*) as n_days, sum(({S} is null)::int)::bigint as no_steps, sum(({A} is null)::int)::bigint as no_sleep, sum(({S} is null and {A} is null)::int)::bigint as nothing from w group by 1")
def _(t):
    n = lambda c: F.count_if(c)
    return days(t).groupBy("id").agg(F.count(F.lit(1)).alias("n_days"), n(F.col(S).isNull()).alias("no_steps"), n(F.col(A).isNull()).alias("no_sleep"), n(F.col(S).isNull() & F.col(A).isNull()).alias("nothing"))


@R.query("q_ag_08", f"with {_SQL} select floor(timepoint / 7)::bigint as week, group_bin, count(distinct id) as n_people from w group by 1, 2")
def _(t):
    return days(t).groupBy(F.floor(F.col("timepoint") / 7).alias("week"), "group_bin").agg(F.countDistinct("id").alias("n_people"))


@R.query("q_ag_09", f"with {_SQL}, c as (select floor(timepoint / 28)::bigint as bin, group_bin, m, count(v) as n from (select timepoint, group_bin, unnest(['{S}', '{A}', '{D}', '{HR}']) as m, unnest([{S}, {A}, {D}, {HR}]) as v from w) group by 1, 2, 3) select bin, min(n) filter (where group_bin = 0) as min_0, max(n) filter (where group_bin = 0) as max_0, min(n) filter (where group_bin = 1) as min_1, max(n) filter (where group_bin = 1) as max_1 from c group by 1")
def _(t):
    c = days(t).withColumn("bin", F.floor(F.col("timepoint") / 28)).unpivot(["bin", "group_bin"], [S, A, D, HR], "m", "v").groupBy("bin", "group_bin", "m").agg(F.count("v").alias("n"))
    p = c.groupBy("bin").pivot("group_bin", [0, 1]).agg(F.min("n").alias("min"), F.max("n").alias("max"))
    return p.select("bin", *(F.col(f"{g}_{k}").alias(f"{k}_{g}") for g in (0, 1) for k in ("min", "max")))


@R.query("q_jn_01", f"with {_SQL}, a as (select row_id, id, log_date, {S} as x from w), b as (select row_id, id, log_date, coalesce({A}, -1) as x from w) select a.row_id, a.id, coalesce(a.x, b.x) as x from a join b on a.row_id = b.row_id and a.id = b.id and a.log_date = b.log_date")
def _(t):
    """Two sheets merged on their keys, shared columns coalesced."""
    from cohortloom.operators.relational import merge_coalesce

    a, b = days(t).select("row_id", "id", "log_date", F.col(S).alias("x")), days(t).select("row_id", "id", "log_date", F.coalesce(A, F.lit(-1.0)).alias("x"))
    return merge_coalesce(a, b, ["row_id", "id", "log_date"]).drop("log_date")


@R.query("q_hp_02", f"select id, count(distinct log_date) as n_dates from {W} group by 1")
def _(t):
    return t(W).groupBy("id").agg(F.countDistinct("log_date").alias("n_dates"))


@R.query("q_hp_20", f"with {_SQL} select floor(timepoint / 7)::bigint as week, count(distinct id) as n_all, count(distinct case when timepoint / 7 <= gest_age_del then id end) as n_pregnant from w group by 1")
def _(t):
    w = F.col("timepoint") / 7
    return days(t).groupBy(F.floor(w).alias("week")).agg(F.countDistinct("id").alias("n_all"), F.countDistinct(F.when(w <= F.col("gest_age_del"), F.col("id"))).alias("n_pregnant"))


@R.query("q_tr_24", f"with {_SQL} select row_id, round(({A} - avg({A}) over ()) / nullif(stddev_pop({A}) over (), 0), 6) as z from w where {A} is not null")
def _(t):
    """Pooled z-score: two numbers over all rows, joined to every row."""
    from cohortloom.operators.relational import with_totals

    x = days(t).where(F.col(A).isNotNull()).select("row_id", A)
    return with_totals(x, {"m": F.avg(A), "s": F.stddev_pop(A)}).select("row_id", F.round((F.col(A) - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0)), 6).alias("z"))


QUERIES, SQL = R.queries, R.sql
