"""Queries of cleaning, quality, normalisation and window operators over long measurements.

The measurements are the events table: subject user_id, feature event_type, timepoint the week as a letter, batch and
group by user_id; every seventh value counts as missing. Plate readings come from olink_long.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortloom.functions.text import is_control_sample, passes, read_number
from cohortloom.operators import normalize as nz
from cohortloom.operators import qc, ranks
from cohortloom.operators import relational as rel
from cohortloom.operators.quantiles import exact_quantiles
from cohortloom.plans.registry import Register

R = Register()
M_SQL = """m as (select event_id, user_id as subject, event_type as feature, case when event_id % 7 <> 0 then value end as value, user_id % 3 as batch, user_id % 2 as grp,
  chr(65 + ((day(ts) - 1) // 7)::int) as tp, user_id * 8 + (day(ts) - 1) // 7 as sample, ts from events)"""
r6 = lambda c: F.round(c, 6)


def measured(t):
    week = F.floor((F.dayofmonth("ts") - 1) / 7)
    return t("events").select("event_id", F.col("user_id").alias("subject"), F.col("event_type").alias("feature"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
                              (F.col("user_id") % 3).alias("batch"), (F.col("user_id") % 2).alias("grp"), F.char(F.lit(65) + week).alias("tp"), (F.col("user_id") * 8 + week).alias("sample"), "ts")


def per_sample(t):
    """One value per sample and feature."""
    return measured(t).groupBy("sample", "subject", "feature", "batch", "grp", "tp").agg(F.avg("value").alias("value"))


S_SQL = M_SQL + ", s as (select sample, subject, feature, batch, grp, tp, avg(value) as value from m group by all)"


def q(name, sql):
    return R.query(name, f"with {sql}")


@R.query("q_src_07", "select source_file, case when source_file like '%plasma%' then 'plasma' when source_file like '%placenta%' then 'placenta' when source_file like '%tissue%' then 'tissue' when source_file like '%lysate%' then 'lysate' else 'other' end as kind, count(*) as n from olink_long group by 1, 2")
def _(t):
    f = F.lower("source_file")
    kind = F.lit("other")
    for k in ("lysate", "tissue", "placenta", "plasma"):
        kind = F.when(f.contains(k), k).otherwise(kind)
    return t("olink_long").groupBy("source_file", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@R.query("q_src_12", "select row_id, regexp_replace(sample_id, '[A-E]$', '') as stem, group_label as third from sample_metadata")
def _(t):
    x = t("sample_metadata")
    return x.select("row_id", F.regexp_replace(x.columns[1], "[A-E]$", "").alias("stem"), F.col(x.columns[3]).alias("third"))


@R.query("q_src_15", "select source_file as file, regexp_extract(source_file, 'npx_([a-z0-9]+)_', 1) as run, regexp_extract(source_file, '_(plasma|placenta)_', 1) as kind, try_cast(regexp_extract(source_file, 'plate([0-9]+)', 1) as bigint) as plate, row_number() over (order by source_file) as ordinal from (select distinct source_file from olink_long)")
def _(t):
    x = t("olink_long").select("source_file").distinct()
    g = lambda p: F.regexp_extract("source_file", p, 1)
    return x.select(F.col("source_file").alias("file"), g("npx_([a-z0-9]+)_").alias("run"), g("_(plasma|placenta)_").alias("kind"), g("plate([0-9]+)").try_cast("bigint").alias("plate"),
                    F.row_number().over(Window.orderBy("source_file")).cast("long").alias("ordinal"))  # one row per file


_N = "try_cast(replace(trim(npx), ',', '.') as double)"


@R.query("q_flt_13", f"select row_id, nullif(case when regexp_full_match(trim(npx), '-?[0-9]+([.,][0-9]+)?') then {_N} end, 0) as npx from olink_long")
def _(t):
    v = read_number(F.col("npx"))
    return t("olink_long").select("row_id", F.when(v != 0, v).alias("npx"))


@R.query("q_flt_14", f"select row_id, case when upper(trim(coalesce(qc_warning, 'NAN'))) = 'PASS' and upper(trim(coalesce(assay_warning, 'NAN'))) = 'PASS' then npx end as npx from olink_long")
def _(t):
    return t("olink_long").select("row_id", F.when(passes(F.col("qc_warning")) & passes(F.col("assay_warning")), F.col("npx")).alias("npx"))


@R.query("q_flt_15", "select regexp_matches(upper(sample_id), '^(CONTROL|NEG|PLATE)') as control_sample, regexp_matches(lower(assay), '\\bcontrol\\b') as control_assay, count(*) as n from olink_long group by 1, 2")
def _(t):
    return t("olink_long").groupBy(is_control_sample(F.col("sample_id")).alias("control_sample"), F.lower("assay").rlike(r"\bcontrol\b").alias("control_assay")).agg(F.count(F.lit(1)).alias("n"))


@q("q_flt_16", M_SQL + " select event_id, case when value > 20 then value end as value from m")
def _(t):
    return measured(t).select("event_id", F.when(F.col("value") - 20 > 0, F.col("value")).alias("value"))


@q("q_flt_18", M_SQL + ", a as (select feature, avg((value is null)::int) filter (where grp = 0) as c, avg((value is null)::int) filter (where grp = 1) as k from m group by 1) select feature, round(c, 6) as control_missing, round(k, 6) as case_missing, c > 0.2 or k > 0.2 as drop, not (c > 0.2 or k > 0.2) and abs(c - k) > 0.1 as warn from a")
def _(t):
    return qc.missing_by_feature(measured(t), "feature", "value", F.col("grp") == 1).select("feature", r6("control_missing").alias("control_missing"), r6("case_missing").alias("case_missing"), "drop", "warn")


@q("q_flt_19", M_SQL + ", a as (select feature, tp, avg((value is null)::int) filter (where grp = 0) as c, avg((value is null)::int) filter (where grp = 1) as k from m group by 1, 2) select feature, bool_or(coalesce(c > 0.2 and k > 0.2, false)) as drop, bool_or(coalesce(c between 0.1 and 0.2, false) or coalesce(k between 0.1 and 0.2, false)) as borderline from a group by 1")
def _(t):
    return qc.missing_by_window(measured(t), "feature", "tp", "value", F.col("grp") == 1)


@q("q_flt_20", M_SQL + " select sample, round(avg((value is null)::int), 6) as missing from m where batch <> 2 group by 1 having avg((value is null)::int) > 0.5")
def _(t):
    return qc.poor_samples(measured(t), "sample", "value", F.col("batch") != 2).withColumn("missing", r6("missing"))


@R.query("q_flt_21", "with x as (select row_id, subject_id, case when sample_gest_age < 14 then 'w1' when sample_gest_age < 22 then 'w2' when sample_gest_age < 32 then 'w3' else 'w4' end as win, sample_gest_age as ga from sample_metadata where not isnan(sample_gest_age) and not isnan(gest_age_delivery) and gest_age_delivery - sample_gest_age > 0.1), m as (select win, median(ga) as med from x group by 1) select row_id from (select row_id, row_number() over (partition by subject_id, x.win order by abs(ga - med), row_id) as n from x join m on x.win = m.win) where n = 1")
def _(t):
    """Samples before delivery, one per participant and window: the one nearest to the window's median week."""
    ga = F.col("sample_gest_age")
    win = F.when(ga < 14, "w1").when(ga < 22, "w2").when(ga < 32, "w3").otherwise("w4")
    x = t("sample_metadata").where(~F.isnan("sample_gest_age") & ~F.isnan("gest_age_delivery") & (F.col("gest_age_delivery") - ga > 0.1)).select("row_id", "subject_id", win.alias("win"), ga.alias("ga"))
    m = exact_quantiles(x, ["win"], "ga", {"med": 0.5}).drop("n")
    return rel.first_by(x.join(F.broadcast(m), "win").withColumn("_d", F.abs(F.col("ga") - F.col("med"))), ["subject_id", "win"], ["_d", "row_id"]).select("row_id")


@q("q_flt_22", M_SQL + ", a as (select *, median(value) over (partition by batch, feature) as mid from m where value is not null), b as (select *, median(abs(value - mid)) over (partition by batch, feature) as mad from a) select event_id, round(mid, 6) as mid, round(mad, 6) as mad from b where mad > 0 and abs(value - mid) > 5 * mad")
def _(t):
    return qc.mad_outliers(measured(t).select("event_id", "batch", "feature", "value"), ["batch", "feature"], "value").select("event_id", r6("mid").alias("mid"), r6("mad").alias("mad"))


@q("q_flt_23", M_SQL + ", a as (select feature, batch, stddev_samp(value) / nullif(avg(value), 0) * 100 as rsd from m group by 1, 2 having count(value) >= 2) select feature, round(max(rsd), 6) as worst_rsd, bool_or(coalesce(rsd > 30, true)) as fails from a group by 1")
def _(t):
    return qc.rsd(measured(t), "feature", "batch", "value").withColumn("worst_rsd", r6("worst_rsd"))


@q("q_flt_24", M_SQL + ", a as (select feature, tp, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) as iqr from m where value is not null group by 1, 2 having count(*) >= 4), b as (select feature, median(iqr) as iqr from a group by 1), c as (select quantile_cont(iqr, 0.05) as lo, quantile_cont(iqr, 0.95) as hi from b) select feature, round(iqr, 6) as iqr, (iqr < lo and iqr < 0.1) or (iqr > hi and iqr > 5.0) as drop from b, c")
def _(t):
    return qc.iqr_filter(measured(t), "feature", "tp", "value").withColumn("iqr", r6("iqr"))


_OTU = "o as (select l_orderkey as sample, 'T' || (l_partkey % 40) as taxon, sum(l_quantity)::double as reads from lineitem group by 1, 2)"


def taxa(t):
    return t("lineitem").groupBy(F.col("l_orderkey").alias("sample"), F.concat(F.lit("T"), (F.col("l_partkey") % 40).cast("string")).alias("taxon")).agg(F.sum("l_quantity").alias("reads"))


@R.query("q_flt_25", "select p_partkey, regexp_replace(p_brand, '^Brand', '') as genus from part where trim(regexp_replace(p_brand, '^Brand#1?', '')) <> ''")
def _(t):
    return t("part").where(F.trim(F.regexp_replace("p_brand", "^Brand#1?", "")) != "").select("p_partkey", F.regexp_replace("p_brand", "^Brand", "").alias("genus"))


@q("q_flt_26", _OTU + ", n as (select sample, sum(reads) as n from o group by 1) select taxon, round(avg((reads >= 3)::int), 6) as prevalence, round(avg(reads / n), 6) as mean_share from o join n on o.sample = n.sample group by 1 having avg((reads >= 3)::int) >= 0.1 and avg(reads / n) >= 0.005")
def _(t):
    return qc.taxa_filter(taxa(t), "sample", "taxon", "reads").select("taxon", r6("prevalence").alias("prevalence"), r6("mean_share").alias("mean_share"))


@q("q_flt_27", _OTU + " select sample, sum(reads) as depth from o group by 1 having sum(reads) >= 200")
def _(t):
    return taxa(t).groupBy("sample").agg(F.sum("reads").alias("depth")).where("depth >= 200")


@q("q_flt_28", _OTU + ", n as (select sample, sum(reads) as n from o group by 1) select taxon, coalesce(bool_or(reads / n >= 0.6) filter (where o.sample % 50 = 0), false) and coalesce(bool_or(reads / n >= 0.6) filter (where o.sample % 50 <> 0), false) as contaminant from o join n on o.sample = n.sample group by 1")
def _(t):
    return qc.contaminants(taxa(t), "sample", "taxon", "reads", F.col("sample") % 50 == 0, 0.6)


@R.query("q_flt_29", "select p_partkey, p_name from part where not regexp_matches(p_name, '127|IS|red')")
def _(t):
    return t("part").where(~F.col("p_name").rlike("127|IS|red")).select("p_partkey", "p_name")


@R.query("q_flt_32", "select p_partkey, trim(regexp_replace(p_name, 'ing$', '')) as clean from part where not regexp_matches(p_name, '^[pn][0-9]+$') and not contains(lower(p_name), 'istd') and not starts_with(p_name, '[Similar to:')")
def _(t):
    n = F.col("p_name")
    return t("part").where(~n.rlike("^[pn][0-9]+$") & ~F.lower(n).contains("istd") & ~n.startswith("[Similar to:")).select("p_partkey", F.trim(F.regexp_replace(n, "ing$", "")).alias("clean"))


@q("q_ag_11", M_SQL + ", a as (select tp, feature, median(value) as md from m where value is not null group by 1, 2), b as (select tp, median(md) as g from a group by 1) select event_id, round(value - md + g, 6) as value from m join a on m.tp = a.tp and m.feature = a.feature join b on m.tp = b.tp")
def _(t):
    return nz.panel_shift(measured(t).select("event_id", "tp", "feature", "value"), ["tp"], "feature", "value").select("event_id", r6("value").alias("value"))


@q("q_ag_12", M_SQL + " select sample, round(median(value) filter (where feature = 'click'), 6) as click, round(median(value) filter (where feature = 'error'), 6) as error, round(median(value) filter (where feature = 'view'), 6) as view from m group by 1")
def _(t):
    return measured(t).groupBy("sample").pivot("feature", ["click", "error", "view"]).agg(r6(F.median("value")))


@q("q_ag_15", M_SQL + " select subject, feature, round(avg(value), 6) as value from m group by 1, 2")
def _(t):
    return measured(t).groupBy("subject", "feature").agg(r6(F.avg("value")).alias("value"))


@q("q_ag_16", M_SQL + " select feature, round(exp(avg(ln(value)) filter (where value > 0)), 6) as gm from m group by 1")
def _(t):
    return measured(t).groupBy("feature").agg(r6(nz.geometric_mean(F.col("value"))).alias("gm"))


@q("q_ag_17", M_SQL + ", a as (select feature, batch, median(value) as md from m where tp = 'B' and value is not null group by 1, 2), x as (select a.batch, a.md / b.md as ratio from a join a b on a.feature = b.feature and b.batch = 0 where b.md <> 0) select batch, round(median(ratio), 6) as factor from x group by 1")
def _(t):
    return nz.batch_factors(measured(t), "feature", "batch", "value", F.col("tp") == "B", 0).withColumn("factor", r6("factor"))


@q("q_ag_20", M_SQL + ", a as (select sample, sum(value) as tic from m group by 1) select sample, round(tic, 6) as tic from a order by tic desc nulls last, sample limit 20")
def _(t):
    return measured(t).groupBy("sample").agg(F.sum("value").alias("tic")).orderBy(F.desc_nulls_last("tic"), "sample").limit(20).withColumn("tic", r6("tic"))


@R.query("q_ag_26", "select upper(trim(sample_id)) as sample, count(distinct load_id) as n_batches from olink_long where not regexp_matches(upper(trim(sample_id)), '^(CONTROL|NEG|PLATE)') group by 1 having count(distinct load_id) > 1")
def _(t):
    return t("olink_long").where(~is_control_sample(F.col("sample_id")) & F.col("sample_id").isNotNull()).groupBy(F.upper(F.trim("sample_id")).alias("sample")).agg(F.countDistinct("load_id").alias("n_batches")).where("n_batches > 1")


@q("q_ag_27", _OTU + ", n as (select sample, sum(reads) as n from o group by 1) select taxon, round(avg(reads / n), 6) as mean_share from o join n on o.sample = n.sample group by 1")
def _(t):
    return nz.shares(taxa(t), "sample", "reads").groupBy("taxon").agg(r6(F.avg("share")).alias("mean_share"))


@q("q_wn_05", S_SQL + " select sample, feature, round(value - median(value) over (partition by batch, feature), 6) as centered from s where value is not null")
def _(t):
    x = per_sample(t).where("value is not null")
    mid = exact_quantiles(x, ["batch", "feature"], "value", {"mid": 0.5}).drop("n")
    return x.join(mid, ["batch", "feature"]).select("sample", "feature", r6(F.col("value") - F.col("mid")).alias("centered"))


@q("q_wn_07", M_SQL + " select event_id, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2 as mid_rank from m where value is not null")
def _(t):
    x = measured(t).where("value is not null").select("event_id", "feature", F.col("value").alias("v"))
    rk = ranks.value_counts(x, ["feature"], "v", {}).select("feature", "v", ranks.mid_rank().alias("mid_rank"))
    return x.join(rk, ["feature", "v"]).select("event_id", "mid_rank")


@R.query("q_wn_08", "select p_brand, p_partkey from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_size desc, p_name, p_partkey) as n from part) where n = 1")
def _(t):
    return rel.first_by(t("part"), ["p_brand"], [F.desc_nulls_last("p_retailprice"), F.desc_nulls_last("p_size"), F.asc_nulls_last("p_name"), F.asc("p_partkey")]).select("p_brand", "p_partkey")


@q("q_wn_11", S_SQL + " select sample, feature, round(greatest(-2, least(2, coalesce((value - avg(value) over (partition by feature)) / nullif(stddev_samp(value) over (partition by feature), 0), 0))), 6) as z from s where value is not null")
def _(t):
    x = per_sample(t).where("value is not null")
    s = x.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    z = F.coalesce((F.col("value") - F.col("m")) / F.nullif(F.col("sd"), F.lit(0.0)), F.lit(0.0))
    return x.join(s, "feature").select("sample", "feature", r6(F.greatest(F.lit(-2.0), F.least(F.lit(2.0), z))).alias("z"))


@q("q_wn_12", M_SQL + " select distinct feature, value, round(cume_dist() over (partition by feature order by value), 6) as ecdf from m where value is not null")
def _(t):
    v = ranks.value_counts(measured(t), ["feature"], "value", {})
    n = v.groupBy("feature").agg(F.sum("c").alias("n"))
    return v.join(n, "feature").select("feature", F.col("v").alias("value"), r6((F.col("c_before") + F.col("c")) / F.col("n")).alias("ecdf"))


@q("q_wn_13", M_SQL + " select feature, batch, round(regr_slope(value, event_id), 6) as slope, abs(regr_slope(value, event_id)) / nullif(avg(abs(value)), 0) > 0.0005 as drifts from m group by 1, 2")
def _(t):
    s = F.regr_slope("value", F.col("event_id").cast("double"))
    return measured(t).groupBy("feature", "batch").agg(r6(s).alias("slope"), (F.abs(s) / F.nullif(F.avg(F.abs("value")), F.lit(0.0)) > 0.0005).alias("drifts"))


@q("q_wn_14", S_SQL + " select a.batch, a.feature as f1, b.feature as f2, round(corr(a.value, b.value), 6) as r, count(*) as n from s a join s b on a.sample = b.sample and a.feature < b.feature where a.value is not null and b.value is not null group by 1, 2, 3 having count(*) >= 3")
def _(t):
    """Correlation of each two features over the samples of a batch: features of one sample are few."""
    a = per_sample(t).where("value is not null").select("sample", "batch", F.col("feature").alias("f1"), F.col("value").alias("v1"))
    b = a.select("sample", F.col("f1").alias("f2"), F.col("v1").alias("v2"))
    return a.join(b, "sample").where("f1 < f2").groupBy("batch", "f1", "f2").agg(r6(F.corr("v1", "v2")).alias("r"), F.count(F.lit(1)).alias("n")).where("n >= 3")


@q("q_tr_01", M_SQL + " select event_id, round(coalesce(value, min(value) over (partition by feature) - 1), 6) as value from m")
def _(t):
    return nz.half_min(measured(t), "feature", "value").select("event_id", r6("value").alias("value"))


@q("q_tr_02", M_SQL + " select event_id, round(coalesce(value, min(value) over (partition by feature) / 2), 6) as value from m")
def _(t):
    return nz.half_min(measured(t), "feature", "value", logged=False).select("event_id", r6("value").alias("value"))


@q("q_tr_04", M_SQL + " select event_id, round(log2(value + 1), 6) as value from m")
def _(t):
    return measured(t).select("event_id", r6(F.log2(F.col("value") + 1)).alias("value"))


@q("q_tr_05", S_SQL + ", i as (select sample, exp(avg(ln(value)) filter (where value > 0)) as f from s where feature in ('click', 'error') group by 1), u as (select distinct sample, batch from s), x as (select u.sample, u.batch, i.f from u left join i on u.sample = i.sample), b as (select batch, median(f) as bf from x group by 1) select s.sample, s.feature, round(s.value / coalesce(x.f, b.bf, (select median(f) from x)), 6) as value from s join x on s.sample = x.sample left join b on x.batch = b.batch where s.feature not in ('click', 'error')")
def _(t):
    return nz.by_standards(per_sample(t), "sample", "batch", "value", F.col("feature").isin("click", "error")).select("sample", "feature", r6("value").alias("value"))


@q("q_tr_07", M_SQL + ", a as (select feature, batch, median(value) as md from m where tp = 'B' and value is not null group by 1, 2), x as (select a.batch, a.md / b.md as ratio from a join a b on a.feature = b.feature and b.batch = 0 where b.md <> 0), f as (select batch, median(ratio) as factor from x group by 1) select event_id, round(value / factor, 6) as value from m join f on m.batch = f.batch")
def _(t):
    m = measured(t)
    return m.join(F.broadcast(nz.batch_factors(m, "feature", "batch", "value", F.col("tp") == "B", 0)), "batch").select("event_id", r6(F.col("value") / F.col("factor")).alias("value"))


@q("q_tr_09", M_SQL + ", s as (select feature, batch, avg(value) as mu, coalesce(nullif(stddev_samp(value), 0), 1) as sd from m group by 1, 2) select event_id, round((value - s.mu) / s.sd * r.sd + r.mu, 6) as value from m join s on m.feature = s.feature and m.batch = s.batch join s r on m.feature = r.feature and r.batch = 0")
def _(t):
    return nz.location_scale(measured(t), "feature", "batch", "value", 0).select("event_id", r6("value").alias("value"))


@q("q_tr_10", S_SQL + " select sample, feature, round(ln(value) - avg(ln(value)) over (partition by sample), 6) as value from s where value > 0")
def _(t):
    return nz.clr(per_sample(t).where("value > 0"), "sample", "value").select("sample", "feature", r6("value").alias("value"))


@q("q_tr_11", S_SQL + " select sample, feature, round(value / nullif(sum(value) over (partition by sample), 0), 6) as share from s")
def _(t):
    return nz.shares(per_sample(t), "sample", "value").select("sample", "feature", r6("share").alias("share"))


@R.query("q_tr_12")
def _(t):
    """Count-zero multiplicative replacement; tests check that shares stay positive and sum to one."""
    x = taxa(t).withColumn("reads", F.when(F.col("reads") > 20, F.col("reads")).otherwise(0.0))
    return nz.zeros_replaced(x, "sample", "reads").select("sample", "taxon", r6("share").alias("share"))


@q("q_tr_13", M_SQL + ", f as (select feature, median(value) as md, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) as iqr from m where grp = 0 and value is not null group by 1) select event_id, round((value - md) / case when iqr > 0 then iqr else 1 end, 6) as scaled from m join f on m.feature = f.feature")
def _(t):
    return nz.robust_scaled(measured(t), "feature", "value", F.col("grp") == 0).select("event_id", r6("scaled").alias("scaled"))


@q("q_tr_14", M_SQL + ", a as (select feature, median(log2(value + 1)) filter (where grp = 0) as m1, median(log2(value + 1)) filter (where grp = 1) as m2 from m group by 1) select feature, round(log2(greatest(2 ^ m2 - 1, 1e-12) / greatest(2 ^ m1 - 1, 1e-12)), 6) as log2fc from a")
def _(t):
    x = measured(t).withColumn("l", F.log2(F.col("value") + 1))
    md = exact_quantiles(x, ["feature", "grp"], "l", {"mid": 0.5}).groupBy("feature").agg(*(F.max(F.when(F.col("grp") == g, F.col("mid"))).alias(f"m{g}") for g in (0, 1)))
    back = lambda c: F.greatest(F.pow(F.lit(2.0), F.col(c)) - 1, F.lit(1e-12))
    return md.select("feature", r6(F.log2(back("m1") / back("m0"))).alias("log2fc"))


@R.query("q_tr_08")
def _(t):
    """Empirical-Bayes batch correction; tests check single batches, missing values and recovered shifts."""
    return nz.combat(per_sample(t), "sample", "feature", "batch", "value").select("sample", "feature", "batch", r6("value").alias("value"))


@R.query("q_tr_19", "select p_partkey, trim(replace(replace(regexp_replace(lower(p_name), '^(d|l)-', ''), 'red', 'alpha'), 'widget', 'beta')) as simple from part")
def _(t):
    n = F.regexp_replace(F.lower("p_name"), "^(d|l)-", "")
    return t("part").select("p_partkey", F.trim(F.replace(F.replace(n, F.lit("red"), F.lit("alpha")), F.lit("widget"), F.lit("beta"))).alias("simple"))


@R.query("q_tr_21", "select p_partkey, try_cast(regexp_extract('unk_9_POS_' || format('{:.4f}', p_retailprice) || '_RT' || format('{:.2f}', p_size::double), '_([0-9.]+)_RT', 1) as double) as mz, try_cast(regexp_extract('unk_9_POS_' || format('{:.4f}', p_retailprice) || '_RT' || format('{:.2f}', p_size::double), '_RT([0-9.]+)$', 1) as double) as rt from part")
def _(t):
    name = F.concat(F.lit("unk_9_POS_"), F.format_string("%.4f", "p_retailprice"), F.lit("_RT"), F.format_string("%.2f", F.col("p_size").cast("double")))
    x = t("part").select("p_partkey", name.alias("name"))
    return x.select("p_partkey", F.regexp_extract("name", "_([0-9.]+)_RT", 1).try_cast("double").alias("mz"), F.regexp_extract("name", "_RT([0-9.]+)$", 1).try_cast("double").alias("rt"))


@R.query("q_tr_22", "select distinct load_id, try_cast(regexp_extract(load_id, '-L([0-9]+)$', 1) as int) as batch_no, strftime(min(loaded_at) over (partition by load_id), '%Y-%m-%d') as batch_date from olink_long")
def _(t):
    return t("olink_long").groupBy("load_id").agg(F.date_format(F.min("loaded_at"), "yyyy-MM-dd").alias("batch_date")).select("load_id", F.regexp_extract("load_id", "-L([0-9]+)$", 1).try_cast("int").alias("batch_no"), "batch_date")


@R.query("q_rs_02", "select row_id, unnest(['gravida', 'parity']) as field, unnest([gravida, parity]) as v from processed_clinical_data")
def _(t):
    return t("processed_clinical_data").unpivot(["row_id"], ["gravida", "parity"], "field", "v")


@q("q_rs_01", M_SQL + " select subject, count(value) filter (where tp = 'A') as a, count(value) filter (where tp = 'B') as b, count(value) filter (where tp = 'C') as c from m group by 1")
def _(t):
    return measured(t).groupBy("subject").pivot("tp", ["A", "B", "C"]).agg(F.count("value")).select("subject", *(F.coalesce(k, F.lit(0)).alias(k.lower()) for k in "ABC"))


@R.query("q_rs_03", "select vec_id, i - 1 as dim, round(embedding[i]::double, 6) as v from (select vec_id, embedding, unnest(range(1, 65)) as i from embeddings)")
def _(t):
    return t("embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "v")).select("vec_id", F.col("dim").cast("long").alias("dim"), r6(F.col("v").cast("double")).alias("v"))


@q("q_rs_15", M_SQL + " select event_id, case tp when 'A' then 'first' when 'B' then 'second' when 'C' then 'third' end as visit from m")
def _(t):
    return measured(t).select("event_id", F.when(F.col("tp") == "A", "first").when(F.col("tp") == "B", "second").when(F.col("tp") == "C", "third").alias("visit"))


@q("q_rs_16", M_SQL + " select subject, round(count(*) filter (where value > 10) / nullif(count(value), 0), 6) as exceed_rate from m group by 1")
def _(t):
    return measured(t).groupBy("subject").agg(r6(F.try_divide(F.count_if(F.col("value") > 10), F.count("value"))).alias("exceed_rate"))


@R.query("q_rs_17", "select row_id, case when starts_with(sample_id, subject_id) then substr(sample_id, length(subject_id) + 1) else regexp_extract(sample_id, '([A-E])$', 1) end as suffix from sample_metadata where sample_id is not null and subject_id is not null")
def _(t):
    x = t("sample_metadata").where("sample_id is not null and subject_id is not null")
    return x.select("row_id", F.when(F.startswith("sample_id", "subject_id"), F.expr("substr(sample_id, length(subject_id) + 1)")).otherwise(F.regexp_extract("sample_id", "([A-E])$", 1)).alias("suffix"))


@R.query("q_rs_20", "select row_id, case when isnan(sample_gest_age) or sample_gest_age is null or sample_gest_age < 6 then null when sample_gest_age <= 13.9 then '6-13.9' when sample_gest_age <= 21.9 then '14-21.9' when sample_gest_age <= 31.9 then '22-31.9' when sample_gest_age <= 36.9 then '32-36.9' end as win from sample_metadata")
def _(t):
    g = F.col("sample_gest_age")
    return t("sample_metadata").select("row_id", F.when(g.isNull() | F.isnan(g) | (g < 6), None).when(g <= 13.9, "6-13.9").when(g <= 21.9, "14-21.9").when(g <= 31.9, "22-31.9").when(g <= 36.9, "32-36.9").alias("win"))


@q("q_jn_06", M_SQL + ", a as (select feature, avg(value) as adj from m group by 1) select event_id, round(value - adj, 6) as value from m join a on m.feature = a.feature")
def _(t):
    m = measured(t)
    return m.join(m.groupBy("feature").agg(F.avg("value").alias("adj")), "feature").select("event_id", r6(F.col("value") - F.col("adj")).alias("value"))


@q("q_jn_12", S_SQL + " select a.subject, a.feature, b.tp || '_minus_' || a.tp as comparison, round(b.value - a.value, 6) as delta from s a join s b on a.subject = b.subject and a.feature = b.feature and ascii(b.tp) = ascii(a.tp) + 1")
def _(t):
    return rel.adjacent_deltas(per_sample(t), "subject", "feature", "tp", "value").withColumn("delta", r6("delta"))


@R.query("q_jn_16", "select l_orderkey, l_linenumber, l_partkey, p_brand from lineitem left join (select * from part where p_size < 10) on l_partkey = p_partkey where p_brand is not null")
def _(t):
    meta = t("part").where("p_size < 10").select("p_partkey", "p_brand")
    return t("lineitem").join(meta, F.col("l_partkey") == F.col("p_partkey"), "left").where("p_brand is not null").select("l_orderkey", "l_linenumber", "l_partkey", "p_brand")


@q("q_tk_01", M_SQL + ", a as (select feature, avg(value) as a from m where value > 40 group by 1) select feature, round(a, 6) as a, row_number() over (order by a nulls last, feature) as place from a")
def _(t):
    a = measured(t).where("value > 40").groupBy("feature").agg(F.avg("value").alias("a"))
    return a.select("feature", r6("a").alias("a"), F.row_number().over(Window.orderBy(F.asc_nulls_last("a"), "feature")).cast("long").alias("place"))  # one row per feature


@R.query("q_tk_03", "select p_partkey from part order by p_retailprice desc, p_partkey limit 500")
def _(t):
    return t("part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(500).select("p_partkey")


@R.query("q_tk_05", "select p_brand, p_partkey from (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as n from part) where n <= 5")
def _(t):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return t("part").withColumn("n", F.row_number().over(w)).where("n <= 5").select("p_brand", "p_partkey")


@q("q_tk_09", S_SQL + ", c as (select distinct tp from s) select b.tp || '_minus_' || a.tp as label, ascii(b.tp) - ascii(a.tp) = 1 as adjacent from c a join c b on a.tp < b.tp")
def _(t):
    """Labels of comparisons and whether their timepoints are neighbours; timepoints are a closed list."""
    tp = measured(t).select("tp").distinct()
    return tp.join(tp.withColumnRenamed("tp", "later"), F.col("tp") < F.col("later")).select(F.concat("later", F.lit("_minus_"), "tp").alias("label"), (F.ascii("later") - F.ascii("tp") == 1).alias("adjacent"))


@R.query("q_snk_03", "select p_partkey, format('{:.10f}', p_retailprice) || ' ' || format('{:.10f}', p_size::double) as line from part")
def _(t):
    return t("part").select("p_partkey", F.concat_ws(" ", F.format_string("%.10f", "p_retailprice"), F.format_string("%.10f", F.col("p_size").cast("double"))).alias("line"))


@q("q_snk_04", M_SQL + " select rpad(feature, 20, '.') || lpad(count(*)::varchar, 8, ' ') as line from m group by feature")
def _(t):
    return measured(t).groupBy("feature").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.rpad("feature", 20, "."), F.lpad(F.col("n").cast("string"), 8, " ")).alias("line"))


@q("q_snk_11", M_SQL + ", a as (select sample from m group by 1 having avg((value is null)::int) > 0.4), b as (select sample from m group by 1 having count(*) < 12) select sample, min(step) as step, arg_min(name, step) as step_name from (select sample, 1 as step, 'missing' as name from a union all select sample, 2, 'few' from b) group by 1")
def _(t):
    m = measured(t)
    a = m.groupBy("sample").agg(F.avg(F.col("value").isNull().cast("double")).alias("x")).where("x > 0.4")
    b = m.groupBy("sample").agg(F.count(F.lit(1)).alias("x")).where("x < 12")
    return qc.drop_log(m, [("missing", a), ("few", b)], "sample")


QUERIES, SQL = R.queries, R.sql
