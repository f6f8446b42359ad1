"""Queries of the clinical, placental and Table 1 operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortloom.operators import clinical as cl
from cohortloom.operators import relational as rel
from cohortloom.plans.registry import Register

R = Register()
C, P, V = "processed_clinical_data", "processed_placental_data", "dp3_variables_of_interest"
#: Codes of the findings that the placental table here has.
CODES = {c: m for c, m in cl.PLACENTAL_CODES.items() if c not in ("distal_villous_hypoplasia", "increased_perivillous_fibrin_deposition", "segmental_avascular_villi")}
_WORDS = ", ".join(f"'{w}'" for w in ("", *cl.PLACEHOLDERS))
_UNMASK = lambda c: f"case when lower(trim({c})) not in ({_WORDS}) then {c} end"
_num = lambda c: F.when(~F.isnan(c), F.col(c))


@R.query("q_prj_02", f"select row_id, id, lower(trim(group_label)) as group_label, lower(trim(subgroup)) as subgroup, lower(trim(diabetes)) as diabetes from {C}")
def _(t):
    return cl.lowered(t(C).select("row_id", "id", "group_label", "subgroup", "diabetes"), ["id"])


@R.query("q_prj_04", f"select row_id as record, id as participant, gravida from {C}")
def _(t):
    return t(C).withColumnsRenamed({"row_id": "record", "id": "participant", "absent": "x"}).select("record", "participant", "gravida")


@R.query("q_prj_05", f"select row_id, id, group_label from {C}")
def _(t):
    return t(C).select("row_id", "id", "group_label", "apgar_1", "parity").drop("apgar_1", "parity", "not_there")


@R.query("q_prj_06", f"select row_id, id, group_label, gravida, parity from {C}")
def _(t):
    x = t(C).select("gravida", "parity", "group_label", "row_id", "id")
    front = ["row_id", "id"]
    return x.select(*front, *(c for c in x.columns if c not in front))


@R.query("q_flt_02", f"select row_id, status from {V} where lower(trim(status)) in ('delivered', 'delivered off site', 'active')")
def _(t):
    return t(V).where(F.lower(F.trim("status")).isin("delivered", "delivered off site", "active")).select("row_id", "status")


@R.query("q_flt_10", f"select p.row_id from {P} p where not coalesce(replace(p.not_in_file, '_', ' ') = 'no slides', false) and not coalesce(p.slide_a = 'x' and p.slide_b = 'x' and p.slide_membrane_roll = 'x', false) and p.id in (select id from cohort_registry)")
def _(t):
    """Leave out participants without slides, with none usable, or outside the cohort."""
    none = F.coalesce(F.replace(F.col("not_in_file"), F.lit("_"), F.lit(" ")) == "no slides", F.lit(False))
    all_x = F.coalesce((F.col("slide_a") == "x") & (F.col("slide_b") == "x") & (F.col("slide_membrane_roll") == "x"), F.lit(False))
    return t(P).where(~none & ~all_x).join(t("cohort_registry").select("id").distinct(), "id", "left_semi").select("row_id")


@R.query("q_flt_11", f"select row_id, {_UNMASK('race')} as race, {_UNMASK('ethnicity')} as ethnicity, {_UNMASK('smoking')} as smoking from {V}")
def _(t):
    return t(V).select("row_id", *(cl.unmasked(F.col(c)).alias(c) for c in ("race", "ethnicity", "smoking")))


@R.query("q_flt_12", f"select row_id, replace(replace(lower(status), 'delievred', 'delivered'), 'dilvered', 'delivered') as status from {V}")
def _(t):
    return t(V).select("row_id", F.replace(F.replace(F.lower("status"), F.lit("delievred"), F.lit("delivered")), F.lit("dilvered"), F.lit("delivered")).alias("status"))


@R.query("q_rs_04", f"select row_id, coalesce(regexp_matches(lower(trim(race)), 'white')::int, 0) as race_white, coalesce(regexp_matches(lower(trim(race)), 'black|african|africian')::int, 0) as race_black, coalesce(regexp_matches(lower(trim(race)), 'asian|korean')::int, 0) as race_asian, case when ethnicity is null or lower(trim(ethnicity)) in ({_WORDS}) then null when regexp_matches(lower(trim(ethnicity)), '^(not|non|no)') then 0 when regexp_matches(lower(trim(ethnicity)), 'hispanic|latin') then 1 else 0 end as hispanic from {V}")
def _(t):
    return t(V).select("row_id", *(c.alias(k) for k, c in cl.race_flags(F.col("race")).items()), cl.hispanic_flag(F.col("ethnicity")).alias("hispanic"))


@R.query("q_rs_06", f"select row_id, (race is null)::int as race_is_missing, (ethnicity is null)::int as eth_is_missing, (smoking is null)::int as smoking_is_missing from {V}")
def _(t):
    return t(V).select("row_id", *(F.col(c).isNull().cast("int").alias(f"{k}_is_missing") for c, k in (("race", "race"), ("ethnicity", "eth"), ("smoking", "smoking"))))


@R.query("q_rs_07", f"select row_id, coalesce((lower(trim(smoking)) = 'yes')::int, 0) as smoking_encoded from {V}")
def _(t):
    return t(V).select("row_id", cl.smoking_code(F.col("smoking")).alias("smoking_encoded"))


@R.query("q_rs_08", f"select row_id, " + ", ".join("coalesce(case " + " ".join(f"when lower({c}) = '{w}' then {k}" for w, k in m.items()) + f" end, 0) as {c}" for c, m in CODES.items()) + f" from {P}")
def _(t):
    return t(P).select("row_id", *(cl.coded(F.lower(c), m).alias(c) for c, m in CODES.items()))


_SPTB = "case when lower(c.group_label) like '%sptb%' or lower(c.subgroup) like '%sptb%' then 1 when lower(v.labor_onset) in ('spontaneous', 'prom', '0') and c.gest_age_del < 37 and not isnan(c.gest_age_del) then 1 else 0 end"


@R.query("q_rs_09", f"select c.row_id, v.row_id as v_row, {_SPTB} as sptb from {C} c left join {V} v on c.id = v.id")
def _(t):
    v = t(V).select("id", F.col("row_id").alias("v_row"), "labor_onset")
    return t(C).join(v, "id", "left").select("row_id", "v_row", cl.spontaneous_preterm(F.col("group_label"), F.col("subgroup"), F.col("labor_onset"), F.col("gest_age_del")).alias("sptb"))


@R.query("q_ag_21", "select finding, sum(v)::bigint as total from (select unnest([" + ", ".join(f"'{c}'" for c in CODES) + "]) as finding, unnest([" + ", ".join("coalesce(case " + " ".join(f"when lower({c}) = '{w}' then {k}" for w, k in m.items()) + " end, 0)" for c, m in CODES.items()) + f"]) as v from {P}) group by 1 having sum(v) > 0")
def _(t):
    x = t(P).select("row_id", *(cl.coded(F.lower(c), m).alias(c) for c, m in CODES.items()))
    return x.unpivot(["row_id"], list(CODES), "finding", "v").groupBy("finding").agg(F.sum("v").cast("long").alias("total")).where("total > 0")


def _sql_bin(c, edges):
    return f"case when {c} is null or isnan({c}) then null " + " ".join(f"when {c} {'<=' if closed else '<'} {e} then '{label}'" for e, closed, label in edges[:-1]) + f" else '{edges[-1][2]}' end"


@R.query("q_rs_12", f"select row_id, {_sql_bin('maternal_age', cl.BINS['maternal_age'])} as age_bin, {_sql_bin('gest_age_del', cl.BINS['gest_age_del'])} as ga_bin, {_sql_bin('birthweight', cl.BINS['birthweight'])} as weight_bin, {_sql_bin('apgar_1::double', cl.BINS['apgar'])} as apgar_1, {_sql_bin('try_cast(prepregnancy_bmi_self_or_record as double)', cl.BINS['bmi'])} as bmi_bin, case when parity is null then null when parity = 0 then 'Nulliparity (0)' when parity between 1 and 3 then 'Low Multiparity (1-3)' else 'Grand Multiparity (4+)' end as parity, case when gravida is null then null when gravida = 0 then 'Nulligravidity (0)' when gravida between 1 and 5 then 'Low Multigravidity (1-5)' else 'Grand Multigravidity (>=6)' end as gravida, case when nicu_days is null or isnan(nicu_days) then null when nicu_days = 0 then '0' when nicu_days between 1 and 7 then '1-7' else '8+' end as nicu from {C}")
def _(t):
    b = lambda c, k: cl.binned(F.col(c), cl.BINS[k])
    return t(C).select("row_id", b("maternal_age", "maternal_age").alias("age_bin"), b("gest_age_del", "gest_age_del").alias("ga_bin"), b("birthweight", "birthweight").alias("weight_bin"), b("apgar_1", "apgar").alias("apgar_1"),
                       cl.binned(F.col("prepregnancy_bmi_self_or_record").try_cast("double"), cl.BINS["bmi"]).alias("bmi_bin"), cl.counted_bin(F.col("parity"), "Nulliparity (0)", "Low Multiparity (1-3)", 3, "Grand Multiparity (4+)").alias("parity"),
                       cl.counted_bin(F.col("gravida"), "Nulligravidity (0)", "Low Multigravidity (1-5)", 5, "Grand Multigravidity (>=6)").alias("gravida"), cl.counted_bin(_num("nicu_days"), "0", "1-7", 7, "8+").alias("nicu"))


@R.query("q_rs_13", f"select row_id, case when maternal_age is null or isnan(maternal_age) or maternal_age <= 18 then null when maternal_age <= 25 then '18-24' when maternal_age <= 30 then '25-29' when maternal_age <= 35 then '30-34' when maternal_age <= 1000 then '35+' end as age_cut from {C}")
def _(t):
    return t(C).select("row_id", cl.cut_right(_num("maternal_age"), [18, 25, 30, 35, 1000], ["18-24", "25-29", "30-34", "35+"]).alias("age_cut"))


@R.query("q_rs_14", f"select case when group_label = 'Control' then 'Control' else 'Complication' end as pooled, count(*) as n from {C} group by 1")
def _(t):
    return t(C).groupBy(cl.pooled(F.col("group_label")).alias("pooled")).agg(F.count(F.lit(1)).alias("n"))


@R.query("q_tr_03", f"select row_id, round(coalesce(case when not isnan(maternal_age) then maternal_age end, (select median(maternal_age) from {C} where not isnan(maternal_age))), 6) as age from {C}")
def _(t):
    """Median imputation with the exact median, read once."""
    x = t(C).select("row_id", _num("maternal_age").alias("age"))
    return rel.with_totals(x, {"m": F.median("age")}).select("row_id", F.round(F.coalesce("age", "m"), 6).alias("age"))


@R.query("q_tr_25", f"select row_id, upper(substr(race, 1, 1)) || lower(substr(race, 2)) as race from {V} where race is not null and length(race) > 0")
def _(t):
    return t(V).where("race is not null and length(race) > 0").select("row_id", F.concat(F.upper(F.substring("race", 1, 1)), F.lower(F.substring("race", 2, 1000))).alias("race"))


@R.query("q_jn_02", f"select c.row_id as c_row, p.row_id as p_row, v.row_id as v_row from {C} c join {P} p on c.id = p.id join {V} v on c.id = v.id")
def _(t):
    row = lambda n, a: t(n).select("id", F.col("row_id").alias(a))
    return rel.join_all([row(C, "c_row"), row(P, "p_row"), row(V, "v_row")], "id", "inner").drop("id")


@R.query("q_jn_03", f"select id, max(a) as n_clinical, max(b) as n_placental, max(c) as n_typed from (select id, count(*) as a, null as b, null as c from {C} where id is not null group by 1 union all select id, null, count(*), null from {P} where id is not null group by 1 union all select id, null, null, count(*) from {V} where id is not null group by 1) group by 1")
def _(t):
    n = lambda x, a: t(x).where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias(a))
    return rel.join_all([n(C, "n_clinical"), n(P, "n_placental"), n(V, "n_typed")], "id")


@R.query("q_jn_04", f"select c.row_id, p.n as n_slides, v.h as height from {C} c left join (select id, count(*) as n from {P} group by 1) p on c.id = p.id left join (select id, max(height_cm) as h from {V} where not isnan(height_cm) group by 1) v on c.id = v.id")
def _(t):
    p = t(P).groupBy("id").agg(F.count(F.lit(1)).alias("n_slides"))
    v = t(V).where(~F.isnan("height_cm")).groupBy("id").agg(F.max("height_cm").alias("height"))
    return t(C).select("row_id", "id").join(p, "id", "left").join(v, "id", "left").drop("id")


@R.query("q_jn_05", f"select c.row_id, coalesce(try_cast(c.prepregnancy_bmi_self_or_record as double), g.x) as bmi from {C} c left join (select group_label, round(median(try_cast(prepregnancy_bmi_self_or_record as double)), 6) as x from {C} where not isnan(try_cast(prepregnancy_bmi_self_or_record as double)) group by 1) g on c.group_label = g.group_label where not coalesce(isnan(try_cast(c.prepregnancy_bmi_self_or_record as double)), false)")
def _(t):
    x = t(C).select("row_id", "group_label", F.col("prepregnancy_bmi_self_or_record").try_cast("double").alias("bmi")).where(~F.coalesce(F.isnan("bmi"), F.lit(False)))
    g = x.groupBy("group_label").agg(F.round(F.median("bmi"), 6).alias("g_bmi"))
    return x.join(g, "group_label", "left").select("row_id", F.coalesce("bmi", "g_bmi").alias("bmi"))


@R.query("q_jn_08", f"select row_id from {C} where id in (select id from cohort_registry)")
def _(t):
    return t(C).join(t("cohort_registry").select("id"), "id", "left_semi").select("row_id")


@R.query("q_jn_09", f"select row_id from {C} c where not exists (select 1 from cohort_registry r where r.id = c.id)")
def _(t):
    return t(C).join(t("cohort_registry").select("id"), "id", "left_anti").select("row_id")


@R.query("q_jn_10", f"with m as (select id, max({_SPTB.replace('v.labor_onset', 'null')}) as s from {C} c group by 1) select p.row_id, coalesce(s, 0) as sptb from {P} p left join m on p.id = m.id")
def _(t):
    m = t(C).groupBy("id").agg(F.max(cl.spontaneous_preterm(F.col("group_label"), F.col("subgroup"), F.lit(None).cast("string"), F.col("gest_age_del"))).alias("sptb"))
    return t(P).select("row_id", "id").join(m, "id", "left").select("row_id", F.coalesce("sptb", F.lit(0)).alias("sptb"))


@R.query("q_jn_11", f"with a as (select id, row_id, row_number() over (partition by id order by loaded_at, row_id) - 1 as occurrence from {C}), b as (select id, row_id, row_number() over (partition by id order by loaded_at, row_id) - 1 as occurrence from {P}) select a.row_id as a_row, b.row_id as b_row, a.occurrence from a join b on a.id = b.id and a.occurrence = b.occurrence")
def _(t):
    a = t(C).select("id", F.col("row_id").alias("a_row"), F.col("loaded_at").alias("a_at"))
    b = t(P).select("id", F.col("row_id").alias("b_row"), F.col("loaded_at").alias("b_at"))
    return rel.pair_by_occurrence(a, b, ["id"], ["a_at", "a_row"], ["b_at", "b_row"]).select("a_row", "b_row", "occurrence")


@R.query("q_ag_01", f"select group_label, count(*) as n from {C} group by 1")
def _(t):
    return t(C).groupBy("group_label").agg(F.count(F.lit(1)).alias("n"))


@R.query("q_ag_03", f"select id, arg_min(group_label, row_id) filter (where group_label is not null) as first_group from {C} group by 1")
def _(t):
    return t(C).groupBy("id").agg(F.min_by("group_label", F.when(F.col("group_label").isNotNull(), F.col("row_id"))).alias("first_group"))


@R.query("q_ag_13", f"select id, round(median(case when not isnan(birthweight) then birthweight end), 6) as weight, arg_min(subgroup, row_id) as subgroup from {C} group by 1")
def _(t):
    return t(C).groupBy("id").agg(F.round(F.median(_num("birthweight")), 6).alias("weight"), F.min_by("subgroup", "row_id").alias("subgroup"))


@R.query("q_ag_14", f"select id, round(avg(case when not isnan(gest_age_del) then gest_age_del end), 6) as ga, round(avg(apgar_1), 6) as apgar_1, arg_min(group_label, row_id) as first_label from {C} group by 1")
def _(t):
    return t(C).groupBy("id").agg(F.round(F.avg(_num("gest_age_del")), 6).alias("ga"), F.round(F.avg("apgar_1"), 6).alias("apgar_1"), F.min_by("group_label", "row_id").alias("first_label"))


@R.query("q_ag_18", f"select diabetes, chtn, count(*) as n from {C} group by 1, 2")
def _(t):
    return t(C).groupBy("diabetes", "chtn").agg(F.count(F.lit(1)).alias("n"))


@R.query("q_ag_19", "select group_label, count(*) filter (where sample_id like '%A') as a, count(*) filter (where sample_id like '%B') as b, count(*) filter (where sample_id like '%C') as c from sample_metadata group by 1")
def _(t):
    x = t("sample_metadata").select("group_label", F.lower(F.when(F.substring("sample_id", -1, 1).isin("A", "B", "C"), F.substring("sample_id", -1, 1))).alias("tp"))
    return x.groupBy("group_label").pivot("tp", ["a", "b", "c"]).count().na.fill(0, ["a", "b", "c"])


@R.query("q_ag_22", f"select lower(trim(race)) as race, lower(trim(ethnicity)) as ethnicity, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as pct from {V} group by 1, 2")
def _(t):
    x = t(V).groupBy(F.lower(F.trim("race")).alias("race"), F.lower(F.trim("ethnicity")).alias("ethnicity")).agg(F.count(F.lit(1)).alias("n"))
    return rel.with_totals(x, {"total": F.sum("n")}).select("race", "ethnicity", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("pct"))


@R.query("q_ag_23", f"select f as field, count(*) as n, string_agg(row_id::varchar, ' ' order by row_id) as row_ids from (select row_id, unnest(['race', 'smoking', 'status']) as f, unnest([race, smoking, status]) as v from {V}) where v is null group by 1")
def _(t):
    x = t(V).unpivot(["row_id"], ["race", "smoking", "status"], "field", "v").where("v is null")
    return x.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("row_id")), lambda i: i.cast("string")), " ").alias("row_ids"))


@R.query("q_hp_01", f"select row_id, case when gravida = 1 then null else parity end as parity from {C}")
def _(t):
    return t(C).select("row_id", F.when(~F.coalesce(F.col("gravida") == 1, F.lit(False)), F.col("parity")).alias("parity"))


@R.query("q_hp_04", "select row_id, case when lower(trim(group_label)) = 'sptb' then 'sPTB' when lower(trim(group_label)) in ('fgr', 'hdp') then upper(trim(group_label)) when lower(trim(group_label)) in ('control', 'ctl', 'cntrl') then 'Control' else group_label end as g from sample_metadata")
def _(t):
    g = F.lower(F.trim("group_label"))
    return t("sample_metadata").select("row_id", F.when(g == "sptb", "sPTB").when(g.isin("fgr", "hdp"), F.upper(F.trim("group_label"))).when(g.isin("control", "ctl", "cntrl"), "Control").otherwise(F.col("group_label")).alias("g"))


@R.query("q_hp_05", "select row_id, regexp_replace(sample_id, '\\s+', '', 'g') as sample_id from sample_metadata")
def _(t):
    return t("sample_metadata").select("row_id", F.regexp_replace("sample_id", r"\s+", "").alias("sample_id"))


@R.query("q_hp_10", "select group_label, case when subgroup in ('PTL', 'PPROM', 'FGR early') then subgroup else coalesce(group_label, '') end as label, count(*) as n from sample_metadata group by 1, 2")
def _(t):
    x = t("sample_metadata").withColumn("label", F.when(F.col("subgroup").isin("PTL", "PPROM", "FGR early"), F.col("subgroup")).otherwise(F.coalesce("group_label", F.lit(""))))
    return x.groupBy("group_label", "label").agg(F.count(F.lit(1)).alias("n"))


@R.query("q_src_11", "select * exclude (n) from (select trim(sample_id) as sample_id, regexp_replace(trim(group_label), '\\s+', ' ', 'g') as group_label, batch, row_number() over (partition by trim(sample_id) order by row_id) as n from sample_metadata) where n = 1")
def _(t):
    """Metadata with trimmed ids, blanks squeezed, first row of each sample."""
    x = t("sample_metadata").select("row_id", F.trim("sample_id").alias("sample_id"), F.regexp_replace(F.trim("group_label"), r"\s+", " ").alias("group_label"), "batch")
    return rel.first_by(x, ["sample_id"], ["row_id"]).drop("row_id")


@R.query("q_src_13", "with a as (select distinct sample_id, sample_id as key from sample_metadata where sample_id is not null), b as (select distinct metadata_canonical_id as key, sample_id from sample_metadata where metadata_canonical_id is not null and sample_id is not null) select key, sample_id from a union all select key, sample_id from b where key not in (select key from a)")
def _(t):
    """Sample names and, beyond them, aliases that are no sample's own name."""
    m = t("sample_metadata").where("sample_id is not null")
    own = m.select(F.col("sample_id").alias("key"), "sample_id").distinct()
    alias = m.where("metadata_canonical_id is not null").select(F.col("metadata_canonical_id").alias("key"), "sample_id").distinct()
    return own.unionByName(alias.join(own.select("key"), "key", "left_anti"))


@R.query("q_src_14", "select distinct on (id) id, group_label from cohort_registry where group_label in ('Control', 'FGR', 'HDP', 'sPTB') and id <> 'id' order by id, registry_id")
def _(t):
    x = t("cohort_registry").where(F.col("group_label").isin("Control", "FGR", "HDP", "sPTB") & (F.col("id") != "id"))
    return rel.first_by(x, ["id"], ["registry_id"]).select("id", "group_label")


@R.query("q_set_01", f"select row_id, id, birthweight, null as slide_a from (select row_id, id, case when not isnan(birthweight) then birthweight end as birthweight from {C}) union all select row_id, id, null, slide_a from {P}")
def _(t):
    return rel.union_aligned([t(C).select("row_id", "id", _num("birthweight").alias("birthweight")), t(P).select("row_id", "id", "slide_a")])


@R.query("q_set_02", f"select id from {C} union select id from {P}")
def _(t):
    return t(C).select("id").union(t(P).select("id")).distinct()


@R.query("q_set_03", f"select id from {C} intersect select id from {P}")
def _(t):
    return t(C).select("id").intersect(t(P).select("id"))


@R.query("q_set_04", f"select id from {C} except select id from {P}")
def _(t):
    return t(C).select("id").subtract(t(P).select("id"))


@R.query("q_set_05", f"select coalesce(a.row_id, b.row_id) as row_id, a.gravida, b.slide_a from {C} a full join {P} b on a.row_id = b.row_id")
def _(t):
    return t(C).select("row_id", "gravida").join(t(P).select("row_id", "slide_a"), "row_id", "full")


@R.query("q_snk_10", "with a as (select upper(trim(sample_id)) as k, string_agg(distinct batch, ',' order by batch) as batches, count(*) as n from sample_metadata where sample_id is not null group by 1), b as (select upper(trim(sample_id)) as k, count(*) as n_readings from olink_long where sample_id is not null group by 1) select coalesce(a.k, b.k) as sample, case when a.k is null then 'missing' when b.k is null then 'unread' else 'both' end as state, batches, coalesce(n_readings, 0) as n_readings from a full join b on a.k = b.k")
def _(t):
    k = F.upper(F.trim("sample_id")).alias("k")
    a = t("sample_metadata").where("sample_id is not null").groupBy(k).agg(F.when(F.count("batch") > 0, F.array_join(F.array_sort(F.collect_set("batch")), ",")).alias("batches"), F.lit(1).alias("a"))
    b = t("olink_long").where("sample_id is not null").groupBy(k).agg(F.count(F.lit(1)).alias("n_readings"), F.lit(1).alias("b"))
    return a.join(b, "k", "full").select(F.col("k").alias("sample"), F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "unread").otherwise("both").alias("state"), "batches", F.coalesce("n_readings", F.lit(0)).alias("n_readings"))


@R.query("q_tk_10", "select lab_code, arg_min(load_id, loaded_at) as first_load from (select lab_code, load_id, min(loaded_at) as loaded_at from olink_long group by 1, 2) group by 1")
def _(t):
    return t("olink_long").groupBy("lab_code", "load_id").agg(F.min("loaded_at").alias("at")).groupBy("lab_code").agg(F.min_by("load_id", "at").alias("first_load"))


@R.query("q_wn_03", f"select row_id, row_number() over (partition by id order by row_id) - 1 as occurrence from {C}")
def _(t):
    return t(C).select("row_id", (F.row_number().over(Window.partitionBy("id").orderBy("row_id")) - 1).cast("long").alias("occurrence"))


@R.query("q_wn_04", f"select row_id from (select row_id, row_number() over (partition by id order by loaded_at, row_id) as n from {C}) where n = 1")
def _(t):
    return rel.first_by(t(C), ["id"], ["loaded_at", "row_id"]).select("row_id")


@R.query("q_wn_09", "select row_id, case when n > 1 then assay || '__' || n else assay end as name from (select row_id, assay, row_number() over (partition by load_id, sample_id, assay order by row_id) as n from olink_long)")
def _(t):
    n = F.row_number().over(Window.partitionBy("load_id", "sample_id", "assay").orderBy("row_id"))
    return t("olink_long").select("row_id", "assay", n.alias("n")).select("row_id", F.when(F.col("n") > 1, F.concat_ws("__", "assay", F.col("n").cast("string"))).otherwise(F.col("assay")).alias("name"))


@R.query("q_wn_10", f"select row_id, case when lag(group_label) over (order by group_label nulls last, row_id) = group_label then '' else group_label end as shown from {C} where group_label is not null")
def _(t):
    """Blank a repeated label; the first row of each label is found per label, not in one sorted task."""
    x = t(C).where("group_label is not null")
    first = x.groupBy("group_label").agg(F.min("row_id").alias("first_row"))
    return x.join(first, "group_label").select("row_id", F.when(F.col("row_id") == F.col("first_row"), F.col("group_label")).otherwise("").alias("shown"))


QUERIES, SQL = R.queries, R.sql
