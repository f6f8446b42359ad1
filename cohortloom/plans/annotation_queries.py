"""Queries of feature annotation, result filters, design matrices, drivers over timepoints, and what reports are made of.

Results of tests are stood in for by the part table: one row per feature and library (brand), with a p value spread
by a fixed rule; further measurements are those of omics_queries.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortloom.operators import annotation as an
from cohortloom.operators import dedup, design, ranks
from cohortloom.operators import modelling as ml
from cohortloom.operators import normalize as nz
from cohortloom.operators import relational as rel
from cohortloom.plans.omics_queries import M_SQL, S_SQL, measured, per_sample, r6
from cohortloom.plans.registry import Register
from cohortloom.plans.stats_queries import _U
from cohortloom.sources import readers

R = Register()


def q(name, sql):
    return R.query(name, f"with {sql}")


def one(name, sql):
    return R.query(name, sql)


# ---- results of tests

_RES = """p as (select p_partkey, p_brand, power((p_partkey * 7919 % 1000 + 1) / 1000.0, 4) as p, (p_size - 25) / 10.0 as log2fc, p_partkey % 11 = 0 as excluded from part),
i as (select *, row_number() over (partition by p_brand order by p, p_partkey) as i, count(*) over (partition by p_brand) as m from p),
res as (select p_partkey, p_brand, p, log2fc, excluded, least(1, min(p * m / i) over (partition by p_brand order by i desc rows unbounded preceding)) as q_value from i)"""


def results(t):
    x = t("part").select("p_partkey", "p_brand", F.pow((F.col("p_partkey") * 7919 % 1000 + 1) / 1000.0, F.lit(4)).alias("p"), ((F.col("p_size") - 25) / 10.0).alias("log2fc"), (F.col("p_partkey") % 11 == 0).alias("excluded"))
    return ranks.adjust_bh(x, ["p_brand"], "p", ["p_partkey"])


@q("q_flt_31", _RES + " select p_partkey, p_brand from res where q_value < 0.05 and not excluded")
def _(t):
    return an.significant(results(t)).select("p_partkey", "p_brand")


@q("q_hp_14", _RES + " select p_brand, count(*) filter (where q_value < 0.05 and not excluded) as n_q_only, count(*) filter (where q_value < 0.05 and not excluded and abs(log2fc) >= 0.5849625007211562) as n_full from res group by 1 having count(*) filter (where q_value < 0.05 and not excluded) > 0")
def _(t):
    """Significant features per timepoint (here the brand), by q alone and by the whole rule."""
    r = results(t)
    a = an.significant(r).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_q_only"))
    b = an.significant(r, log2fc=0.5849625007211562).groupBy(F.col("p_brand").alias("_b")).agg(F.count(F.lit(1)).alias("n_full"))
    return a.join(b, F.col("p_brand") == F.col("_b"), "left").select("p_brand", "n_q_only", F.coalesce("n_full", F.lit(0)).alias("n_full"))


@q("q_tk_04", _RES + ", k as (select *, row_number() over (partition by p_brand order by p, p_partkey) as n from res) select p_brand, p_partkey, round(q_value, 6) as q_value from k where n <= 50")
def _(t):
    """The fifty best of each list; adjusted over the whole list before it is cut."""
    return ml.top_by(results(t), ["p_brand"], [F.col("p"), F.col("p_partkey")], 50).select("p_brand", "p_partkey", r6("q_value").alias("q_value"))


@q("q_tr_23", _RES + " select p_partkey, case when q_value < 0.0001 then '****' when q_value < 0.001 then '***' when q_value < 0.01 then '**' when q_value < 0.05 then '*' else '' end as mark from res")
def _(t):
    return results(t).select("p_partkey", an.stars(F.col("q_value")).alias("mark"))


_TERM = "case p_partkey % 4 when 0 then 'REACTOME_' || upper(replace(p_name, ' ', '_')) when 1 then p_name || ' (GO:' || p_partkey || ')' when 2 then 'WP_' || replace(p_name, ' ', '_') || '_' || repeat('pathway_', 6) else p_name end"
_LIB = "case p_size % 4 when 0 then 'GO_Biological_Process_2025' when 1 then 'KEGG_2026' when 2 then 'Reactome_Pathways_2024' else p_brand end"


def terms(t):
    k = F.col("p_partkey")
    flat = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    term = F.when(k % 4 == 0, F.concat(F.lit("REACTOME_"), F.upper(flat))).when(k % 4 == 1, F.concat("p_name", F.lit(" (GO:"), k.cast("string"), F.lit(")"))).when(k % 4 == 2, F.concat(F.lit("WP_"), flat, F.lit("_"), F.lit("pathway_" * 6))).otherwise(F.col("p_name"))
    s = F.col("p_size") % 4
    lib = F.when(s == 0, "GO_Biological_Process_2025").when(s == 1, "KEGG_2026").when(s == 2, "Reactome_Pathways_2024").otherwise(F.col("p_brand"))
    return t("part").select("p_partkey", term.alias("term"), lib.alias("library"), "p_size")


_TITLE = "list_aggregate(list_transform(string_split(replace({0}, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ')"


@q("q_tr_20", f"x as (select p_partkey, {_TERM} as t, {_LIB} as l from part), c as (select p_partkey, l, case when t like 'REACTOME_%' then {_TITLE.format('t[10:]')} when t like 'WP_%' then {_TITLE.format('t[4:]')} when t like '% (%' then regexp_replace(t, ' \\([^(]*$', '') else t end as t from x) select p_partkey, case when length(t) > 55 then t[:54] || '…' else t end as label, case l when 'GO_Biological_Process_2025' then 'GO:BP' when 'KEGG_2026' then 'KEGG' when 'Reactome_Pathways_2024' then 'Reactome' else l end as library from c")
def _(t):
    return terms(t).select("p_partkey", an.term_label(F.col("term")).alias("label"), an.library_name(F.col("library")).alias("library"))


@q("q_hp_17", f"x as (select p_partkey, {_LIB} as l, p_size from part), s as (select case l when 'GO_Biological_Process_2025' then 'GO:BP' when 'KEGG_2026' then 'KEGG' when 'Reactome_Pathways_2024' then 'Reactome' else l end as library, p_size from x) select library, count(*) as n_terms, sum((p_size < 10)::int)::bigint as n_hits from s where library in ('GO:BP', 'KEGG', 'Reactome') group by 1")
def _(t):
    """Terms and hits per known gene-set library."""
    x = terms(t).where(F.col("library").isin(*an.LIBRARIES))
    return x.groupBy(an.library_name(F.col("library")).alias("library")).agg(F.count(F.lit(1)).alias("n_terms"), F.count_if(F.col("p_size") < 10).alias("n_hits"))


# ---- names, compounds, pathways


def _listed(t):
    """A list of names with ids: names of parts over a size, ids by key."""
    return t("part").where("p_size > 15").select(F.col("p_name").alias("listed_name"), F.concat(F.lit("C"), F.lpad(F.col("p_partkey").cast("string"), 5, "0")).alias("id"), F.col("p_partkey").alias("rank"))


_LISTED = "l as (select lower(p_name) as n, arg_min('C' || lpad(p_partkey::varchar, 5, '0'), p_partkey) as id from part where p_size > 15 group by 1)"


@q("q_src_18", _LISTED + ", a as (select distinct case when p_partkey % 2 = 0 then 'L-' || p_name else p_name end as name from part) select name, coalesce(x.id, y.id) as id from a left join l x on lower(a.name) = x.n left join l y on regexp_replace(lower(a.name), '^(d|l)-', '') = y.n")
def _(t):
    """Names looked up in an edge table, each once, else by their simplified form."""
    names = t("part").select(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("L-"), "p_name")).otherwise(F.col("p_name")).alias("name"))
    return an.looked_up(names, "name", _listed(t), lambda c: F.regexp_replace(F.lower(c), "^(d|l)-", ""))


@q("q_hp_13", _LISTED + ", e as (select distinct 'C' || lpad(p_partkey::varchar, 5, '0') as id, 'map' || lpad((p_size * 250)::varchar, 5, '0') as pathway from part where p_size > 15), n as (select distinct p_name from part) select e.pathway, 'Pathway ' || (e.pathway[4:]::int) as pathway_name, count(distinct n.p_name) as n_names, count(distinct l.id) as n_compounds from n join l on lower(n.p_name) = l.n join e on l.id = e.id where e.pathway[4:]::int < 9000 group by 1, 2")
def _(t):
    """Names to compounds to pathways, pathway names cleaned, large pathway numbers left out."""
    number = F.regexp_extract("pathway", "([0-9]+)$", 1).cast("int")
    edges = t("part").where("p_size > 15").select(F.concat(F.lit("C"), F.lpad(F.col("p_partkey").cast("string"), 5, "0")).alias("id"), F.concat(F.lit("map"), F.lpad((F.col("p_size") * 250).cast("string"), 5, "0")).alias("pathway")).distinct()
    ids = an.looked_up(t("part").select("p_name"), "p_name", _listed(t), F.lower).where("id is not null")
    raw = F.concat(F.lit("Pathway "), number.cast("string"), F.lit(" - Homo sapiens (human)"))
    return ids.join(edges, "id").where(number < 9000).groupBy("pathway", F.regexp_replace(raw, r"\s*-\s*Homo sapiens.*$", "").alias("pathway_name")).agg(F.countDistinct("p_name").alias("n_names"), F.countDistinct("id").alias("n_compounds"))


# ---- feature metadata

_SAYS = "case {} % 4 when 0 then 'Full match' when 1 then 'Not the top hit' when 2 then 'Partial match' end"


def _feature_table(t):
    says = lambda c: F.when(c % 4 == 0, "Full match").when(c % 4 == 1, "Not the top hit").when(c % 4 == 2, "Partial match")
    k, s = F.col("p_partkey"), F.col("p_size")
    return t("part").select("p_partkey", F.when(k % 5 == 0, "Not named").when(k % 7 != 0, F.col("p_name")).alias("Name"), says(k).alias("Annot. Source: mzCloud Search"), says(s).alias("Annot. Source: MassList Search"), says(k + s).alias("Annot. Source: ChemSpider Search"),
                            F.when(k % 9 != 0, F.col("p_retailprice").cast("string")).otherwise("n/a").alias("m/z"), (s / 2.0).alias("RT [min]"))


@q("q_hp_07", f"x as (select p_partkey, case when p_partkey % 5 = 0 then 'Not named' when p_partkey % 7 <> 0 then p_name else '' end as n, [{_SAYS.format('p_partkey')}, {_SAYS.format('p_size')}, {_SAYS.format('(p_partkey + p_size)')}] as a, case when p_partkey % 9 <> 0 then round(p_retailprice, 4) end as mz, p_size / 2.0 as rt from part) select p_partkey::varchar as feature, n as annotation_name, n as compound_group_name, len(list_filter(a, lambda y: y = 'Full match'))::int as full_matches, len(list_filter(a, lambda y: y = 'Not the top hit'))::int as not_top, len(list_filter(a, lambda y: y = 'Partial match'))::int as partial, mz, rt::double as rt, lower(n) not in ('', 'not named') as is_named from x")
def _(t):
    m = an.feature_metadata(_feature_table(t), "p_partkey", "POS")
    return m.select("feature", "annotation_name", "compound_group_name", F.col("annotation_source_matches").alias("full_matches"), F.col("annotation_not_top_hit").alias("not_top"), F.col("annotation_partial_matches").alias("partial"), F.round("mz", 4).alias("mz"), "rt", "is_named")


@q("q_hp_07_lipid", "x as (select p_partkey, p_name || case when p_partkey % 2 = 0 then '+H' else '' end as n, p_partkey % 2 = 0 as ion, p_retailprice as mz from part) select p_partkey::varchar as feature, n as annotation_name, case when ion then regexp_replace(n, '([+-].+)$', '') else n end as compound_group_name, round(mz, 4) as mz, 0 as matches from x")
def _(t):
    """The lipid dialect: the adduct leaves the compound's name."""
    even = F.col("p_partkey") % 2 == 0
    x = t("part").select("p_partkey", F.concat("p_name", F.when(even, "+H").otherwise("")).alias("LipidID"), F.when(even, "M+H").alias("AdductIon"), F.col("p_retailprice").alias("CalcMz"))
    return an.feature_metadata(x, "p_partkey", "POS").select("feature", "annotation_name", "compound_group_name", F.round("mz", 4).alias("mz"), F.col("annotation_source_matches").alias("matches"))


@one("q_src_17", "select p_type as \"Type\", p_name as \"Name\", p_retailprice as \"Delta_m/z\", p_brand as \"Description\" from part")
def _(t):
    """A list of modifications with its required columns."""
    x = t("part").select(F.col("p_brand").alias("Description"), F.col("p_type").alias("Type"), F.col("p_name").alias("Name"), F.col("p_retailprice").alias("Delta_m/z"), "p_size")
    return an.required(x)


@one("q_src_10", "with f as (select feature, row_number() over (order by feature) as i from (select distinct event_type as feature from events)), s as (select subject, row_number() over (order by subject) as j from (select distinct user_id as subject from events)) select f.feature, s.subject, round(avg(e.value), 6) as area from events e join f on e.event_type = f.feature join s on e.user_id = s.subject group by 1, 2")
def _(t):
    """Areas by row and column number with the labels of both, joined by position after the lengths are compared."""
    e = t("events")
    numbered = lambda c, n: e.select(F.col(c).alias(n)).distinct().withColumn("_at", F.row_number().over(Window.orderBy(n)))  # noqa: E731  # labels of a file
    f, s = numbered("event_type", "feature"), numbered("user_id", "subject")
    areas = e.groupBy("event_type", "user_id").agg(F.avg("value").alias("area")).join(f.withColumnRenamed("_at", "row_no"), F.col("event_type") == F.col("feature")).join(s.withColumnRenamed("_at", "column_no"), F.col("user_id") == F.col("subject")).select("row_no", "column_no", "area")
    return readers.bundle(areas, f.withColumnRenamed("_at", "row_no"), s.withColumnRenamed("_at", "column_no"), "row_no", "column_no").select("feature", "subject", r6("area").alias("area"))


# ---- projections and joins by position


@one("q_prj_03", "select r_regionkey, r_name from (select *, row_number() over (order by r_regionkey) as n, count(*) over () as c from region) where n > 1 or c = 1")
def _(t):
    return readers.without_first(t("region").select("r_regionkey", "r_name"), "r_regionkey")


@one("q_prj_07", "select l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_partkey, l_suppkey from lineitem")
def _(t):
    """Numeric columns of a prefix."""
    x = t("lineitem")
    return x.select(*readers.columns_like(x, ("l_",), numeric=True))


@one("q_prj_08", "select p_partkey, upper(p_name) as upper_name, p_size from part")
def _(t):
    return readers.insert_after(t("part").select("p_partkey", "p_size"), "p_partkey", "upper_name", F.lit(None).cast("string")).drop("upper_name").join(t("part").select("p_partkey", F.upper("p_name").alias("upper_name")), "p_partkey").select("p_partkey", "upper_name", "p_size")


@one("q_prj_09", "select n_nationkey, n_name from nation")
def _(t):
    return readers.drop_unnamed(t("nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("Unnamed: 0"), F.lit(1).alias("unnamed_1")))


@q("q_jn_07", S_SQL + ", g as (select sample, max(value) as v from s where feature = 'click' and grp = 0 group by 1), w as (select distinct sample from s) select w.sample, round(g.v, 6) as v from w left join g on w.sample = g.sample")
def _(t):
    """One table's rows in the other's index; absent ones are null."""
    s = per_sample(t)
    g = s.where("feature = 'click' and grp = 0").groupBy("sample").agg(F.max("value").alias("v"))
    return rel.reindexed(g, s.select("sample").distinct(), "sample").select("sample", r6("v").alias("v"))


@q("q_jn_15", S_SQL + ", w as (select sample, max(value) filter (where feature = 'click') as click, max(value) filter (where feature = 'view') as view from s group by 1), d as (select distinct sample, grp from s where tp <> 'E') select w.sample, grp, round(click, 6) as click, round(view, 6) as view from w join d on w.sample = d.sample")
def _(t):
    """Metadata joined to the wide table by sample."""
    s = per_sample(t)
    w = s.groupBy("sample").pivot("feature", ["click", "view"]).agg(F.max("value"))
    return w.join(s.where("tp <> 'E'").select("sample", "grp").distinct(), "sample").select("sample", "grp", r6("click").alias("click"), r6("view").alias("view"))


@one("q_hp_06", "select row_id, k as field, try_cast(replace(trim(v), ',', '.') as double) as value from (select row_id, unnest(['npx', 'panel', 'lab']) as k, unnest([npx, panel, lab_code]) as v from olink_long) where try_cast(replace(trim(v), ',', '.') as double) is not null and not isnan(try_cast(replace(trim(v), ',', '.') as double)) and not isinf(try_cast(replace(trim(v), ',', '.') as double))")
def _(t):
    """Every cell of a matrix read as a number, in long form; what is none is left out."""
    x = t("olink_long").select("row_id", "npx", "panel", F.col("lab_code").alias("lab")).unpivot(["row_id"], ["npx", "panel", "lab"], "field", "v")
    number = F.replace(F.trim("v"), F.lit(","), F.lit(".")).try_cast("double")
    return x.select("row_id", "field", number.alias("value")).where("value is not null and not isnan(value) and abs(value) < 1e308")


# ---- design matrices, visits


_MED = "(select median({0}) from sample_metadata where {0} is not null and not isnan({0}))"


@one("q_rs_05", f"select row_id, (g = 'FGR')::int::double as g_fgr, (g = 'HDP')::int::double as g_hdp, (g = 'Unknown')::int::double as g_unknown, (g = 'sPTB')::int::double as g_sptb, round(coalesce(a, {_MED.format('sample_gest_age')}), 6) as age from (select row_id, coalesce(case lower(trim(group_label)) when 'control' then 'Control' when 'fgr' then 'FGR' when 'hdp' then 'HDP' when 'sptb' then 'sPTB' end, 'Unknown') as g, case when not isnan(sample_gest_age) then sample_gest_age end as a from sample_metadata)")
def _(t):
    """Indicators without the first level, medians for missing numbers; a column that repeats another leaves."""
    g = F.lower(F.trim("group_label"))
    label = F.when(g == "control", "Control").when(g == "fgr", "FGR").when(g == "hdp", "HDP").when(g == "sptb", "sPTB")
    age = F.when(~F.isnan("sample_gest_age"), F.col("sample_gest_age"))
    x, kept = design.covariates(t("sample_metadata").select("row_id", label.alias("g"), age.alias("age"), (2 * age).alias("twice")), "row_id", "g", ["age", "twice"])
    names = {"g_FGR": "g_fgr", "g_HDP": "g_hdp", "g_Unknown": "g_unknown", "g_sPTB": "g_sptb", "age": "age"}
    return x.select("row_id", *(F.round(c, 6).alias(names[c]) if c == "age" else F.col(c).alias(names[c]) for c in kept))


@one("q_rs_11", "with x as (select id, case when timepoint < 14 then 'a' when timepoint < 22 then 'b' else 'c' end as bucket, activities_summary_steps as s from (select id, activities_summary_steps, date_diff('day', date '2020-01-01', log_date) % 40 as timepoint from processed_fitbit_data)) select id, round(avg(s) filter (where bucket = 'a'), 4) as a_steps, round(avg(s) filter (where bucket = 'b'), 4) as b_steps, round(avg(s) filter (where bucket = 'c'), 4) as c_steps from x group by 1")
def _(t):
    """Metrics per bucket as columns named after it."""
    at = F.datediff(F.col("log_date"), F.lit("2020-01-01").cast("date")) % 40
    x = t("processed_fitbit_data").select("id", F.when(at < 14, "a").when(at < 22, "b").otherwise("c").alias("bucket"), "activities_summary_steps")
    return x.groupBy("id").agg(*(F.round(F.avg(F.when(F.col("bucket") == b, F.col("activities_summary_steps"))), 4).alias(f"{b}_steps") for b in "abc"))


@q("q_rs_19", S_SQL + " select subject || 'B' as sample_id, subject, max(grp) as grp, round(avg(value), 6) as value from s where tp = 'B' group by subject")
def _(t):
    return design.visit_matrix(per_sample(t), "subject", "tp", "B", ["grp"], ["value"]).select("sample_id", "subject", "grp", r6("value").alias("value"))


_HP15 = ("click", "view")


@q("q_hp_15", S_SQL + " select subject || tp as sample_id, tp, round(max(value) filter (where feature = 'click'), 6) as click, round(max(value) filter (where feature = 'view'), 6) as view from s where tp in ('A', 'B') group by subject, tp")
def _(t):
    """Two visits prepared for a model with a given list of features."""
    w = per_sample(t).groupBy("subject", "tp").pivot("feature", list(_HP15)).agg(F.max("value"))
    parts = [design.visit_matrix(w, "subject", "tp", v, ["tp"], list(_HP15)) for v in "AB"]
    return parts[0].unionByName(parts[1]).select("sample_id", "tp", *(r6(c).alias(c) for c in _HP15))


# ---- normalisation, tests


@q("q_tr_06", S_SQL + ", d as (select sample, feature, value from s where feature in ('click', 'error')), g as (select sample, exp(avg(ln(value)) filter (where value > 0)) as f from d group by 1), u as (select distinct sample, batch from s), x as (select u.sample, u.batch, g.f from u left join g on u.sample = g.sample), b as (select batch, median(f) as bf from x group by 1) select s.sample, s.feature, round(s.value / coalesce(d.value, x.f, b.bf, (select median(f) from x)), 6) as value, d.value is not null as matched from s join x on s.sample = x.sample left join b on x.batch = b.batch left join d on d.sample = s.sample and d.value > 0 and d.feature = case s.feature when 'view' then 'click' when 'purchase' then 'error' end where s.feature not in ('click', 'error')")
def _(t):
    """Values over the standard of their class, else the sample's pooled standards."""
    x = nz.by_class_standards(per_sample(t), "sample", "batch", "feature", "feature", "value", F.col("feature").isin("click", "error"), {"view": "click", "purchase": "error"})
    return x.select("sample", "feature", r6("value").alias("value"), "matched")


@q("q_tst_04", M_SQL + """, x as (select feature, tp, value as v from m where value is not null), z as (select feature, v, count(*)::double as l from x group by 1, 2), bb as (select *, sum(l) over (partition by feature order by v) - l / 2 as b, sum(l) over (partition by feature) as n from z),
s as (select feature, tp, count(*)::double as ni from x group by 1, 2), f as (select feature, tp, v, count(*)::double as f from x group by 1, 2, 3), g as (select bb.*, s.tp, s.ni, coalesce(f.f, 0) as f from bb join s on bb.feature = s.feature left join f on f.feature = bb.feature and f.tp = s.tp and f.v = bb.v),
h as (select *, sum(f) over (partition by feature, tp order by v) - f / 2 as mm from g), a as (select feature, tp, max(n) as n, sum(l / n * (n * mm - ni * b) ^ 2 / nullif(b * (n - b) - n * l / 4, 0)) / max(ni) as a from h group by 1, 2)
select feature, max(n)::bigint as n, count(*) as n_groups, round((max(n) - 1) / max(n) * sum(a), 6) as a2 from a group by 1""")
def _(t):
    return ranks.anderson_darling(measured(t), ["feature"], "value", "tp").select("feature", "n", "n_groups", r6("a2").alias("a2"))


@q("q_hp_16", M_SQL + _U.replace("partition by feature", "partition by feature, tp").replace("select feature, grp, value,", "select feature, tp, grp, value,").replace("u as (select feature, count", "u as (select feature, tp, count").replace("from k group by 1)", "from k group by 1, 2)") + " select tp, feature, n1, n2, round(u, 6) as u from z where n1 >= 5 and n2 >= 5")
def _(t):
    """The U test for every timepoint at once."""
    return ranks.mann_whitney(measured(t), ["tp", "feature"], "value", F.col("grp") == 1).where("u is not null").select("tp", "feature", "n1", "n2", r6("u").alias("u"))


@q("q_hp_09", M_SQL + """, k as (select feature, tp, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2 as rk, count(*) over (partition by feature, value) as c from m where value is not null), g as (select feature, tp, count(*)::double as n, sum(rk) as r from k group by 1, 2 having count(*) >= 5),
t as (select feature, sum(c * c - 1)::double as ties, count(*)::double as n from k group by 1), h as (select g.feature, 'kruskal' as test, '' as pair, (12.0 / (max(t.n) * (max(t.n) + 1)) * sum(r * r / g.n) - 3 * (max(t.n) + 1)) / (1 - max(ties) / (max(t.n) ^ 3 - max(t.n))) as statistic from g join t on g.feature = t.feature group by 1),
e as (select feature, value, unnest([['A', 'B'], ['B', 'C']]) as pr, tp from m where value is not null), e2 as (select feature, value, pr[1] || pr[2] as pair, tp = pr[1] as one from e where tp = pr[1] or tp = pr[2]), c as (select feature, pair, sum(one::int) over (partition by feature, pair order by value) / sum(one::int) over (partition by feature, pair) as a, sum((not one)::int) over (partition by feature, pair order by value) / sum((not one)::int) over (partition by feature, pair) as b from e2)
select feature, test, pair, round(statistic, 6) as statistic from h union all select feature, 'ks', pair, round(max(abs(a - b)), 6) from c group by feature, pair""")
def _(t):
    """Statistics of every feature: over all groups, and for pairs of them, in one table."""
    m = measured(t)
    out = ranks.kruskal(m, ["feature"], "value", "tp").select("feature", F.lit("kruskal").alias("test"), F.lit("").alias("pair"), F.col("h").alias("statistic"))
    for a, b in ("AB", "BC"):
        ks = ranks.kolmogorov(m.where(F.col("tp").isin(a, b)), ["feature"], "value", F.col("tp") == b)
        out = out.unionByName(ks.select("feature", F.lit("ks").alias("test"), F.lit(a + b).alias("pair"), F.col("d").alias("statistic")))
    return out.withColumn("statistic", r6("statistic"))


@q("q_hp_18", S_SQL + ", z as (select feature, grp, (value - avg(value) over (partition by feature)) / nullif(stddev_pop(value) over (partition by feature), 0) as z from s where value is not null) select feature, grp, round(greatest(-3, least(3, avg(z))), 6) as z, count(*) as n from z group by 1, 2")
def _(t):
    """Cells of a heat map: mean z per feature and group, cut at three."""
    s = per_sample(t).where("value is not null")
    f = s.groupBy("feature").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    z = s.join(f, "feature").withColumn("z", (F.col("value") - F.col("mu")) / F.nullif(F.col("sd"), F.lit(0.0)))
    return z.groupBy("feature", "grp").agg(r6(F.greatest(F.lit(-3.0), F.least(F.lit(3.0), F.avg("z")))).alias("z"), F.count(F.lit(1)).alias("n"))


@q("q_hp_22", S_SQL + ", d as (select a.feature, a.grp, b.tp || '_minus_' || a.tp as comparison, b.value - a.value as d, a.subject from s a join s b on a.subject = b.subject and a.feature = b.feature and ascii(b.tp) = ascii(a.tp) + 1 where a.value is not null and b.value is not null) select comparison, feature, grp, count(distinct subject) as n_subjects, round(median(d), 6) as middle from d group by 1, 2, 3 having count(distinct subject) >= 2")
def _(t):
    """Changes between neighbouring timepoints per group, where two or more subjects have both."""
    s = per_sample(t)
    d = rel.adjacent_deltas(s, "subject", "feature", "tp", "value").where("delta is not null").join(s.select("subject", "grp").distinct(), "subject")
    return d.groupBy("comparison", "feature", "grp").agg(F.countDistinct("subject").alias("n_subjects"), r6(F.median("delta")).alias("middle")).where("n_subjects >= 2")


@R.query("q_tst_20")
def _(t):
    """Features in the order of a Ward tree over their means per timepoint; tests hold it against brute force."""
    x = measured(t).groupBy("feature", "tp").agg(F.avg("value").alias("v"))
    return design.leaf_order(x, "feature", "tp", "v")


# ---- reports, plots' data, registry


@q("q_snk_08", M_SQL + ", e as (select feature, min(value) as lo, max(value) as hi from m where value is not null group by 1), b as (select m.feature, least(9, floor((value - lo) / nullif(hi - lo, 0) * 10))::int as bin from m join e on m.feature = e.feature where value is not null) select feature, coalesce(bin, 0) as bin, count(*) as n from b group by 1, 2")
def _(t):
    """Counts of a histogram of ten bins per feature."""
    m = measured(t).where("value is not null")
    e = m.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    place = F.least(F.lit(9), F.floor((F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * 10)).cast("int")
    return m.join(e, "feature").groupBy("feature", F.coalesce(F.when(F.col("hi") > F.col("lo"), place), F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@one("q_hp_19", "select rpad('group ' || coalesce(group_label, 'none'), 30, '.') || lpad(n::varchar, 8, ' ') as line from (select group_label, count(*) as n from processed_clinical_data group by 1)")
def _(t):
    """Log lines of counts per group."""
    n = t("processed_clinical_data").groupBy("group_label").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.concat(F.rpad(F.concat(F.lit("group "), F.coalesce("group_label", F.lit("none"))), 30, "."), F.lpad(F.col("n").cast("string"), 8, " ")).alias("line"))


#: The data sets that runs are made for: table, column of the measured value, columns that name a feature.
DATASETS = (("plasma readings", "olink_long", "npx", ("panel", "assay")), ("wearables", "processed_fitbit_data", "activities_summary_steps", ("event_name",)), ("events", "events", "value", ("event_type",)))


@one("q_hp_08", "select 'plasma readings' as dataset, count(*) as n_rows, count(npx) as n_values, count(distinct coalesce(panel, '') || '|' || coalesce(assay, '')) as n_features from olink_long union all select 'wearables', count(*), count(activities_summary_steps), count(distinct coalesce(event_name, '')) from processed_fitbit_data union all select 'events', count(*), count(value), count(distinct coalesce(event_type, '')) from events")
def _(t):
    """One line per registered data set."""
    out = None
    for name, source, value, features in DATASETS:
        key = F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in features))
        x = t(source).agg(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("n_rows"), F.count(value).alias("n_values"), F.countDistinct(key).alias("n_features"))
        out = x if out is None else out.unionByName(x)
    return out


# ---- features: classes and spreads on their own, resampling


_KNOWN = "mods as (select unnest([" + ", ".join(f"{{'o': {i}, 't': '{a}', 's': {c}::double}}" for i, (a, _b, c) in enumerate(dedup.MODIFICATIONS)) + "], recursive := true))"


@q("q_tr_16", _KNOWN + ", x as (select p_partkey, p_retailprice / 10.0 - (p_retailprice / 10.0 - (p_partkey % 5) * 5.0) as delta from part) select p_partkey, case when abs(delta) <= 0.02 then 'Parent' else coalesce((select arg_min(t, o) from mods where abs(s - delta) <= 0.1), 'Unknown/Measurement Error') end as classification from x")
def _(t):
    """Parent, known modification or neither, by the distance of a feature from its expected mass."""
    mz = F.col("p_retailprice") / 10.0
    mass = mz - (F.col("p_partkey") % 5) * 5.0 - dedup.PROTON
    return t("part").select("p_partkey", dedup.classified(mass, mz)["classification"].alias("classification"))


@one("q_tr_17", "with g as (select p_brand, p_type, count(*) as n, (max(p_size) - min(p_size)) / 10.0 as spread from part group by 1, 2) select p_brand, p_type, n, case when n < 2 then 'single_candidate' when spread < 0.5 then 'chromatographic_artifact' when spread <= 3.0 then 'potential_structural_isomers' else 'likely_annotation_error' end as flag from g")
def _(t):
    """What the spread of retention times of a compound's candidates says."""
    g = t("part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), ((F.max("p_size") - F.min("p_size")) / 10.0).alias("spread"))
    return g.select("p_brand", "p_type", "n", dedup.rt_flag(F.col("n"), F.col("spread")).alias("flag"))


@R.query("q_tk_08")
def _(t):
    """Interval of a mean from 1000 resamples by hash; tests hold it against the normal interval."""
    return ml.bootstrap_means(measured(t), "event_id", "value", 1000)


QUERIES, SQL = R.queries, R.sql
