"""Queries of tests, enrichment, deduplication, models and what they rest on."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortloom.operators import contingency as ct
from cohortloom.operators import dedup, ranks
from cohortloom.operators import modelling as ml
from cohortloom.operators import relational as rel
from cohortloom.operators.quantiles import exact_quantiles
from cohortloom.plans.omics_queries import M_SQL, S_SQL, measured, per_sample, r6
from cohortloom.plans.registry import Register
from cohortloom.session import cut

R = Register()


def q(name, sql):
    return R.query(name, f"with {sql}")


_U = """, k as (select feature, grp, value, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2 as rk, count(*) over (partition by feature, value) as c from m where value is not null),
u as (select feature, count(*) filter (where grp = 0) as n1, count(*) filter (where grp = 1) as n2, sum(rk) filter (where grp = 0) as r1, sum(c * c - 1) as ties, count(*) as n from k group by 1),
z as (select *, r1 - n1 * (n1 + 1) / 2 as u from u)"""


def case(t):
    return measured(t), F.col("grp") == 1


@q("q_tst_01", M_SQL + _U + " select feature, n1, n2, round(u, 6) as u, round((greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))), 6) as z from z")
def _(t):
    m, second = case(t)
    return ranks.mann_whitney(m, ["feature"], "value", second).select("feature", "n1", "n2", r6("u").alias("u"), r6("z").alias("z"))


@R.query("q_tst_01_p")
def _(t):
    """The differential table: U test per feature, p, q, medians, log2 fold change and the hit rule."""
    m, second = case(t)
    x = m.withColumn("l", F.log2(F.col("value") + 1))
    u = ranks.mann_whitney(x, ["feature"], "l", second)
    u = u.withColumn("p_value", ranks.p_of_u("u", "z", "n1", "n2", "tied"))
    med = exact_quantiles(x, ["feature", "grp"], "l", {"mid": 0.5}).groupBy("feature").agg(*(F.max(F.when(F.col("grp") == g, F.col("mid"))).alias(f"median_group{g + 1}") for g in (0, 1)))
    back = lambda c: F.greatest(F.pow(F.lit(2.0), F.col(c)) - 1, F.lit(1e-12))
    out = ranks.adjust_bh(u, [], "p_value", ["feature"]).join(med, "feature").withColumn("log2fc", F.log2(back("median_group2") / back("median_group1")))
    hit = (F.col("q_value") < 0.05) & (F.abs("log2fc") >= F.lit(0.5849625007211562))
    return out.select("feature", "n1", "n2", "u", "p_value", "q_value", hit.alias("significant"), "median_group1", "median_group2", "log2fc", "excluded")


@q("q_tst_02", S_SQL + ", d as (select a.feature, round(b.value - a.value, 6) as d from s a join s b on a.subject = b.subject and a.feature = b.feature and ascii(b.tp) = ascii(a.tp) + 1), k as (select feature, d, rank() over (partition by feature order by abs(d)) + (count(*) over (partition by feature, abs(d)) - 1) / 2 as rk from d where d <> 0) select feature, count(*) as n_pairs, round(least(coalesce(sum(rk) filter (where d > 0), 0), coalesce(sum(rk) filter (where d < 0), 0)), 6) as w from k group by 1")
def _(t):
    d = rel.adjacent_deltas(per_sample(t), "subject", "feature", "tp", "value").withColumn("delta", r6("delta"))
    return ranks.wilcoxon(d, ["feature"], "delta").select("feature", "n_pairs", r6("w").alias("w"))


@R.query("q_tst_02_p")
def _(t):
    """Longitudinal table: signed-rank test per comparison and feature with p and q per comparison."""
    d = rel.adjacent_deltas(per_sample(t), "subject", "feature", "tp", "value")
    w = ranks.wilcoxon(d, ["comparison", "feature"], "delta").withColumn("p_value", ranks.p_of_w("w", "z", "n_pairs", "tied"))
    return ranks.adjust_bh(w, ["comparison"], "p_value", ["feature"])


@q("q_tst_03", M_SQL + ", k as (select feature, sum((grp = 0)::int) over (partition by feature order by value) / sum((grp = 0)::int) over (partition by feature) as a, sum((grp = 1)::int) over (partition by feature order by value) / sum((grp = 1)::int) over (partition by feature) as b from m where value is not null) select feature, round(max(abs(a - b)), 6) as d from k group by 1")
def _(t):
    m, second = case(t)
    return ranks.kolmogorov(m, ["feature"], "value", second).select("feature", r6("d").alias("d"))


@q("q_tst_05", """c as (select p_brand, sum((p_size < 10)::int) as a, sum((p_size >= 10)::int) as b from part group by 1), t as (select sum(a)::int as ta, sum(b)::int as tb from c),
x as (select p_brand, a::int as a, b::int as b, ta - a::int as c, tb - b::int as d from c, t), k as (select *, unnest(range(a, least(a + b, a + c) + 1)) as i from x)
select p_brand, round(sum(exp(lgamma(a + c + 1) - lgamma(i + 1) - lgamma(a + c - i + 1) + lgamma(b + d + 1) - lgamma(a + b - i + 1) - lgamma(b + d - a - b + i + 1) - lgamma(a + b + c + d + 1) + lgamma(a + b + 1) + lgamma(c + d + 1))), 6) as p from k group by 1""")
def _(t):
    c = t("part").groupBy("p_brand").agg(F.count_if(F.col("p_size") < 10).alias("a"), F.count_if(F.col("p_size") >= 10).alias("b"))
    x = rel.with_totals(c, {"ta": F.sum("a"), "tb": F.sum("b")})
    return x.select("p_brand", r6(ct.fisher(F.col("a"), F.col("b"), F.col("ta") - F.col("a"), F.col("tb") - F.col("b"), "greater")).alias("p"))


@R.query("q_tst_05_two")
def _(t):
    c = t("part").groupBy("p_brand").agg(F.count_if(F.col("p_size") < 10).alias("a"), F.count_if(F.col("p_size") >= 10).alias("b"))
    x = rel.with_totals(c, {"ta": F.sum("a"), "tb": F.sum("b")})
    return x.select("p_brand", ct.fisher(F.col("a"), F.col("b"), F.col("ta") - F.col("a"), F.col("tb") - F.col("b")).alias("p"))


@q("q_tst_07", M_SQL + ", k as (select feature, tp, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2 as rk, count(*) over (partition by feature, value) as c from m where value is not null), g as (select feature, tp, count(*)::double as n, sum(rk) as r from k group by 1, 2), t as (select feature, sum(c * c - 1)::double as ties, count(*)::double as n from k group by 1) select g.feature, count(*) as n_groups, round((12.0 / (max(t.n) * (max(t.n) + 1)) * sum(r * r / g.n) - 3 * (max(t.n) + 1)) / (1 - max(ties) / (max(t.n) ^ 3 - max(t.n))), 6) as h from g join t on g.feature = t.feature group by 1")
def _(t):
    return ranks.kruskal(measured(t), ["feature"], "value", "tp").select("feature", "n_groups", r6("h").alias("h"))


@q("q_tst_08", M_SQL + ", x as (select event_id, feature, value as a, hour(ts) as b from m where value is not null), k as (select feature, rank() over (partition by feature order by a) + (count(*) over (partition by feature, a) - 1) / 2 as ra, rank() over (partition by feature order by b) + (count(*) over (partition by feature, b) - 1) / 2 as rb from x) select feature, count(*) as n, round(corr(ra, rb), 6) as rho from k group by 1")
def _(t):
    x = measured(t).withColumn("b", F.hour("ts").cast("double"))
    return ranks.spearman(x, ["feature"], "value", "b").select("feature", "n", r6("rho").alias("rho"))


@q("q_tst_10", "p as (select p_partkey, p_brand, (p_partkey * 7919 % 1000 + 1) / 1000.0 as p from part), i as (select *, row_number() over (partition by p_brand order by p, p_partkey) as i, count(*) over (partition by p_brand) as m from p) select p_partkey, round(least(1, min(p * m / i) over (partition by p_brand order by i desc rows unbounded preceding)), 6) as q_value from i")
def _(t):
    x = t("part").select("p_partkey", "p_brand", ((F.col("p_partkey") * 7919 % 1000 + 1) / 1000.0).alias("p"))
    return ranks.adjust_bh(x, ["p_brand"], "p", ["p_partkey"]).select("p_partkey", r6("q_value").alias("q_value"))


@q("q_tst_11", "n as (select diabetes, chtn, count(*) as o from processed_clinical_data where diabetes is not null and chtn is not null group by 1, 2), r as (select diabetes, sum(o) as r from n group by 1), c as (select chtn, sum(o) as c from n group by 1), g as (select r.diabetes, c.chtn, coalesce(o, 0) as o, r * c / (select sum(o) from n) as e from r cross join c left join n on r.diabetes = n.diabetes and c.chtn = n.chtn) select round(sum((o - e) ^ 2 / e), 6) as chi2, (count(distinct diabetes) - 1) * (count(distinct chtn) - 1) as df from g")
def _(t):
    return ct.chi_square(t("processed_clinical_data"), "diabetes", "chtn").select(r6("chi2").alias("chi2"), "df")


@q("q_tst_12", M_SQL + " , g as (select feature, tp, count(value) as n, avg(value) as mu, sum(value) as s, sum(value * value) as q from m where value is not null group by 1, 2), t as (select feature, count(*) as k, sum(n) as n, sum(s) as s, sum(q) as q, sum(s * s / n) as b from g group by 1) select feature, round(((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)), 4) as f, k - 1 as df1, (n - k)::bigint as df2 from t")
def _(t):
    return ct.anova(measured(t), ["feature"], "tp", "value").select("feature", F.round("f", 4).alias("f"), "df1", "df2")


@q("q_tst_12_t", M_SQL + ", a as (select feature, count(value) filter (where grp = 0) as n0, avg(value) filter (where grp = 0) as m0, var_samp(value) filter (where grp = 0) as v0, count(value) filter (where grp = 1) as n1, avg(value) filter (where grp = 1) as m1, var_samp(value) filter (where grp = 1) as v1 from m group by 1) select feature, round((m0 - m1) / sqrt(v0 / n0 + v1 / n1), 6) as t, round((v0 / n0 + v1 / n1) ^ 2 / ((v0 / n0) ^ 2 / (n0 - 1) + (v1 / n1) ^ 2 / (n1 - 1)), 4) as df from a")
def _(t):
    m, second = case(t)
    return ct.welch(m, ["feature"], "value", second).select("feature", r6("t").alias("t"), F.round("df", 4).alias("df"))


@q("q_tst_14", M_SQL + ", a as (select feature, avg(value) filter (where grp = 0) as m0, var_samp(value) filter (where grp = 0) as v0, avg(value) filter (where grp = 1) as m1, var_samp(value) filter (where grp = 1) as v1, avg((value > 10)::int) filter (where grp = 0 and value is not null) as p0, avg((value > 10)::int) filter (where grp = 1 and value is not null) as p1 from m group by 1) select feature, round(abs(m0 - m1) / sqrt((v0 + v1) / 2), 6) as smd, round(abs(p0 - p1) / sqrt((p0 * (1 - p0) + p1 * (1 - p1)) / 2), 6) as smd_high from a")
def _(t):
    m, second = case(t)
    a = ct.smd_continuous(m, ["feature"], "value", second)
    b = ct.smd_binary(m, ["feature"], F.col("value") > 10, second).withColumnRenamed("smd", "smd_high")
    return a.join(b, "feature").select("feature", r6("smd").alias("smd"), r6("smd_high").alias("smd_high"))


@R.query("q_tst_14_k")
def _(t):
    return ct.smd_levels(t("processed_clinical_data"), "route_of_delivery", F.col("group_label") != "Control")


@R.query("q_tst_15")
def _(t):
    """Average precision on held-out rows against that of 1000 refits to relabelled rows; share at least as good."""
    train, test = _parts(t)
    return ml.permutation_test(train, test, "vec_id", 1000)


@R.query("q_tst_16")
def _(t):
    """Interval of the ROC area from 1000 resamples."""
    return ml.bootstrap_auc(scores(t), "vec_id", "score", F.col("truth"))


@q("q_tst_17", M_SQL + ", a as (select feature, count(value)::double as n, avg(value) as mu from m group by 1), b as (select m.feature, max(n) as n, avg((value - mu) ^ 3) / avg((value - mu) ^ 2) ^ 1.5 as g from m join a on m.feature = a.feature where value is not null group by 1) select feature, round(g, 6) as skew_population, round(g * sqrt(n * (n - 1)) / (n - 2), 6) as skew_corrected from b")
def _(t):
    s = measured(t).groupBy("feature").agg(F.skewness("value").alias("g"), F.count("value").cast("double").alias("n"))
    return s.select("feature", r6("g").alias("skew_population"), r6(F.col("g") * F.sqrt(F.col("n") * (F.col("n") - 1)) / (F.col("n") - 2)).alias("skew_corrected"))


@q("q_tst_18", M_SQL + ", a as (select feature, quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from m where value is not null group by 1) select event_id from m join a on m.feature = a.feature where value < a - 3 * (b - a) or value > b + 3 * (b - a)")
def _(t):
    m = measured(t).select("event_id", "feature", "value")
    f = exact_quantiles(m, ["feature"], "value", {"a": 0.25, "b": 0.75}).drop("n")
    w = 3 * (F.col("b") - F.col("a"))
    return m.join(f, "feature").where((F.col("value") < F.col("a") - w) | (F.col("value") > F.col("b") + w)).select("event_id")


@R.query("q_tst_13")
def _(t):
    """Variance inflation of daily metrics: the inverse correlation matrix of a fixed list of columns."""
    import numpy as np

    cols = ["activities_summary_steps", "sleep_summary_total_minutes_asleep", "sleep_summary_stages_deep", "heart_rate_resting_heart_rate"]
    x = t("processed_fitbit_data")
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).between(1, 50000)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    got = x.where(ok).agg(*(F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs))).first()
    m = np.eye(len(cols))
    for i, (a, b) in enumerate(pairs):
        m[cols.index(a), cols.index(b)] = m[cols.index(b), cols.index(a)] = got[f"r{i}"] if got[f"r{i}"] is not None else float(a == b)
    return x.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(cols, np.diag(np.linalg.pinv(m)), strict=True)], "column_name string, vif double")


@R.query("q_tst_19")
def _(t):
    """Two principal components of standardised vectors and a flag beyond three deviations."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import vector_to_array

    v = ml.vectors(t("embeddings"), "embedding", F.col("label") < 5)
    s = StandardScaler(inputCol="features", outputCol="z", withMean=True).fit(v).transform(v)
    p = PCA(k=2, inputCol="z", outputCol="p").fit(s).transform(s).select("vec_id", vector_to_array("p").alias("p")).select("vec_id", F.col("p")[0].alias("pc1"), F.col("p")[1].alias("pc2"))
    x = rel.with_totals(p, {"s1": F.stddev_samp("pc1"), "s2": F.stddev_samp("pc2")})
    return x.select("vec_id", "pc1", "pc2", ((F.abs("pc1") > 3 * F.col("s1")) | (F.abs("pc2") > 3 * F.col("s2"))).alias("outlier"))


@R.query("q_tst_09")
def _(t):
    """One-sample distance of the standardised values from the normal distribution, per feature, with its tail."""
    from cohortloom.functions import tails

    x = measured(t).where("value is not null")
    s = x.groupBy("feature").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"))
    v = ranks.value_counts(x, ["feature"], "value", {}).join(s, "feature")
    n = x.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import types as T

    cdf = F.pandas_udf(lambda z: z.map(lambda a: 1 - tails.normal_sf(a)).astype("float64"), T.DoubleType(), F.PandasUDFType.SCALAR)
    y = v.join(n, "feature").withColumn("f", cdf((F.col("v") - F.col("mu")) / F.col("sd")))
    d = F.greatest(F.abs((F.col("c_before") + F.col("c")) / F.col("n") - F.col("f")), F.abs(F.col("f") - F.col("c_before") / F.col("n")))
    return y.groupBy("feature").agg(F.max(d).alias("d"), F.max("n").alias("n"))


# ---- features: deduplication

_PART = "x as (select p_partkey as id, p_retailprice / 10.0 as mz, p_size / 10.0 as rt, p_brand as grp, p_retailprice as area, p_size::double as rsd, (p_partkey % 10)::double as peak, case when p_partkey % 3 <> 0 then (p_partkey % 100)::double end as conf, case p_partkey % 4 when 0 then 'DDA for preferred ion' when 1 then 'DDA for other ion' when 2 then 'DDA available' end as ms2, p_partkey % 7 as n_full, p_partkey % 2 as n_low, p_partkey % 5 as n_part, case when p_size % 2 = 0 then p_brand else '' end as formula, p_retailprice / 10.0 - 1.007276 - (p_partkey % 3) * 1.0 as mass from part)"


def features(t):
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    return t("part").select(k.alias("id"), (price / 10.0).alias("mz"), (F.col("p_size") / 10.0).alias("rt"), F.col("p_brand").alias("grp"), price.alias("area"), F.col("p_size").cast("double").alias("rsd"),
                            (k % 10).cast("double").alias("peak"), F.when(k % 3 != 0, (k % 100).cast("double")).alias("conf"), F.when(k % 4 == 0, "DDA for preferred ion").when(k % 4 == 1, "DDA for other ion").when(k % 4 == 2, "DDA available").alias("ms2"),
                            (k % 7).alias("n_full"), (k % 2).alias("n_low"), (k % 5).alias("n_part"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("").alias("formula"), (price / 10.0 - 1.007276 - (k % 3) * 1.0).alias("mass"))


@q("q_jn_13", _PART + " select a.id as a, b.id as b from x a join x b on a.id < b.id and abs(a.mz - b.mz) <= 0.02 and abs(a.rt - b.rt) <= 0.2")
def _(t):
    return rel.band_join(features(t), "id", "mz", "rt", 0.02, 0.2).select("a", "b")


_MODS = "mods as (select unnest([" + ", ".join(f"{{'o': {i}, 't': '{a}', 'n': '{b}', 's': {c}::double}}" for i, (a, b, c) in enumerate(dedup.MODIFICATIONS)) + "], recursive := true))"
_CLASS = _PART + ", " + _MODS + ", y as (select *, mz - (mass + 1.007276) as delta from x), z as (select y.*, case when abs(delta) <= 0.02 then 'Parent' else coalesce((select arg_min(t, o) from mods where abs(s - delta) <= 0.1), 'Unknown/Measurement Error') end as cls from y)"


@q("q_jn_14", _CLASS + " select id, cls as classification, case when cls = 'Parent' then '' else coalesce((select arg_min(n, o) from mods where abs(s - delta) <= 0.1), '') end as modification_name from z")
def _(t):
    x = features(t)
    return x.select("id", *(c.alias(k) for k, c in dedup.classified(F.col("mass"), F.col("mz")).items()))


_SCORE = _CLASS + ", w as (select *, case when peak >= 7 then 10 when peak >= 5 then 7 when peak >= 3 then 4 else 1 end + case when rsd < 10 then 10 when rsd < 15 then 8 when rsd < 20 then 6 when rsd < 25 then 4 when rsd < 30 then 2 else 0 end + (area - min(area) over ()) / (max(area) over () - min(area) over ()) * 10 + case when conf is null then case when n_full >= 1 then least(n_full, 6) + 4 when n_low >= 1 then 4 else least(n_part, 3) end when conf >= 90 then 10 when conf >= 80 then 9 when conf >= 70 then 8 else 0 end + case ms2 when 'DDA for preferred ion' then 10 when 'DDA for other ion' then 6 when 'DDA available' then 4 else 0 end as score from z)"


def graded(t):
    x = dedup.quality_score(features(t), F.col("peak"), F.col("rsd"), F.col("area"), F.col("conf"), F.col("ms2"), dedup.source_points(F.col("n_full"), F.col("n_low"), F.col("n_part")))
    return x.withColumns(dedup.classified(F.col("mass"), F.col("mz")))


@q("q_tr_15", _SCORE + " select id, round(score, 6) as quality_score from w")
def _(t):
    return graded(t).select("id", r6("quality_score").alias("quality_score"))


@q("q_gr_01", _SCORE + ", k as (select *, case when cls = 'Parent' then 0 when cls <> 'Unknown/Measurement Error' then 1 else 2 end as tier from w), c as (select k.* from k join (select grp, min(tier) as top from k group by 1) m on k.grp = m.grp and k.tier = m.top) select grp, (list(id order by score desc, area desc, rsd, rt, id))[1] as winner, count(*) as n_candidates, round(max(rt) - min(rt), 6) as rt_spread, case when count(*) < 2 then 'single_candidate' when max(rt) - min(rt) < 0.5 then 'chromatographic_artifact' when max(rt) - min(rt) <= 3.0 then 'potential_structural_isomers' else 'likely_annotation_error' end as rt_flag from c group by 1")
def _(t):
    return dedup.best_of_group(graded(t), "grp", "id").withColumn("rt_spread", r6("rt_spread"))


@R.query("q_gr_02")
def _(t):
    """Both passes: by formula, and by mass and time where there is none; tests hold it against a plain sweep."""
    return dedup.unnamed_clusters(features(t), "id", "rt", "mz", "formula")


@R.query("q_gr_03", "with recursive " + _PART + ", e as (select a.id as a, b.id as b from x a join x b on a.id <> b.id and abs(a.mz - b.mz) <= 0.02 and abs(a.rt - b.rt) <= 0.2), r(n, c) as (select id, id from x union select e.b, r.c from r join e on e.a = r.n) select n as id, min(c) as component from r group by 1")
def _(t):
    return dedup.near_components(features(t), "id", "mz", "rt", 0.02, 0.2)


@R.query("q_rs_18", "with x as (select p_partkey as id, case when p_size < 10 then '' else p_name end as name, p_type as formula, (p_partkey % 100)::double as conf, p_retailprice as mz, p_size::double as rt from part) select id, case when name <> '' then name || '_POS' else 'unk_' || id || '_POS_' || format('{:.4f}', mz) || '_RT' || format('{:.2f}', rt) end as final_id, case when contains(lower(name), 'istd') then 'Level 1' when name <> '' and conf >= 80 then 'Level 2' when name <> '' then 'Level 3' when formula <> '' then 'Level 4' else 'Level 5' end as level from x")
def _(t):
    n = F.when(F.col("p_size") < 10, "").otherwise(F.col("p_name"))
    unk = F.concat(F.lit("unk_"), F.col("p_partkey").cast("string"), F.lit("_POS_"), F.format_string("%.4f", "p_retailprice"), F.lit("_RT"), F.format_string("%.2f", F.col("p_size").cast("double")))
    level = F.when(F.lower(n).contains("istd"), "Level 1").when((n != "") & (F.col("p_partkey") % 100 >= 80), "Level 2").when(n != "", "Level 3").when(F.col("p_type") != "", "Level 4").otherwise("Level 5")
    return t("part").select(F.col("p_partkey").alias("id"), F.when(n != "", F.concat(n, F.lit("_POS"))).otherwise(unk).alias("final_id"), level.alias("level"))


# ---- enrichment

_EDGE = "e as (select distinct l_partkey as item, l_suppkey as pw from lineitem), h as (select p_partkey as item from part where p_size < 10), g as (select pw, count(h.item) as k, count(*) as n from e join part on e.item = p_partkey left join h on e.item = h.item group by 1)"


def enriched(t):
    edges = t("lineitem").select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("pw"))
    bg = t("part").select(F.col("p_partkey").alias("item"), "p_size")
    return ct.over_represented(edges, bg.where("p_size < 10"), bg, "item", "pw")


@q("q_jn_17", "e as (select distinct l_partkey as item, l_suppkey as pw from lineitem), h as (select p_partkey as item from part where p_size < 10) select pw, count(*) as n_hits from e join h on e.item = h.item group by 1")
def _(t):
    e = t("lineitem").select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("pw")).distinct()
    return e.join(t("part").where("p_size < 10").select(F.col("p_partkey").alias("item")), "item").groupBy("pw").agg(F.count(F.lit(1)).alias("n_hits"))


@q("q_gr_04", _EDGE + ", c as (select pw, k as a, (select count(*) from h)::bigint - k as b, n - k as c, (select count(*) from part)::bigint - n - (select count(*) from h)::bigint + k as d from g where k > 0), s as (select *, unnest(range(a, least(a + b, a + c) + 1)) as i from c) select pw, a as n_hits, round(sum(exp(lgamma(a + c + 1) - lgamma(i + 1) - lgamma(a + c - i + 1) + lgamma(b + d + 1) - lgamma(a + b - i + 1) - lgamma(b + d - a - b + i + 1) - lgamma(a + b + c + d + 1) + lgamma(a + b + 1) + lgamma(c + d + 1))), 6) as p_value from s group by 1, 2")
def _(t):
    x = enriched(t)
    a, nh, nb, n = F.col("n_hits_in_pw"), F.col("n_hits_total"), F.col("n_bg_in_pw"), F.col("n_bg_total")
    return x.select("pw", a.alias("n_hits"), r6(ct.fisher(a, nh - a, nb - a, n - nb - nh + a, "greater")).alias("p_value"))


@R.query("q_tst_06")
def _(t):
    """Over-representation with q values and the combined score."""
    x = enriched(t)
    a, nh, nb, n = F.col("n_hits_in_pw"), F.col("n_hits_total"), F.col("n_bg_in_pw"), F.col("n_bg_total")
    p = x.withColumn("p_value", ct.fisher(a, nh - a, nb - a, n - nb - nh + a, "greater")).withColumn("enrichment", (a / nh) / (nb / n))
    return ranks.adjust_bh(p, [], "p_value", ["pw"]).withColumn("combined", -F.log10(F.greatest("p_value", F.lit(1e-300))) * F.col("enrichment"))


@q("q_tr_18", _EDGE + " select pw, round(-log10(greatest(k / n, 1e-300)) * (k / (select count(*) from h)) / (n / (select count(*) from part)), 6) as combined from g where k > 0")
def _(t):
    x = enriched(t)
    k, n = F.col("n_hits_in_pw"), F.col("n_bg_in_pw")
    return x.select("pw", r6(-F.log10(F.greatest(k / n, F.lit(1e-300))) * (k / F.col("n_hits_total")) / (n / F.col("n_bg_total"))).alias("combined"))


@q("q_gr_06", M_SQL + ", a as (select feature, tp, median(value) filter (where grp = 1) - median(value) filter (where grp = 0) as d from m group by 1, 2) select tp, case when d > 0 then 'higher_in_g2' else 'higher_in_g1' end as direction, string_agg(feature, ';' order by feature) as features from a group by 1, 2 having count(*) >= 2")
def _(t):
    x = exact_quantiles(measured(t), ["feature", "tp", "grp"], "value", {"mid": 0.5}).groupBy("feature", "tp").agg((F.max(F.when(F.col("grp") == 1, F.col("mid"))) - F.max(F.when(F.col("grp") == 0, F.col("mid")))).alias("d"))
    g = x.groupBy("tp", F.when(F.col("d") > 0, "higher_in_g2").otherwise("higher_in_g1").alias("direction")).agg(F.array_join(F.array_sort(F.collect_list("feature")), ";").alias("features"), F.count(F.lit(1)).alias("n"))
    return g.where("n >= 2").drop("n")


@q("q_gr_05", M_SQL + ", a as (select feature, tp, min(value) as p from m group by 1, 2) select feature, " + ", ".join(f"round(-log10(greatest(coalesce(max(p) filter (where tp = '{k}'), 1), 0.001)), 6) as {k.lower()}" for k in "ABC") + " from a group by 1")
def _(t):
    a = measured(t).groupBy("feature").pivot("tp", ["A", "B", "C"]).agg(F.min("value"))
    return a.select("feature", *(r6(-F.log10(F.greatest(F.coalesce(k, F.lit(1.0)), F.lit(0.001)))).alias(k.lower()) for k in "ABC"))


@q("q_gr_07", M_SQL + _U.replace("where value is not null)", "where value is not null and feature in (select feature from m group by 1 having count(*) >= (select median(n) from (select count(*) as n from m group by feature))))") + " select feature, round(u, 6) as u from z")
def _(t):
    """The U test again, over the features of a list only."""
    m, second = case(t)
    n = m.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    keep = rel.with_totals(n, {"middle": F.median("n")}).where("n >= middle").select("feature")
    return ranks.mann_whitney(m.join(keep, "feature", "left_semi"), ["feature"], "value", second).select("feature", r6("u").alias("u"))


@q("q_hp_03", M_SQL + ", x as (select feature, value as a, y, case y when 'hour' then hour(ts) else day(ts) end as b from m, (select unnest(['hour', 'day']) as y) where value is not null), k as (select feature, y, rank() over (partition by feature, y order by a) + (count(*) over (partition by feature, y, a) - 1) / 2 as ra, rank() over (partition by feature, y order by b) + (count(*) over (partition by feature, y, b) - 1) / 2 as rb from x) select feature, y as outcome, count(*) as n, round(corr(ra, rb), 6) as rho from k group by 1, 2")
def _(t):
    x = measured(t).select("feature", "value", F.hour("ts").cast("double").alias("hour"), F.dayofmonth("ts").cast("double").alias("day")).unpivot(["feature", "value"], ["hour", "day"], "outcome", "b")
    return ranks.spearman(x, ["feature", "outcome"], "value", "b").withColumn("rho", r6("rho"))


@q("q_jn_18", M_SQL + ", o as (select user_id as subject, unnest(['n', 'last']) as outcome, unnest([count(*)::double, max(value)]) as y from events group by user_id), v as (select subject, feature, avg(value) as x from m group by 1, 2) select feature, outcome, count(*) as n, round(corr(x, y), 6) as r from v join o on v.subject = o.subject where x is not null group by 1, 2")
def _(t):
    o = t("events").groupBy(F.col("user_id").alias("subject")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.max("value").alias("last")).unpivot(["subject"], ["n", "last"], "outcome", "y")
    v = measured(t).groupBy("subject", "feature").agg(F.avg("value").alias("x")).where("x is not null")
    return v.join(o, "subject").groupBy("feature", "outcome").agg(F.count(F.lit(1)).alias("n"), r6(F.corr("x", "y")).alias("r"))


# ---- models

_EMB = "x as (select vec_id, label < 5 as truth, round(embedding[1]::double, 6) as score from embeddings)"


def scores(t):
    return t("embeddings").select("vec_id", (F.col("label") < 5).alias("truth"), r6(F.col("embedding")[0].cast("double")).alias("score"))


@q("q_ml_07", _EMB + ", g as (select score, sum(truth::int) as pos, count(*) as c from x group by 1), k as (select *, sum(pos) over (order by score desc) as tp, sum(c) over (order by score desc) as seen from g), a as (select sum(pos * tp / seen) / sum(pos) as ap, sum((c - pos) * (tp - pos / 2)) / (sum(pos) * sum(c - pos)) as auc from k), b as (select sum((score >= 0.05 and truth)::int) as tp, sum((score >= 0.05 and not truth)::int) as fp, sum(truth::int) as p, count(*) as n from x) select round(ap, 6) as average_precision, round(auc, 6) as roc_auc, round((tp + n - p - fp) / n, 6) as accuracy, round(tp / (tp + fp), 6) as precision, round(tp / p, 6) as recall, round(2 * tp / (2 * tp + fp + p - tp), 6) as f1 from a, b")
def _(t):
    m = ml.metrics(scores(t), [], "score", F.col("truth"), 0.05)
    return m.select(*(r6(c).alias(c) for c in m.columns))


@q("q_ml_08", "x as (select label, count(*) as n from embeddings group by 1) select label, n, n >= 5 and (select sum(n) from x) - n >= 5 as usable from x")
def _(t):
    n = t("embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return rel.with_totals(n, {"all": F.sum("n")}).select("label", "n", ((F.col("n") >= 5) & (F.col("all") - F.col("n") >= 5)).alias("usable"))


@q("q_ml_10", "x as (select label as outcome, avg(embedding[1]::double) as a, max(embedding[2]::double) as b from embeddings group by 1) select outcome, unnest(['mean_first', 'max_second']) as metric, unnest([round(a, 4), round(b, 4)]) as v from x")
def _(t):
    e = lambda i: F.col("embedding")[i].cast("double")
    x = t("embeddings").groupBy(F.col("label").alias("outcome")).agg(F.round(F.avg(e(0)), 4).alias("a"), F.round(F.max(e(1)), 4).alias("b"))
    return x.select("outcome", F.explode(F.create_map(F.lit("mean_first"), "a", F.lit("max_second"), "b")).alias("metric", "v"))


@q("q_hp_11", "x as (select label < 5 as truth from embeddings) select sum(truth::int)::bigint as n_case, sum((not truth)::int)::bigint as n_control from x")
def _(t):
    return t("embeddings").agg(F.count_if(F.col("label") < 5).alias("n_case"), F.count_if(F.col("label") >= 5).alias("n_control"))


@R.query("q_tk_07")
def _(t):
    return ml.split(t("embeddings").select("vec_id", (F.col("label") < 5).cast("int").alias("label")), "vec_id", "label")


def _parts(t):
    v = ml.vectors(t("embeddings"), "embedding", F.col("label") < 5).select("vec_id", "features", "label")
    s = ml.split(t("embeddings").select("vec_id", (F.col("label") < 5).cast("int").alias("label")), "vec_id", "label").select("vec_id", "split")
    x = v.join(s, "vec_id")
    return x.where("split <> 'test'").drop("split"), x.where("split = 'test'").drop("split")


@R.query("q_ml_02")
def _(t):
    """Features kept by the elastic net whose mix and penalty cross-validation chose."""
    return ml.elastic_net_cv(_parts(t)[0], "vec_id")


@R.query("q_ml_03")
def _(t):
    """Features that any of several outcomes needs."""
    x = t("embeddings")
    v = ml.vectors(x, "embedding", F.col("label") < 5).select("vec_id", "features").join(x.select("vec_id", F.col("label").alias("kind")), "vec_id")
    return ml.any_outcome(v, {f"kind {k}": F.col("kind") == k for k in range(3)})


@R.query("q_ml_05")
def _(t):
    """Settings tried by seeded random search, with their average precision on the validation part."""
    train, test = _parts(t)
    return ml.random_search(train, test, 10)


@R.query("q_ml_04")
def _(t):
    """Test metrics of four kinds of model."""
    train, test = _parts(t)
    out = None
    for kind in ("lr", "rf", "gbt", "svm"):
        m = ml.metrics(ml.scored(train, test, kind), [], "score", F.col("label") == 1).select(F.lit(kind).alias("model"), "*")
        out = m if out is None else out.unionByName(m)
    return out


@R.query("q_ml_06")
def _(t):
    """Cross-validated metrics by fold."""
    v = ml.vectors(t("embeddings"), "embedding", F.col("label") < 5).select("vec_id", "features", "label")
    f, n = ml.stratified_folds(v.select("vec_id", "label"), "vec_id", "label")
    x = cut(v.join(f.select("vec_id", "fold"), "vec_id"))  # each fold fits anew
    out = None
    for k in range(n):
        m = ml.metrics(ml.scored(x.where(F.col("fold") != k), x.where(F.col("fold") == k)), [], "score", F.col("label") == 1).select(F.lit(k).alias("fold"), "*")
        out = m if out is None else out.unionByName(m)
    return out


@R.query("q_ml_01")
def _(t):
    """Every outcome on every metric, by the family that the outcome calls for; p values adjusted over the grid."""
    c = t("processed_clinical_data").select("id", "maternal_age", "gest_age_del", "birthweight", "nicu_days", (F.col("chtn") == "1").cast("int").alias("hypertension"), F.coalesce("group_label", F.lit("none")).alias("cohort"))
    w = t("processed_fitbit_data").groupBy("id").agg(F.avg("activities_summary_steps").alias("steps"), F.avg("sleep_summary_total_minutes_asleep").alias("asleep"))
    g = ml.glm_grid(c.join(w, "id"), ["steps", "asleep"], ["birthweight", "nicu_days", "hypertension"], ["maternal_age"])
    return ranks.adjust_bh(g, [], "p_value", ["outcome", "metric"])


@R.query("q_ml_09")
def _(t):
    """Contribution of each feature to a linear score: coefficient times distance from the mean, averaged in size."""
    from pyspark.ml.functions import vector_to_array

    train, test = _parts(t)
    c = ml.elastic_net(train)
    long = lambda d: d.select("vec_id", F.posexplode(vector_to_array("features")).alias("feature", "x"))
    mean = long(train).groupBy("feature").agg(F.avg("x").alias("m"))
    return long(test).join(c, "feature").join(mean, "feature").groupBy("feature").agg(F.avg(F.abs(F.col("coefficient") * (F.col("x") - F.col("m")))).alias("importance"))


@q("q_ag_24", "x as (select p_brand, p_type, (p_partkey * 7919 % 1000 + 1) / 1000.0 as q from part) select p_type, round(least(1.0, min(q)), 6) as min_q from x group by 1")
def _(t):
    return t("part").groupBy("p_type").agg(r6(F.least(F.lit(1.0), F.min((F.col("p_partkey") * 7919 % 1000 + 1) / 1000.0))).alias("min_q"))


@q("q_ag_25", "x as (select i - 1 as dim, embedding[i]::double as v from (select embedding, unnest(range(1, 65)) as i from embeddings)) select dim, round(avg(abs(v)), 6) as importance from x group by 1")
def _(t):
    return t("embeddings").select(F.posexplode("embedding").alias("dim", "v")).groupBy(F.col("dim").cast("long").alias("dim")).agg(r6(F.avg(F.abs(F.col("v").cast("double")))).alias("importance"))


@q("q_tk_02", "x as (select p_partkey, (p_partkey * 7919 % 1000 + 1) / 1000.0 as q from part) select p_partkey, round(q, 6) as q from x order by (q < 0.05) desc, q, p_partkey limit 25")
def _(t):
    return t("part").select("p_partkey", r6((F.col("p_partkey") * 7919 % 1000 + 1) / 1000.0).alias("q")).orderBy(F.desc(F.col("q") < 0.05), "q", "p_partkey").limit(25)


@q("q_tk_06", "x as (select l_suppkey as pw, l_returnflag as tp, min((l_partkey * 7919 % 1000 + 1) / 1000.0) as p from lineitem group by 1, 2), t as (select pw, min(p) as best from x group by 1 order by 2, 1 limit 20) select t.pw, round(-log10(coalesce(max(p) filter (where tp = 'A'), 1)), 6) as a, round(-log10(coalesce(max(p) filter (where tp = 'N'), 1)), 6) as n, round(-log10(coalesce(max(p) filter (where tp = 'R'), 1)), 6) as r from t join x on t.pw = x.pw group by 1")
def _(t):
    x = t("lineitem").groupBy(F.col("l_suppkey").alias("pw"), F.col("l_returnflag").alias("tp")).agg(F.min((F.col("l_partkey") * 7919 % 1000 + 1) / 1000.0).alias("p"))
    top = x.groupBy("pw").agg(F.min("p").alias("best")).orderBy("best", "pw").limit(20)
    m = x.join(F.broadcast(top), "pw").groupBy("pw").pivot("tp", ["A", "N", "R"]).agg(F.max("p"))
    return m.select("pw", *(r6(-F.log10(F.coalesce(k, F.lit(1.0)))).alias(k.lower()) for k in "ANR"))


@q("q_flt_17", M_SQL + ", a as (select feature, tp, avg((value is null)::int) as miss, sum((value is null and grp = 0)::int) as a, sum((value is not null and grp = 0)::int) as b from m group by 1, 2) select feature, tp, round(miss, 6) as miss, miss < 0.15 as kept from a")
def _(t):
    return measured(t).groupBy("feature", "tp").agg(F.avg(F.col("value").isNull().cast("double")).alias("m")).select("feature", "tp", r6("m").alias("miss"), (F.col("m") < 0.15).alias("kept"))


@q("q_flt_30", "x as (select p_partkey, (p_partkey * 7919 % 1000 + 1) / 1000.0 as q, ln(p_retailprice / 2000) / ln(2) as fc from part) select p_partkey from x where q < 0.05 and abs(fc) >= ln(1.5) / ln(2)")
def _(t):
    x = t("part").select("p_partkey", ((F.col("p_partkey") * 7919 % 1000 + 1) / 1000.0).alias("q"), (F.log(F.col("p_retailprice") / 2000) / F.log(F.lit(2.0))).alias("fc"))
    return x.where((F.col("q") < 0.05) & (F.abs("fc") >= F.log(F.lit(1.5)) / F.log(F.lit(2.0)))).select("p_partkey")


@q("q_hp_21", "x as (select p_type as term, p_brand as lib, min((p_partkey * 7919 % 1000 + 1) / 1000.0) as q, count(*) as overlap from part group by 1, 2) select lib, term, round(-log10(q), 6) as score, overlap from (select *, row_number() over (partition by lib order by q, term) as n from x) where n <= 3")
def _(t):
    x = t("part").groupBy(F.col("p_type").alias("term"), F.col("p_brand").alias("lib")).agg(F.min((F.col("p_partkey") * 7919 % 1000 + 1) / 1000.0).alias("q"), F.count(F.lit(1)).alias("overlap"))
    return ml.top_by(x, ["lib"], ["q", "term"], 3).select("lib", "term", r6(-F.log10("q")).alias("score"), "overlap")


@q("q_wn_06", "x as (select p_partkey, p_brand, (p_partkey * 7919 % 1000 + 1) / 1000.0 as p from part) select p_partkey, row_number() over (partition by p_brand order by p, p_partkey) as place, round(min(p) over (partition by p_brand order by p desc, p_partkey desc rows unbounded preceding), 6) as running_min from x")
def _(t):
    """Places and running minima over each list of tests."""
    x = t("part").select("p_partkey", "p_brand", ((F.col("p_partkey") * 7919 % 1000 + 1) / 1000.0).alias("p"))
    down = Window.partitionBy("p_brand").orderBy(F.desc("p"), F.desc("p_partkey")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return x.select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy("p", "p_partkey")).cast("long").alias("place"), r6(F.min("p").over(down)).alias("running_min"))


QUERIES, SQL = R.queries, R.sql
