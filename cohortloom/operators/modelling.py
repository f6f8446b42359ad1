"""Labels, splits, metrics, resampling and Spark ML models on a long or vector feature table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.operators.ranks import running
from cohortloom.session import cut

SEED = 42


def hash_share(key: Column, seed: int = SEED) -> Column:
    """A share in [0, 1) that depends on the key alone, whatever the partitioning."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def split(df: DataFrame, key: str, label: str, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """Stratified split by order of hash within each class; exact shares from ranks over hash buckets."""
    x = df.withColumn("_h", F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(1 << 30)).cast("double"))
    r = running(x.groupBy(label, "_h").agg(F.count(F.lit(1)).alias("c")), [label], "_h", ["c"])
    n = x.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    share = (F.col("c_before") + 0.5) / F.col("_n")
    return x.join(r, [label, "_h"]).join(n, label).withColumn("split", F.when(share < train, "train").when(share < train + val, "val").otherwise("test")).drop("_h", "c", "c_before", "_n")


def metrics(df: DataFrame, keys: list[str], score: str, truth: Column, threshold: float = 0.5) -> DataFrame:
    """Average precision (step-wise), ROC area, accuracy, precision, recall and F1; tied scores count as one step."""
    x = df.withColumn("_t", truth.cast("int")).where(F.col("_t").isNotNull() & F.col(score).isNotNull())
    v = running(x.groupBy(*keys, (-F.col(score).cast("double")).alias("v")).agg(F.sum("_t").alias("pos"), F.count(F.lit(1)).alias("c")), keys, "v", ["pos", "c"])
    tp, seen = F.col("pos_before") + F.col("pos"), F.col("c_before") + F.col("c")
    neg, neg_before = F.col("c") - F.col("pos"), F.col("c_before") - F.col("pos_before")
    hit = F.col("v") <= -threshold
    s = v.groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum("c").alias("n"), F.sum(F.col("pos") * tp / seen).alias("ap"), F.sum(neg * (F.col("pos_before") + F.col("pos") / 2)).alias("auc"),
                             F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, neg).otherwise(0)).alias("fp"))
    p, n, tpc, fpc = F.col("p"), F.col("n"), F.col("tp"), F.col("fp")
    div = lambda a, b: a / F.nullif(b, F.lit(0))
    return s.select(*keys, div(F.col("ap"), p).alias("average_precision"), div(F.col("auc"), p * (n - p)).alias("roc_auc"), div(tpc + (n - p - fpc), n).alias("accuracy"),
                    F.coalesce(div(tpc, tpc + fpc), F.lit(0.0)).alias("precision"), F.coalesce(div(tpc, p), F.lit(0.0)).alias("recall"), F.coalesce(div(2 * tpc, 2 * tpc + fpc + (p - tpc)), F.lit(0.0)).alias("f1"))


def resampled_means(df: DataFrame, key: str, value: str, group: Column, replicates: int) -> DataFrame:
    """Difference of group means under relabelling, one row per replicate (0: as observed).

    A replicate's labels come from a hash of key and replicate, so each row adds to every replicate's sums where it
    lies; the partial sums of the partitions, one row per replicate, are all that is shuffled.
    """
    x = df.select(F.xxhash64(key).alias("h"), F.col(value).cast("double").alias("v"), group.cast("int").alias("g")).where("v is not null and g is not null")
    share = x.agg(F.avg("g")).first()[0]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((replicates + 1, 4))
        for p in batches:
            h, v, g = p["h"].to_numpy().astype(np.uint64), p["v"].to_numpy(), p["g"].to_numpy().astype(bool)
            for r in range(replicates + 1):
                if r:
                    with np.errstate(over="ignore"):
                        m = (h ^ np.uint64(r * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
                        m ^= m >> np.uint64(29)
                        m *= np.uint64(0x94D049BB133111EB)
                    g = (m >> np.uint64(11)).astype(float) / float(1 << 53) < share
                total[r] += (g.sum(), v[g].sum(), (~g).sum(), v[~g].sum())
        yield pd.DataFrame({"replicate": np.arange(replicates + 1), "n1": total[:, 0], "s1": total[:, 1], "n0": total[:, 2], "s0": total[:, 3]})

    out = x.mapInPandas(sums, "replicate int, n1 double, s1 double, n0 double, s0 double").groupBy("replicate").agg(*(F.sum(c).alias(c) for c in ("n1", "s1", "n0", "s0")))
    return out.select("replicate", (F.col("s1") / F.nullif(F.col("n1"), F.lit(0.0)) - F.col("s0") / F.nullif(F.col("n0"), F.lit(0.0))).alias("difference"))


def permutation_p(replicates: DataFrame, value: str = "difference") -> DataFrame:
    """Share of relabelled statistics at least as large as the observed one, in size; nothing is added."""
    seen = F.abs(replicates.where("replicate = 0").agg(F.max(value)).scalar())
    return replicates.where("replicate > 0").agg(F.avg((F.abs(value) >= seen).cast("double")).alias("p_value"), F.count(F.lit(1)).alias("n_replicates"))


def bootstrap_means(df: DataFrame, key: str, value: str, replicates: int, level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean from Poisson resampling by hash."""
    x = df.select(F.xxhash64(key).alias("h"), F.col(value).cast("double").alias("v")).where("v is not null")
    cuts = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1)) for k in range(8)])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((replicates, 2))
        for p in batches:
            v = p["v"].to_numpy()
            for r in range(replicates):
                rng = (p["h"].to_numpy().astype(np.uint64) ^ np.uint64((r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
                rng ^= rng >> np.uint64(29)
                rng *= np.uint64(0x94D049BB133111EB)
                w = np.searchsorted(cuts, (rng >> np.uint64(11)).astype(float) / float(1 << 53))
                total[r] += (w.sum(), (w * v).sum())
        yield pd.DataFrame({"replicate": np.arange(replicates), "n": total[:, 0], "s": total[:, 1]})

    m = x.mapInPandas(sums, "replicate int, n double, s double").groupBy("replicate").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0.0))).alias("m"))
    return m.agg(F.percentile("m", (1 - level) / 2).alias("low"), F.percentile("m", (1 + level) / 2).alias("high"), F.count("m").alias("n_replicates"))  # one row per replicate


def bootstrap_auc(df: DataFrame, key: str, score: str, truth: Column, replicates: int = 1000, level: float = 0.95, least: int = 20) -> DataFrame:
    """ROC area and its percentile interval from Poisson resampling by hash; no interval under the least valid replicates.

    Rows are parted by ranges of the score, so each part counts its own ordered pairs of every replicate; pairs across
    parts follow from the parts' sums. A replicate without both classes is not valid. Replicate 0 is as observed.
    """
    x = df.select(F.xxhash64(key).alias("h"), F.col(score).cast("double").alias("v"), truth.cast("int").alias("t")).where("v is not null and not isnan(v) and t is not null")
    cuts = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(16)])

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        p = pd.concat(got).sort_values("v")
        h, t, v = p["h"].to_numpy().astype(np.uint64), p["t"].to_numpy() == 1, p["v"].to_numpy()
        first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])  # equal scores are one step
        out = np.zeros((replicates + 1, 3))
        for r in range(replicates + 1):
            w = np.ones(len(h))
            if r:
                m = h ^ np.uint64(r * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
                for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
                    m ^= m >> np.uint64(30)
                    m *= np.uint64(factor)
                m ^= m >> np.uint64(31)
                w = np.searchsorted(cuts, (m >> np.uint64(11)).astype(float) / float(1 << 53), side="right").astype(float)
            pos, neg = np.add.reduceat(w * t, first), np.add.reduceat(w * ~t, first)
            out[r] = pos.sum(), neg.sum(), (pos * (np.cumsum(neg) - neg / 2)).sum()
        yield pd.DataFrame({"low_score": v[0], "replicate": np.arange(replicates + 1), "pos": out[:, 0], "neg": out[:, 1], "pairs": out[:, 2]})

    parts = x.repartitionByRange("v").mapInPandas(pairs, "low_score double, replicate int, pos double, neg double, pairs double")
    below = Window.partitionBy("replicate").orderBy("low_score").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    s = parts.withColumn("under", F.coalesce(F.sum("neg").over(below), F.lit(0.0))).groupBy("replicate").agg(
        (F.sum(F.col("pairs") + F.col("pos") * F.col("under")) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("auc"))
    drawn = F.when(F.col("replicate") > 0, F.col("auc"))
    n = F.count(drawn)
    return s.agg(F.max(F.when(F.col("replicate") == 0, F.col("auc"))).alias("roc_auc"), F.when(n >= least, F.percentile(drawn, (1 - level) / 2)).alias("low"),
                 F.when(n >= least, F.percentile(drawn, (1 + level) / 2)).alias("high"), n.alias("n_replicates"))


def vectors(df: DataFrame, array: str, label: Column) -> DataFrame:
    """features and label for Spark ML."""
    from pyspark.ml.functions import array_to_vector

    return df.select(*(c for c in df.columns if c not in ("features", "label")), array_to_vector(F.col(array).cast("array<double>")).alias("features"), label.cast("double").alias("label"))


def elastic_net(train: DataFrame, mix: float = 0.5, strength: float = 0.02) -> DataFrame:
    """Features kept by a balanced elastic-net logistic regression, with their coefficients."""
    from pyspark.ml.classification import LogisticRegression

    share = train.agg(F.avg("label")).first()[0]
    w = F.when(F.col("label") == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9))
    m = LogisticRegression(elasticNetParam=mix, regParam=strength, weightCol="w", maxIter=50).fit(train.withColumn("w", w))
    kept = [(i, float(c)) for i, c in enumerate(m.coefficients.toArray()) if abs(c) > 1e-12]
    return train.sparkSession.createDataFrame(kept, "feature int, coefficient double")


def elastic_net_cv(train: DataFrame, key: str, mixes: tuple = (0.1, 0.5, 0.7, 0.9, 1.0), strengths: tuple = (0.005, 0.02, 0.08), most_folds: int = 10) -> DataFrame:
    """As elastic_net, with mix and penalty that give the best average precision over stratified folds."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    folds_, n = stratified_folds(train.select(key, "label"), key, "label", most_folds)
    x = cut(train.join(folds_.select(key, "fold"), key))
    lr = LogisticRegression(maxIter=20)
    grid = ParamGridBuilder().addGrid(lr.elasticNetParam, list(mixes)).addGrid(lr.regParam, list(strengths)).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(metricName="areaUnderPR"), numFolds=n, foldCol="fold", parallelism=8, seed=SEED)
    scores = cv.fit(x).avgMetrics
    best = grid[int(np.argmax(scores))]
    mix, strength = float(best[lr.elasticNetParam]), float(best[lr.regParam])
    return elastic_net(train, mix, strength).select("*", F.lit(mix).alias("mix"), F.lit(strength).alias("strength"), F.lit(float(max(scores))).alias("average_precision"))


def any_outcome(df: DataFrame, outcomes: dict[str, Column], mix: float = 0.5, strength: float = 0.02) -> DataFrame:
    """Features that the elastic net of at least one outcome keeps, with those outcomes; outcomes are a short list."""
    out = None
    for name, truth in outcomes.items():
        one = elastic_net(df.select("features", truth.cast("double").alias("label")), mix, strength).select("feature", F.lit(name).alias("outcome"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("feature").agg(F.array_join(F.array_sort(F.collect_set("outcome")), ", ").alias("outcomes"))


def random_search(train: DataFrame, val: DataFrame, trials: int) -> DataFrame:
    """Seeded random settings of four kinds of model, one row each, best first by average precision."""
    rng, out = np.random.default_rng(SEED), None
    for k in range(trials):
        kind = ("lr", "rf", "gbt", "svm")[k % 4]
        setting = {"regParam": float(np.round(10 ** rng.uniform(-4, 0), 5))} if kind in ("lr", "svm") else {"maxDepth": int(rng.integers(2, 7))}
        if kind == "lr":
            setting["elasticNetParam"] = float(np.round(rng.random(), 2))
        m = metrics(scored(train, val, kind, **setting), [], "score", F.col("label") == 1)
        one = m.select(F.lit(k).alias("trial"), F.lit(kind).alias("model"), F.lit(str(sorted(setting.items()))).alias("setting"), "average_precision", "roc_auc")
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc("average_precision"), "trial")


#: Labelled rows that a refitted model is trained and measured on, by order of hash; more are left out of the refits.
REFIT_ROWS = 20_000


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 8) -> np.ndarray:
    """Coefficients of a ridge logistic regression by Newton steps; the first column is the constant."""
    beta, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def average_precision(score: np.ndarray, y: np.ndarray) -> float:
    """Mean over cases of the precision at their score, ties taken together."""
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(y[order])
    ends = np.flatnonzero(np.r_[s[1:] != s[:-1], True])
    tp, seen = hit[ends], ends + 1
    return float((np.diff(np.r_[0, tp]) * tp / seen).sum() / max(tp[-1], 1)) if len(ends) else float("nan")


def permutation_test(train: DataFrame, test: DataFrame, key: str, replicates: int = 1000, rows: int = REFIT_ROWS) -> DataFrame:
    """Average precision of a model on test rows, and the share of replicates with permuted training labels, each
    fitted anew, that reach it; nothing is added to the share.

    Training and test use at most ``rows`` labelled rows each, the first by hash, as every replicate needs them whole;
    replicates are dealt to the executors.
    """
    from pyspark.ml.functions import vector_to_array

    def some(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        got = df.orderBy(F.xxhash64(F.col(key), F.lit(SEED)), key).limit(rows).select(vector_to_array("features").alias("v"), "label").collect()
        x = np.array([r["v"] for r in got], float).reshape(len(got), -1)
        return np.column_stack([np.ones(len(x)), x]), np.array([r["label"] for r in got], float)

    (xa, ya), (xb, yb) = some(train), some(test)
    mean, sd = xa[:, 1:].mean(axis=0), np.maximum(xa[:, 1:].std(axis=0), 1e-12)
    xa[:, 1:], xb[:, 1:] = (xa[:, 1:] - mean) / sd, (xb[:, 1:] - mean) / sd

    def refit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for r in b["id"]:
                y = ya if r == 0 else np.random.default_rng([SEED, int(r)]).permutation(ya)
                got.append(average_precision(xb @ fit_logistic(xa, y), yb))
            yield pd.DataFrame({"replicate": b["id"], "v": got})

    spark = train.sparkSession
    rep = cut(spark.range(replicates + 1).repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(refit, "replicate long, v double"))
    seen = rep.where("replicate = 0").agg(F.max("v")).scalar()
    return rep.agg(F.round(F.max(F.when(F.col("replicate") == 0, F.col("v"))), 6).alias("average_precision"), F.avg(F.when(F.col("replicate") > 0, (F.col("v") >= seen).cast("double"))).alias("p_value"), F.count_if(F.col("replicate") > 0).alias("n_replicates"))


def scored(train: DataFrame, test: DataFrame, kind: str = "lr", **setting) -> DataFrame:
    """Scores of a fitted model on other rows: lr, rf, gbt or svm (its margin through the logistic function), with
    further settings of that model."""
    from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import vector_to_array

    model = {"lr": LogisticRegression(maxIter=50), "rf": RandomForestClassifier(numTrees=40, maxDepth=6, seed=SEED), "gbt": GBTClassifier(maxIter=20, maxDepth=3, seed=SEED), "svm": LinearSVC(maxIter=30)}[kind].setParams(**setting).fit(train)
    out = model.transform(test)
    if kind == "svm":
        return out.withColumn("score", 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1])))
    return out.withColumn("score", vector_to_array("probability")[1])


def folds(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """Fold number by hash."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(n)).cast("int"))


def stratified_folds(df: DataFrame, key: str, label: str, most: int = 10) -> tuple[DataFrame, int]:
    """Folds of equal class shares by order of hash, and their number: most, or the least class size, or two."""
    least = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]
    n = max(2, min(most, least or 0))
    x = df.withColumn("_h", F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(1 << 30)).cast("double"))
    r = running(x.groupBy(label, "_h").agg(F.count(F.lit(1)).alias("c")), [label], "_h", ["c"])
    return x.join(r, [label, "_h"]).withColumn("fold", F.pmod(F.col("c_before"), F.lit(n)).cast("int")).drop("_h", "c", "c_before"), n


def top_by(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def glm_grid(df: DataFrame, metrics_: list[str], outcomes: list[str], covariates: list[str], least: int = 15) -> DataFrame:
    """A regression of every outcome on every metric and the covariates, with the family the outcome calls for.

    Binomial for outcomes of 0 and 1; gamma with log link for outcomes that are never negative and skewed by more than
    1.5, zeros taken as half the least positive value; else Gaussian. Fewer rows than ``least`` or a metric or outcome
    without spread give no row. Text covariates are factors. The lists are short; each fit runs over all rows.
    """
    from pyspark.ml.feature import RFormula
    from pyspark.ml.regression import GeneralizedLinearRegression

    rows = []
    for y in outcomes:
        for m in metrics_:
            real = lambda c: F.col(c).isNotNull() & (~F.isnan(c) if df.schema[c].dataType.typeName() in ("float", "double") else F.lit(True))
            x = df.where(real(y) & real(m)).select(F.col(y).cast("double").alias("y"), F.col(m).cast("double").alias("metric"), *covariates).dropna()
            f = x.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("metric").alias("sm"), F.stddev_samp("y").alias("sy"), F.min("y").alias("lo"), F.skewness("y").alias("skew"), F.min(F.when(F.col("y") > 0, F.col("y"))).alias("pos"), F.count_if(~F.col("y").isin(0.0, 1.0)).alias("other")).first()
            if f["n"] < least or not f["sm"] or f["sm"] < 1e-8 or not f["sy"] or f["sy"] < 1e-8:
                continue
            family, link = ("binomial", "logit") if not f["other"] else ("gamma", "log") if f["lo"] >= 0 and abs(f["skew"] or 0.0) > 1.5 else ("gaussian", "identity")
            if family == "gamma":
                x = x.withColumn("y", F.when(F.col("y") == 0, f["pos"] / 2).otherwise(F.col("y")))
            ready = RFormula(formula="y ~ metric" + "".join(f" + {c}" for c in covariates)).fit(x).transform(x)
            fit = GeneralizedLinearRegression(family=family, link=link, maxIter=25).fit(ready)
            s = fit.summary
            null = float(s.nullDeviance)
            rows.append((y, m, family, int(f["n"]), float(fit.coefficients[0]), float(s.coefficientStandardErrors[0]), float(s.pValues[0]), 1 - float(s.deviance) / null if null else None))
    return df.sparkSession.createDataFrame(rows, "outcome string, metric string, family string, n long, estimate double, standard_error double, p_value double, pseudo_r2 double")
