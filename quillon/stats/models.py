"""Regressions from aggregates, clustering and principal components by pyspark.ml, forecast metrics and comparison.

Normal equations and score sums are aggregates over all rows; only matrices of the number of regressors reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.stats import special


def _design(regressors: Sequence[str]) -> list[Column]:
    return [F.lit(1.0), *(F.col(c).cast("double") for c in regressors)]


def _sums(rows: DataFrame, weight: Column, x: list[Column], extra: dict[str, Column]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Weighted cross products of the regressors, and of each extra column with them, in one pass."""
    k = len(x)
    cross = [F.sum(weight * x[i] * x[j]).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)]
    more = [F.sum(e * x[i]).alias(f"{n}{i}") for n, e in extra.items() for i in range(k)]
    one = rows.agg(*cross, *more).first()
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = one[f"x{i}_{j}"] or 0.0
    return m, {n: np.array([one[f"{n}{i}"] or 0.0 for i in range(k)]) for n in extra}


def _table(rows: DataFrame, names: Sequence[str], b: np.ndarray, cov: np.ndarray, df: float | None) -> DataFrame:
    out = []
    for n, e, v in zip(names, b, np.diag(cov), strict=True):
        se = math.sqrt(max(v, 0.0))
        t = float(e) / se if se else float("nan")
        p = float("nan") if not se else special.t_two_sided(t, df) if df else special.normal_two_sided(t)
        out.append((n, float(e), se, t, float(p)))
    return rows.sparkSession.createDataFrame(out, "term string, estimate double, se double, t double, p double")


def ols(rows: DataFrame, y: str, regressors: Sequence[str], robust: bool = True, cluster: str | None = None) -> DataFrame:
    """Least squares with HC1 or cluster-robust standard errors. Rows with nulls are dropped."""
    rows = rows.dropna(subset=[y, *regressors])
    x, target = _design(regressors), F.col(y).cast("double")
    xx, s = _sums(rows, F.lit(1.0), x, {"y": target})
    inverse = np.linalg.pinv(xx)
    b = inverse @ s["y"]
    n, k = rows.count(), len(x)
    e = target - sum((F.lit(float(c)) * v for c, v in zip(b, x, strict=True)), F.lit(0.0))
    if cluster:
        scores = rows.groupBy(cluster).agg(*(F.sum(e * v).alias(f"s{i}") for i, v in enumerate(x)))
        meat, _ = _sums(scores, F.lit(1.0), [F.col(f"s{i}") for i in range(k)], {})
        g = scores.count()
        cov = inverse @ meat @ inverse * (g / (g - 1) * (n - 1) / (n - k))
    else:
        meat, _ = _sums(rows, e * e, x, {})
        cov = inverse @ meat @ inverse * (n / (n - k)) if robust else inverse * (rows.agg(F.sum(e * e)).first()[0] / (n - k))
    return _table(rows, ["(intercept)", *regressors], b, cov, n - k)


def logit(rows: DataFrame, y: str, regressors: Sequence[str], rounds: int = 25, cluster: str | None = None) -> DataFrame:
    """Logistic regression by Newton steps, each one pass; HC1 or cluster-robust standard errors."""
    rows = rows.dropna(subset=[y, *regressors])
    x, target = _design(regressors), F.col(y).cast("double")
    b = np.zeros(len(x))

    def p_of(b: np.ndarray) -> Column:
        return 1 / (1 + F.exp(-sum((F.lit(float(c)) * v for c, v in zip(b, x, strict=True)), F.lit(0.0))))

    for _ in range(rounds):
        p = p_of(b)
        h, s = _sums(rows, p * (1 - p), x, {"g": target - p})
        step = np.linalg.pinv(h) @ s["g"]
        b = b + step
        if np.abs(step).max() < 1e-10:
            break
    p = p_of(b)
    h, _ = _sums(rows, p * (1 - p), x, {})
    bread, n, k = np.linalg.pinv(h), rows.count(), len(x)
    if cluster:
        scores = rows.groupBy(cluster).agg(*(F.sum((target - p) * v).alias(f"s{i}") for i, v in enumerate(x)))
        meat, _ = _sums(scores, F.lit(1.0), [F.col(f"s{i}") for i in range(k)], {})
        factor = (g := scores.count()) / (g - 1)
    else:
        meat, _ = _sums(rows, (target - p) * (target - p), x, {})
        factor = n / (n - k)
    return _table(rows, ["(intercept)", *regressors], b, bread @ meat @ bread * factor, None)


def icc(rows: DataFrame, value: str, group: str) -> DataFrame:
    """Intraclass correlation by the method of moments, negative estimates as 0."""
    per = rows.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")).where("n > 0")
    all_ = per.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("v")).alias("within"))
    one = per.crossJoin(all_.select("mean")).agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2)).alias("between")).crossJoin(all_).first()
    n, k = one["n"], one["k"]
    ms_b, ms_w, n0 = one["between"] / (k - 1), one["within"] / (n - k), (n - one["n2"] / n) / (k - 1)
    var = max(0.0, (ms_b - ms_w) / n0)
    return rows.sparkSession.createDataFrame([(var / (var + ms_w) if var + ms_w else 0.0, k, n)], "icc double, groups long, n long")


def kmeans(rows: DataFrame, features: str, k: int, seeds: Sequence[int], key: str) -> tuple[DataFrame, DataFrame]:
    """Assignments of the best seed, and per seed the cost, silhouette, and adjusted Rand index against the best."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    data = rows.select(key, array_to_vector(F.col(features).cast("array<double>")).alias("features")).cache()
    fits = []
    for seed in seeds:
        model = KMeans(k=k, seed=seed, featuresCol="features").fit(data)
        out = model.transform(data)
        fits.append((seed, model.summary.trainingCost, ClusteringEvaluator(featuresCol="features").evaluate(out), out.select(key, F.col("prediction").alias("cluster"))))
    best = min(fits, key=lambda f: f[1])
    report = [(s, float(c), float(v), adjusted_rand(f, best[3], key)) for s, c, v, f in fits]
    return best[3], rows.sparkSession.createDataFrame(report, "seed int, cost double, silhouette double, ari double")


def adjusted_rand(a: DataFrame, b: DataFrame, key: str) -> float:
    pairs = a.select(key, F.col("cluster").alias("i")).join(b.select(key, F.col("cluster").alias("j")), key).groupBy("i", "j").agg(F.count("*").alias("n"))
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    cells = pairs.agg(F.sum(two("n")).alias("s"), F.sum("n").alias("n")).first()
    side = lambda c: pairs.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(two("n"))).first()[0]
    left, right, total = side("i"), side("j"), cells["n"] * (cells["n"] - 1) / 2
    expected, most = left * right / total, (left + right) / 2
    return float((cells["s"] - expected) / (most - expected)) if most != expected else 1.0


def principal_components(rows: DataFrame, features: str, k: int, key: str) -> tuple[DataFrame, list[float]]:
    """Standardized scores on k components, each with its largest loading positive, and the explained shares."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = rows.select(key, array_to_vector(F.col(features).cast("array<double>")).alias("raw"))
    scaled = StandardScaler(inputCol="raw", outputCol="z", withMean=True).fit(data).transform(data)
    model = PCA(k=k, inputCol="z", outputCol="pc").fit(scaled)
    loadings = model.pc.toArray()
    signs = [1.0 if col[np.abs(col).argmax()] >= 0 else -1.0 for col in loadings.T]
    scores = F.transform(vector_to_array("pc"), lambda v, i: v * F.element_at(F.lit(signs), i + 1))
    return model.transform(scaled).select(key, scores.alias("scores")), list(model.explainedVariance.toArray())


def vif(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Variance inflation: the diagonal of the inverse correlation matrix."""
    one = rows.agg(*(F.corr(a, b).alias(f"{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j)).first()
    m = np.eye(len(columns))
    for i in range(len(columns)):
        for j in range(i + 1, len(columns)):
            m[i, j] = m[j, i] = one[f"{i}_{j}"]
    return rows.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, np.diag(np.linalg.pinv(m)), strict=True)], "term string, vif double")


def forecast_metrics(rows: DataFrame, by: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """MAPE, sMAPE (percent), RMSE, MAE, WAPE per group; zero actuals don't count in MAPE."""
    y, f = F.col(actual), F.col(predicted)
    error = F.abs(y - f)
    size = F.abs(y) + F.abs(f)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        (100 * F.avg(F.when(y != 0, error / F.abs(y)))).alias("mape"),
        (100 * F.avg(F.when(size > 0, 2 * error / size).otherwise(0.0))).alias("smape"),
        F.sqrt(F.avg((y - f) * (y - f))).alias("rmse"),
        F.avg(error).alias("mae"),
        F.try_divide(F.sum(error), F.sum(F.abs(y))).alias("wape"),
    )


def seasonal_naive(series: DataFrame, by: Sequence[str], order: str, value: str, season: int) -> DataFrame:
    """Adds the value a season ago and the last value as predictions."""
    w = Window.partitionBy(*by).orderBy(order)
    return series.withColumns({"seasonal": F.lag(value, season).over(w), "last": F.lag(value, 1).over(w)})


def walk_forward_ridge(series: DataFrame, by: str, order: str, value: str, lags: Sequence[int], test: int, ridge: float = 1.0) -> DataFrame:
    """Per series the last `test` steps, each predicted by ridge regression on the lags, refitted on everything before it."""
    schema = f"{by} {series.schema[by].dataType.simpleString()}, {order} {series.schema[order].dataType.simpleString()}, actual double, predicted double"

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(order).reset_index(drop=True)
        y = pdf[value].to_numpy(float)
        out = []
        for t in range(max(len(y) - test, max(lags) + 2), len(y)):
            x = np.array([[1.0, *(y[i - k] for k in lags)] for i in range(max(lags), t + 1)])
            a, target = x[:-1], y[max(lags) : t]
            b = np.linalg.solve(a.T @ a + ridge * np.eye(a.shape[1]), a.T @ target)
            out.append((pdf[by][0], pdf[order][t], y[t], float(x[-1] @ b)))
        return pd.DataFrame(out, columns=[by, order, "actual", "predicted"])

    return series.select(by, order, value).groupBy(by).applyInPandas(run, schema)


def diebold_mariano(errors: DataFrame, by: Sequence[str], first: str, second: str, horizon: int = 1) -> DataFrame:
    """Harvey-Leybourne-Newbold statistic of the squared errors' difference and its two-sided p, per group; horizon 1 has no autocovariances."""
    d = F.pow(F.col(first), 2) - F.pow(F.col(second), 2)
    per = errors.groupBy(*by).agg(F.count("*").alias("n"), F.avg(d).alias("m"), F.var_pop(d).alias("v"))
    out = []
    for r in per.collect():
        n = r["n"]
        ok = n > 1 and r["v"]
        dm = r["m"] / math.sqrt(r["v"] / n) * math.sqrt((n + 1 - 2 * horizon + horizon * (horizon - 1) / n) / n) if ok else None
        out.append((*(r[c] for c in by), n, dm, special.t_two_sided(dm, n - 1) if ok else None))
    kinds = ", ".join(f"{c} {errors.schema[c].dataType.simpleString()}" for c in by)
    return errors.sparkSession.createDataFrame(out, f"{kinds}, n long, dm double, p double")


def wilcoxon_signed_rank(rows: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Per group: the smaller rank sum of the nonzero differences, z with tie correction, p. Average ranks from counts of equal sizes."""
    d = rows.withColumn("_d", F.col(a) - F.col(b)).where("_d != 0")
    per = d.groupBy(*by, F.abs("_d").alias("_s")).agg(F.count("*").alias("t"), F.count_if(F.col("_d") > 0).alias("pos"))
    w = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("rank", F.coalesce(F.sum("t").over(w), F.lit(0)) + (F.col("t") + 1) / 2)
    t = F.col("t").cast("double")
    out = per.groupBy(*by).agg(F.sum("t").alias("n"), F.sum(F.col("pos") * F.col("rank")).alias("plus"), F.sum((F.col("t") - F.col("pos")) * F.col("rank")).alias("minus"), F.sum(t * t * t - t).alias("ties"))
    n = F.col("n")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return out.select(*by, "n", F.least("plus", "minus").alias("w"), F.when(sd > 0, (F.least("plus", "minus") - n * (n + 1) / 4) / sd).alias("z"))


def confidence_set(losses: DataFrame, model: str, step: str, loss: str, alpha: float = 0.1, draws: int = 500, block: int = 3, seed: int = 1) -> DataFrame:
    """Model confidence set by the range statistic and a block bootstrap of mean losses; one row per model: excluded at which p.

    Losses of all models at all test steps are collected: models times steps numbers, the forecasts' size, not the data's.
    """
    pdf = losses.groupBy(step).pivot(model).agg(F.avg(loss)).orderBy(step).toPandas()
    names = [c for c in pdf.columns if c != step]
    x = pdf[names].to_numpy(float)
    rng, n = np.random.default_rng(seed), len(x)
    starts = rng.integers(0, n, (draws, -(-n // block)))
    index = (starts[:, :, None] + np.arange(block)).reshape(draws, -1)[:, :n] % n
    means, boot = x.mean(0), x[index].mean(1)
    alive, out, worst = list(range(len(names))), {}, 0.0
    while len(alive) > 1:
        gap = means[alive][:, None] - means[alive][None, :]
        each = boot[:, alive][:, :, None] - boot[:, alive][:, None, :] - gap
        sd = np.sqrt((each**2).mean(0)) + 1e-300
        p = float((np.abs(each / sd).max((1, 2)) >= np.abs(gap / sd).max()).mean())
        worst = max(worst, p)
        lose = alive[int((gap / sd).max(1).argmax())]
        out[names[lose]] = worst
        alive.remove(lose)
    out[names[alive[0]]] = 1.0
    return losses.sparkSession.createDataFrame([(m, p, p >= alpha) for m, p in out.items()], "model string, p double, kept boolean")
