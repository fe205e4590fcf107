"""Rank and contingency tests. Statistics are DataFrame aggregates over all rows; only their small tables reach the driver for p-values.

Ranks over all rows would sort them in one task. Rows shrink to counts of equal values first; running counts over ranges of
distinct values then give average ranks, so no task holds more than a range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.ranks import running
from quillon.stats import special


def value_ranks(rows: DataFrame, value: str, group: str | None = None) -> DataFrame:
    """(group, value, c, t, rank): c rows of the group and t rows in all have the value, whose average rank is rank."""
    keys = [F.col(value).alias("v"), *([F.col(group).alias("g")] if group else [])]
    per = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("c"))
    ties = per.groupBy("v").agg(F.sum("c").alias("t"))
    ranked = running(ties, [], "v", {"upto": F.col("t")}).withColumn("rank", F.col("upto") - (F.col("t") - 1) / 2)
    return per.join(ranked.select("v", "t", "rank"), "v")


def kruskal_wallis(rows: DataFrame, value: str, group: str) -> DataFrame:
    """One row: h with tie correction, df, epsilon squared, p."""
    r = value_ranks(rows, value, group)
    sums = r.groupBy("g").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("rank")).alias("rs"))
    ties = r.select("v", "t").distinct().agg(F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("ties"))
    one = sums.agg(F.sum("n").alias("n"), F.sum(F.col("rs") * F.col("rs") / F.col("n")).alias("q"), F.count("*").alias("k")).crossJoin(ties).first()
    n, k = one["n"] or 0, one["k"]
    spark = rows.sparkSession
    if n < 2 or k < 2 or n**3 - n == one["ties"]:
        return spark.createDataFrame([], "h double, df long, epsilon2 double, p double")
    h = (12 / (n * (n + 1)) * one["q"] - 3 * (n + 1)) / (1 - one["ties"] / (n**3 - n))
    return spark.createDataFrame([(h, k - 1, (h - k + 1) / (n - k) if n > k else None, special.chi2_sf(h, k - 1))], "h double, df long, epsilon2 double, p double")


def mann_whitney(rows: DataFrame, value: str, group: str, first: object, second: object) -> DataFrame:
    """One row: u of the first group, both signs of the rank-biserial correlation, z with tie correction, p."""
    r = value_ranks(rows.where(F.col(group).isin([first, second])), value, group)
    a = F.col("g") == F.lit(first)
    one = r.agg(
        F.sum(F.when(a, F.col("c")).otherwise(0)).alias("n"),
        F.sum(F.when(~a, F.col("c")).otherwise(0)).alias("m"),
        F.sum(F.when(a, F.col("c") * F.col("rank"))).alias("r"),
        F.sum((F.pow(F.col("t").cast("double"), 3) - F.col("t")) * F.col("c") / F.col("t")).alias("ties"),
    ).first()
    n, m = one["n"] or 0, one["m"] or 0
    schema = "u double, biserial double, biserial_reversed double, z double, p double"
    if not n or not m:
        return rows.sparkSession.createDataFrame([], schema)
    u, total = one["r"] - n * (n + 1) / 2, n + m
    sd = math.sqrt(n * m / 12 * (total + 1 - one["ties"] / (total * (total - 1)))) if total > 1 else 0.0
    z = (u - n * m / 2 - math.copysign(0.5, u - n * m / 2)) / sd if sd else 0.0
    return rows.sparkSession.createDataFrame([(u, 1 - 2 * u / (n * m), 2 * u / (n * m) - 1, z, special.normal_two_sided(z))], schema)


def dunn(rows: DataFrame, value: str, group: str) -> DataFrame:
    """Pairs of groups: z of Dunn's test with tie correction, p, and p adjusted by Benjamini-Hochberg."""
    r = value_ranks(rows, value, group)
    means = r.groupBy("g").agg(F.sum("c").alias("n"), (F.sum(F.col("c") * F.col("rank")) / F.sum("c")).alias("mean"))
    ties = r.select("v", "t").distinct().agg(F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("ties"), F.sum("t").alias("total"))
    a, b = means.select(F.col("g").alias("first"), F.col("n").alias("n1"), F.col("mean").alias("m1")), means.select(F.col("g").alias("second"), F.col("n").alias("n2"), F.col("mean").alias("m2"))
    pairs = a.join(b, F.col("first") < F.col("second")).crossJoin(ties)
    t = F.col("total")
    var = (t * (t + 1) / 12 - F.col("ties") / (12 * (t - 1))) * (1 / F.col("n1") + 1 / F.col("n2"))
    out = pairs.withColumn("z", F.when(var > 0, (F.col("m1") - F.col("m2")) / F.sqrt(var))).select("first", "second", "z")
    rows_ = [(x["first"], x["second"], x["z"], special.normal_two_sided(x["z"]) if x["z"] is not None else None) for x in out.collect()]
    kind = rows.schema[group].dataType.simpleString()
    return benjamini_hochberg(rows.sparkSession.createDataFrame(rows_, f"first {kind}, second {kind}, z double, p double"), "p")


def benjamini_hochberg(tests: DataFrame, p: str) -> DataFrame:
    """Adds `adjusted`: the running minimum from the largest p down of p m / rank, at most 1. A row per test."""
    w = Window.orderBy(F.col(p).asc_nulls_last())
    ranked = tests.withColumn("_r", F.row_number().over(w)).withColumn("_m", F.count(p).over(Window.partitionBy()))
    down = Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    adjusted = F.least(F.lit(1.0), F.min(F.when(F.col(p).isNotNull(), F.col(p) * F.col("_m") / F.col("_r"))).over(down))
    return ranked.withColumn("adjusted", F.when(F.col(p).isNotNull(), adjusted)).drop("_r", "_m")


def ks_two_sample(rows: DataFrame, value: str, group: str, first: object, second: object) -> DataFrame:
    """One row: the largest distance of the two distribution functions, and its asymptotic p."""
    per = rows.where(F.col(group).isin([first, second]) & F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count_if(F.col(group) == F.lit(first)).alias("a"), F.count_if(F.col(group) == F.lit(second)).alias("b"))
    per = running(per, [], "v", {"up_a": F.col("a"), "up_b": F.col("b")})
    gap = F.abs(F.col("up_a") / F.col("up_a_all") - F.col("up_b") / F.col("up_b_all"))
    one = per.select(gap.alias("gap"), "a", "b").agg(F.max("gap").alias("d"), F.sum("a").alias("n"), F.sum("b").alias("m")).first()
    if not one["n"] or not one["m"]:
        return rows.sparkSession.createDataFrame([], "d double, p double")
    x = one["d"] * math.sqrt(one["n"] * one["m"] / (one["n"] + one["m"]))
    p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)) if x > 0.2 else 1.0
    return rows.sparkSession.createDataFrame([(one["d"], min(1.0, max(0.0, p)))], "d double, p double")


def chi_square(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: chi2, df, Cramer's V, the smallest expected count, p. Fisher's exact p replaces it in a 2 x 2 table with an expected count below 5."""
    cells = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    left = cells.groupBy("a").agg(F.sum("n").alias("ra"))
    right = cells.groupBy("b").agg(F.sum("n").alias("rb"))
    total = cells.agg(F.sum("n").alias("total"))
    grid = left.crossJoin(right).crossJoin(total).join(cells, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    e = F.col("ra") * F.col("rb") / F.col("total")
    one = grid.agg(F.sum((F.col("n") - e) * (F.col("n") - e) / e).alias("chi2"), F.min(e).alias("least"), F.max("total").alias("total"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c")).first()
    schema = "chi2 double, df long, cramers_v double, least_expected double, p double"
    if one["total"] is None:
        return rows.sparkSession.createDataFrame([], schema)
    df = (one["r"] - 1) * (one["c"] - 1)
    v = math.sqrt(one["chi2"] / (one["total"] * max(1, min(one["r"], one["c"]) - 1)))
    p = special.chi2_sf(one["chi2"], df) if df else 1.0
    if (one["r"], one["c"]) == (2, 2) and one["least"] < 5:
        four = [x["n"] for x in grid.orderBy("a", "b").select("n").collect()]
        p = fisher_exact(*four)
    return rows.sparkSession.createDataFrame([(one["chi2"], df, v, one["least"], p)], schema)


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided: the tables with the same margins that are no likelier."""
    r1, r2, c1 = a + b, c + d, a + c
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    prob = lambda x: math.exp(log(r1, x) + log(r2, c1 - x) - log(r1 + r2, c1))
    own = prob(a)
    return min(1.0, sum(q for x in range(max(0, c1 - r2), min(r1, c1) + 1) if (q := prob(x)) <= own * (1 + 1e-9)))


def correlation(rows: DataFrame, x: str, y: str, least: int = 4, spearman: bool = False) -> DataFrame:
    """One row: n, r, p by Student's t; null r below `least` rows or without variance. Spearman takes average ranks."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    if spearman:
        per = both.groupBy("x", "y").agg(F.count("*").alias("k"))
        rank = lambda c: value_ranks(both, c).select(F.col("v").alias(c), F.col("rank").alias(f"r{c}"))
        ranked = per.join(rank("x"), "x").join(rank("y"), "y")
        n, k = F.sum("k"), F.col("k")
        sx, sy, sxy, sxx, syy = F.sum(k * F.col("rx")), F.sum(k * F.col("ry")), F.sum(k * F.col("rx") * F.col("ry")), F.sum(k * F.col("rx") * F.col("rx")), F.sum(k * F.col("ry") * F.col("ry"))
        one = ranked.agg(n.alias("n"), ((n * sxy - sx * sy) / F.nullif(F.sqrt(n * sxx - sx * sx) * F.sqrt(n * syy - sy * sy), F.lit(0.0))).alias("r")).first()
    else:
        one = both.agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("r")).first()
    n, r = one["n"] or 0, one["r"]
    if n < least:
        r = None
    p = None if r is None or n < 3 else 0.0 if abs(r) >= 1 else special.t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)
    return rows.sparkSession.createDataFrame([(n, r, p)], "n long, r double, p double")


def jarque_bera(rows: DataFrame, value: str) -> DataFrame:
    one = rows.agg(F.count(value).alias("n"), F.skewness(value).alias("s"), F.kurtosis(value).alias("k")).first()
    jb = None if not one["n"] or one["s"] is None else one["n"] / 6 * (one["s"] ** 2 + one["k"] ** 2 / 4)
    return rows.sparkSession.createDataFrame([(jb, None if jb is None else special.chi2_sf(jb, 2))], "jb double, p double")


def autocorrelation(series: DataFrame, value: str, order: str, lags: int) -> DataFrame:
    """(lag, r, q, p): autocorrelations and Ljung-Box statistics of one series."""
    m = series.select(F.col(order).alias("o"), (F.col(value) - F.avg(value).over(Window.partitionBy())).alias("d"))
    w = Window.orderBy("o")
    lagged = m.select("d", *(F.lag("d", k).over(w).alias(f"l{k}") for k in range(1, lags + 1)))
    one = lagged.agg(F.count("*").alias("n"), F.sum(F.col("d") * F.col("d")).alias("v"), *(F.sum(F.col("d") * F.col(f"l{k}")).alias(f"s{k}") for k in range(1, lags + 1))).first()
    out, q = [], 0.0
    for k in range(1, lags + 1):
        r = one[f"s{k}"] / one["v"] if one["v"] else 0.0
        q += one["n"] * (one["n"] + 2) * r * r / (one["n"] - k)
        out.append((k, r, q, special.chi2_sf(q, k)))
    return series.sparkSession.createDataFrame(out, "lag int, r double, q double, p double")


def funnel_limits(groups: DataFrame, hits: str, n: str, total: Column | None = None) -> DataFrame:
    """Adds the share, 95 % and 99.8 % limits around the overall share, and whether the group lies outside the wider ones."""
    p = F.sum(hits).over(Window.partitionBy()) / F.sum(n).over(Window.partitionBy())
    se = F.sqrt(F.col("_p") * (1 - F.col("_p")) / F.col(n))
    out = groups.withColumn("_p", p).withColumn("share", F.col(hits) / F.col(n))
    for name, z in (("95", 1.959963984540054), ("998", 3.090232306167813)):
        out = out.withColumn(f"low_{name}", F.greatest(F.lit(0.0), F.col("_p") - z * se)).withColumn(f"high_{name}", F.least(F.lit(1.0), F.col("_p") + z * se))
    return out.withColumn("outside", (F.col("share") < F.col("low_998")) | (F.col("share") > F.col("high_998"))).drop("_p")
