"""Tests, correlations, regressions and forecast comparison on the portfolio."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon import tables
from quillon.plans.base import Book
from quillon.stats import hypothesis_tests as tests
from quillon.stats import models

book = Book()


def _rounded(df, digits=6):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


_RANK = "WITH v AS (SELECT {group} AS g, {value} AS v FROM {table}), r AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS r, count(*) OVER (PARTITION BY v) AS t FROM v)"


@book.query(
    _RANK.format(group="segment", value="round(value, -3)", table="debts")
    + ", s AS (SELECT g, count(*) AS n, sum(r) AS rs FROM r GROUP BY g), k AS (SELECT sum(n) AS n, sum(rs * rs / n) AS q, count(*) AS k FROM s), t AS (SELECT sum(pow(t, 2) - 1) AS ties FROM r) SELECT round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (pow(n, 3) - n)), 6) AS h, CAST(k - 1 AS BIGINT) AS df FROM k, t"
)
def kruskal(spark, sf_dir):
    d = tables.debts(spark, sf_dir).withColumn("value", F.round("value", -3))
    return _rounded(tests.kruskal_wallis(d, "value", "segment").select("h", "df"))


@book.query(
    _RANK.format(group="status", value="round(value, -3)", table="(SELECT * FROM debts WHERE status IN ('F', 'O'))")
    + " SELECT u, round(1 - 2 * u / (n * m), 9) AS biserial, round(2 * u / (n * m) - 1, 9) AS biserial_reversed FROM (SELECT sum(r) FILTER (WHERE g = 'F') - count(*) FILTER (WHERE g = 'F') * (count(*) FILTER (WHERE g = 'F') + 1) / 2 AS u, count(*) FILTER (WHERE g = 'F') AS n, count(*) FILTER (WHERE g = 'O') AS m FROM r)"
)
def mannwhitney_rank_biserial(spark, sf_dir):
    d = tables.debts(spark, sf_dir).withColumn("value", F.round("value", -3))
    return _rounded(tests.mann_whitney(d, "value", "status", "F", "O").select("u", "biserial", "biserial_reversed"), 9)


@book.query(
    "WITH v AS (SELECT value AS v, count(*) FILTER (WHERE status = 'F') AS a, count(*) FILTER (WHERE status = 'P') AS b FROM debts WHERE status IN ('F', 'P') GROUP BY ALL), c AS (SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER () - sum(b) OVER (ORDER BY v) / sum(b) OVER () AS gap FROM v) SELECT round(max(abs(gap)), 9) AS d FROM c"
)
def ks_distance(spark, sf_dir):
    return _rounded(tests.ks_two_sample(tables.debts(spark, sf_dir), "value", "status", "F", "P").select("d"), 9)


_CHI = "WITH c AS (SELECT a, b, count(d.debt_id) AS n FROM (SELECT DISTINCT segment AS a FROM debts) CROSS JOIN (SELECT DISTINCT status AS b FROM debts) LEFT JOIN debts d ON d.segment = a AND d.status = b GROUP BY ALL), e AS (SELECT n, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS e, sum(n) OVER () AS total FROM c)"


@book.query(_CHI + " SELECT round(sum((n - e) * (n - e) / e), 6) AS chi2, CAST(8 AS BIGINT) AS df, round(sqrt(sum((n - e) * (n - e) / e) / (max(total) * 2)), 9) AS cramers_v, round(min(e), 6) AS least_expected FROM e")
def chi2_cramers_v(spark, sf_dir):
    out = tests.chi_square(tables.debts(spark, sf_dir), "segment", "status")
    return out.select(F.round("chi2", 6).alias("chi2"), "df", F.round("cramers_v", 9).alias("cramers_v"), F.round("least_expected", 6).alias("least_expected"))


@book.query(
    "WITH p AS (SELECT p_partkey AS id, pow((p_partkey * 7919) % 1009 / 1009.0, 3) AS p FROM part), r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS r, count(*) OVER () AS m FROM p) SELECT id, round(p, 12) AS p, round(least(1.0, min(p * m / r) OVER (ORDER BY r DESC)), 12) AS adjusted FROM r", roles=False
)
def bh_adjust(spark, sf_dir):
    p = tables.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.pow((F.col("p_partkey") * 7919) % 1009 / 1009.0, F.lit(3.0)).alias("p"))
    return _rounded(tests.benjamini_hochberg(p, "p"), 12)


@book.query("SELECT a.name_a AS a, a.name_b AS b, round(r, 9) AS r FROM (SELECT 'quantity' AS name_a, 'price' AS name_b, corr(l_quantity, l_extendedprice) AS r FROM lineitem UNION ALL SELECT 'discount', 'tax', corr(l_discount, l_tax) FROM lineitem UNION ALL SELECT 'quantity', 'discount', corr(l_quantity, l_discount) FROM lineitem) a", roles=False)
def pearson_pairs(spark, sf_dir):
    line = tables.read(spark, sf_dir, "lineitem")
    pairs = (("quantity", "price", "l_quantity", "l_extendedprice"), ("discount", "tax", "l_discount", "l_tax"), ("quantity", "discount", "l_quantity", "l_discount"))
    one = line.agg(*(F.corr(x, y).alias(f"r{i}") for i, (*_, x, y) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"r{i}", 9).alias("r")) for i, (a, b, *_) in enumerate(pairs)))).alias("x")).select("x.*")


@book.query("WITH r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem)) SELECT count(*) AS n, round(corr(rx, ry), 9) AS r FROM r", roles=False)
def spearman_avg_rank(spark, sf_dir):
    out = tests.correlation(tables.read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", spearman=True)
    return out.select("n", F.round("r", 9).alias("r"))


@book.query("WITH m AS (SELECT avg(value) AS mu, var_pop(value) AS v FROM debts) SELECT round(count(*) / 6 * (pow(avg(pow(value - mu, 3)) / pow(any_value(v), 1.5), 2) + pow(avg(pow(value - mu, 4)) / pow(any_value(v), 2) - 3, 2) / 4), 4) AS jb FROM debts, m")
def jarque_bera(spark, sf_dir):
    return _rounded(tests.jarque_bera(tables.debts(spark, sf_dir), "value").select("jb"), 4)


@book.query(
    "WITH m AS (SELECT year(paid_on) * 12 + month(paid_on) AS m, count(*)::DOUBLE AS v FROM payments GROUP BY ALL), d AS (SELECT m, v - avg(v) OVER () AS d FROM m), l AS (SELECT k, sum(x.d * y) AS s FROM (SELECT d.d, k, lag(d.d, CAST(k AS INTEGER)) OVER (PARTITION BY k ORDER BY m) AS y FROM d, range(1, 5) t(k)) x GROUP BY k) SELECT CAST(k AS INTEGER) AS lag, round(s / (SELECT sum(d * d) FROM d), 9) AS r FROM l"
)
def autocorrelations(spark, sf_dir):
    m = tables.payments(spark, sf_dir).groupBy((F.year("paid_on") * 12 + F.month("paid_on")).alias("m")).agg(F.count("*").cast("double").alias("v"))
    return _rounded(tests.autocorrelation(m, "v", "m", 4).select("lag", "r"), 9)


@book.query(
    "WITH g AS (SELECT place, count(*) AS n, count(*) FILTER (WHERE balance > 0) AS hits FROM firms GROUP BY ALL), p AS (SELECT *, sum(hits) OVER () / sum(n) OVER () AS p FROM g) SELECT place, n, hits, round(hits / n, 9) AS share, round(greatest(0, p - 1.959963984540054 * sqrt(p * (1 - p) / n)), 9) AS low_95, round(least(1, p + 1.959963984540054 * sqrt(p * (1 - p) / n)), 9) AS high_95, round(greatest(0, p - 3.090232306167813 * sqrt(p * (1 - p) / n)), 9) AS low_998, round(least(1, p + 3.090232306167813 * sqrt(p * (1 - p) / n)), 9) AS high_998, abs(hits / n - p) > 3.090232306167813 * sqrt(p * (1 - p) / n) AS outside FROM p"
)
def funnel_limits(spark, sf_dir):
    g = tables.firms(spark, sf_dir).groupBy("place").agg(F.count("*").alias("n"), F.count_if(F.col("balance") > 0).alias("hits"))
    return _rounded(tests.funnel_limits(g, "hits", "n"), 9)


@book.query("SELECT 'x' AS term, round(regr_slope(l_extendedprice, l_quantity), 6) AS estimate FROM lineitem UNION ALL SELECT '(intercept)', round(regr_intercept(l_extendedprice, l_quantity), 6) FROM lineitem", roles=False)
def ols_line(spark, sf_dir):
    line = tables.read(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return _rounded(models.ols(line, "y", ["x"]).select("term", "estimate"))


@book.query()
def logit_open_debt(spark, sf_dir):
    d = tables.debts(spark, sf_dir).select((F.col("status") == "O").cast("int").alias("y"), F.log("value").alias("log_value"), (F.datediff(F.lit("2001-12-31").cast("date"), "enrolled") / 365.25).alias("age"), "firm_id")
    return models.logit(d, "y", ["log_value", "age"], cluster="firm_id")


@book.query()
def dunn_pairs(spark, sf_dir):
    return tests.dunn(tables.debts(spark, sf_dir), "value", "segment")


@book.query()
def icc_by_firm(spark, sf_dir):
    return models.icc(tables.debts(spark, sf_dir), "value", "firm_id")


@book.query()
def kmeans_embeddings(spark, sf_dir):
    assigned, _ = models.kmeans(tables.read(spark, sf_dir, "embeddings"), "embedding", 10, (1, 2), "vec_id")
    return assigned


@book.query()
def pca_embeddings(spark, sf_dir):
    scores, _ = models.principal_components(tables.read(spark, sf_dir, "embeddings"), "embedding", 3, "vec_id")
    return scores


_MONTHLY = "WITH m AS (SELECT segment, year(enrolled) * 12 + month(enrolled) AS m, count(*)::DOUBLE AS v FROM debts GROUP BY ALL), f AS (SELECT *, lag(v, 12) OVER w AS seasonal, lag(v) OVER w AS last FROM m WINDOW w AS (PARTITION BY segment ORDER BY m))"


def _monthly(spark, sf_dir):
    m = tables.debts(spark, sf_dir).groupBy("segment", (F.year("enrolled") * 12 + F.month("enrolled")).alias("m")).agg(F.count("*").cast("double").alias("v"))
    return models.seasonal_naive(m, ["segment"], "m", "v", 12)


@book.query(_MONTHLY + " SELECT segment, m, v, seasonal, last FROM f")
def naive_lags(spark, sf_dir):
    return _monthly(spark, sf_dir).select("segment", "m", "v", "seasonal", "last")


@book.query(
    _MONTHLY
    + " SELECT segment, count(*) AS n, round(100 * avg(abs(v - seasonal) / abs(v)), 9) AS mape, round(100 * avg(2 * abs(v - seasonal) / (abs(v) + abs(seasonal))), 9) AS smape, round(sqrt(avg((v - seasonal) * (v - seasonal))), 9) AS rmse, round(avg(abs(v - seasonal)), 9) AS mae, round(sum(abs(v - seasonal)) / sum(abs(v)), 9) AS wape FROM f WHERE seasonal IS NOT NULL GROUP BY segment"
)
def forecast_metrics(spark, sf_dir):
    return _rounded(models.forecast_metrics(_monthly(spark, sf_dir).where("seasonal is not null"), ["segment"], "v", "seasonal"), 9)


@book.query(
    _MONTHLY
    + ", d AS (SELECT segment, pow(v - seasonal, 2) - pow(v - last, 2) AS d FROM f WHERE seasonal IS NOT NULL) SELECT segment, count(*) AS n, round(avg(d) / sqrt(var_pop(d) / count(*)) * sqrt((count(*) - 1) / count(*)), 6) AS dm FROM d GROUP BY segment"
)
def dm_statistic(spark, sf_dir):
    e = _monthly(spark, sf_dir).where("seasonal is not null").select("segment", (F.col("v") - F.col("seasonal")).alias("a"), (F.col("v") - F.col("last")).alias("b"))
    return models.diebold_mariano(e, ["segment"], "a", "b").select("segment", "n", F.round("dm", 6).alias("dm"))


@book.query(
    _MONTHLY
    + ", d AS (SELECT segment, abs(v - seasonal) - abs(v - last) AS d FROM f WHERE seasonal IS NOT NULL), r AS (SELECT segment, d, rank() OVER (PARTITION BY segment ORDER BY abs(d)) + (count(*) OVER (PARTITION BY segment, abs(d)) - 1) / 2 AS r FROM d WHERE d <> 0) SELECT segment, count(*) AS n, least(sum(r) FILTER (WHERE d > 0), sum(r) FILTER (WHERE d < 0)) AS w FROM r GROUP BY segment"
)
def wilcoxon_pairs(spark, sf_dir):
    e = _monthly(spark, sf_dir).where("seasonal is not null").select("segment", F.abs(F.col("v") - F.col("seasonal")).alias("a"), F.abs(F.col("v") - F.col("last")).alias("b"))
    return models.wilcoxon_signed_rank(e, ["segment"], "a", "b").select("segment", "n", "w")


@book.query()
def ridge_walk_forward(spark, sf_dir):
    m = _monthly(spark, sf_dir).select("segment", "m", "v")
    return models.walk_forward_ridge(m, "segment", "m", "v", (1, 2, 12), 12)


@book.query()
def model_confidence_set(spark, sf_dir):
    m = _monthly(spark, sf_dir).where("seasonal is not null").groupBy("m").agg(F.avg(F.pow(F.col("v") - F.col("seasonal"), 2)).alias("seasonal"), F.avg(F.pow(F.col("v") - F.col("last"), 2)).alias("last"))
    return models.confidence_set(m.unpivot("m", ["seasonal", "last"], "model", "loss"), "model", "m", "loss")


@book.query(
    "WITH r AS (SELECT value, status, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS r, count(*) OVER () AS n FROM (SELECT round(value, -4) AS value, status FROM debts)), d AS (SELECT CAST(ceil(r * 10 / n) AS INTEGER) AS decile, value, status FROM r) SELECT decile, count(*) AS n, round(100.0 * count(*) FILTER (WHERE status = 'O') / count(*), 6)::DOUBLE AS percent_open, min(value) AS low, max(value) AS high FROM d GROUP BY decile"
)
def deciles(spark, sf_dir):
    d = tables.debts(spark, sf_dir).select(F.round("value", -4).alias("value"), "status")
    ranked = tests.value_ranks(d, "value", "status").withColumn("n", F.lit(d.count()))
    ranked = ranked.withColumn("decile", F.ceil(F.col("rank") * 10 / F.col("n")).cast("int"))
    share = F.round(100.0 * F.sum(F.when(F.col("g") == "O", F.col("c")).otherwise(0)) / F.sum("c"), 6)
    return ranked.groupBy("decile").agg(F.sum("c").alias("n"), share.alias("percent_open"), F.min("v").alias("low"), F.max("v").alias("high"))
