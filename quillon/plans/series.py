"""Monthly, weekly and daily series: spines, seasonality, indices, gaps, quality flags."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon import tables
from quillon.functions import bands
from quillon.operators import panel
from quillon.plans.base import Book

book = Book()

book.sql(
    "monthly_full_outer",
    """WITH e AS (SELECT CAST(date_trunc('month', enrolled) AS DATE) AS month, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS enrolled_value FROM debts GROUP BY 1), p AS (SELECT CAST(date_trunc('month', paid_on) AS DATE) AS month, CAST(sum(amount) AS DOUBLE) AS paid FROM payments GROUP BY 1)
SELECT coalesce(e.month, p.month) AS month, coalesce(enrolled_value, 0) AS enrolled_value, coalesce(paid, 0) AS paid FROM e FULL OUTER JOIN p ON e.month = p.month""",
)


@book.query(
    "WITH p AS (SELECT paid_on AS day, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS paid FROM payments GROUP BY ALL) SELECT CAST(s.day AS DATE) AS day, coalesce(n, 0) AS n, coalesce(paid, 0) AS paid FROM (SELECT unnest(generate_series((SELECT min(day) FROM p), (SELECT max(day) FROM p), INTERVAL 1 DAY)) AS day) s LEFT JOIN p ON p.day = s.day"
)
def calendar_spine_daily(spark, sf_dir):
    return panel.daily_spine(tables.payments(spark, sf_dir), "paid_on", {"n": F.count("*"), "paid": F.sum("amount").cast("double")})


@book.query("SELECT CAST(date_trunc('week', paid_on) + INTERVAL 6 DAY AS DATE) AS week, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS paid FROM payments GROUP BY ALL")
def weekly_sunday(spark, sf_dir):
    return tables.payments(spark, sf_dir).groupBy(bands.week_ending_sunday(F.col("paid_on")).alias("week")).agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("paid"))


book.sql(
    "business_days",
    "SELECT weekday(paid_on) AS weekday, CAST(count(*) AS BIGINT) AS n FROM payments WHERE weekday(paid_on) < 5 GROUP BY weekday(paid_on)",
    "SELECT CAST(isodow(paid_on) - 1 AS INTEGER) AS weekday, count(*) AS n FROM payments WHERE isodow(paid_on) < 6 GROUP BY ALL",
)
book.sql("iso_week_and_parts", "SELECT year(enrolled) AS y, month(enrolled) AS m, weekofyear(enrolled) AS w, CAST(count(*) AS BIGINT) AS n FROM debts GROUP BY 1, 2, 3", "SELECT CAST(year(enrolled) AS INTEGER) AS y, CAST(month(enrolled) AS INTEGER) AS m, CAST(weekofyear(enrolled) AS INTEGER) AS w, count(*) AS n FROM debts GROUP BY 1, 2, 3")
book.sql(
    "seasonal_index",
    "WITH m AS (SELECT year(paid_on) AS y, month(paid_on) AS m, CAST(sum(amount) AS DOUBLE) AS paid FROM payments WHERE year(paid_on) BETWEEN 1995 AND 2000 GROUP BY year(paid_on), month(paid_on)) SELECT DISTINCT m AS month, round(avg(CAST(paid AS DECIMAL(18,2))) OVER (PARTITION BY m) / avg(CAST(paid AS DECIMAL(18,2))) OVER (), 4) AS season FROM m",
    "WITH m AS (SELECT year(paid_on) AS y, month(paid_on) AS m, CAST(sum(amount) AS DOUBLE) AS paid FROM payments WHERE year(paid_on) BETWEEN 1995 AND 2000 GROUP BY ALL) SELECT DISTINCT m AS month, round(avg(paid) OVER (PARTITION BY m) / avg(paid) OVER (), 4) AS season FROM m",
)
book.queries["seasonal_index"] = (lambda q: lambda spark, d: q(spark, d).withColumn("season", F.col("season").cast("double")))(book.queries["seasonal_index"])


@book.query(
    """WITH e AS (SELECT l_orderkey AS debt_id, min(year(l_shipdate) * 12 + month(l_shipdate)) AS event_month FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), w AS (SELECT year(paid_on) * 12 + month(paid_on) - event_month AS k, CAST(sum(amount) AS DOUBLE) AS paid FROM payments JOIN e USING (debt_id) GROUP BY ALL)
SELECT CAST(k AS INTEGER) AS k, round(100 * paid / avg(paid) FILTER (WHERE k < 0) OVER (), 6) AS indexed FROM w WHERE k BETWEEN -12 AND 12"""
)
def event_window_index(spark, sf_dir):
    line = tables.read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    month = lambda c: F.year(c) * 12 + F.month(c)
    e = line.groupBy(F.col("l_orderkey").alias("debt_id")).agg(F.min(month("l_shipdate")).alias("at"))
    w = tables.payments(spark, sf_dir).join(e, "debt_id").groupBy((month("paid_on") - F.col("at")).alias("k")).agg(F.sum("amount").cast("double").alias("paid")).where("k between -12 and 12")
    base = F.avg(F.when(F.col("k") < 0, F.col("paid"))).over(Window.partitionBy())
    return w.select("k", F.round(100 * F.col("paid") / base, 6).alias("indexed"))


_EVENTS = "WITH v AS (SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN value END AS v, ts FROM events)"


@book.query(_EVENTS + " SELECT event_id, user_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS filled FROM v")
def forward_fill(spark, sf_dir):
    v = tables.read(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "click", F.col("value")).alias("v")).withColumn("o", F.struct("ts", "event_id"))
    return v.select("event_id", "user_id", panel.forward_fill("v", "o", ["user_id"]).alias("filled"))


@book.query(
    "WITH m AS (SELECT year(paid_on) * 12 + month(paid_on) AS m, round((count(*) % 7) / 10.0, 1) AS r FROM payments GROUP BY ALL), c AS (SELECT m, exp(sum(ln(1 + r / 100)) OVER (ORDER BY m ROWS UNBOUNDED PRECEDING)) AS x FROM m) SELECT m, round(x / (SELECT x FROM c WHERE m = 2000 * 12 + 12), 9) AS price FROM c"
)
def price_index_chain(spark, sf_dir):
    p = tables.payments(spark, sf_dir).groupBy((F.year("paid_on") * 12 + F.month("paid_on")).alias("m")).agg(F.round((F.count("*") % 7) / 10.0, 1).alias("r"))
    level, rebase = panel.chained_index("r", "m", F.col("m") == 2000 * 12 + 12)
    return p.withColumn("x", level).select("m", F.round(rebase(F.col("x")), 9).alias("price"))


_MONTHS = "WITH m AS (SELECT CAST(date_trunc('month', enrolled) AS DATE) AS month, CAST(count(*) AS BIGINT) AS n FROM debts GROUP BY ALL)"


@book.query(
    _MONTHS
    + ", s AS (SELECT CAST(unnest(generate_series((SELECT min(month) FROM m), (SELECT max(month) FROM m), INTERVAL 1 MONTH)) AS DATE) AS month), j AS (SELECT s.month, n, CASE WHEN count(n) OVER w >= 3 THEN quantile_cont(CAST(n AS DOUBLE), 0.5) OVER w END AS median7 FROM s LEFT JOIN m USING (month) WINDOW w AS (ORDER BY s.month ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) SELECT month, n, median7, n IS NULL AS absent, coalesce(n < 0.8 * median7, false) AS partial FROM j"
)
def quality_flags_months(spark, sf_dir):
    m = tables.debts(spark, sf_dir).groupBy(F.trunc("enrolled", "month").alias("month")).agg(F.count("*").alias("n"))
    return panel.month_quality(m, "n")


book.sql(
    "last_complete_snapshot",
    """WITH m AS (SELECT CAST(date_trunc('month', enrolled) AS DATE) AS month, count(*) AS n FROM debts GROUP BY 1), w AS (SELECT month, n, avg(n) OVER (ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS before FROM m)
SELECT max(month) FILTER (WHERE n >= 0.8 * before) AS snapshot, CAST(count(*) FILTER (WHERE n < 0.8 * before) AS BIGINT) AS partial FROM w""",
)
book.sql(
    "increase_by_part",
    """WITH y AS (SELECT segment, CAST(sum(CASE WHEN year(enrolled) = 1999 THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS a, CAST(sum(CASE WHEN year(enrolled) = 2000 THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS b FROM debts GROUP BY segment), t AS (SELECT CAST(sum(CAST(b - a AS DECIMAL(18,2))) AS DOUBLE) AS d FROM y)
SELECT segment, a AS before, b AS after, round((b - a) / d, 6) AS part FROM y CROSS JOIN t""",
)
book.sql(
    "running_sum_and_product",
    "SELECT segment, year, n, CAST(sum(n) OVER (PARTITION BY segment ORDER BY year) AS BIGINT) AS running, round(exp(sum(ln(1 + n / 10000.0D)) OVER (PARTITION BY segment ORDER BY year)), 9) AS product, CAST(count(*) OVER (PARTITION BY n % 3) AS BIGINT) AS peers FROM (SELECT segment, year(enrolled) AS year, count(*) AS n FROM debts GROUP BY segment, year(enrolled))",
    "SELECT segment, year, n, CAST(sum(n) OVER (PARTITION BY segment ORDER BY year) AS BIGINT) AS running, round(exp(sum(ln(1 + n / 10000.0)) OVER (PARTITION BY segment ORDER BY year)), 9) AS product, count(*) OVER (PARTITION BY n % 3) AS peers FROM (SELECT segment, year(enrolled) AS year, count(*) AS n FROM debts GROUP BY ALL)",
)
book.sql("two_way_row_numbers", "SELECT firm_id, debt_id, row_number() OVER (PARTITION BY firm_id ORDER BY enrolled, debt_id) AS from_first, row_number() OVER (PARTITION BY firm_id ORDER BY enrolled DESC, debt_id DESC) AS from_last, CAST(count(*) OVER (PARTITION BY firm_id) AS BIGINT) AS n FROM debts")
book.sql("month_arithmetic", "SELECT ym, CAST(((ym DIV 100) * 12 + ym % 100 - 1 + 5) DIV 12 * 100 + ((ym DIV 100) * 12 + ym % 100 - 1 + 5) % 12 + 1 AS INT) AS later, CAST(count(*) AS BIGINT) AS n FROM (SELECT year(enrolled) * 100 + month(enrolled) AS ym FROM debts) GROUP BY ym", "SELECT CAST(year(enrolled) * 100 + month(enrolled) AS INTEGER) AS ym, CAST(strftime(date_trunc('month', min(enrolled)) + INTERVAL 5 MONTH, '%Y%m') AS INTEGER) AS later, count(*) AS n FROM debts GROUP BY 1")
book.sql("duration_half_even", "SELECT debt_id, CAST(bround(datediff(DATE '2001-12-31', enrolled) / 30.44D, 2) AS DOUBLE) AS months, floor(year(enrolled) / 10) * 10 AS decade FROM debts", "SELECT debt_id, round_even(date_diff('day', enrolled, DATE '2001-12-31') / 30.44::DOUBLE, 2) AS months, CAST(year(enrolled) // 10 * 10 AS BIGINT) AS decade FROM debts")
book.sql("annual_mean_and_december", "SELECT year(month) AS year, round(avg(v), 4) AS mean, max(CASE WHEN month(month) = 12 THEN v END) AS december FROM (SELECT CAST(date_trunc('month', enrolled) AS DATE) AS month, CAST(count(*) AS DOUBLE) AS v FROM debts GROUP BY 1) GROUP BY year(month)")
