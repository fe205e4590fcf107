"""Further forms of statements: samples, draws, intervals, lookups, totals, ordering, casts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon import tables
from quillon.functions import bands
from quillon.operators import records
from quillon.operators.ranks import running
from quillon.plans.base import Book
from quillon.stats import models

book = Book()

book.sql(
    "except_all_both_ways",
    """WITH a AS (SELECT segment, status FROM debts), b AS (SELECT segment, status FROM debts WHERE debt_id IN (SELECT debt_id FROM payments WHERE line = 3))
SELECT 'only in a' AS side, segment, status, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) x GROUP BY segment, status
UNION ALL SELECT 'only in b', segment, status, CAST(count(*) AS BIGINT) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) y GROUP BY segment, status""",
)
book.sql("offset_page", "SELECT debt_id, value FROM debts ORDER BY value DESC, debt_id LIMIT 20 OFFSET 40")
book.sql(
    "nulls_first_and_last",
    """SELECT firm_id, row_number() OVER (PARTITION BY place ORDER BY v ASC NULLS LAST, firm_id) AS up, row_number() OVER (PARTITION BY place ORDER BY v DESC NULLS FIRST, firm_id) AS down
FROM (SELECT firm_id, place, CASE WHEN firm_id % 4 <> 0 THEN balance END AS v FROM firms) x""",
)
book.sql(
    "lookup_by_case",
    "SELECT r_name, CAST(count(*) AS BIGINT) AS n FROM debts LEFT JOIN region ON r_regionkey = CASE WHEN status = 'O' THEN 0 WHEN value > 200000 THEN 1 WHEN segment = '5-LOW' THEN 7 ELSE 2 END GROUP BY r_name",
)
book.sql(
    "total_row_by_union",
    """WITH d AS (SELECT segment, count(*) AS n, sum(CAST(value AS DECIMAL(18,2))) AS v FROM debts GROUP BY segment)
SELECT segment, CAST(n AS BIGINT) AS n, CAST(v AS DOUBLE) AS v FROM d UNION ALL SELECT 'TOTAL', CAST(sum(n) AS BIGINT), CAST(sum(v) AS DOUBLE) FROM d""",
)
book.sql(
    "mode_by_count",
    "SELECT firm_id, status, n FROM (SELECT firm_id, status, n, row_number() OVER (PARTITION BY firm_id ORDER BY n DESC, status) AS i FROM (SELECT firm_id, status, CAST(count(*) AS BIGINT) AS n FROM debts GROUP BY firm_id, status) x) y WHERE i = 1",
)
book.sql("any_value_of_dependent", "SELECT segment, any_value(substr(segment, 1, 1)) AS code, CAST(count(*) AS BIGINT) AS n FROM debts GROUP BY segment")
book.sql(
    "strings_in_order_with_repeats",
    "SELECT firm_id, listagg(status, '>') WITHIN GROUP (ORDER BY enrolled, debt_id) AS path FROM debts GROUP BY firm_id",
    "SELECT firm_id, string_agg(status, '>' ORDER BY enrolled, debt_id) AS path FROM debts GROUP BY firm_id",
)
book.sql(
    "monthly_difference",
    "WITH m AS (SELECT year(paid_on) * 12 + month(paid_on) AS m, sum(amount) AS paid FROM payments GROUP BY year(paid_on) * 12 + month(paid_on)) SELECT CAST(m AS INTEGER) AS m, CAST(paid - lag(paid) OVER (ORDER BY m) AS DOUBLE) AS diff, CAST(lag(paid, 12) OVER (ORDER BY m) AS DOUBLE) AS shifted FROM m",
)
book.sql(
    "casts_that_may_fail",
    "SELECT debt_id, CAST(try_cast(t AS DECIMAL(18,2)) AS DOUBLE) AS as_decimal, try_cast(t AS DOUBLE) AS as_double, try_cast(d AS DATE) AS as_date, CAST(try_cast(concat(d, ' 10:20:30') AS TIMESTAMP) AS STRING) AS as_time FROM (SELECT debt_id, CASE WHEN debt_id % 3 = 0 THEN 'x1' ELSE CAST(CAST(value AS DECIMAL(18,2)) AS STRING) END AS t, CASE WHEN debt_id % 5 = 0 THEN '2024-02-31' ELSE CAST(enrolled AS STRING) END AS d FROM debts) x",
    "SELECT debt_id, CAST(try_cast(t AS DECIMAL(18,2)) AS DOUBLE) AS as_decimal, try_cast(t AS DOUBLE) AS as_double, try_cast(d AS DATE) AS as_date, CAST(try_cast(d || ' 10:20:30' AS TIMESTAMP) AS VARCHAR) AS as_time FROM (SELECT debt_id, CASE WHEN debt_id % 3 = 0 THEN 'x1' ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS t, CASE WHEN debt_id % 5 = 0 THEN '2024-02-31' ELSE CAST(enrolled AS VARCHAR) END AS d FROM debts) x",
)
book.sql(
    "december_and_positive_bases",
    "SELECT year(paid_on) AS year, CAST(count(DISTINCT CASE WHEN amount > 0 THEN debt_id END) AS BIGINT) AS positive, CAST(count(DISTINCT CASE WHEN month(paid_on) = 12 THEN debt_id END) AS BIGINT) AS december, CAST(sum(amount) AS DOUBLE) AS paid, CAST(sum(CASE WHEN month(paid_on) = 12 THEN amount END) AS DOUBLE) AS paid_december FROM payments GROUP BY year(paid_on)",
)
book.sql(
    "decades",
    "SELECT CAST(floor(year(enrolled) / 10) * 10 AS BIGINT) AS decade, segment, CAST(count(*) AS BIGINT) AS n FROM debts GROUP BY CAST(floor(year(enrolled) / 10) * 10 AS BIGINT), segment",
)
book.sql(
    "parameters_of_one_row",
    "WITH p AS (SELECT max(enrolled) AS latest, 365 AS days FROM debts) SELECT segment, CAST(count(*) FILTER (WHERE datediff(latest, enrolled) > days) AS BIGINT) AS older, CAST(count(*) AS BIGINT) AS n FROM debts CROSS JOIN p GROUP BY segment",
    "WITH p AS (SELECT max(enrolled) AS latest, 365 AS days FROM debts) SELECT segment, CAST(count(*) FILTER (WHERE date_diff('day', enrolled, latest) > days) AS BIGINT) AS older, CAST(count(*) AS BIGINT) AS n FROM debts CROSS JOIN p GROUP BY segment",
)
book.sql(
    "seven_code_tables",
    """SELECT r.r_name AS region, sr.r_name AS supplier_region, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT p.p_brand) AS BIGINT) AS brands
FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey LEFT JOIN nation sn ON s.s_nationkey = sn.n_nationkey LEFT JOIN region sr ON sn.n_regionkey = sr.r_regionkey LEFT JOIN part p ON l.l_partkey = p.p_partkey GROUP BY r.r_name, sr.r_name""",
)
book.sql("all_but_some_columns", "SELECT * EXCEPT (value, enrolled) FROM debts", "SELECT * EXCLUDE (value, enrolled) FROM debts")
book.sql(
    "membership_in_either_list",
    "SELECT sector, CAST(count(*) AS BIGINT) AS n FROM firms WHERE name IN (SELECT c_name FROM customer WHERE c_acctbal > 9000) OR regexp_replace(name, '[^0-9]', '') IN (SELECT regexp_replace(s_name, '[^0-9]', '') FROM supplier) GROUP BY sector",
    "SELECT sector, CAST(count(*) AS BIGINT) AS n FROM firms WHERE name IN (SELECT c_name FROM customer WHERE c_acctbal > 9000) OR regexp_replace(name, '[^0-9]', '', 'g') IN (SELECT regexp_replace(s_name, '[^0-9]', '', 'g') FROM supplier) GROUP BY sector",
)
book.sql(
    "fraction_sample_by_hash",
    "SELECT debt_id FROM debts WHERE CAST(conv(substr(md5(concat('7:', debt_id)), 1, 8), 16, 10) AS BIGINT) % 20 = 0",
    "SELECT debt_id FROM debts WHERE CAST('0x' || substr(md5('7:' || debt_id), 1, 8) AS BIGINT) % 20 = 0",
)
book.sql(
    "validation_sample",
    "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang, hit ORDER BY md5(concat('v', doc_id)), doc_id) AS i, hit FROM (SELECT doc_id, lang, text LIKE '%@%' AS hit FROM documents) x) SELECT doc_id, lang, hit FROM r WHERE i <= 15",
    "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang, hit ORDER BY md5('v' || doc_id), doc_id) AS i, hit FROM (SELECT doc_id, lang, text LIKE '%@%' AS hit FROM documents) x) SELECT doc_id, lang, hit FROM r WHERE i <= 15",
)
book.sql(
    "monotone_by_size",
    """WITH b AS (SELECT segment, CASE WHEN value <= 100000 THEN 1 WHEN value <= 200000 THEN 2 ELSE 3 END AS level, count(*) AS n, count(*) FILTER (WHERE status = 'O') AS k FROM debts GROUP BY 1, 2),
o AS (SELECT segment, level, n, ln((k + 0.5D) / (n - k + 0.5D)) AS odds FROM b), l AS (SELECT segment, level, n, odds - lag(odds) OVER (PARTITION BY segment ORDER BY level) AS step FROM o)
SELECT segment, min(n) >= 5 AS publishable, CASE WHEN min(n) >= 5 THEN coalesce(min(step) > 0 OR max(step) < 0, true) END AS monotone FROM l GROUP BY segment""",
    """WITH b AS (SELECT segment, CASE WHEN value <= 100000 THEN 1 WHEN value <= 200000 THEN 2 ELSE 3 END AS level, count(*) AS n, count(*) FILTER (WHERE status = 'O') AS k FROM debts GROUP BY 1, 2),
o AS (SELECT segment, level, n, ln((k + 0.5) / (n - k + 0.5)) AS odds FROM b), l AS (SELECT segment, level, n, odds - lag(odds) OVER (PARTITION BY segment ORDER BY level) AS step FROM o)
SELECT segment, min(n) >= 5 AS publishable, CASE WHEN min(n) >= 5 THEN coalesce(min(step) > 0 OR max(step) < 0, true) END AS monotone FROM l GROUP BY segment""",
)
book.sql(
    "empirical_prediction_interval",
    """WITH m AS (SELECT segment, year(enrolled) * 12 + month(enrolled) AS m, CAST(count(*) AS DOUBLE) AS v FROM debts GROUP BY segment, year(enrolled) * 12 + month(enrolled)), r AS (SELECT a.segment, a.v - b.v AS e FROM m a JOIN m b ON a.segment = b.segment AND a.m = b.m + 12)
SELECT segment, CAST(count(*) AS BIGINT) AS n, percentile(e, 0.05) AS low, percentile(e, 0.95) AS high FROM r GROUP BY segment""",
    """WITH m AS (SELECT segment, year(enrolled) * 12 + month(enrolled) AS m, CAST(count(*) AS DOUBLE) AS v FROM debts GROUP BY ALL), r AS (SELECT a.segment, a.v - b.v AS e FROM m a JOIN m b ON a.segment = b.segment AND a.m = b.m + 12)
SELECT segment, count(*) AS n, quantile_cont(e, 0.05) AS low, quantile_cont(e, 0.95) AS high FROM r GROUP BY segment""",
)
book.sql(
    "fisher_z_interval",
    "WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem) SELECT CAST(n AS BIGINT) AS n, round(r, 9) AS r, round(tanh(atanh(r) - 1.959963984540054D / sqrt(n - 3)), 9) AS low, round(tanh(atanh(r) + 1.959963984540054D / sqrt(n - 3)), 9) AS high FROM c",
    "WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem) SELECT CAST(n AS BIGINT) AS n, round(r, 9) AS r, round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 9) AS low, round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 9) AS high FROM c",
)

#: A draw of the bootstrap is a number from a digest of (draw, position), so reruns and engines agree. The series is a row per month.
_SERIES = "m AS (SELECT year(paid_on) * 12 + month(paid_on) AS m, CAST(sum(amount) AS DOUBLE) AS v, CAST(count(*) AS DOUBLE) AS w FROM payments GROUP BY year(paid_on) * 12 + month(paid_on)), s AS (SELECT row_number() OVER (ORDER BY m) - 1 AS i, v, w FROM m), n AS (SELECT count(*) AS n FROM s)"
_PICK = {"spark": "CAST(conv(substr(md5(concat({a}, ':', {b})), 1, 8), 16, 10) AS BIGINT)", "duck": "CAST('0x' || substr(md5({a} || ':' || {b}), 1, 8) AS BIGINT)"}


def _bootstrap_mean(engine: str) -> str:
    pick = _PICK[engine].format(a="b", b="j")
    draws = "SELECT b, explode(sequence(0, n - 1)) AS j, n FROM (SELECT explode(sequence(0, 199)) AS b, n FROM n) x" if engine == "spark" else "SELECT b, unnest(range(n)) AS j, n FROM (SELECT unnest(range(200)) AS b, n FROM n) x"
    quantile = "percentile" if engine == "spark" else "quantile_cont"
    return f"WITH {_SERIES}, d AS ({draws}), e AS (SELECT b, avg(v) AS mean FROM (SELECT b, {pick} % n AS i FROM d) y JOIN s USING (i) GROUP BY b) SELECT CAST(count(*) AS BIGINT) AS draws, round({quantile}(mean, 0.025), 4) AS low, round({quantile}(mean, 0.975), 4) AS high, round((SELECT avg(v) FROM s), 4) AS mean FROM e"


def _block_bootstrap(engine: str) -> str:
    pick = _PICK[engine].format(a="b", b="k")
    if engine == "spark":
        blocks = "SELECT b, explode(sequence(0, CAST(floor((n - 1) / 12) AS INT))) AS k, n FROM (SELECT explode(sequence(0, 998)) AS b, n FROM n) x"
        places = f"SELECT b, {pick} % (n - 11) + o AS i, k * 12 + o AS spot, n FROM (SELECT b, k, n, explode(sequence(0, 11)) AS o FROM k) y"
    else:
        blocks = "SELECT b, unnest(range((n - 1) // 12 + 1)) AS k, n FROM (SELECT unnest(range(999)) AS b, n FROM n) x"
        places = f"SELECT b, {pick} % (n - 11) + o AS i, k * 12 + o AS spot, n FROM (SELECT b, k, n, unnest(range(12)) AS o FROM k) y"
    quantile = "percentile" if engine == "spark" else "quantile_cont"
    return f"WITH {_SERIES}, k AS ({blocks}), p AS ({places}), e AS (SELECT b, corr(v, w) AS r FROM p JOIN s USING (i) WHERE spot < n GROUP BY b) SELECT CAST(count(*) AS BIGINT) AS draws, round({quantile}(r, 0.025), 6) AS low, round({quantile}(r, 0.975), 6) AS high FROM e"


book.sql("bootstrap_mean_interval", _bootstrap_mean("spark"), _bootstrap_mean("duck"))
book.sql("block_bootstrap_correlation", _block_bootstrap("spark"), _block_bootstrap("duck"))


@book.query(
    "WITH r AS (SELECT segment, debt_id, row_number() OVER (PARTITION BY segment ORDER BY debt_id) AS i, count(*) OVER (PARTITION BY segment) AS n FROM debts), d AS (SELECT segment, n, j, CAST('0x' || substr(md5(segment || ':' || j), 1, 8) AS BIGINT) % n + 1 AS i FROM (SELECT DISTINCT segment, n FROM r), range(1, 41) t(j)) SELECT d.segment, j AS draw, r.debt_id FROM d JOIN r ON r.segment = d.segment AND r.i = d.i"
)
def draws_with_replacement(spark, sf_dir):
    """40 draws of each segment; positions come from ranges of debt_id, so no segment is sorted in one task."""
    rows = running(tables.debts(spark, sf_dir).select("segment", "debt_id"), ["segment"], "debt_id", {"i": F.lit(1).cast("long")})
    sizes = rows.groupBy("segment").agg(F.max("i_all").alias("n"))
    draws = sizes.withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(40).cast("long"))))
    number = F.conv(F.substring(F.md5(F.concat_ws(":", "segment", "draw")), 1, 8), 16, 10).cast("long")
    draws = draws.select("segment", "draw", (number % F.col("n") + 1).alias("i"))
    return rows.join(draws, ["segment", "i"]).select("segment", "draw", "debt_id")


@book.query(
    "WITH r AS (SELECT segment, value, count(*) OVER (PARTITION BY segment) AS n, row_number() OVER (PARTITION BY segment ORDER BY value, debt_id) AS i FROM debts) SELECT segment, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM r WHERE n - i + 1 > ceil(n * 0.01) GROUP BY segment"
)
def without_top_share(spark, sf_dir):
    rows = running(tables.debts(spark, sf_dir), ["segment"], "value", {"i": F.lit(1).cast("long")}, "debt_id")
    kept = rows.where(F.col("i_all") - F.col("i") + 1 > F.ceil(F.col("i_all") * 0.01))
    return kept.groupBy("segment").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


@book.query("SELECT debt_id, CASE WHEN enrolled BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' THEN enrolled END AS enrolled FROM debts")
def null_if_implausible(spark, sf_dir):
    return tables.debts(spark, sf_dir).select("debt_id", bands.plausible(F.col("enrolled"), "1996-01-01", "2000-12-31").alias("enrolled"))


@book.query("WITH m AS (SELECT event_id, user_id, md5(user_id || '|' || event_type) AS move_id, ts FROM events) SELECT move_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY move_id ORDER BY ts DESC, event_id DESC) AS i FROM m) WHERE i = 1", roles=False)
def last_of_each_move(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events").withColumn("move_id", F.md5(F.concat_ws("|", F.col("user_id").cast("string"), "event_type")))
    return records.dedupe_moves(e, [F.desc("ts"), F.desc("event_id")]).select("move_id", "event_id")


@book.query("SELECT x.name AS variable, round(1 / (1 - x.r * x.r), 6) AS vif FROM (SELECT 'l_quantity' AS name, corr(l_quantity, l_extendedprice) AS r FROM lineitem UNION ALL SELECT 'l_extendedprice', corr(l_quantity, l_extendedprice) FROM lineitem) x", roles=False)
def variance_inflation(spark, sf_dir):
    out = models.vif(tables.read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])
    return out.select(F.col(out.columns[0]).alias("variable"), F.round(out.columns[1], 6).alias("vif"))
