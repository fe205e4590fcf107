"""Concentration, distributions, aggregates and joins over the portfolio."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon import tables
from quillon.functions import ids
from quillon.operators import concentration, joins
from quillon.plans.base import Book

book = Book()


def _firm_values(spark: SparkSession, sf_dir: str, by: str = "segment") -> DataFrame:
    return tables.debts(spark, sf_dir).groupBy(by, "firm_id").agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("value"))


_UNITS = "WITH u AS (SELECT segment, firm_id, sum(CAST(value AS DECIMAL(18,2))) AS value FROM debts GROUP BY ALL)"
_GINI = _UNITS + ", r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY value, firm_id) AS i FROM u) SELECT segment, count(*) AS units, round(2 * CAST(sum(CAST(i * value AS DECIMAL(38,4))) AS DOUBLE) / (count(*) * CAST(sum(value) AS DOUBLE)) - (count(*) + 1) / count(*), 9) AS gini FROM r GROUP BY segment"


@book.query(_GINI)
def gini_by_segment(spark, sf_dir):
    return concentration.gini(_firm_values(spark, sf_dir), "value", ["segment"], "firm_id").withColumn("gini", F.round("gini", 9))


@book.query(_GINI)
def gini_from_value_counts(spark, sf_dir):
    return concentration.gini_by_value(_firm_values(spark, sf_dir), "value", ["segment"]).withColumn("gini", F.round("gini", 9))


@book.query(
    _UNITS
    + """, r AS (SELECT segment, row_number() OVER w AS i, CAST(sum(value) OVER (PARTITION BY segment ORDER BY value, firm_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS c, count(*) OVER (PARTITION BY segment) AS n, CAST(sum(value) OVER (PARTITION BY segment) AS DOUBLE) AS s FROM u WINDOW w AS (PARTITION BY segment ORDER BY value, firm_id)),
t AS (SELECT segment, n, (c + lag(c) OVER (PARTITION BY segment ORDER BY i)) / 2 / s / n AS area FROM r) SELECT segment, any_value(n) AS units, round(1 - 2 * sum(area), 7) AS gini_trapezoid FROM t GROUP BY segment"""
)
def gini_by_trapezoids(spark, sf_dir):
    return concentration.gini_trapezoid(_firm_values(spark, sf_dir), "value", ["segment"], "firm_id").withColumn("gini_trapezoid", F.round("gini_trapezoid", 7))


_TOP = _UNITS + ", r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY value DESC, firm_id) AS i, {k} AS k FROM u) SELECT segment, CAST(max(k) AS BIGINT) AS top_units, round(CAST(sum(value) FILTER (WHERE i <= k) AS DOUBLE) / CAST(sum(value) AS DOUBLE), 9) AS top_share FROM r GROUP BY segment"


@book.query(_TOP.format(k="greatest(1, ceil(count(*) OVER (PARTITION BY segment) * 0.01))"))
def top_share_ceil(spark, sf_dir):
    return concentration.top_share(_firm_values(spark, sf_dir), "value", ["segment"], "firm_id", 0.01).withColumn("top_share", F.round("top_share", 9))


@book.query(_TOP.format(k="greatest(1, round_even(count(*) OVER (PARTITION BY segment) * 0.05, 0))"))
def top_share_half_even(spark, sf_dir):
    return concentration.top_share(_firm_values(spark, sf_dir), "value", ["segment"], "firm_id", 0.05, "round").withColumn("top_share", F.round("top_share", 9))


@book.query(
    _UNITS
    + ", r AS (SELECT segment, coalesce(sum(value) OVER (PARTITION BY segment ORDER BY value DESC, firm_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(value) OVER (PARTITION BY segment) AS s FROM u) SELECT segment, count(*) AS units, count(*) FILTER (WHERE CAST(b AS DOUBLE) < 0.5 * CAST(s AS DOUBLE)) AS units_needed FROM r GROUP BY segment"
)
def units_for_half(spark, sf_dir):
    return concentration.units_for(_firm_values(spark, sf_dir), "value", ["segment"], "firm_id")


@book.query(
    _UNITS
    + ", r AS (SELECT segment, row_number() OVER w AS i, count(*) OVER (PARTITION BY segment) AS n, CAST(sum(value) OVER (PARTITION BY segment ORDER BY value, firm_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS c, CAST(sum(value) OVER (PARTITION BY segment) AS DOUBLE) AS s FROM u WINDOW w AS (PARTITION BY segment ORDER BY value, firm_id)) SELECT segment, CAST(i * 10 // n AS BIGINT) AS point, round(i / n, 9) AS unit_share, round(c / s, 9) AS value_share FROM r WHERE i * 10 // n > (i - 1) * 10 // n"
)
def lorenz_points(spark, sf_dir):
    out = concentration.lorenz(_firm_values(spark, sf_dir), "value", ["segment"], "firm_id")
    return out.select("segment", "point", F.round("unit_share", 9).alias("unit_share"), F.round("value_share", 9).alias("value_share"))


@book.query(
    "WITH u AS (SELECT firm_id, year(enrolled) AS year, sum(CAST(value AS DECIMAL(18,2))) AS v FROM debts GROUP BY ALL), t AS (SELECT firm_id, year FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY v DESC, firm_id) AS i, count(*) OVER (PARTITION BY year) AS n FROM u) WHERE i <= greatest(1, ceil(n * 0.05))) SELECT a.year, count(*) AS top_units, count(b.firm_id) AS retained FROM t a LEFT JOIN t b ON a.firm_id = b.firm_id AND b.year = a.year + 1 GROUP BY a.year"
)
def top1_retention(spark, sf_dir):
    u = tables.debts(spark, sf_dir).groupBy("firm_id", F.year("enrolled").alias("year")).agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("v"))
    return concentration.retention(u, "firm_id", "year", "v", 0.05)


@book.query("WITH n AS (SELECT segment, status, count(*) AS n FROM debts GROUP BY ALL), p AS (SELECT segment, n / sum(n) OVER (PARTITION BY segment) AS p FROM n) SELECT segment, round(-sum(p * ln(p)), 9) AS entropy, count(*) AS classes FROM p GROUP BY segment")
def entropy(spark, sf_dir):
    n = tables.debts(spark, sf_dir).groupBy("segment", "status").agg(F.count("*").alias("n"))
    return concentration.entropy(n, "n", ["segment"]).withColumn("entropy", F.round("entropy", 9))


book.sql(
    "jaccard_of_id_sets",
    """WITH a AS (SELECT DISTINCT firm_id FROM debts WHERE year(enrolled) = 1997), b AS (SELECT DISTINCT firm_id FROM debts WHERE year(enrolled) = 1998)
SELECT CAST(count(a.firm_id) AS BIGINT) AS left_ids, CAST(count(b.firm_id) AS BIGINT) AS right_ids, CAST(sum(CASE WHEN a.firm_id = b.firm_id THEN 1 ELSE 0 END) AS BIGINT) AS common, round(CAST(sum(CASE WHEN a.firm_id = b.firm_id THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 9) AS jaccard FROM a FULL OUTER JOIN b ON a.firm_id = b.firm_id""",
)
book.sql(
    "multi_unit_ownership",
    """WITH k AS (SELECT firm_id, count(*) AS n FROM debts GROUP BY firm_id) SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' ELSE '>20' END AS debts_held, CAST(count(*) AS BIGINT) AS firms, CAST(sum(n) AS BIGINT) AS debts FROM k
GROUP BY CASE WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' ELSE '>20' END""",
)
book.sql(
    "mode_by_weight",
    """WITH w AS (SELECT firm_id, segment, sum(CAST(value AS DECIMAL(18,2))) AS v FROM debts GROUP BY firm_id, segment), r AS (SELECT *, row_number() OVER (PARTITION BY firm_id ORDER BY v DESC, segment) AS i FROM w) SELECT segment, CAST(count(*) AS BIGINT) AS firms FROM r WHERE i = 1 GROUP BY segment""",
)
book.sql(
    "weighted_mean",
    """SELECT segment, round(CAST(sum(CAST(2001 - year(enrolled) AS DECIMAL(10,0)) * CAST(value AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 9) AS mean_age FROM debts GROUP BY segment""",
)
book.sql("two_level_mean_of_counts", "WITH m AS (SELECT year(enrolled) AS y, month(enrolled) AS m, count(*) AS n FROM debts GROUP BY year(enrolled), month(enrolled)) SELECT m AS month, round(avg(n), 6) AS mean_debts, CAST(max(n) AS BIGINT) AS most FROM m GROUP BY m")
book.sql("group_by_all", "SELECT segment, status, CAST(count(*) AS BIGINT) AS n, min(enrolled) AS first_day, max(enrolled) AS last_day FROM debts GROUP BY ALL")
book.sql("group_by_ordinal_having", "SELECT firm_id % 10 AS digit, segment, CAST(count(*) AS BIGINT) AS n FROM debts GROUP BY 1, 2 HAVING count(*) > 10")
book.sql(
    "distinct_with_null_as_value",
    "SELECT segment, CAST(count(DISTINCT s) + max(CASE WHEN s IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS values_seen FROM (SELECT segment, CASE WHEN status <> 'P' THEN status END AS s FROM debts) t GROUP BY segment",
)
book.sql(
    "distinct_strings_in_order",
    "SELECT firm_id, listagg(DISTINCT segment, '|') WITHIN GROUP (ORDER BY segment) AS segments, sort_array(collect_set(status)) AS states FROM debts GROUP BY firm_id",
    "SELECT firm_id, string_agg(DISTINCT segment, '|' ORDER BY segment) AS segments, list_sort(list_distinct(list(status))) AS states FROM debts GROUP BY firm_id",
)
book.sql("pivot_sum", "SELECT * FROM (SELECT year(enrolled) AS year, status, CAST(1 AS BIGINT) AS one FROM debts) PIVOT (sum(one) FOR status IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT year(enrolled) AS year, CAST(sum(1) FILTER (WHERE status = 'F') AS BIGINT) AS f, CAST(sum(1) FILTER (WHERE status = 'O') AS BIGINT) AS o, CAST(sum(1) FILTER (WHERE status = 'P') AS BIGINT) AS p FROM debts GROUP BY ALL")


@book.query("SELECT firm_id, name AS measure, value FROM (SELECT firm_id, count(*)::DOUBLE AS debts, max(value) AS largest, min(value) AS smallest FROM debts GROUP BY ALL) UNPIVOT (value FOR name IN (debts, largest, smallest))")
def unpivot_measures(spark, sf_dir):
    wide = tables.debts(spark, sf_dir).groupBy("firm_id").agg(F.count("*").cast("double").alias("debts"), F.max("value").alias("largest"), F.min("value").alias("smallest"))
    return wide.unpivot("firm_id", ["debts", "largest", "smallest"], "measure", "value")


@book.query("SELECT segment, count(*) FILTER (WHERE status = 'F') AS \"F\", count(*) FILTER (WHERE status = 'O') AS \"O\", count(*) FILTER (WHERE status = 'P') AS \"P\" FROM debts GROUP BY segment")
def crosstab_counts(spark, sf_dir):
    return tables.debts(spark, sf_dir).groupBy("segment").pivot("status", ["F", "O", "P"]).count().fillna(0)


book.sql("conditional_sums", "SELECT segment, CAST(count(*) FILTER (WHERE value > 200000) AS BIGINT) AS large, CAST(coalesce(sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE status = 'O'), 0) AS DOUBLE) AS open_value, CAST(sum(CASE WHEN status = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS closed FROM debts GROUP BY segment")
book.sql(
    "quantile_bundle",
    "SELECT segment, round(percentile(value, 0.5), 4) AS median, round(percentile(value, 0.9), 6) AS p90, max(value) AS top, round(avg(CASE WHEN value < 50000 THEN 1.0D ELSE 0.0D END), 6) AS share_small, round(stddev_samp(value), 4) AS sd FROM debts GROUP BY segment",
    "SELECT segment, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.9), 6) AS p90, max(value) AS top, round(avg(CASE WHEN value < 50000 THEN 1.0 ELSE 0.0 END), 6) AS share_small, round(stddev_samp(value), 4) AS sd FROM debts GROUP BY segment",
)


@book.query("WITH r AS (SELECT segment, value, row_number() OVER (PARTITION BY segment ORDER BY value) AS i, count(*) OVER (PARTITION BY segment) AS n FROM debts) SELECT segment, max(value) FILTER (WHERE i = round_even((n - 1) * 0.25, 0) + 1) AS q25, max(value) FILTER (WHERE i = round_even((n - 1) * 0.9, 0) + 1) AS q90 FROM r GROUP BY segment")
def quantile_nearest(spark, sf_dir):
    n = Window.partitionBy("segment")
    r = tables.debts(spark, sf_dir).select("segment", "value", F.row_number().over(n.orderBy("value")).alias("i"), F.count("*").over(n).alias("n"))
    at = lambda q: F.max(F.when(F.col("i") == F.bround((F.col("n") - 1) * F.lit(q), 0) + 1, F.col("value")))
    return r.groupBy("segment").agg(at(0.25).alias("q25"), at(0.9).alias("q90"))


book.sql(
    "skew_and_kurtosis",
    "SELECT status, round(skewness(value), 6) AS skew, round(kurtosis(value), 6) AS excess FROM debts GROUP BY status",
    "WITH m AS (SELECT status, avg(value) AS mu, var_pop(value) AS v, count(*) AS n FROM debts GROUP BY status) SELECT status, round(any_value(pow(v, -1.5)) * avg(pow(value - mu, 3)), 6) AS skew, round(any_value(pow(v, -2)) * avg(pow(value - mu, 4)) - 3, 6) AS excess FROM debts JOIN m USING (status) GROUP BY status",
)
book.sql(
    "histogram",
    "SELECT width_bucket(value, 0, 500000, 20) AS bin, CAST(count(*) AS BIGINT) AS n FROM debts GROUP BY width_bucket(value, 0, 500000, 20)",
    "SELECT CAST(CASE WHEN value >= 500000 THEN 21 WHEN value < 0 THEN 0 ELSE floor(value / 25000) + 1 END AS BIGINT) AS bin, count(*) AS n FROM debts GROUP BY ALL",
)
book.sql(
    "histogram_two_dimensions",
    "SELECT CAST(least(floor(value / 50000), 9) AS BIGINT) AS vbin, CAST(floor(datediff(enrolled, DATE '1995-01-01') / 365) AS BIGINT) AS abin, CASE WHEN count(*) >= 5 THEN CAST(count(*) AS BIGINT) END AS n FROM debts GROUP BY 1, 2",
    "SELECT CAST(least(floor(value / 50000), 9) AS BIGINT) AS vbin, CAST(floor(date_diff('day', DATE '1995-01-01', enrolled) / 365) AS BIGINT) AS abin, CASE WHEN count(*) >= 5 THEN CAST(count(*) AS BIGINT) END AS n FROM debts GROUP BY 1, 2",
)
book.sql(
    "box_statistics",
    "SELECT segment, round(percentile(value, 0.25), 4) AS q1, round(percentile(value, 0.5), 4) AS q2, round(percentile(value, 0.75), 4) AS q3, min(value) AS low, max(value) AS high FROM debts GROUP BY segment",
    "SELECT segment, round(quantile_cont(value, 0.25), 4) AS q1, round(quantile_cont(value, 0.5), 4) AS q2, round(quantile_cont(value, 0.75), 4) AS q3, min(value) AS low, max(value) AS high FROM debts GROUP BY segment",
)


@book.query("SELECT status, CAST(q AS DOUBLE) AS q, round(v, 4) AS v FROM (SELECT status, unnest([0.1, 0.25, 0.5, 0.75, 0.9]) AS q, unnest(quantile_cont(value, [0.1, 0.25, 0.5, 0.75, 0.9])) AS v FROM debts GROUP BY status)")
def ecdf_on_quantile_grid(spark, sf_dir):
    grid = [0.1, 0.25, 0.5, 0.75, 0.9]
    d = tables.debts(spark, sf_dir).groupBy("status").agg(F.percentile("value", grid).alias("v"))
    return d.select("status", F.explode(F.arrays_zip(F.lit(grid).alias("q"), F.col("v"))).alias("x")).select("status", "x.q", F.round("x.v", 4).alias("v"))


book.sql(
    "iqr_outliers",
    "WITH q AS (SELECT segment, percentile(value, 0.75) + 1.5 * (percentile(value, 0.75) - percentile(value, 0.25)) AS fence FROM debts GROUP BY segment) SELECT d.segment, CAST(count(*) AS BIGINT) AS debts, CAST(count(*) FILTER (WHERE value > fence) AS BIGINT) AS outliers, CAST(count(*) FILTER (WHERE value > fence * 0.8) AS BIGINT) AS near_fence FROM debts d JOIN q ON d.segment = q.segment GROUP BY d.segment",
    "WITH q AS (SELECT segment, quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS fence FROM debts GROUP BY segment) SELECT d.segment, CAST(count(*) AS BIGINT) AS debts, CAST(count(*) FILTER (WHERE value > fence) AS BIGINT) AS outliers, CAST(count(*) FILTER (WHERE value > fence * 0.8) AS BIGINT) AS near_fence FROM debts d JOIN q ON d.segment = q.segment GROUP BY d.segment",
)
book.sql("priority_queue", "WITH top AS (SELECT doc_id, lang, n_chars FROM documents ORDER BY CASE lang WHEN 'en' THEN 0 ELSE 1 END, n_chars DESC, doc_id LIMIT 25) SELECT d.doc_id, d.source, length(d.text) AS chars FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM top)", "WITH top AS (SELECT doc_id, lang, n_chars FROM documents ORDER BY CASE lang WHEN 'en' THEN 0 ELSE 1 END, n_chars DESC, doc_id LIMIT 25) SELECT d.doc_id, d.source, CAST(length(d.text) AS INTEGER) AS chars FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM top)")
book.sql("within_group_homogeneity", "SELECT sector, round(stddev_samp(balance) / abs(avg(balance)), 6) AS cv, round(stddev_samp(balance), 4) AS sd FROM firms GROUP BY sector")
book.sql("repeat_enrolment_gaps", "WITH g AS (SELECT firm_id, datediff(enrolled, lag(enrolled) OVER (PARTITION BY firm_id ORDER BY enrolled, debt_id)) AS gap FROM debts) SELECT CAST(count(gap) AS BIGINT) AS gaps, percentile(gap, 0.5) AS median_gap, CAST(max(gap) AS BIGINT) AS longest FROM g", "WITH g AS (SELECT firm_id, date_diff('day', lag(enrolled) OVER (PARTITION BY firm_id ORDER BY enrolled, debt_id), enrolled) AS gap FROM debts) SELECT CAST(count(gap) AS BIGINT) AS gaps, quantile_cont(CAST(gap AS DOUBLE), 0.5) AS median_gap, CAST(max(gap) AS BIGINT) AS longest FROM g")

# joins and sets
book.sql("semi_paid", "SELECT segment, CAST(count(*) AS BIGINT) AS n FROM debts d WHERE EXISTS (SELECT 1 FROM payments p WHERE p.debt_id = d.debt_id AND p.amount > 80000) GROUP BY segment")
book.sql("anti_unpaid", "SELECT segment, CAST(count(*) AS BIGINT) AS n FROM debts d WHERE NOT EXISTS (SELECT 1 FROM payments p WHERE p.debt_id = d.debt_id) GROUP BY segment")
book.sql("star_join_with_codes", "SELECT f.region, d.status, CAST(count(*) AS BIGINT) AS debts, CAST(sum(CAST(d.value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM debts d LEFT JOIN firms f ON d.firm_id = f.firm_id GROUP BY f.region, d.status")
book.sql("multi_key_using", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(a.n * b.n) AS BIGINT) AS pairs FROM (SELECT year(enrolled) AS y, status, count(*) AS n FROM debts GROUP BY year(enrolled), status) a JOIN (SELECT year(enrolled) AS y, status, count(DISTINCT firm_id) AS n FROM debts GROUP BY year(enrolled), status) b USING (y, status)")
book.sql("right_join_keeps_all", "SELECT f.place, CAST(count(d.debt_id) AS BIGINT) AS debts, CAST(count(DISTINCT f.firm_id) AS BIGINT) AS firms FROM (SELECT * FROM debts WHERE value > 400000) d RIGHT JOIN firms f ON d.firm_id = f.firm_id GROUP BY f.place")
book.sql("cross_grid", "SELECT s.status, h.h AS horizon, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT status FROM debts) s CROSS JOIN (SELECT DISTINCT l_linenumber - 1 AS h FROM lineitem) h LEFT JOIN (SELECT status, year(enrolled) - 1995 AS h FROM debts) d ON d.status = s.status AND d.h = h.h GROUP BY s.status, h.h")
book.sql("self_pairs", "WITH m AS (SELECT segment, avg(value) AS m FROM debts GROUP BY segment) SELECT a.segment AS first_one, b.segment AS second_one, round(a.m - b.m, 4) AS difference FROM m a JOIN m b ON a.segment < b.segment")
book.sql("except_pending", "SELECT c_custkey AS firm_id FROM customer EXCEPT SELECT firm_id FROM debts WHERE value > 450000")
book.sql("intersect_ids", "SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT p_partkey FROM part WHERE p_size < 10")
book.sql("union_by_name_diagonal", "SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(count(segment) AS BIGINT) AS with_segment, CAST(count(line) AS BIGINT) AS with_line FROM (SELECT 'debt' AS kind, debt_id, segment, CAST(NULL AS INT) AS line FROM debts UNION ALL SELECT 'payment', debt_id, CAST(NULL AS STRING), line FROM payments) GROUP BY kind", "SELECT kind, count(*) AS n, count(segment) AS with_segment, count(line) AS with_line FROM (SELECT 'debt' AS kind, debt_id, segment FROM debts UNION ALL BY NAME SELECT 'payment' AS kind, debt_id, line FROM payments) GROUP BY kind")


@book.query("SELECT kind, count(*) AS n, count(segment) AS with_segment, count(line) AS with_line FROM (SELECT 'debt' AS kind, debt_id, segment FROM debts UNION ALL BY NAME SELECT 'payment' AS kind, debt_id, line FROM payments) GROUP BY kind")
def diagonal_concat(spark, sf_dir):
    d = tables.debts(spark, sf_dir).select(F.lit("debt").alias("kind"), "debt_id", "segment")
    p = tables.payments(spark, sf_dir).select(F.lit("payment").alias("kind"), "debt_id", "line")
    return d.unionByName(p, allowMissingColumns=True).groupBy("kind").agg(F.count("*").alias("n"), F.count("segment").alias("with_segment"), F.count("line").alias("with_line"))


@book.query("WITH s AS (SELECT debt_id, max(paid_on) AS seen FROM payments GROUP BY ALL) SELECT CAST(count(*) AS BIGINT) AS pending, CAST(count(*) FILTER (WHERE s.debt_id IS NULL) AS BIGINT) AS fresh FROM debts d LEFT JOIN s USING (debt_id) WHERE s.debt_id IS NULL OR d.enrolled > s.seen - INTERVAL 30 DAY")
def new_or_newer(spark, sf_dir):
    seen = tables.payments(spark, sf_dir).select("debt_id", F.col("paid_on").alias("at"))
    incoming = tables.debts(spark, sf_dir).withColumn("at", F.date_add("enrolled", 30))
    return joins.new_or_newer(incoming, seen, ["debt_id"], "at").agg(F.count("*").alias("pending"), F.count_if("is_new").alias("fresh"))


@book.query(
    "WITH s AS (SELECT s_suppkey AS id, n_name AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000), f AS (SELECT firm_id, place FROM firms WHERE balance > 8000) SELECT CAST(count(*) AS BIGINT) AS n FROM debts d WHERE d.firm_id IN (SELECT firm_id FROM f) OR d.debt_id IN (SELECT id FROM s)"
)
def membership_of_either_key(spark, sf_dir):
    known_firms = tables.firms(spark, sf_dir).where("balance > 8000").select("firm_id")
    known_debts = tables.read(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("debt_id"))
    return joins.either_key(tables.debts(spark, sf_dir), {"firm_id": known_firms, "debt_id": known_debts}).agg(F.count("*").alias("n"))


@book.query(
    """WITH a AS (SELECT debt_id, segment, enrolled FROM debts WHERE firm_id % 2 = 1), b AS (SELECT debt_id AS other, segment, enrolled AS day FROM debts WHERE firm_id % 2 = 0), n AS (SELECT unnest([0, 3, 7, 15, 30]) AS days),
k AS (SELECT a.debt_id, n.days, count(b.other) AS block FROM a CROSS JOIN n LEFT JOIN b ON a.segment = b.segment AND abs(date_diff('day', a.enrolled, b.day)) <= n.days GROUP BY ALL)
SELECT CAST(days AS INTEGER) AS days, count(*) FILTER (WHERE block = 1) AS unique_links, count(*) FILTER (WHERE block > 1) AS ambiguous, count(*) FILTER (WHERE block = 0) AS none FROM k GROUP BY days"""
)
def softlink_blocks(spark, sf_dir):
    d = tables.debts(spark, sf_dir)
    # two parties of all debts: those of odd and of even firms
    left = d.where("firm_id % 2 = 1").select("debt_id", "segment", "enrolled")
    right = d.where("firm_id % 2 = 0 AND debt_id IS NOT NULL").select("segment", F.col("enrolled").alias("day"))
    return joins.soft_link(left, right, "debt_id", "segment", "enrolled", "day", (0, 3, 7, 15, 30))


@book.query(
    """WITH k AS (SELECT firm_id, name, CASE WHEN firm_id % 3 = 0 THEN name WHEN firm_id % 3 = 1 THEN replace(name, '#', ' nr ') ELSE CAST(firm_id + 1000000 AS VARCHAR) END AS raw FROM firms)
SELECT CASE WHEN EXISTS (SELECT 1 FROM firms f WHERE f.name = k.raw) THEN 'exact' WHEN EXISTS (SELECT 1 FROM firms f WHERE regexp_replace(f.name, '[^0-9]', '', 'g') = regexp_replace(k.raw, '[^0-9]', '', 'g')) THEN 'digits' ELSE 'none' END AS level, count(*) AS n FROM k GROUP BY ALL"""
)
def match_ladder(spark, sf_dir):
    f = tables.firms(spark, sf_dir).select("firm_id", "name")
    raw = F.when(F.col("firm_id") % 3 == 0, F.col("name")).when(F.col("firm_id") % 3 == 1, F.replace("name", F.lit("#"), F.lit(" nr "))).otherwise((F.col("firm_id") + 1_000_000).cast("string"))
    probes = f.select(F.col("firm_id").alias("probe"), raw.alias("raw"))
    steps = [("exact", lambda c: c), ("digits", ids.digits)]
    return joins.match_ladder(probes, "raw", f, "name", "firm_id", steps).groupBy("level").agg(F.count("*").alias("n"))


book.sql(
    "anchor_last_snapshot",
    "WITH m AS (SELECT year(enrolled) AS y, max(month(enrolled)) AS m FROM debts GROUP BY year(enrolled)) SELECT m.y AS year, m.m AS month, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM debts d JOIN m ON year(d.enrolled) = m.y AND month(d.enrolled) = m.m GROUP BY m.y, m.m",
)


@book.query(
    "SELECT d.segment, k, round(corr(v, lagged), 9) AS r FROM (SELECT segment, year(enrolled) * 12 + month(enrolled) AS m, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS v FROM debts GROUP BY ALL) d JOIN (SELECT unnest([1, 6, 12]) AS k) ks ON true JOIN (SELECT year(paid_on) * 12 + month(paid_on) AS m, CAST(sum(amount) AS DOUBLE) AS lagged FROM payments GROUP BY ALL) p ON p.m = d.m - k GROUP BY d.segment, k HAVING count(*) >= 24"
)
def lagged_series_join(spark, sf_dir):
    month = lambda c: F.trunc(c, "month")
    d = tables.debts(spark, sf_dir).groupBy("segment", month("enrolled").alias("m")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("v"))
    p = tables.payments(spark, sf_dir).groupBy(month("paid_on").alias("m")).agg(F.sum("amount").cast("double").alias("lagged"))
    shifted = p.withColumn("k", F.explode(F.lit([1, 6, 12]))).select("k", F.expr("add_months(m, k)").alias("m"), "lagged")
    return d.join(F.broadcast(shifted), "m").groupBy("segment", "k").agg(F.round(F.corr("v", "lagged"), 9).alias("r"), F.count("*").alias("n")).where("n >= 24").drop("n")
