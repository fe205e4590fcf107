"""Recovery, cohorts, panel, classification: the portfolio's questions over debts and payments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon import tables
from quillon.functions import bands
from quillon.operators import classify, panel, suppress, survival
from quillon.plans.base import Book

book = Book()
CENSOR = "2001-12-31"
FIRST, LAST = 1995, 2001

PANEL = f"""WITH paid_year AS (SELECT debt_id, year(paid_on) AS year, sum(amount) AS paid FROM payments GROUP BY ALL),
grid AS (SELECT debt_id, firm_id, status, value, enrolled, segment, unnest(range(greatest(year(enrolled), {FIRST}), {LAST} + 1)) AS year FROM debts WHERE year(enrolled) <= {LAST}),
base AS (SELECT g.*, coalesce(p.paid, 0) AS paid FROM grid g LEFT JOIN paid_year p ON g.debt_id = p.debt_id AND g.year = p.year),
panel AS (SELECT *, greatest(CAST(value AS DECIMAL(28,4)) - coalesce(sum(paid) OVER (PARTITION BY debt_id ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS stock FROM base)
"""
AGE = "CASE WHEN age <= 0 THEN NULL WHEN age <= 2 THEN '0-2' WHEN age <= 5 THEN '2-5' WHEN age <= 10 THEN '5-10' ELSE '>10' END"


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.debt_years(tables.debts(spark, sf_dir), tables.payments(spark, sf_dir), FIRST, LAST)


def _aged(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _panel(spark, sf_dir)
    age = F.datediff(F.make_date("year", F.lit(12), F.lit(31)), F.col("enrolled")) / 365.25
    return p.withColumn("band", bands.age_band(age)).withColumn("cohort", F.year("enrolled"))


AGED = PANEL + f""", aged AS (SELECT *, year(enrolled) AS cohort, {AGE} AS band FROM (SELECT *, date_diff('day', enrolled, make_date(year, 12, 31)) / 365.25 AS age FROM panel))
"""
def _money() -> dict:
    return {"paid": F.round(F.sum("paid").cast("double"), 2), "stock": F.round(F.sum("stock").cast("double"), 2)}



def _suppressed_oracle(key: str, pool: str, least: int, whole: bool) -> str:
    """Two-key suppression of (key, pool) cells by distinct firms."""
    same = f"f.{pool} IS NOT DISTINCT FROM a.{pool}" + ("" if whole else f" AND f.{key} IS NOT DISTINCT FROM a.{key}")
    flags = f"SELECT {'DISTINCT ' + pool if whole else key + ', ' + pool} FROM (SELECT {key}, {pool}, count(DISTINCT firm_id) AS n FROM aged GROUP BY ALL) WHERE n < {least}"
    return (
        AGED
        + f""", flags AS ({flags}),
labelled AS (SELECT a.{key}, CASE WHEN EXISTS (SELECT 1 FROM flags f WHERE {same}) THEN '(pooled)' ELSE CAST(a.{pool} AS VARCHAR) END AS {pool}, a.firm_id, a.paid, a.stock FROM aged a),
cells AS (SELECT {key}, {pool}, count(DISTINCT firm_id) AS n, round(CAST(sum(paid) AS DOUBLE), 2) AS paid, round(CAST(sum(stock) AS DOUBLE), 2) AS stock FROM labelled GROUP BY ALL)
SELECT {key}, {pool}, CASE WHEN n >= {least} THEN n END AS units, CASE WHEN n >= {least} THEN paid END AS paid, CASE WHEN n >= {least} THEN stock END AS stock, n < {least} AS suppressed FROM cells"""
    )


@book.query(
    AGED
    + """SELECT cohort, band, count(DISTINCT firm_id) AS firms, round(CAST(sum(paid) AS DOUBLE), 2) AS paid, round(CAST(sum(stock) AS DOUBLE), 2) AS stock,
round(CAST(sum(paid) AS DOUBLE) / nullif(CAST(sum(stock) AS DOUBLE), 0), 6) AS recovery FROM aged GROUP BY cohort, band HAVING count(DISTINCT firm_id) >= 5"""
)
def recovery_by_cohort_band(spark, sf_dir):
    out = suppress.suppress(_aged(spark, sf_dir), ["cohort", "band"], "firm_id", {"paid": F.sum("paid").cast("double"), "stock": F.sum("stock").cast("double")})
    out = out.where(~F.col("suppressed") & ~F.col("band").eqNullSafe(suppress.POOL))
    rate = F.round(F.try_divide(F.col("paid"), F.when(F.col("stock") != 0, F.col("stock"))), 6)
    return out.select("cohort", "band", F.col("units").alias("firms"), F.round("paid", 2).alias("paid"), F.round("stock", 2).alias("stock"), rate.alias("recovery"))


@book.query(_suppressed_oracle("year", "cohort", 900, False))
def suppressed_cells(spark, sf_dir):
    return suppress.suppress(_aged(spark, sf_dir), ["year", "cohort"], "firm_id", _money(), least=900)


@book.query(_suppressed_oracle("year", "band", 900, True))
def suppressed_whole_label(spark, sf_dir):
    return suppress.suppress(_aged(spark, sf_dir), ["year", "band"], "firm_id", _money(), least=900, whole=True)


@book.query(
    """WITH c AS (SELECT segment, status, count(*) AS debts, count(DISTINCT firm_id) AS firms, round(sum(CAST(value AS DECIMAL(18,2))), 2)::DOUBLE AS value FROM debts GROUP BY ALL)
SELECT segment, status, CASE WHEN hit THEN NULL ELSE debts END AS debts, CASE WHEN hit THEN NULL ELSE firms END AS firms, CASE WHEN hit THEN NULL ELSE value END AS value, hit AS suppressed
FROM (SELECT *, (debts BETWEEN 0 AND 100) OR (firms BETWEEN 1 AND 60) AS hit FROM c)"""
)
def suppressed_two_counts(spark, sf_dir):
    cells = tables.debts(spark, sf_dir).groupBy("segment", "status").agg(F.count("*").alias("debts"), F.count_distinct("firm_id").alias("firms"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))
    return suppress.suppress_counts(cells, ["segment", "status"], {"debts": (0, 100), "firms": (1, 60)})


@book.query(
    """WITH r AS (SELECT CASE WHEN sector IN ('MACHINERY','HOUSEHOLD') THEN 'other' ELSE sector END AS sector, firm_id FROM firms), n AS (SELECT place, count(*) AS k FROM firms GROUP BY ALL)
SELECT CASE WHEN k < 60 THEN 'other' ELSE f.place END AS place, count(*) AS firms FROM firms f JOIN n USING (place) GROUP BY ALL"""
)
def pooled_rare_places(spark, sf_dir):
    return suppress.pool_rare(tables.firms(spark, sf_dir), "place", 60).groupBy("place").agg(F.count("*").alias("firms"))


book.sql(
    "coverage_with_total",
    """SELECT CASE WHEN GROUPING(segment) = 1 THEN '(all)' ELSE segment END AS segment, CAST(count(*) AS BIGINT) AS debts, CAST(count(DISTINCT d.firm_id) AS BIGINT) AS firms,
CAST(count(DISTINCT CASE WHEN f.firm_id IS NOT NULL THEN d.firm_id END) AS BIGINT) AS matched, round(count(f.firm_id) * 100.0 / count(*), 4) AS percent
FROM debts d LEFT JOIN (SELECT * FROM firms WHERE balance > 0) f ON d.firm_id = f.firm_id GROUP BY GROUPING SETS ((segment), ())""",
    """SELECT CASE WHEN GROUPING(segment) = 1 THEN '(all)' ELSE segment END AS segment, CAST(count(*) AS BIGINT) AS debts, CAST(count(DISTINCT d.firm_id) AS BIGINT) AS firms,
CAST(count(DISTINCT CASE WHEN f.firm_id IS NOT NULL THEN d.firm_id END) AS BIGINT) AS matched, CAST(round(count(f.firm_id) * 100.0 / count(*), 4) AS DOUBLE) AS percent
FROM debts d LEFT JOIN (SELECT * FROM firms WHERE balance > 0) f ON d.firm_id = f.firm_id GROUP BY GROUPING SETS ((segment), ())""",
)
book.queries["coverage_with_total"] = (lambda q: lambda spark, d: q(spark, d).withColumn("percent", F.col("percent").cast("double")))(book.queries["coverage_with_total"])


@book.query(
    AGED
    + """SELECT year, CASE WHEN GROUPING(band) = 1 THEN '(all)' ELSE band END AS band, GROUPING(band) = 1 AS is_total, count(DISTINCT debt_id) AS debts, quantile_cont(CAST(value AS DOUBLE), 0.5) AS median_value FROM aged GROUP BY GROUPING SETS ((year, band), (year))"""
)
def grouping_sets_age(spark, sf_dir):
    _aged(spark, sf_dir).createOrReplaceTempView("_aged")
    return spark.sql("SELECT year, CASE WHEN grouping(band) = 1 THEN '(all)' ELSE band END AS band, grouping(band) = 1 AS is_total, count(DISTINCT debt_id) AS debts, percentile(value, 0.5) AS median_value FROM _aged GROUP BY GROUPING SETS ((year, band), (year))")


@book.query("SELECT firm_id, arg_max(status, (enrolled, status)) AS status, arg_max(segment, (enrolled, segment)) AS segment FROM debts GROUP BY firm_id")
def latest_attributes(spark, sf_dir):
    return panel.latest(tables.debts(spark, sf_dir), ["firm_id"], "enrolled", ["status", "segment"])


@book.query("SELECT debt_id, year(paid_on) AS year, month(max(paid_on)) AS last_month, CAST(count(*) AS BIGINT) AS payments, CAST(arg_max(amount, (paid_on, line, amount)) AS DOUBLE) AS last_amount FROM payments GROUP BY ALL")
def year_end_snapshot(spark, sf_dir):
    p = tables.payments(spark, sf_dir)
    last = F.max(F.struct("paid_on", "line", "amount"))["amount"].cast("double")
    return p.groupBy("debt_id", F.year("paid_on").alias("year")).agg(F.month(F.max("paid_on")).alias("last_month"), F.count("*").alias("payments"), last.alias("last_amount"))


@book.query(PANEL + "SELECT debt_id, year, CAST(paid AS DOUBLE) AS paid, CAST(stock AS DOUBLE) AS stock, round(CAST(paid AS DOUBLE) / nullif(CAST(stock AS DOUBLE), 0), 6) AS rate FROM panel")
def panel_years(spark, sf_dir):
    return _panel(spark, sf_dir).select("debt_id", "year", F.col("paid").cast("double").alias("paid"), F.col("stock").cast("double").alias("stock"), F.round("rate", 6).alias("rate"))


_PAID_YEARS = "WITH y AS (SELECT debt_id, year(paid_on) AS year, CAST(sum(amount) AS DOUBLE) AS paid FROM payments GROUP BY ALL)"


@book.query(
    _PAID_YEARS
    + """SELECT debt_id, year, paid, CASE WHEN lag(year) OVER w = year - 1 THEN lag(paid) OVER w END AS paid_1, CASE WHEN lag(year, 2) OVER w = year - 2 THEN lag(paid, 2) OVER w END AS paid_2, lag(paid) OVER w AS paid_any
FROM y WINDOW w AS (PARTITION BY debt_id ORDER BY year)"""
)
def contiguous_lags(spark, sf_dir):
    y = tables.payments(spark, sf_dir).groupBy("debt_id", F.year("paid_on").alias("year")).agg(F.sum("amount").cast("double").alias("paid"))
    return y.select("debt_id", "year", "paid", panel.contiguous_lag("paid", "debt_id", "year").alias("paid_1"), panel.contiguous_lag("paid", "debt_id", "year", 2).alias("paid_2"), F.lag("paid").over(Window.partitionBy("debt_id").orderBy("year")).alias("paid_any"))


book.sql(
    "lags_by_shifted_join",
    """WITH y AS (SELECT segment, year(enrolled) AS year, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM debts GROUP BY segment, year(enrolled))
SELECT y.segment, y.year, y.value, a.value AS value_1, b.value AS value_2 FROM y LEFT JOIN y a ON a.segment = y.segment AND a.year + 1 = y.year LEFT JOIN y b ON b.segment = y.segment AND b.year + 2 = y.year""",
)


@book.query(
    """WITH e AS (SELECT d.debt_id, year(d.enrolled) AS cohort, year(p.paid_on) - year(d.enrolled) AS horizon, p.amount FROM debts d JOIN payments p USING (debt_id)),
v AS (SELECT year(enrolled) AS cohort, sum(CAST(value AS DECIMAL(18,2))) AS enrolled_value FROM debts GROUP BY ALL), h AS (SELECT cohort, horizon, sum(amount) AS paid FROM e WHERE horizon >= 0 GROUP BY ALL)
SELECT cohort, horizon, round(CAST(sum(paid) OVER (PARTITION BY cohort ORDER BY horizon) AS DOUBLE), 2) AS cumulative, round(CAST(sum(paid) OVER (PARTITION BY cohort ORDER BY horizon) AS DOUBLE) / CAST(enrolled_value AS DOUBLE), 6) AS share FROM h JOIN v USING (cohort)"""
)
def cumulative_recovery(spark, sf_dir):
    d, p = tables.debts(spark, sf_dir), tables.payments(spark, sf_dir)
    paid = p.groupBy("debt_id", F.year("paid_on").alias("year")).agg(F.sum("amount").alias("amount"))
    h = paid.join(d.select("debt_id", F.year("enrolled").alias("cohort")), "debt_id").withColumn("horizon", F.col("year") - F.col("cohort")).where("horizon >= 0").groupBy("cohort", "horizon").agg(F.sum("amount").alias("paid"))
    v = d.groupBy(F.year("enrolled").alias("cohort")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("v"))
    cum = F.sum("paid").over(Window.partitionBy("cohort").orderBy("horizon").rowsBetween(Window.unboundedPreceding, 0)).cast("double")
    return h.join(F.broadcast(v), "cohort").select("cohort", "horizon", F.round(cum, 2).alias("cumulative"), F.round(cum / F.col("v"), 6).alias("share"))


@book.query(PANEL + "SELECT debt_id, min(year) FILTER (WHERE cum >= opening) AS settled_year FROM (SELECT debt_id, year, sum(paid) OVER (PARTITION BY debt_id ORDER BY year) AS cum, first_value(stock) OVER (PARTITION BY debt_id ORDER BY year) AS opening FROM panel) GROUP BY debt_id")
def settlement_year(spark, sf_dir):
    w = Window.partitionBy("debt_id").orderBy("year")
    rows = _panel(spark, sf_dir).withColumns({"cum": F.sum("paid").over(w.rowsBetween(Window.unboundedPreceding, 0)), "opening": F.first("stock").over(w)})
    return rows.groupBy("debt_id").agg(F.min(F.when(F.col("cum") >= F.col("opening"), F.col("year"))).alias("settled_year"))


_DELAY = "WITH f AS (SELECT debt_id, min(paid_on) AS first_paid FROM payments GROUP BY debt_id), t AS (SELECT d.debt_id, segment, (year(first_paid) - year(enrolled)) * 12 + month(first_paid) - month(enrolled) AS months FROM debts d LEFT JOIN f USING (debt_id))"


def _first_payment(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = tables.payments(spark, sf_dir).groupBy("debt_id").agg(F.min("paid_on").alias("first_paid"))
    d = tables.debts(spark, sf_dir).join(first, "debt_id", "left")
    end = F.coalesce("first_paid", F.lit(CENSOR).cast("date"))
    return d.withColumn("event", F.col("first_paid").isNotNull() & (F.col("first_paid") <= CENSOR)).withColumn("months", bands.months_between_boundaries(F.col("enrolled"), end))


@book.query(_DELAY + ", b AS (SELECT least(months, 6) AS bin, count(*) AS n FROM t WHERE months >= 0 GROUP BY ALL) SELECT CAST(s.bin AS INTEGER) AS bin, coalesce(n, 0) AS debts FROM (SELECT unnest(range(0, 7)) AS bin) s LEFT JOIN b USING (bin)")
def delay_to_first_payment(spark, sf_dir):
    t = _first_payment(spark, sf_dir).where("event and months >= 0").groupBy(F.least("months", F.lit(6)).alias("bin")).agg(F.count("*").alias("n"))
    spine = spark.range(7).select(F.col("id").cast("int").alias("bin"))
    return spine.join(F.broadcast(t), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("debts"))


_KM = """, o AS (SELECT debt_id, {by}first_paid IS NOT NULL AND first_paid <= DATE '2001-12-31' AS event, (year(coalesce(first_paid, DATE '2001-12-31')) - year(enrolled)) * 12 + month(coalesce(first_paid, DATE '2001-12-31')) - month(enrolled) AS t FROM debts LEFT JOIN f USING (debt_id)),
g AS (SELECT {by}t, count(*) FILTER (WHERE event) AS d, count(*) FILTER (WHERE NOT event) AS c FROM o WHERE t >= 0 GROUP BY ALL),
r AS (SELECT *, sum(d + c) OVER ({part}ORDER BY t DESC) AS n FROM g)
SELECT {by}t, d, c, CAST(n AS BIGINT) AS n, CASE WHEN n >= 5 THEN round(1 - product((n - d) / n) OVER ({part}ORDER BY t), 9) END AS incidence FROM r"""
_FIRST = "WITH f AS (SELECT debt_id, min(paid_on) AS first_paid FROM payments GROUP BY debt_id)"


@book.query(_FIRST + _KM.format(by="", part=""))
def km_first_payment(spark, sf_dir):
    table = survival.event_table(_first_payment(spark, sf_dir), "months", "event")
    return survival.kaplan_meier(table).withColumn("incidence", F.round("incidence", 9))


@book.query(_FIRST + _KM.format(by="segment, ", part="PARTITION BY segment "))
def km_by_segment(spark, sf_dir):
    table = survival.event_table(_first_payment(spark, sf_dir), "months", "event", ["segment"])
    return survival.kaplan_meier(table, ["segment"]).withColumn("incidence", F.round("incidence", 9))


@book.query(
    _FIRST
    + """, o AS (SELECT status AS grp, first_paid IS NOT NULL AND first_paid <= DATE '2001-12-31' AS event, (year(coalesce(first_paid, DATE '2001-12-31')) - year(enrolled)) * 12 + month(coalesce(first_paid, DATE '2001-12-31')) - month(enrolled) AS t FROM debts LEFT JOIN f USING (debt_id)),
k AS (SELECT * FROM o WHERE t >= 0), e AS (SELECT t, count(*) AS dt FROM k WHERE event GROUP BY t), gs AS (SELECT DISTINCT grp FROM k),
a AS (SELECT e.t, e.dt, gs.grp, (SELECT count(*) FROM k WHERE k.grp = gs.grp AND k.t >= e.t) AS n, (SELECT count(*) FROM k WHERE k.t >= e.t) AS nt, (SELECT count(*) FROM k WHERE k.grp = gs.grp AND k.t = e.t AND k.event) AS d FROM e, gs),
s AS (SELECT grp, sum(d) AS observed, sum(dt * n / nt) AS expected, sum(CASE WHEN nt > 1 THEN dt * n / nt * (1 - n / nt) * (nt - dt) / (nt - 1) ELSE 0 END) AS variance FROM a GROUP BY grp)
SELECT grp AS status, CAST(observed AS BIGINT) AS observed, round(expected, 6) AS expected, round(pow(observed - expected, 2) / variance, 6) AS chi2 FROM s"""
)
def logrank(spark, sf_dir):
    out = survival.log_rank(_first_payment(spark, sf_dir), "months", "event", "status")
    return out.select("status", "observed", F.round("expected", 6).alias("expected"), F.round("chi2", 6).alias("chi2"))


@book.query(
    """WITH e AS (SELECT year(d.enrolled) AS cohort, year(p.paid_on) - year(d.enrolled) AS horizon, p.amount FROM debts d JOIN payments p USING (debt_id)), v AS (SELECT year(enrolled) AS cohort, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS v FROM debts GROUP BY ALL)
SELECT cohort, """
    + ", ".join(f"CASE WHEN cohort + {h} <= 2001 THEN round(coalesce(CAST(sum(amount) FILTER (WHERE horizon = {h}) AS DOUBLE), 0) / any_value(v), 6) END AS h{h}" for h in range(4))
    + " FROM e JOIN v USING (cohort) GROUP BY cohort"
)
def cohort_horizon_pivot(spark, sf_dir):
    d, p = tables.debts(spark, sf_dir), tables.payments(spark, sf_dir)
    v = d.groupBy(F.year("enrolled").alias("cohort")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("v"))
    e = p.join(d.select("debt_id", F.year("enrolled").alias("cohort")), "debt_id").withColumn("h", F.concat(F.lit("h"), F.year("paid_on") - F.col("cohort")))
    wide = e.groupBy("cohort").pivot("h", [f"h{h}" for h in range(4)]).agg(F.sum("amount").cast("double")).join(F.broadcast(v), "cohort")
    return wide.select("cohort", *(F.when(F.col("cohort") + h <= LAST, F.round(F.coalesce(f"h{h}", F.lit(0.0)) / F.col("v"), 6)).alias(f"h{h}") for h in range(4)))


_STATE = "CASE WHEN paid = 0 THEN 'none' WHEN paid >= stock THEN 'full' ELSE 'part' END"


@book.query(
    PANEL
    + f""", s AS (SELECT debt_id, year, {_STATE} AS state FROM panel), t AS (SELECT lag(state) OVER (PARTITION BY debt_id ORDER BY year) AS before, state FROM s)
SELECT before, state, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY before), 6) AS p FROM t WHERE before IS NOT NULL GROUP BY before, state"""
)
def transition_matrix(spark, sf_dir):
    state = F.expr(_STATE)
    w = Window.partitionBy("debt_id").orderBy("year")
    t = _panel(spark, sf_dir).withColumn("state", state).withColumn("before", F.lag("state").over(w)).where("before is not null").groupBy("before", "state").agg(F.count("*").alias("n"))
    return t.withColumn("p", F.round(F.col("n").cast("double") / F.sum("n").over(Window.partitionBy("before")), 6))


RULES = classify.Rules()
_BRANCHES = {
    "settled": "stock <= paid",
    "recent": "age <= 1",
    "paying": "unit_recent > 0 AND paid > 0",
    "high_payer": "unit_paid >= 0.5 * value",
    "stopped": "unit_paid > 0 AND unit_recent = 0",
    "old_never_paid": "age > 5 AND unit_paid = 0",
    "small": "value < 50000",
    "large_never_paid": "value >= 250000 AND unit_paid = 0",
}
_CLASS = "CASE " + " ".join(f"WHEN {_BRANCHES[b]} THEN '{b}'" for b in RULES.precedence) + " ELSE 'other' END"
_HISTORY = PANEL + """, refs AS (SELECT unnest([{years}]) AS reference),
u AS (SELECT r.reference, p.firm_id, CAST(sum(p.paid) AS DOUBLE) AS unit_paid, CAST(coalesce(sum(p.paid) FILTER (WHERE p.year > r.reference - 3), 0) AS DOUBLE) AS unit_recent FROM panel p, refs r WHERE p.year <= r.reference GROUP BY ALL),
h AS (SELECT p.*, u.reference, u.unit_paid, u.unit_recent, date_diff('day', p.enrolled, make_date(u.reference, 12, 31)) / 365.25 AS age FROM panel p JOIN u ON p.firm_id = u.firm_id AND p.year = u.reference),
k AS (SELECT *, """ + _CLASS + " AS klass FROM h)"


@book.query(_HISTORY.replace("{years}", "1999") + "SELECT c.klass, coalesce(debts, 0) AS debts, coalesce(stock, 0) AS stock FROM (SELECT unnest([" + ", ".join(f"'{b}'" for b in (*RULES.precedence, "other")) + "]) AS klass) c LEFT JOIN (SELECT klass, count(*) AS debts, CAST(sum(stock) AS DOUBLE) AS stock FROM k GROUP BY ALL) USING (klass)")
def rule_classifier(spark, sf_dir):
    rows = classify.history(_panel(spark, sf_dir), "firm_id", 1999, RULES)
    return classify.summary(classify.classify(rows, RULES, 1999), RULES)


@book.query(
    _HISTORY.replace("{years}", "1997, 1998, 1999")
    + """, after AS (SELECT k.reference, k.debt_id, CAST(sum(p.paid) AS DOUBLE) AS paid_after FROM k JOIN panel p ON p.debt_id = k.debt_id AND p.year > k.reference AND p.year <= k.reference + 2 GROUP BY ALL)
SELECT k.reference, klass, count(*) AS debts, CAST(sum(stock) AS DOUBLE) AS stock, round(CAST(sum(CAST(coalesce(paid_after, 0) AS DECIMAL(28,4))) AS DOUBLE), 2) AS paid_after FROM k LEFT JOIN after a ON a.reference = k.reference AND a.debt_id = k.debt_id GROUP BY ALL"""
)
def rule_backtest(spark, sf_dir):
    out = classify.backtest(_panel(spark, sf_dir), "firm_id", (1997, 1998, 1999), RULES)
    return out.select("reference", "klass", "debts", "stock", F.round("paid_after", 2).alias("paid_after"))


@book.query(
    """WITH e AS (SELECT l_orderkey AS debt_id, min(CAST(l_shipdate AS DATE)) AS event_on FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT segment, count(DISTINCT p.debt_id) AS debts, round(CAST(coalesce(sum(amount) FILTER (WHERE paid_on < event_on), 0) AS DOUBLE), 2) AS before, round(CAST(coalesce(sum(amount) FILTER (WHERE paid_on >= event_on), 0) AS DOUBLE), 2) AS after
FROM e JOIN payments p USING (debt_id) JOIN debts USING (debt_id) GROUP BY segment"""
)
def recovery_before_after_event(spark, sf_dir):
    line = tables.read(spark, sf_dir, "lineitem")
    e = line.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("debt_id")).agg(F.min(F.col("l_shipdate").cast("date")).alias("event_on"))
    p = tables.payments(spark, sf_dir).join(e, "debt_id").groupBy("debt_id").agg(
        F.coalesce(F.sum(F.when(F.col("paid_on") < F.col("event_on"), F.col("amount"))), F.lit(0)).alias("b"), F.coalesce(F.sum(F.when(F.col("paid_on") >= F.col("event_on"), F.col("amount"))), F.lit(0)).alias("a")
    )
    rows = p.join(tables.debts(spark, sf_dir).select("debt_id", "segment"), "debt_id")
    return rows.groupBy("segment").agg(F.count("*").alias("debts"), F.round(F.sum("b").cast("double"), 2).alias("before"), F.round(F.sum("a").cast("double"), 2).alias("after"))


book.sql(
    "share_with_event",
    """WITH r AS (SELECT DISTINCT l_orderkey AS debt_id FROM lineitem WHERE l_returnflag = 'R')
SELECT year(enrolled) AS year, CAST(count(*) AS BIGINT) AS debts, CAST(count(r.debt_id) AS BIGINT) AS with_event, round(CAST(count(r.debt_id) AS DOUBLE) / count(*), 6) AS share FROM debts d LEFT JOIN r ON d.debt_id = r.debt_id GROUP BY year(enrolled)""",
)
book.sql(
    "status_distribution",
    """SELECT segment, coalesce(CASE WHEN status = 'P' THEN NULL ELSE status END, 'missing') AS status, CAST(count(*) AS BIGINT) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY segment), 6) AS share
FROM debts GROUP BY segment, coalesce(CASE WHEN status = 'P' THEN NULL ELSE status END, 'missing')""",
)
book.sql(
    "break_rates_by_instalments",
    """WITH k AS (SELECT l_orderkey, count(*) AS n, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS broke FROM lineitem GROUP BY l_orderkey)
SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 12 THEN '2-12' WHEN n <= 60 THEN '13-60' ELSE '>60' END AS band, CAST(count(*) AS BIGINT) AS plans, CAST(sum(broke) AS BIGINT) AS broken, round(CAST(sum(broke) AS DOUBLE) / count(*), 6) AS rate
FROM k GROUP BY CASE WHEN n <= 1 THEN '1' WHEN n <= 12 THEN '2-12' WHEN n <= 60 THEN '13-60' ELSE '>60' END""",
)
book.sql(
    "reference_year_facts",
    "SELECT segment, "
    + ", ".join(
        f"CAST(count(*) FILTER (WHERE year(enrolled) <= {y}) AS BIGINT) AS debts_{y}, CAST(coalesce(sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE year(enrolled) = {y}), 0) AS DOUBLE) AS enrolled_{y}" for y in (1996, 1998, 2000)
    )
    + " FROM debts GROUP BY segment",
)
book.sql(
    "open_plan_at_reference",
    """WITH s AS (SELECT l_orderkey AS debt_id, CAST(min(l_shipdate) AS DATE) AS opened, CAST(max(l_shipdate) AS DATE) AS closed FROM lineitem GROUP BY l_orderkey)
SELECT segment, CAST(count(*) FILTER (WHERE opened <= DATE '1998-06-30' AND closed > DATE '1998-06-30') AS BIGINT) AS open_plans, bool_or(opened <= DATE '1998-06-30' AND closed > DATE '1998-06-30') AS any_open, bool_and(closed > DATE '1998-06-30') AS all_open
FROM debts d JOIN s ON d.debt_id = s.debt_id GROUP BY segment""",
)
book.sql(
    "annual_bundle",
    """WITH y AS (SELECT d.debt_id, d.value, year(p.paid_on) AS year, CAST(sum(p.amount) AS DOUBLE) AS paid FROM debts d JOIN payments p ON d.debt_id = p.debt_id GROUP BY d.debt_id, d.value, year(p.paid_on))
SELECT year, CAST(count(*) AS BIGINT) AS payers, round(median(paid), 4) AS median_paid, round(CAST(sum(CAST(paid AS DECIMAL(18,4))) AS DOUBLE) / CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 6) AS ratio_of_sums, round(avg(CAST(paid / value AS DECIMAL(18,10))), 6) AS mean_of_ratios FROM y GROUP BY year""",
)
book.queries["annual_bundle"] = (lambda q: lambda spark, d: q(spark, d).withColumn("mean_of_ratios", F.col("mean_of_ratios").cast("double")))(book.queries["annual_bundle"])
book.sql(
    "population_funnel",
    """WITH s AS (SELECT d.debt_id, d.firm_id, d.value, max(p.paid_on) AS last_paid, count(p.debt_id) AS n FROM debts d LEFT JOIN payments p ON p.debt_id = d.debt_id GROUP BY d.debt_id, d.firm_id, d.value)
SELECT 1 AS step, 'all' AS label, CAST(count(*) AS BIGINT) AS debts, CAST(count(DISTINCT firm_id) AS BIGINT) AS firms FROM s
UNION ALL SELECT 2, 'paid once', CAST(count(*) AS BIGINT), CAST(count(DISTINCT firm_id) AS BIGINT) FROM s WHERE n > 0
UNION ALL SELECT 3, 'paid often', CAST(count(*) AS BIGINT), CAST(count(DISTINCT firm_id) AS BIGINT) FROM s WHERE n > 3
UNION ALL SELECT 4, 'and large', CAST(count(*) AS BIGINT), CAST(count(DISTINCT firm_id) AS BIGINT) FROM s WHERE n > 3 AND value > 200000
UNION ALL SELECT 5, 'and lately', CAST(count(*) AS BIGINT), CAST(count(DISTINCT firm_id) AS BIGINT) FROM s WHERE n > 3 AND value > 200000 AND last_paid >= DATE '2000-01-01'""",
)


@book.query(
    _DELAY
    + """, c AS (SELECT year(enrolled) AS cohort, months, count(*) AS n FROM t JOIN debts USING (debt_id) GROUP BY ALL), s AS (SELECT year(enrolled) AS cohort, count(*) AS size FROM debts GROUP BY ALL), g AS (SELECT s.cohort, s.size, h.h AS months FROM s, (SELECT unnest([0, 1, 3, 6, 12]) AS h) h)
SELECT g.cohort, g.months, CASE WHEN g.cohort + g.months / 12 <= 2001 THEN round(CAST(coalesce((SELECT sum(n) FROM c WHERE c.cohort = g.cohort AND c.months BETWEEN 0 AND g.months), 0) AS DOUBLE) / g.size, 6) END AS incidence FROM g"""
)
def incidence_grid(spark, sf_dir):
    t = _first_payment(spark, sf_dir).withColumn("cohort", F.year("enrolled"))
    horizons = (0, 1, 3, 6, 12)
    per = t.groupBy("cohort").agg(F.count("*").alias("size"), *(F.count_if(F.col("event") & F.col("months").between(0, h)).alias(f"h{h}") for h in horizons))
    long = per.select("cohort", "size", F.explode(F.array(*(F.struct(F.lit(h).alias("months"), F.col(f"h{h}").alias("n")) for h in horizons))).alias("x")).select("cohort", "size", "x.*")
    seen = F.col("cohort") + F.col("months") / 12 <= LAST
    return long.select("cohort", "months", F.when(seen, F.round(F.col("n") / F.col("size"), 6)).alias("incidence"))


@book.query(
    PANEL + "SELECT age_year, count(*) AS exposed, count(*) FILTER (WHERE paid > 0) AS payers, round(CAST(count(*) FILTER (WHERE paid > 0) AS DOUBLE) / count(*), 6) AS hazard FROM (SELECT *, year - year(enrolled) AS age_year FROM panel WHERE stock > 0) GROUP BY age_year"
)
def payment_hazard(spark, sf_dir):
    p = _panel(spark, sf_dir).where("stock > 0").withColumn("age_year", F.col("year") - F.year("enrolled"))
    return p.groupBy("age_year").agg(F.count("*").alias("exposed"), F.count_if(F.col("paid") > 0).alias("payers"), F.round(F.count_if(F.col("paid") > 0) / F.count("*"), 6).alias("hazard"))


@book.query(
    AGED + ", o AS (SELECT *, sum(paid) OVER (PARTITION BY debt_id ORDER BY year) AS cum FROM aged) SELECT band, count(*) AS debts, round(CAST(sum(cum) AS DOUBLE), 2) AS cumulative FROM (SELECT debt_id, band, arg_max(cum, year) AS cum FROM o WHERE band IS NOT NULL GROUP BY ALL) GROUP BY band"
)
def cumulative_in_band(spark, sf_dir):
    w = Window.partitionBy("debt_id").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    rows = _aged(spark, sf_dir).withColumn("cum", F.sum("paid").over(w)).where("band is not null").groupBy("debt_id", "band").agg(F.max_by("cum", "year").alias("cum"))
    return rows.groupBy("band").agg(F.count("*").alias("debts"), F.round(F.sum("cum").cast("double"), 2).alias("cumulative"))


book.sql(
    "recovery_by_flag",
    """WITH p AS (SELECT debt_id, sum(amount) AS paid FROM payments GROUP BY debt_id), r AS (SELECT DISTINCT l_orderkey AS debt_id FROM lineitem WHERE l_returnflag = 'R')
SELECT r.debt_id IS NOT NULL AS flagged, CAST(count(*) AS BIGINT) AS debts, round(CAST(sum(coalesce(p.paid, 0)) AS DOUBLE) / CAST(sum(CAST(d.value AS DECIMAL(18,2))) AS DOUBLE), 6) AS recovery
FROM debts d LEFT JOIN p ON p.debt_id = d.debt_id LEFT JOIN r ON r.debt_id = d.debt_id GROUP BY r.debt_id IS NOT NULL""",
)
book.sql(
    "programme_response",
    """SELECT segment, round(CAST(sum(CASE WHEN paid_on >= DATE '1999-01-01' AND paid_on < DATE '1999-07-01' THEN amount ELSE 0 END) AS DOUBLE) / nullif(CAST(sum(CASE WHEN paid_on >= DATE '1998-01-01' AND paid_on < DATE '1999-01-01' THEN amount ELSE 0 END) AS DOUBLE), 0), 6) AS response
FROM payments p JOIN debts d ON p.debt_id = d.debt_id GROUP BY segment""",
)
