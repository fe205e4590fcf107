"""The longitudinal panel: snapshots to year ends, payments by year, lags that respect gaps, monthly spines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Per key the last non-null value of each column by `order`; equal orders are settled by the larger value."""
    return rows.groupBy(*keys).agg(*(F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(order), F.col(c).alias("v"))))["v"].alias(c) for c in columns))


def keep_latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the given order; Catalyst limits each task to one row per key before the shuffle."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def debt_years(debts: DataFrame, payments: DataFrame, first: int, last: int) -> DataFrame:
    """(debt, year) from enrolment on: stock at the year's start, paid in the year, rate.

    Payments shrink to one row per debt and year before they meet the panel.
    """
    paid = payments.groupBy("debt_id", F.year("paid_on").alias("year")).agg(F.sum("amount").alias("paid"))
    years = F.sequence(F.greatest(F.year("enrolled"), F.lit(first)), F.lit(last))
    panel = debts.where(F.year("enrolled") <= last).withColumn("year", F.explode(years)).join(paid, ["debt_id", "year"], "left")
    panel = panel.withColumn("paid", F.coalesce("paid", F.lit(0).cast("decimal(18,4)")))
    before = Window.partitionBy("debt_id").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    already = F.coalesce(F.sum("paid").over(before), F.lit(0).cast("decimal(28,4)"))
    stock = F.greatest(F.col("value").cast("decimal(28,4)") - already, F.lit(0).cast("decimal(28,4)"))
    panel = panel.withColumn("stock", stock)
    return panel.withColumn("rate", F.when(F.col("stock") > 0, F.col("paid").cast("double") / F.col("stock").cast("double")))


def contiguous_lag(column: str, by: str, period: str, k: int = 1) -> Column:
    """The value k periods ago, null if the row k before isn't of that period."""
    w = Window.partitionBy(by).orderBy(period)
    return F.when(F.lag(period, k).over(w) == F.col(period) - k, F.lag(column, k).over(w))


def calendar(first: Column, last: Column, step: str = "1 day") -> Column:
    return F.explode(F.sequence(first, last, F.expr(f"interval {step}")))


def daily_spine(rows: DataFrame, day: str, measures: dict[str, Column]) -> DataFrame:
    """One row per day between the first and the last, zeros where nothing happened."""
    per = rows.groupBy(F.col(day).alias("day")).agg(*(m.alias(n) for n, m in measures.items()))
    spine = per.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(calendar(F.col("a"), F.col("b")).alias("day"))
    joined = spine.join(per, "day", "left")
    return joined.select("day", *(F.coalesce(n, F.lit(0)).alias(n) for n in measures))


def month_quality(months: DataFrame, value: str, month: str = "month", share: float = 0.8) -> DataFrame:
    """Flags: absent from the spine, or partial: below `share` of the centred 7-month median with 3 months or more."""
    spine = months.agg(F.min(month).alias("a"), F.max(month).alias("b")).select(calendar(F.col("a"), F.col("b"), "1 month").alias(month))
    w = Window.orderBy(month).rowsBetween(-3, 3)
    joined = spine.join(months, month, "left")
    middle = F.when(F.count(value).over(w) >= 3, F.percentile(F.col(value).cast("double"), F.lit(0.5)).over(w))
    out = joined.withColumn("median7", middle)
    return out.select(month, value, "median7", F.col(value).isNull().alias("absent"), F.coalesce(F.col(value) < share * F.col("median7"), F.lit(False)).alias("partial"))


def forward_fill(column: str, order: str, by: Sequence[str] = ()) -> Column:
    return F.last(column, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def chained_index(rate: str, order: str, base: Column, by: Sequence[str] = ()) -> Column:
    """Index of compounded percent rates, 1 at the row where `base` holds."""
    level = F.exp(F.sum(F.ln(1 + F.col(rate) / 100)).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    return level, lambda levels: levels / F.max(F.when(base, levels)).over(Window.partitionBy(*by))
