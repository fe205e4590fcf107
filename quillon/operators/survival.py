"""Survival: event tables, Kaplan-Meier curves, log-rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def event_table(rows: DataFrame, time: str, event: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, t, d, c, n): events and censored at each time, and how many were at risk. Rows with a null or negative time don't count.

    Rows shrink to one per time before the window, so the window sees as many rows as there are distinct times.
    """
    per = rows.where(F.col(time) >= 0).groupBy(*by, F.col(time).alias("t")).agg(F.count_if(F.col(event)).alias("d"), F.count_if(~F.col(event)).alias("c"))
    later = Window.partitionBy(*by).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("n", F.sum(F.col("d") + F.col("c")).over(later))


def kaplan_meier(table: DataFrame, by: Sequence[str] = (), least: int = 5) -> DataFrame:
    """1 - S(t) at each time; null where fewer than `least` were at risk. A factor of 0 (all at risk have the event) stays 0."""
    before = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    factor = 1 - F.col("d") / F.col("n")
    ended = F.max(F.when(F.col("d") == F.col("n"), 1).otherwise(0)).over(before) == 1
    logs = F.sum(F.when(F.col("d") < F.col("n"), F.ln(factor))).over(before)
    survival = F.when(ended, F.lit(0.0)).otherwise(F.exp(F.coalesce(logs, F.lit(0.0))))
    return table.withColumn("incidence", F.when(F.col("n") >= least, 1 - survival))


def log_rank(rows: DataFrame, time: str, event: str, group: str) -> DataFrame:
    """Per group observed and expected events, and the statistic of the two-group test in each row (groups against the rest)."""
    table = event_table(rows, time, event, [group])
    times = table.groupBy("t").agg(F.sum("d").alias("dt")).where("dt > 0")
    groups = table.select(group).distinct()
    own = rows.where(F.col(time) >= 0).groupBy(group, F.col(time).alias("t")).agg(F.count("*").alias("k"), F.count_if(F.col(event)).alias("d"))
    # at risk at every event time, also where the group has no row: a running sum over the group's times and all event times
    grid = times.select("t").crossJoin(F.broadcast(groups)).withColumns({"k": F.lit(0).cast("long"), "d": F.lit(0).cast("long")})
    both = own.select(group, "t", "k", "d").unionByName(grid.select(group, "t", "k", "d")).groupBy(group, "t").agg(F.sum("k").alias("k"), F.sum("d").alias("d"))
    later = Window.partitionBy(group).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("n", F.sum("k").over(later)).join(times, "t")
    at = Window.partitionBy("t")
    both = both.withColumn("nt", F.sum("n").over(at)).where("nt > 0")
    expected = F.col("dt") * F.col("n") / F.col("nt")
    variance = F.when(F.col("nt") > 1, expected * (1 - F.col("n") / F.col("nt")) * (F.col("nt") - F.col("dt")) / (F.col("nt") - 1)).otherwise(0.0)
    out = both.groupBy(group).agg(F.sum("d").alias("observed"), F.sum(expected).alias("expected"), F.sum(variance).alias("variance"))
    return out.withColumn("chi2", F.when(F.col("variance") > 0, F.pow(F.col("observed") - F.col("expected"), 2) / F.col("variance")))
