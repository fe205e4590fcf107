"""Concentration: Gini, top shares, Lorenz points, entropy, retention of the top.

Ranks and running sums come from ranges of the value (see ranks), so a group is never sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.ranks import running


def _ranked(units: DataFrame, value: str, by: Sequence[str], tie: str) -> DataFrame:
    """Adds _i, the ascending rank, _i_all, the number of units, _c, the running sum, and _c_all, the sum."""
    return running(units, by, value, {"_i": F.lit(1).cast("long"), "_c": F.col(value)}, tie)


def gini(units: DataFrame, value: str, by: Sequence[str], tie: str) -> DataFrame:
    """Closed form 2 sum(i x) / (n sum x) - (n + 1) / n over ascending ranks."""
    r = _ranked(units, value, by, tie).groupBy(*by).agg(F.count("*").alias("n"), F.sum(value).cast("double").alias("s"), F.sum((F.col("_i") * F.col(value)).cast("decimal(38,4)")).cast("double").alias("w"))
    n = F.col("n")
    return r.select(*by, n.alias("units"), F.when(F.col("s") != 0, 2 * F.col("w") / (n * F.col("s")) - (n + 1) / n).alias("gini"))


def gini_by_value(units: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """The same number from counts of equal values: c units of value x have ranks b + 1 to b + c, whose sum is c b + c (c + 1) / 2."""
    per = running(units.groupBy(*by, value).agg(F.count("*").alias("c")), by, value, {"_upto": F.col("c")})
    c, x = F.col("c"), F.col(value)
    b = F.col("_upto") - c
    per = per.withColumn("w", ((c * b + c * (c + 1) / 2).cast("decimal(38,1)") * x).cast("double"))
    r = per.groupBy(*by).agg(F.sum("c").alias("n"), F.sum((c * x).cast("decimal(38,4)")).cast("double").alias("s"), F.sum("w").alias("w"))
    n = F.col("n")
    return r.select(*by, n.alias("units"), F.when(F.col("s") != 0, 2 * F.col("w") / (n * F.col("s")) - (n + 1) / n).alias("gini"))


def gini_trapezoid(units: DataFrame, value: str, by: Sequence[str], tie: str) -> DataFrame:
    """1 - 2 times the area under the points of the ascending Lorenz curve, from its first point on, by trapezoids."""
    r = _ranked(units, value, by, tie).groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(value).cast("double").alias("s"), F.sum("_c").cast("double").alias("area"), F.min(F.when(F.col("_i") == 1, F.col("_c"))).cast("double").alias("first")
    )
    inner = (F.col("area") - (F.col("first") + F.col("s")) / 2) / F.col("s") / F.col("n")
    return r.select(*by, F.col("n").alias("units"), F.when(F.col("s") != 0, 1 - 2 * inner).alias("gini_trapezoid"))


def top_share(units: DataFrame, value: str, by: Sequence[str], tie: str, fraction: float, rounding: str = "ceil") -> DataFrame:
    """Share of the total that the largest `fraction` of units holds: their number is ceil or half-even round of the product, 1 at least.

    Units of equal value count alike, so which of them are in the top doesn't matter.
    """
    r = _ranked(units, value, by, tie)
    n = F.col("_i_all")
    k = F.greatest(F.lit(1), (F.ceil(n * fraction) if rounding == "ceil" else F.bround(n * F.lit(fraction), 0)).cast("long"))
    r = r.withColumns({"_k": k, "_down": n - F.col("_i") + 1}).groupBy(*by)
    r = r.agg(F.max("_k").alias("top_units"), F.sum(F.when(F.col("_down") <= F.col("_k"), F.col(value))).cast("double").alias("t"), F.sum(value).cast("double").alias("s"))
    return r.select(*by, "top_units", F.when(F.col("s") != 0, F.col("t") / F.col("s")).alias("top_share"))


def units_for(units: DataFrame, value: str, by: Sequence[str], tie: str, share: float = 0.5) -> DataFrame:
    """How many of the largest units it takes to reach a share of the total: those before which, from the largest down, less than it is summed."""
    r = _ranked(units, value, by, tie).withColumn("_before", F.col("_c_all") - F.col("_c"))
    return r.groupBy(*by).agg(F.count("*").alias("units"), F.count_if(F.col("_before").cast("double") < share * F.col("_c_all").cast("double")).alias("units_needed"))


def lorenz(units: DataFrame, value: str, by: Sequence[str], tie: str, points: int = 10) -> DataFrame:
    """Cumulative shares at `points` evenly spaced ranks, the last of them the last unit."""
    r = _ranked(units, value, by, tie)
    step = F.floor(F.col("_i") * points / F.col("_i_all"))
    earlier = F.floor((F.col("_i") - 1) * points / F.col("_i_all"))
    return r.where(step > earlier).select(*by, step.cast("long").alias("point"), (F.col("_i") / F.col("_i_all")).alias("unit_share"), (F.col("_c").cast("double") / F.col("_c_all").cast("double")).alias("value_share"))


def entropy(counts: DataFrame, n: str, by: Sequence[str]) -> DataFrame:
    """Shannon entropy (nats) of the shares of n within by; zero counts don't contribute."""
    p = F.col(n) / F.sum(n).over(Window.partitionBy(*by))
    return counts.where(F.col(n) > 0).withColumn("_p", p).groupBy(*by).agg((-F.sum(F.col("_p") * F.ln("_p"))).alias("entropy"), F.count("*").alias("classes"))


def retention(units: DataFrame, unit: str, period: str, value: str, fraction: float = 0.01) -> DataFrame:
    """Per period: its top units and how many of them are among the next period's top."""
    w = Window.partitionBy(period)
    k = F.greatest(F.lit(1), F.ceil(F.count("*").over(w) * fraction))
    top = units.withColumns({"_k": k, "_i": F.row_number().over(w.orderBy(F.desc(value), F.col(unit)))}).where("_i <= _k").select(unit, period)
    nxt = top.select(F.col(unit), (F.col(period) - 1).alias(period), F.lit(1).alias("_kept"))
    return top.join(nxt, [unit, period], "left").groupBy(period).agg(F.count("*").alias("top_units"), F.count("_kept").alias("retained"))


def nearest_quantile(values: Column, q: float) -> Column:
    """The element of the sorted array at the rounded position q (n - 1): an observed value, halves to even."""
    ordered = F.array_sort(values)
    return F.element_at(ordered, (F.bround((F.size(ordered) - 1) * F.lit(q), 0) + 1).cast("int"))
