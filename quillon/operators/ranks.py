"""Running sums over an order of all rows without sorting a whole group in one task.

A group is cut into ranges of its order column, by approximate quantiles, so whatever the cuts are the result is exact. Each range's sums are
added up over the ranges before it, a table of at most `ranges` rows a group, and only within a range are rows sorted.
Rows with one value are in one range: reduce them to counts first where values repeat much.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def running(rows: DataFrame, by: Sequence[str], order: str, sums: dict[str, Column], tie: str | None = None, ranges: int = RANGES) -> DataFrame:
    """Adds for each of `sums` its sum over the group's rows up to this one, in ascending order, nulls first, and `<name>_all`, that over the group.

    The order column must be a number. Its groups may be null.
    """
    keys, number = list(by), F.col(order).cast("double")
    cuts = rows.groupBy(*keys).agg(F.percentile_approx(number, [i / ranges for i in range(1, ranges)], 4 * ranges).alias("_cuts"))
    placed = rows.withColumns({f"_x_{n}": c for n, c in sums.items()})
    placed = _met(placed, cuts, keys)
    placed = placed.withColumn("_range", F.coalesce(F.size(F.filter("_cuts", lambda c: c < number)), F.lit(0))).drop("_cuts")
    per = placed.groupBy(*keys, "_range").agg(*(F.sum(f"_x_{n}").alias(f"_s_{n}") for n in sums))
    before, whole = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    for n in sums:
        total = F.sum(f"_s_{n}")
        per = per.withColumns({f"_b_{n}": F.coalesce(total.over(before), F.lit(0)), f"{n}_all": total.over(whole)})
    per = per.drop(*(f"_s_{n}" for n in sums))
    placed = _met(placed, per, [*keys, "_range"])
    inside = Window.partitionBy(*keys, "_range").orderBy(*([order, tie] if tie else [order])).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumns({n: F.col(f"_b_{n}") + F.sum(f"_x_{n}").over(inside) for n in sums})
    return placed.drop("_range", *(f"_x_{n}" for n in sums), *(f"_b_{n}" for n in sums))


def _met(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns of the one row of their keys, null keys included."""
    if not keys:
        return rows.crossJoin(small)  # one row
    other = small.withColumnsRenamed({k: f"_k{k}" for k in keys})
    on = rows[keys[0]].eqNullSafe(other[f"_k{keys[0]}"])
    for k in keys[1:]:
        on = on & rows[k].eqNullSafe(other[f"_k{k}"])
    return rows.join(other, on).drop(*(f"_k{k}" for k in keys))
