"""Banding of ages, instalments and amounts, and small date arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def band(value: Column, edges: Sequence[float], labels: Sequence[str], low: float | None = 0) -> Column:
    """Label of the interval (edge, next edge] that holds value; null at or below `low` and for null values.

    There is a label more than edges: the last one is open.
    """
    out = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels, strict=False))):
        out = F.when(value <= edge, label).otherwise(out)
    return F.when(value.isNotNull() & (F.lit(True) if low is None else value > low), out)


def age_band(years: Column) -> Column:
    return band(years, (2, 5, 10), ("0-2", "2-5", "5-10", ">10"))


def instalment_band(n: Column) -> Column:
    return band(n, (1, 12, 60), ("1", "2-12", "13-60", ">60"))


def capital_band(amount: Column, edges: Sequence[float] = (10_000, 100_000, 1_000_000)) -> Column:
    return band(amount, edges, ("small", "medium", "large", "top"), low=None)


def months_between_boundaries(start: Column, end: Column) -> Column:
    """Calendar months crossed: 2 from Jan 31 to Mar 1."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def years_old(since: Column, on: Column) -> Column:
    return F.datediff(on, since) / 365.25


def plausible(day: Column, first: str, last: str) -> Column:
    """The date, or null outside the window."""
    return F.when(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")), day)


def month_shift(yyyymm: Column, months: int) -> Column:
    """Arithmetic on months written as YYYYMM."""
    index = F.floor(yyyymm / 100) * 12 + yyyymm % 100 - 1 + months
    return (F.floor(index / 12) * 100 + index % 12 + 1).cast("int")


def week_ending_sunday(day: Column) -> Column:
    return F.date_add(F.date_trunc("week", day).cast("date"), 6)
