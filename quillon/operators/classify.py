"""Rule classifier with parametric precedence over a unit's history, and its back-test over reference years."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """What the classes look at; precedence lists the branches, the first that holds wins."""

    window: int = 3
    old: float = 5.0
    high_rate: float = 0.5
    precedence: tuple[str, ...] = ("settled", "recent", "paying", "high_payer", "stopped", "old_never_paid", "small", "large_never_paid")
    small: float = 50_000.0
    large: float = 250_000.0
    default: str = "other"


def history(panel: DataFrame, unit: str, reference: int, rules: Rules) -> DataFrame:
    """Rows of the reference year with what their unit paid in the window and ever; the panel up to the reference is summed once per unit."""
    past = panel.where(F.col("year") <= reference)
    paid = past.groupBy(unit).agg(
        F.sum("paid").cast("double").alias("unit_paid"),
        F.coalesce(F.sum(F.when(F.col("year") > reference - rules.window, F.col("paid"))), F.lit(0)).cast("double").alias("unit_recent"),
    )
    return past.where(F.col("year") == reference).join(paid, unit)


def branches(rules: Rules, reference: int) -> dict[str, Column]:
    age = F.datediff(F.lit(f"{reference}-12-31").cast("date"), F.col("enrolled")) / 365.25
    stock, paid = F.col("stock").cast("double"), F.col("paid").cast("double")
    return {
        "settled": stock <= paid,
        "recent": age <= 1,
        "paying": (F.col("unit_recent") > 0) & (paid > 0),
        "high_payer": F.col("unit_paid") >= rules.high_rate * F.col("value"),
        "stopped": (F.col("unit_paid") > 0) & (F.col("unit_recent") == 0),
        "old_never_paid": (age > rules.old) & (F.col("unit_paid") == 0),
        "small": F.col("value") < rules.small,
        "large_never_paid": (F.col("value") >= rules.large) & (F.col("unit_paid") == 0),
    }


def classify(rows: DataFrame, rules: Rules, reference: int) -> DataFrame:
    out, known = F.lit(rules.default), branches(rules, reference)
    for name in reversed(rules.precedence):
        out = F.when(F.coalesce(known[name], F.lit(False)), name).otherwise(out)
    return rows.withColumn("klass", out)


def summary(classified: DataFrame, rules: Rules) -> DataFrame:
    """Debts and stock per class; classes without debts have a row of zeros."""
    spark = classified.sparkSession
    names = spark.createDataFrame([(n,) for n in (*rules.precedence, rules.default)], "klass string")
    per = classified.groupBy("klass").agg(F.count("*").alias("debts"), F.sum("stock").cast("double").alias("stock"))
    return names.join(per, "klass", "left").select("klass", F.coalesce("debts", F.lit(0)).cast("long").alias("debts"), F.coalesce("stock", F.lit(0.0)).alias("stock"))


def backtest(panel: DataFrame, unit: str, references: Sequence[int], rules: Rules, horizon: int = 2) -> DataFrame:
    """Per reference year and class: stock then, and what was paid in the `horizon` years after.

    All reference years are one pass: each panel row goes to the references it matters for, and units are summed per reference.
    """
    refs = F.lit(list(references))
    long = panel.withColumn("reference", F.explode(F.filter(refs, lambda r: (F.col("year") <= r + horizon))))
    past = F.col("year") <= F.col("reference")
    w = Window.partitionBy(unit, "reference")
    long = long.withColumns(
        {
            "unit_paid": F.coalesce(F.sum(F.when(past, F.col("paid"))).over(w), F.lit(0)).cast("double"),
            "unit_recent": F.coalesce(F.sum(F.when(past & (F.col("year") > F.col("reference") - rules.window), F.col("paid"))).over(w), F.lit(0)).cast("double"),
            "after": F.coalesce(F.sum(F.when(~past, F.col("paid"))).over(Window.partitionBy("debt_id", "reference")), F.lit(0)).cast("double"),
        }
    )
    rows = long.where(F.col("year") == F.col("reference"))
    out = None
    age = F.datediff(F.make_date("reference", F.lit(12), F.lit(31)), F.col("enrolled")) / 365.25
    known = branches(rules, references[0]) | {"recent": age <= 1, "old_never_paid": (age > rules.old) & (F.col("unit_paid") == 0)}
    klass = F.lit(rules.default)
    for name in reversed(rules.precedence):
        klass = F.when(F.coalesce(known[name], F.lit(False)), name).otherwise(klass)
    out = rows.withColumn("klass", klass).groupBy("reference", "klass").agg(F.count("*").alias("debts"), F.sum("stock").cast("double").alias("stock"), F.sum(F.col("after").cast("decimal(28,4)")).cast("double").alias("paid_after"))
    return out.withColumn("recovery", F.when(F.col("stock") > 0, F.col("paid_after") / F.col("stock")))
