"""Joins that Spark has no single keyword for."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def new_or_newer(incoming: DataFrame, seen: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Incoming rows whose key wasn't seen, or not as late; is_new tells the two apart. What was seen shrinks to a row per key first."""
    last = seen.groupBy(*keys).agg(F.max(at).alias("_last"))
    joined = incoming.join(last, list(keys), "left")
    return joined.where(F.col("_last").isNull() | (F.col(at) > F.col("_last"))).withColumn("is_new", F.col("_last").isNull()).drop("_last")


def either_key(rows: DataFrame, known: dict[str, DataFrame]) -> DataFrame:
    """Rows of which at least one of several keys is known: a left join to the distinct ids of each, then OR."""
    out, hit = rows, F.lit(False)
    for i, (key, ids) in enumerate(known.items()):
        flag = f"_known{i}"
        out = out.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct().withColumn(flag, F.lit(True)), key, "left")
        hit = hit | F.col(flag).isNotNull()
    return out.where(hit).select(*rows.columns)


def soft_link(left: DataFrame, right: DataFrame, key: str, place: str, day: str, other_day: str, windows: Sequence[int]) -> DataFrame:
    """Per window of N days: how many left rows have one, several or no right rows of the same place within N days.

    No pairs are made. Right rows shrink to a count per place and day, and a running count over a place's days (a row each, however many
    rows a day has) gives any window as a difference of two values. Left rows look theirs up by place and day; those of one key add up.
    """
    right_days = right.select(place, F.unix_date(other_day).alias("_day"), F.lit(1).alias("_n"))
    left_days = left.select(place, F.unix_date(day).alias("_day"), F.lit(0).alias("_n"))
    counts = right_days.union(left_days).dropna(subset=[place, "_day"]).groupBy(place, "_day").agg(F.sum("_n").alias("_n"))
    days = Window.partitionBy(place).orderBy("_day")
    upto = lambda n: F.coalesce(F.sum("_n").over(days.rangeBetween(Window.unboundedPreceding, n)), F.lit(0))
    sizes = counts.select(place, "_day", *((upto(n) - upto(min(n, -n - 1))).alias(f"b{n}") for n in windows))
    found = left.select(key, place, F.unix_date(day).alias("_day")).join(sizes, [place, "_day"], "left")
    blocks = found.groupBy(key).agg(*(F.coalesce(F.sum(f"b{n}"), F.lit(0)).alias(f"b{n}") for n in windows))
    long = blocks.select(F.explode(F.array(*(F.struct(F.lit(n).alias("days"), F.col(f"b{n}").alias("block")) for n in windows))).alias("x")).select("x.*")
    return long.groupBy("days").agg(F.count_if(F.col("block") == 1).alias("unique_links"), F.count_if(F.col("block") > 1).alias("ambiguous"), F.count_if(F.col("block") == 0).alias("none"))


def match_ladder(probes: DataFrame, probe: str, registry: DataFrame, name: str, key: str, steps: Sequence[tuple[str, Callable[[Column], Column]]]) -> DataFrame:
    """Probes with `level` and `matched`: the first step whose transformed value is in the registry; `none` without a match.

    The registry has one row per transformed value (its smallest key) for each step, so a probe never multiplies.
    """
    out, level, matched = probes, F.lit("none"), F.lit(None)
    for i, (label, change) in reversed(list(enumerate(steps))):
        side = registry.select(change(F.col(name)).alias(f"_v{i}"), F.col(key).alias("_k")).where(f"_v{i} is not null and _v{i} != ''").groupBy(f"_v{i}").agg(F.min("_k").alias(f"_k{i}"))
        out = out.withColumn(f"_v{i}", change(F.col(probe))).join(side, f"_v{i}", "left").drop(f"_v{i}")
        level, matched = F.when(F.col(f"_k{i}").isNotNull(), F.lit(label)).otherwise(level), F.coalesce(F.col(f"_k{i}"), matched)
    return out.select(*probes.columns, level.alias("level"), matched.alias("matched"))
