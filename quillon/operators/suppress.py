"""Small-cell suppression: cells with few units are pooled, the pool is aggregated from the rows, and blanked if still small."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POOL = "(pooled)"


def suppress(
    rows: DataFrame,
    keys: Sequence[str],
    unit: str,
    measures: dict[str, Column],
    least: int = 5,
    pool_key: str | None = None,
    whole: bool = False,
    label: str = POOL,
) -> DataFrame:
    """Aggregate `rows` by `keys` with the number of distinct `unit`, hiding cells of fewer than `least` units.

    Small cells' value of `pool_key` (the last key by default) becomes `label`, and the pooled cell is aggregated from the rows,
    so distinct units are counted once. With `whole` a value of pool_key is pooled everywhere if any of its cells is small. A
    pool that is still small keeps its row with null measures. Null keys are values like others.

    Units are counted distinct twice, before and after pooling; Spark first reduces each count to rows of (keys, unit). Measures are
    aggregates of any kind, so they are taken of the rows. The flags are one row per cell.
    """
    pool_key = pool_key or keys[-1]
    small = rows.groupBy(*keys).agg(F.count_distinct(unit).alias("_n")).where(F.col("_n") < least)
    flag_keys = [pool_key] if whole else list(keys)
    flags = small.select(*(F.col(k).alias(f"_f_{k}") for k in flag_keys)).distinct().withColumn("_small", F.lit(True))
    match = [rows[k].eqNullSafe(flags[f"_f_{k}"]) for k in flag_keys]
    on = match[0]
    for m in match[1:]:
        on = on & m
    labelled = rows.join(flags, on, "left").withColumn(pool_key, F.when(F.col("_small"), F.lit(label)).otherwise(F.col(pool_key).cast("string")))
    out = labelled.groupBy(*keys).agg(F.count_distinct(unit).alias("units"), *(m.alias(n) for n, m in measures.items()))
    hidden = F.col("units") < least
    return out.select(*keys, *(F.when(~hidden, F.col(c)).alias(c) for c in ("units", *measures)), hidden.alias("suppressed"))


def suppress_counts(cells: DataFrame, keys: Sequence[str], limits: dict[str, tuple[int, int]]) -> DataFrame:
    """Blank all numbers of a row in which some count lies in its (low, high) range, both ends included."""
    hit = F.lit(False)
    for c, (low, high) in limits.items():
        hit = hit | F.coalesce(F.col(c).between(low, high), F.lit(False))
    values = [c for c in cells.columns if c not in keys]
    return cells.select(*keys, *(F.when(~hit, F.col(c)).alias(c) for c in values), hit.alias("suppressed"))


def pool_rare(rows: DataFrame, column: str, least: int, label: str = "other", counted: Column | None = None) -> DataFrame:
    """Replace values of a column with fewer than `least` rows (or units, if `counted` is given) by a label."""
    n = rows.groupBy(column).agg((F.count("*") if counted is None else F.count_distinct(counted)).alias("_n")).where(F.col("_n") < least)
    rare = n.select(F.col(column).alias("_rare"), F.lit(True).alias("_is_rare"))
    joined = rows.join(rare, rows[column].eqNullSafe(rare["_rare"]), "left")
    return joined.withColumn(column, F.when(F.col("_is_rare"), F.lit(label)).otherwise(F.col(column))).drop("_rare", "_is_rare")


class PublishError(ValueError):
    """A table isn't fit for publication."""


def assert_public(df: DataFrame, forbidden: Sequence[str] = ("name", "document", "person_id", "email", "phone", "address")) -> DataFrame:
    """Refuse columns that identify persons, by the analysed schema, nested fields included."""

    def fields(schema, prefix=""):
        for f in schema.fields:
            yield f.name.lower()
            inner = getattr(f.dataType, "elementType", f.dataType)
            if hasattr(inner, "fields"):
                yield from fields(inner)

    found = sorted(set(fields(df.schema)) & {f.lower() for f in forbidden})
    if found:
        raise PublishError(f"columns not to be published: {', '.join(found)}")
    return df


def k_anonymity(rows: DataFrame, person: str, sets: dict[str, Sequence[str]], k: int = 5) -> DataFrame:
    """Per set of quasi-identifiers: combinations, those below k persons, those with one, and the persons in them."""
    parts = []
    for name, columns in sets.items():
        per = rows.groupBy(*(F.coalesce(F.col(c).cast("string"), F.lit("(null)")).alias(c) for c in columns)).agg(F.count_distinct(person).alias("n"))
        parts.append(
            per.agg(
                F.lit(name).alias("quasi_identifiers"),
                F.count("*").alias("combinations"),
                F.count_if(F.col("n") < k).alias("below_k"),
                F.count_if(F.col("n") == 1).alias("unique_combinations"),
                F.coalesce(F.sum(F.when(F.col("n") < k, F.col("n"))), F.lit(0)).alias("persons_below_k"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
