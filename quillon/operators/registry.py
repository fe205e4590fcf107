"""Building blocks of the firm dimension: match levels, regimes, edges, exports, profiles, samples, the aggregate API."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import ids


def match_level(firms: DataFrame, units: DataFrame, key: str, roots: DataFrame, root: str, option: DataFrame) -> DataFrame:
    """level: unit if the key is known, else root if its root is, else none; option: null where the firm is nowhere, else membership."""
    out = firms.join(units.withColumn("_u", F.lit(True)), key, "left").join(roots.withColumn("_r", F.lit(True)), root, "left").join(option.withColumn("_o", F.lit(True)), key, "left")
    level = F.when(F.col("_u"), "unit").when(F.col("_r"), "root").otherwise("none")
    member = F.when(F.col("_u").isNotNull() | F.col("_r").isNotNull(), F.col("_o").isNotNull())
    return out.withColumns({"level": level, "option": member}).drop("_u", "_r", "_o")


def regimes(rows: DataFrame, key: str, year: str, form: str) -> DataFrame:
    """Per key 'year:forms; year:forms' in order, and the latest year's forms; a year's forms are joined by +."""
    per = rows.groupBy(key, year).agg(F.array_join(F.sort_array(F.collect_set(form)), "+").alias("forms"))
    listed = F.sort_array(F.collect_list(F.struct(F.col(year).alias("y"), "forms")))
    out = per.groupBy(key).agg(listed.alias("all"))
    text = F.array_join(F.transform("all", lambda x: F.concat_ws(":", x["y"].cast("string"), x["forms"])), "; ")
    return out.select(key, text.alias("regimes"), F.element_at("all", -1)["forms"].alias("latest"))


def partner_edges(links: DataFrame) -> DataFrame:
    """source (firm), target and type of partner links: a legal entity by its id, a person by masked document and upper-case name."""
    entity = F.col("kind") == "entity"
    target = F.when(entity, ids.normalize_id(F.col("document"))).otherwise(F.concat_ws("|", "document", F.upper(F.trim("name"))))
    return links.select(F.col("firm").alias("source"), target.alias("target"), F.col("kind").alias("type"), (~entity).alias("approximate_key")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """Distinct neighbours of every node of a bipartite edge list; side tells which column it stands in. Isolated nodes have no edge."""
    e = edges.select("source", "target").where("source is not null and target is not null").distinct()
    one = e.groupBy(F.col("source").cast("string").alias("id")).agg(F.count("*").alias("degree")).withColumn("side", F.lit("source"))
    two = e.groupBy(F.col("target").cast("string").alias("id")).agg(F.count("*").alias("degree")).withColumn("side", F.lit("target"))
    return one.unionByName(two)


def export(rows: DataFrame, policy: dict[str, str], key: bytes, quasi: Sequence[str] = (), k: int = 5) -> DataFrame:
    """Columns by policy: hash (keyed), year (dates), k (null where fewer than k rows share the quasi-identifiers), suppress (null), remove; others are kept."""
    out, columns = rows, []
    if "k" in policy.values():
        sizes = rows.groupBy(*quasi).agg(F.count("*").alias("_k"))
        out = rows.join(sizes.select(*(F.col(c).alias(f"_q_{c}") for c in quasi), "_k"), _null_safe(rows, quasi))
    for c in rows.columns:
        what = policy.get(c, "keep")
        if what == "hash":
            columns.append(ids.hmac_sha256(F.col(c).cast("string"), key).alias(c))
        elif what == "year":
            columns.append(F.year(c).alias(c))
        elif what == "k":
            columns.append(F.when(F.col("_k") >= k, F.col(c)).alias(c))
        elif what == "suppress":
            columns.append(F.lit(None).cast(rows.schema[c].dataType).alias(c))
        elif what == "keep":
            columns.append(F.col(c))
    return out.select(*columns)


def _null_safe(rows: DataFrame, columns: Sequence[str]) -> Column:
    on = F.lit(True)
    for c in columns:
        on = on & rows[c].eqNullSafe(F.col(f"_q_{c}"))
    return on


def date_profile(rows: DataFrame, dates: dict[str, Column], first: str, last: str) -> DataFrame:
    """Per date: rows, nulls, before and after the window, years below 1000. One pass over the rows."""
    measures = []
    for name, d in dates.items():
        measures += [
            F.count_if(d.isNull()).alias(f"{name}_0"),
            F.count_if(d < F.lit(first).cast("date")).alias(f"{name}_1"),
            F.count_if(d > F.lit(last).cast("date")).alias(f"{name}_2"),
            F.count_if(F.year(d) < 1000).alias(f"{name}_3"),
        ]
    wide = rows.agg(F.count("*").alias("rows_seen"), *measures)
    labels = ("nulls", "before_window", "after_window", "impossible")
    each = [F.struct(F.lit(n).alias("field"), F.col("rows_seen"), *(F.col(f"{n}_{i}").alias(x) for i, x in enumerate(labels))) for n in dates]
    return wide.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def null_profile(rows: DataFrame) -> DataFrame:
    """Share of rows that are null, or blank for text, per column. One pass."""
    empty = [F.col(f.name).isNull() | ((F.trim(f.name) == "") if f.dataType.typeName() == "string" else F.lit(False)) for f in rows.schema.fields]
    wide = rows.agg(*(F.round(F.avg(F.when(e, 1.0).otherwise(0.0)), 6).alias(c) for e, c in zip(empty, rows.columns, strict=True)))
    return wide.unpivot([], rows.columns, "field", "share")


def largest_remainder(sizes: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """How many of `total` each stratum gets; what rounding down leaves goes to the largest remainders. A row per stratum."""
    everything = Window.partitionBy()
    x = total * F.col(n) / F.sum(n).over(everything)
    q = sizes.withColumn("_x", x).withColumn("_base", F.floor("_x"))
    q = q.withColumn("_i", F.row_number().over(Window.orderBy(F.desc(F.col("_x") - F.col("_base")), F.col(key)))).withColumn("_left", F.lit(total) - F.sum("_base").over(everything))
    return q.select(key, (F.col("_base") + F.when(F.col("_i") <= F.col("_left"), 1).otherwise(0)).cast("long").alias("take"))


def draw(rows: DataFrame, take: DataFrame, key: str, order: Column, tie: str) -> DataFrame:
    """The first `take` rows of each stratum in a hashed order."""
    ranked = rows.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(order, F.col(tie))))
    return ranked.join(take, key).where("_i <= take").select(*rows.columns)


def aggregate(rows: DataFrame, group_by: Sequence[str], metrics: str, filters: dict[str, object] | None = None, limit: int | None = None) -> DataFrame:
    """The dataset API: metrics such as "count,count_distinct:c,sum:c,avg:c,min:c,max:c"; results are named metric_column.

    Sums and means of floating numbers are taken as decimals, so that they don't depend on the order of rows.
    """
    for column, value in (filters or {}).items():
        rows = rows.where(F.col(column).isin(list(value)) if isinstance(value, list | tuple | set) else F.col(column).eqNullSafe(F.lit(value)))
    exact = lambda c: F.col(c).cast("decimal(18,4)") if rows.schema[c].dataType.typeName() in ("double", "float") else F.col(c)
    known = {
        "count_distinct": F.count_distinct,
        "sum": lambda c: F.sum(exact(c)).cast("double"),
        "avg": lambda c: F.avg(exact(c)).cast("double"),
        "min": F.min,
        "max": F.max,
    }
    measures = []
    for metric in (m.strip() for m in metrics.split(",")):
        name, _, column = metric.partition(":")
        if metric == "count":
            measures.append(F.count("*").alias("count"))
        elif name in known and column:
            measures.append(known[name](column).alias(f"{name}_{column}"))
        else:
            raise ValueError(f"unknown metric: {metric}")
    out = rows.groupBy(*group_by).agg(*measures)
    return out.orderBy(*group_by).limit(limit) if limit else out
