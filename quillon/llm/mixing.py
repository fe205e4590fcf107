"""Mixing sources to target weights: water-filled targets, whole epochs, then Efraimidis-Spirakis sampling. DataFrame functions only.

A document's key is -ln(u) / w: u is uniform from a hash of its doc_id and text, w its quality weight. Where several rows
have the same of both, the row's number goes into the hash too, so that they are drawn each for itself. Within a source, documents in
ascending order of key are taken until their words reach what the target leaves after whole epochs; the document that
crosses that budget is taken if this brings the sum nearer. As each key is exponential with rate w, that is weighted
sampling without replacement.

No source is sorted. Keys are mapped to [0, 1) by 1 - exp(-key), and words are summed in `FAN` bins for each source; the
budget falls in one bin, which is divided again; only what two divisions leave, a millionth of a source, is ordered. What
remains is a table with a row per source: size, target, epochs, and the last key taken. Documents meet only that table.
Words are counted once: sizes and keys are written, with the documents themselves for `mixed`, without their texts for `decide`.

Null sources are one source, last in order. Null and empty texts have size 0 and are never taken. Rows with the same doc_id,
and those with a null one, have keys of their own; which of several equal rows are taken depends on how the table is read, nothing else does. Equal keys are taken in the order of doc_id and size. Very long texts count
whole: a source misses its target by at most half the size of the document at the cut. An empty table gives an empty result. `mixed`
keeps all columns of docs, whatever their names; `decide` gives just its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialize

FAN, DIVISIONS = 1024, 2
SOURCE = ["source_null", "source_key"]


def size(text: Column) -> Column:
    """Words: runs without space and \\x09-\\x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """From 0.2 to 1: falls with the share of digits and marks that prose rarely has."""
    odd = 1 - F.length(F.translate(text, "0123456789|!@#{}<>=[]_\\", "")) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.2), 1 - 4 * odd), F.lit(1.0))


def place(identity: list[Column], weight: Column, seed: int) -> Column:
    """1 - exp(-key): the same order as key, in [0, 1)."""
    u = (F.pmod(F.xxhash64(*identity, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.least(1 - F.pow(u, 1 / weight), F.lit(1 - 2**-53))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Adds `target` to a table of sources: share of all words by weight, at most cap times a source's size.

    Sources that the common level would lift above their cap are found in ascending order of cap / weight. The windows run
    over the table of sources, a row each.
    """
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(*SOURCE)) - 1
    w = F.element_at(F.lit(list(weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("w", w.cast("double")).withColumn("most", cap * F.col("source_size"))
    before = Window.orderBy(F.col("most") / F.col("w"), *SOURCE).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("total", share * F.sum("source_size").over(everything)).withColumn("all_w", F.sum("w").over(everything))
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    t = t.withColumn("capped", F.col("most") <= level * F.col("w"))
    free = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("most"))).over(everything), F.lit(0.0))
    free_w = F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything)
    return t.withColumn("target", F.when(F.col("capped"), F.col("most")).otherwise(free / free_w * F.col("w"))).select(*SOURCE, "source_size", "target")


def keyed(docs: DataFrame, weight: Column | None, seed: int, carried: dict[str, Column]) -> DataFrame:
    """A written table of the columns that the mix works with, and those carried along."""
    text = F.col("text").cast("string")
    own = {"source_null": F.col("source").isNull().cast("int"), "source_key": F.coalesce(F.col("source").cast("string"), F.lit("")), "doc_id": F.col("doc_id"), "size": size(text)}
    own |= {"weight": (quality(text) if weight is None else weight).cast("double"), "digest": F.xxhash64(text), "number": F.monotonically_increasing_id()}
    rows = materialize(docs.select(*(c.alias(n) for n, c in (own | carried).items())), "documents")
    identity = [F.col("doc_id"), F.col("digest")]
    several = rows.groupBy(*identity).count().where("count > 1").select(F.col("doc_id").alias("i"), F.col("digest").alias("d"))
    several = materialize(several, "several")
    if several.limit(1).count() == 0:
        return rows.withColumn("place", place(identity, F.col("weight"), seed))
    # equal rows, however many, are a single row here; AQE splits the other side
    rows = rows.join(several, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")), "left")
    own = place([*identity, F.col("number")], F.col("weight"), seed)
    return rows.withColumn("place", F.when(F.col("d").isNull(), place(identity, F.col("weight"), seed)).otherwise(own)).drop("i", "d")


def plan(rows: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """A written row per source: source_size, target, epochs, and the last place and doc_id taken of the fraction."""
    slim = rows.select(*SOURCE, "doc_id", "size", "place")
    sizes = slim.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"))
    state = targets(sizes, weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = state.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    state = materialize(state.withColumn("low", F.lit(0.0)), "targets")
    rows, width = slim, 1.0
    for d in range(DIVISIONS):
        width /= FAN
        rows = rows.join(state.where("rest > 0").select(*SOURCE, "low"), SOURCE)
        if d:
            rows = rows.where((F.col("place") >= F.col("low")) & (F.col("place") < F.col("low") + width * FAN))
        rows = rows.withColumn("bin", F.floor((F.col("place") - F.col("low")) / width)).drop("low")
        sums = rows.groupBy(*SOURCE, "bin").agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy(*SOURCE).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        sums = sums.withColumn("upto", upto).join(state.select(*SOURCE, "rest"), SOURCE).where("upto > rest")
        cross = sums.groupBy(*SOURCE).agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("c"))
        state = state.join(cross, SOURCE, "left").withColumn("low", F.col("low") + F.coalesce("c.bin", F.lit(0)) * width).withColumn("rest", F.col("rest") - F.coalesce("c.before", F.lit(0))).drop("c")
        state = materialize(state, f"division{d}")
        rows = rows.drop("bin")
    last = rows.join(state.where("rest > 0").select(*SOURCE, "low", "rest"), SOURCE).where((F.col("place") >= F.col("low")) & (F.col("place") < F.col("low") + width))
    upto = F.sum("size").over(Window.partitionBy(*SOURCE).orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("upto", upto).where(F.col("upto") - F.col("size") / 2 <= F.col("rest"))
    last = last.groupBy(*SOURCE).agg(F.max(F.struct("place", "doc_id")).alias("cut"))
    at_low = F.struct(F.col("low").alias("place"), F.lit(None).cast(slim.schema["doc_id"].dataType).alias("doc_id"))
    nothing = F.struct(F.lit(-1.0).alias("place"), F.lit(None).cast(slim.schema["doc_id"].dataType).alias("doc_id"))
    has_rest = F.col("target") > F.col("epochs") * F.col("source_size")
    done = state.join(last, SOURCE, "left").withColumn("cut", F.when(has_rest, F.coalesce("cut", at_low)).otherwise(nothing))
    return materialize(done.select(*SOURCE, "source_size", "target", "epochs", "cut"), "plan")


def _decided(docs: DataFrame, carried: dict[str, Column], weights: tuple[float, ...], share: float, cap: float, quality_weight: Column | None, seed: int) -> DataFrame:
    rows = keyed(docs, quality_weight, seed, carried)
    per_source = plan(rows, weights, share, cap)
    taken = F.struct("place", "doc_id") <= F.col("cut")
    copies = F.when(F.col("size") > 0, F.col("epochs") + taken.cast("long")).otherwise(F.lit(0)).cast("long")
    return rows.join(per_source, SOURCE).withColumn("copies", copies)


def decide(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, quality_weight: Column | None = None, seed: int = 1) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every row of docs: how often the mix takes it.

    weights go to the sources in code point order, again and again; the mix has `share` times all words; no source has more
    than `cap` times its own.
    """
    rows = _decided(docs, {"source": F.col("source")}, weights, share, cap, quality_weight, seed)
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, quality_weight: Column | None = None, seed: int = 1) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs."""
    rows = _decided(docs, {"_row": F.struct("*")}, weights, share, cap, quality_weight, seed)
    return rows.where("copies > 0").select(F.explode(F.array_repeat("_row", F.col("copies").cast("int"))).alias("_row")).select("_row.*")
