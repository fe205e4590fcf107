"""Shared pieces of the corpus operators: scratch tables, file access, text primitives, graph components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to a Python worker; bounds a worker's memory whatever the texts are.
ARROW_ROWS = 500
ARROW_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, so that nothing needs to be installed there."""
    context = spark.sparkContext
    if getattr(context, "_quillon_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    folder = Path(tempfile.mkdtemp()).resolve()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = folder / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._quillon_shipped = True


def tune(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and by bytes, so that very long texts don't swell a worker; ship the package.

    All operators set the same bounds, so no plan built earlier runs under others than it was built for.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def workdir(spark: SparkSession) -> str:
    """The folder that all executors share. Without one a session of one process gets a temporary folder; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below one for the application that is deleted when its driver exits in order."""
    context = spark.sparkContext
    root = f"{workdir(spark)}/quillon/{context.applicationId}"
    if getattr(context, "_quillon_root", None) != root:
        context._quillon_root = root
        atexit.register(_delete, context, root)
    return f"{root}/{uuid.uuid4().hex}/{name}"


def _delete(context, root: str) -> None:
    if context._jsc is not None:  # not stopped yet
        path = context._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system and the path in it; a bare path or file: means local, else what pyarrow knows (hdfs, s3, gs)."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def publish(fs: pafs.FileSystem, temporary: str, final: str) -> None:
    """Give a finished file its name. A retried or speculative task writes the same bytes, so the last one may win."""
    try:
        fs.move(temporary, final)
    except OSError:
        if fs.get_file_info(final).type != pafs.FileType.File:
            raise
        fs.delete_file(temporary)


def sweep(uri: str) -> None:
    """Delete what failed attempts left in a folder: files without their final name, once the job that wrote there is done."""
    fs, root = filesystem(uri)
    if fs.get_file_info(root).type == pafs.FileType.Directory:
        for f in fs.get_file_info(pafs.FileSelector(root)):
            if f.base_name.startswith(".") and f.type == pafs.FileType.File:
                fs.delete_file(f.path)


def words(raw: bytes) -> list[bytes]:
    """Lower-case A-Z, then maximal runs without [\\x20\\x09-\\x0D]: what bytes.lower() and bytes.split() do."""
    return raw.lower().split()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, elementwise."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes:
    """64-bit hashes of words; the cache is emptied when it holds `limit` words."""

    def __init__(self, limit: int = 400_000):
        import xxhash

        self.hash, self.limit, self.seen = xxhash.xxh64_intdigest, limit, {}

    def __call__(self, tokens: list[bytes]) -> np.ndarray:
        seen, h = self.seen, self.hash
        if len(seen) > self.limit:
            seen.clear()
        out = list(map(seen.get, tokens))
        if None in out:
            for i, v in enumerate(out):
                if v is None:
                    out[i] = v = h(tokens[i])
                    if len(tokens[i]) < 64:
                        seen[tokens[i]] = v
        return np.array(out, np.uint64)


#: Odd multipliers of the positions in a shingle.
POSITIONS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words, in order; of the whole sequence if it is shorter; none if it is empty."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64)
    take = min(size, n)
    out = np.zeros(n - take + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(take):
            out += mix64(hashes[j : j + len(out)] * POSITIONS[j % 5] + np.uint64(j))
        return mix64(out)


def scanned(items: str, zero: str, kind: str, step: Callable[[str, str], tuple[str, str]], block: int = 256) -> str:
    """SQL for what the elements of the array column `items` add, in order, while a state is carried along.

    step(state, element) is the new state and the array of what to add, of type `kind`. Appending copies what was added before, so
    elements are taken in blocks, and only whole blocks are added to the rest: as good as linear. A list of one element
    stands for a value that is used twice and evaluated once.
    """
    empty = f"cast(array() as {kind})"
    state, new = step("inn.at", "x")
    one = f"element_at(transform(array(named_struct('at', {state}, 'new', {new})), s -> named_struct('at', s.at, 'out', concat(inn.out, s.new))), 1)"
    inner = f"aggregate(slice({items}, b * {block} + 1, {block}), named_struct('at', acc.at, 'out', {empty}), (inn, x) -> {one})"
    many = f"element_at(transform(array({inner}), s -> named_struct('at', s.at, 'out', concat(acc.out, s.out))), 1)"
    return f"aggregate(sequence(0, cast(floor(size({items}) / {block}) as int)), named_struct('at', {zero}, 'out', {empty}), (acc, b) -> {many}, acc -> acc.out)"


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, component): for every id on an edge the smallest id reachable. Large-star and small-star rounds over tables.

    Each round is two joins by id with aggregated minima, so a hub's edges are split between tasks by AQE and no
    group is gathered. The edges shrink to one per id, towards its component; rounds grow as the logarithm of the longest chain.
    Null ids and self-links are dropped; without edges the result is empty.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    e = materialize(e, "edges")
    for _ in range(rounds):
        stars = e.groupBy("u").agg(F.count("*").alias("n"))
        more = stars.where("n > 1").limit(1).count()
        if not more and not e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count():
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialize(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        e = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "small")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def rows_of(spark: SparkSession, rows: list[tuple], schema: str, parts: int | None = None) -> DataFrame:
    """A small driver-side table, dealt to tasks one row at a time if `parts` is given."""
    df = spark.createDataFrame(rows, schema)
    return df.repartition(parts) if parts else df
