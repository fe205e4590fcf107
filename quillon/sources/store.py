"""Tables on plain Parquet: commits by rename, upserts, partition replacement, ingest log, compaction, content-keyed cache.

Files are reached through Spark's own file systems only, so a table may lie in any store that Spark can write.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.panel import keep_latest


class Files:
    """Hadoop file operations on one path's file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.at(path))

    def delete(self, path: str) -> None:
        self.fs.delete(self.at(path), True)

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self.at(old), self.at(new)):
            raise OSError(f"{old} couldn't be renamed to {new}")

    def size(self, path: str) -> int:
        return self.fs.getContentSummary(self.at(path)).getLength()

    def data_files(self, path: str) -> int:
        found, n = self.fs.listFiles(self.at(path), True), 0
        while found.hasNext():
            n += found.next().getPath().getName().startswith("part-")
        return n


class Table:
    """A Parquet table that is replaced as a whole: a new version is written beside the old one and swapped in by renames.

    One writer at a time: two would share the names of the new and the old version. A reader between the two renames finds the
    new version by `recover`.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)

    def exists(self) -> bool:
        self.recover()
        return self.files.exists(self.path)

    def read(self) -> DataFrame:
        self.recover()
        return self.spark.read.option("mergeSchema", "true").parquet(self.path)

    def recover(self) -> None:
        """After a crash between the two renames the new version is complete: put it in place."""
        if not self.files.exists(self.path) and self.files.exists(f"{self.path}.new/_SUCCESS"):
            self.files.rename(f"{self.path}.new", self.path)

    def replace(self, df: DataFrame, partition_by: Sequence[str] = (), fail: Callable[[str], None] = lambda _: None) -> None:
        """`fail` is called before each step of the swap; tests make it raise."""
        new, old = f"{self.path}.new", f"{self.path}.old"
        self.files.delete(new)
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(new)
        fail("written")
        self.files.delete(old)
        if self.files.exists(self.path):
            self.files.rename(self.path, old)
        fail("moved")
        self.files.rename(new, self.path)
        self.files.delete(old)

    def append(self, df: DataFrame) -> None:
        df.write.mode("append").option("compression", "zstd").parquet(self.path)

    def upsert(self, updates: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> None:
        """Insert or replace by key; of several rows of a key the first in `order` stays. Columns may be new on either side."""
        both = self.read().unionByName(updates, allowMissingColumns=True) if self.exists() else updates
        self.replace(keep_latest(both, keys, order))

    def upsert_changed(self, updates: DataFrame, keys: Sequence[str]) -> int:
        """Insert or replace only rows that differ in some column; their number."""
        if not self.exists():
            self.replace(updates)
            return updates.count()
        old = self.read()
        values = [c for c in updates.columns if c not in keys]
        marked = updates.withColumn("_new", F.struct(*values)).join(old.select(*keys, F.struct(*values).alias("_old")), list(keys), "left")
        changed = marked.where(~F.col("_new").eqNullSafe(F.col("_old"))).select(*updates.columns)
        n = changed.count()
        if n:
            self.replace(old.join(changed.select(*keys), list(keys), "left_anti").unionByName(changed, allowMissingColumns=True))
        return n

    def replace_sources(self, df: DataFrame, source: str) -> None:
        """Delete all rows of the sources in df, then add df: a re-delivered source replaces itself."""
        rest = self.read().join(df.select(source).distinct(), source, "left_anti") if self.exists() else None
        self.replace(df if rest is None else rest.unionByName(df, allowMissingColumns=True))

    def overwrite_partitions(self, df: DataFrame, partition_by: Sequence[str]) -> None:
        """Replace just the partitions that df has."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(self.path)

    def update(self, condition: Column, values: dict[str, Column]) -> None:
        self.replace(self.read().withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()}))

    def compact(self, target_bytes: int = 256 << 20, sort_by: Sequence[str] = ()) -> tuple[int, int]:
        """Rewrite into files of about target_bytes, clustered by range of sort_by if given; numbers of files before and after."""
        before = self.files.data_files(self.path)
        n = max(1, -(-self.files.size(self.path) // target_bytes))
        df = self.read()
        self.replace(df.repartitionByRange(n, *sort_by).sortWithinPartitions(*sort_by) if sort_by else df.repartition(n))
        return before, self.files.data_files(self.path)

    def add_column(self, name: str, kind: str) -> None:
        df = self.read()
        if name not in df.columns:
            self.replace(df.withColumn(name, F.lit(None).cast(kind)))


def pending(incoming: DataFrame, log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the incoming listing that the ingest log doesn't have."""
    return incoming.join(log.select(*keys).distinct(), list(keys), "left_anti")


def row_hash(columns: Sequence[str]) -> Column:
    """A digest of a row's values that tells null from empty."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)


def manifest(outputs: dict[str, DataFrame], **provenance: str) -> DataFrame:
    """(name, rows, digest, provenance) of outputs; the digest doesn't depend on the order of rows."""
    parts = []
    for name, df in outputs.items():
        h = F.xxhash64(*df.columns).cast("decimal(38,0)")
        one = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("digest"))
        parts.append(one.select(F.lit(name).alias("name"), "rows", "digest", F.lit(json.dumps(provenance, sort_keys=True)).alias("provenance")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


class Cache:
    """Named steps kept as Parquet under a key of their parameters, version and inputs; a step with the same key is read back."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def path(self, step: str, params: dict | None = None, version: int = 1, inputs: Sequence[str] = ()) -> str:
        key = json.dumps({"step": step, "params": params or {}, "version": version, "inputs": sorted(inputs)}, sort_keys=True, default=str)
        return f"{self.root}/{step}__{hashlib.sha256(key.encode()).hexdigest()[:16]}"

    def get(self, step: str, build: Callable[[], DataFrame], params: dict | None = None, version: int = 1, inputs: Sequence[str] = ()) -> DataFrame:
        path = self.path(step, params, version, inputs)
        if not self.files.exists(f"{path}/_SUCCESS"):
            self.files.delete(path)
            build().write.option("compression", "zstd").parquet(path)
        return self.spark.read.parquet(path)

    def status(self, steps: dict[str, str]) -> DataFrame:
        """Which of the steps (name: path) are there."""
        return self.spark.createDataFrame([(n, p, self.files.exists(f"{p}/_SUCCESS")) for n, p in steps.items()], "step string, path string, ready boolean")


def load_statements(df: DataFrame, table: str, keys: Sequence[str], dialect: str = "postgres") -> list[str]:
    """DDL and an idempotent load for another database: rows that differ are updated, others left alone."""
    kinds = {"string": "TEXT", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE PRECISION", "date": "DATE", "timestamp": "TIMESTAMP", "boolean": "BOOLEAN", "smallint": "SMALLINT", "tinyint": "SMALLINT"}
    columns = [f'"{c}" {kinds.get(t, t.upper().replace("DECIMAL", "NUMERIC"))}' for c, t in df.dtypes]
    key = ", ".join(f'"{k}"' for k in keys)
    create = f'CREATE TABLE IF NOT EXISTS "{table}" ({", ".join(columns)}, PRIMARY KEY ({key}))'
    names = ", ".join(f'"{c}"' for c in df.columns)
    if dialect == "duckdb":
        return [create, f'INSERT OR REPLACE INTO "{table}" ({names}) SELECT {names} FROM "{table}_staging"']
    values = [c for c in df.columns if c not in keys]
    changes = ", ".join(f'"{c}" = EXCLUDED."{c}"' for c in values)
    differs = " OR ".join(f'"{table}"."{c}" IS DISTINCT FROM EXCLUDED."{c}"' for c in values)
    return [create, f'INSERT INTO "{table}" ({names}) SELECT {names} FROM "{table}_staging" ON CONFLICT ({key}) DO ' + (f"UPDATE SET {changes} WHERE {differs}" if values else "NOTHING")]
