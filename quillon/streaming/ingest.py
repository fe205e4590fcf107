"""Incremental ingest and event windows with Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.sources.store import Table


def files(spark: SparkSession, path: str, schema, form: str = "parquet", per_trigger: int = 100) -> DataFrame:
    """New files of a folder, at most `per_trigger` a batch; the checkpoint remembers which were read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(form).load(path)


def upsert_into(stream: DataFrame, table: Table, keys: Sequence[str], order: Sequence[Column], checkpoint: str) -> StreamingQuery:
    """Keep the latest row per key in a table; a batch that is run again after a crash gives the same table."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            table.upsert(batch, keys, order)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, keys: Sequence[str], at: str, delay: str) -> DataFrame:
    """First row per key; keys are forgotten once the watermark has passed."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def tumbling(events: DataFrame, at: str, size: str, by: Sequence[str], measures: dict[str, Column], delay: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts and sums per window and group, on a table or a stream; late rows beyond `delay` are dropped on a stream."""
    rows = events.withWatermark(at, delay) if delay else events
    out = rows.groupBy(F.window(at, size, slide) if slide else F.window(at, size), *by).agg(*(m.alias(n) for n, m in measures.items()))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), *by, *measures)


def sessions(events: DataFrame, at: str, gap: str, by: Sequence[str], measures: dict[str, Column], delay: str | None = None) -> DataFrame:
    rows = events.withWatermark(at, delay) if delay else events
    out = rows.groupBy(F.session_window(at, gap), *by).agg(*(m.alias(n) for n, m in measures.items()))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), *by, *measures)
