"""Event windows, and streams run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillon import tables
from quillon.plans.base import Book
from quillon.streaming import ingest

book = Book()


@book.query("SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS stop, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS total FROM events GROUP BY ALL", roles=False)
def daily_windows(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    return ingest.tumbling(e, "ts", "1 day", ["event_type"], {"n": F.count("*"), "total": F.sum(F.col("value").cast("decimal(18,6)")).cast("double")})


@book.query("SELECT start, start + INTERVAL 2 DAY AS stop, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS start FROM events) GROUP BY start", roles=False)
def sliding_windows(spark, sf_dir):
    return ingest.tumbling(tables.read(spark, sf_dir, "events"), "ts", "2 days", [], {"n": F.count("*")}, slide="1 day")


@book.query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS stop, user_id, count(*) AS n FROM s GROUP BY user_id, s",
    roles=False,
)
def user_sessions(spark, sf_dir):
    return ingest.sessions(tables.read(spark, sf_dir, "events"), "ts", "6 hours", ["user_id"], {"n": F.count("*")})


@book.query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL", roles=False)
def streamed_daily_counts(spark, sf_dir):
    name = f"daily_{uuid.uuid4().hex}"
    schema = tables.read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    counts = stream.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day"), "event_type").count()
    query = counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", F.col("count").alias("n"))
