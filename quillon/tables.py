"""Fixture tables, and the portfolio's roles in them: debts, payments, firms, places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: The same roles for DuckDB, to begin a statement with.
DUCK = """WITH debts AS (
  SELECT o_orderkey AS debt_id, o_custkey AS firm_id, o_orderstatus AS status, o_totalprice AS value,
         CAST(o_orderdate AS DATE) AS enrolled, o_orderpriority AS segment FROM orders),
payments AS (
  SELECT l_orderkey AS debt_id, l_linenumber AS line, CAST(l_shipdate AS DATE) AS paid_on,
         CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS amount FROM lineitem),
firms AS (
  SELECT c_custkey AS firm_id, c_name AS name, c_mktsegment AS sector, c_acctbal AS balance, n_name AS place, r_name AS region
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def debts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("debt_id"),
        F.col("o_custkey").alias("firm_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderdate").cast("date").alias("enrolled"),
        F.col("o_orderpriority").alias("segment"),
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("debt_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_shipdate").cast("date").alias("paid_on"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("amount"),
    )


def firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    joined = read(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("c_custkey").alias("firm_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("sector"), F.col("c_acctbal").alias("balance"), F.col("n_name").alias("place"), F.col("r_name").alias("region")
    )


def views(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views of all tables and roles, for SQL text."""
    for name in NAMES:
        read(spark, sf_dir, name).createOrReplaceTempView(name)
    for role in (debts, payments, firms):
        role(spark, sf_dir).createOrReplaceTempView(role.__name__)
