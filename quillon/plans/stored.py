"""Tables that are written, changed and read back; scans of files; names and texts taken apart."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import tables
from quillon.functions import ids, text
from quillon.operators import records
from quillon.plans.base import Book
from quillon.sources import files, store

book = Book()


def _place(spark: SparkSession, name: str) -> str:
    """A new folder: below the one that executors share, or a temporary one where the session has none and is of one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
    return f"{base.rstrip('/')}/quillon-tables/{uuid.uuid4().hex}/{name}"


def _kept(spark: SparkSession, df: DataFrame, name: str) -> store.Table:
    table = store.Table(spark, _place(spark, name))
    table.replace(df)
    return table


_FACTS = ("debt_id", "firm_id", "segment", "status", "value")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.debts(spark, sf_dir).select(*_FACTS)


def _sums(df: DataFrame) -> DataFrame:
    return df.groupBy("segment", "status").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))


_TOTAL = " SELECT segment, status, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM x GROUP BY segment, status"


@book.query("WITH x AS (SELECT segment, CASE WHEN debt_id % 10 = 0 THEN 'U' ELSE status END AS status, value FROM debts UNION ALL SELECT segment, 'N', 1.0 FROM debts WHERE debt_id % 100 = 0)" + _TOTAL)
def stored_upsert(spark, sf_dir):
    """A tenth of the rows change, some come twice, and a hundredth are new."""
    facts = _facts(spark, sf_dir).withColumn("version", F.lit(1))
    table = _kept(spark, facts, "upsert")
    changed = facts.where("debt_id % 10 = 0").withColumn("status", F.lit("U")).withColumn("version", F.lit(3))
    new = facts.where("debt_id % 100 = 0").withColumns({"debt_id": -1 - F.col("debt_id"), "status": F.lit("N"), "value": F.lit(1.0), "version": F.lit(2)})
    table.upsert(changed.withColumns({"status": F.lit("old"), "version": F.lit(2)}).union(changed).union(new), ["debt_id"], [F.desc("version")])
    return _sums(table.read())


@book.query("WITH x AS (SELECT segment, CASE WHEN debt_id % 7 = 0 AND status <> 'F' THEN 'F' ELSE status END AS status, value FROM debts)" + _TOTAL)
def stored_changes_only(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    table = _kept(spark, facts, "changes")
    table.upsert_changed(facts.where("debt_id % 7 = 0").withColumn("status", F.lit("F")), ["debt_id"])
    return _sums(table.read())


@book.query("WITH x AS (SELECT segment, status, value FROM debts WHERE segment <> '5-LOW' UNION ALL SELECT segment, 'again', 2.0 FROM debts WHERE segment = '5-LOW' AND status = 'O')" + _TOTAL)
def stored_source_again(spark, sf_dir):
    """A source that is delivered again replaces its rows."""
    facts = _facts(spark, sf_dir)
    table = _kept(spark, facts, "sources")
    table.replace_sources(facts.where("segment = '5-LOW' and status = 'O'").withColumns({"status": F.lit("again"), "value": F.lit(2.0)}), "segment")
    return _sums(table.read())


@book.query("WITH x AS (SELECT segment, CASE WHEN value > 200000 THEN 'large' ELSE status END AS status, CASE WHEN value > 200000 THEN 0.0 ELSE value END AS value FROM debts)" + _TOTAL)
def stored_update(spark, sf_dir):
    table = _kept(spark, _facts(spark, sf_dir), "update")
    table.update(F.col("value") > 200_000, {"status": F.lit("large"), "value": F.lit(0.0)})
    return _sums(table.read())


@book.query("WITH x AS (SELECT segment, status, value FROM debts WHERE status <> 'P' UNION ALL SELECT segment, status, 1.0 FROM debts WHERE status = 'P')" + _TOTAL)
def stored_partitions(spark, sf_dir):
    """Only the partition that is written again changes; the folder names are read as a column."""
    facts = _facts(spark, sf_dir)
    table = store.Table(spark, _place(spark, "partitions"))
    table.replace(facts, ["status"])
    table.overwrite_partitions(facts.where("status = 'P'").withColumn("value", F.lit(1.0)).select("debt_id", "firm_id", "segment", "value", "status"), ["status"])
    return _sums(files.parquet(spark, table.path))


@book.query("SELECT segment, status, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM debts GROUP BY segment, status")
def stored_compaction(spark, sf_dir):
    table = _kept(spark, _facts(spark, sf_dir).repartition(7), "compact")
    table.compact(sort_by=["segment", "debt_id"])
    return _sums(table.read())


@book.query("SELECT status, count(*) AS n, count(*) FILTER (WHERE status = 'O') AS with_extra FROM debts GROUP BY status")
def scan_by_name(spark, sf_dir):
    """Files of which one has a column more."""
    facts, place = _facts(spark, sf_dir), _place(spark, "by_name")
    facts.where("status <> 'O'").write.parquet(f"{place}/a")
    facts.where("status = 'O'").withColumn("extra", F.lit(1)).write.parquet(f"{place}/b")
    return files.parquet(spark, f"{place}/a", f"{place}/b", by_name=True).groupBy("status").agg(F.count("*").alias("n"), F.count("extra").alias("with_extra"))


@book.query("SELECT 'orders.parquet' AS file, count(*) AS n FROM orders UNION ALL SELECT 'part.parquet', count(*) FROM part", roles=False)
def scan_with_file_name(spark, sf_dir):
    per = lambda name: files.parquet(spark, f"{sf_dir}/{name}.parquet").select(F.when(files.file_name().startswith("part-"), F.lit(f"{name}.parquet")).otherwise(files.file_name()).alias("file"))
    return per("orders").unionAll(per("part")).groupBy("file").agg(F.count("*").alias("n"))


@book.query("SELECT c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment || '; \"x\"' AS sector FROM customer", roles=False)
def csv_there_and_back(spark, sf_dir):
    """Written with quotes and compressed, read as text by position."""
    place = _place(spark, "csv")
    rows = tables.read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.concat("c_mktsegment", F.lit('; "x"')).alias("sector"))
    files.write_csv(rows, place)
    return files.csv(spark, place, ["id", "name", "sector"])[0]


@book.query("SELECT firm_id FROM firms WHERE firm_id % 3 <> 0")
def pending_of_log(spark, sf_dir):
    listing = tables.firms(spark, sf_dir).select("firm_id")
    return store.pending(listing, listing.where("firm_id % 3 = 0"), ["firm_id"])


@book.query("SELECT firm_id, sha256(firm_id || chr(31) || name || chr(31) || place) AS digest FROM firms")
def row_digests(spark, sf_dir):
    return tables.firms(spark, sf_dir).select("firm_id", store.row_hash(["firm_id", "name", "place"]).alias("digest"))


@book.query("SELECT c_custkey, unnest([c_name, c_mktsegment]) AS party FROM customer", roles=False)
def parties_apart(spark, sf_dir):
    listed = F.concat_ws(" , ", "c_name", F.lit("-"), "c_mktsegment", F.lit("N/A"))
    return tables.read(spark, sf_dir, "customer").select("c_custkey", F.explode(text.parties(listed)).alias("party"))


@book.query("SELECT c_custkey, c_custkey % 4 IN (0, 3) AS person FROM customer", roles=False)
def natural_persons(spark, sf_dir):
    k = F.col("c_custkey") % 4
    name = F.when(k == 0, "Maria Melo").when(k == 1, "Melo & Cia LTDA").when(k == 2, "Banco X S/A").otherwise("Ana Mello")
    return tables.read(spark, sf_dir, "customer").select("c_custkey", text.natural_person(F.concat(name, F.lit(" "), "c_custkey")).alias("person"))


@book.query("SELECT c_custkey, 'JOAO D AVILA ' || c_custkey || '|' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') AS k FROM customer", roles=False)
def person_keys(spark, sf_dir):
    name = F.concat(F.lit(" João  d  Ávila "), F.col("c_custkey").cast("string"))
    document = F.concat(F.lit("***."), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"), F.lit(".***-**"))
    return tables.read(spark, sf_dir, "customer").select("c_custkey", ids.person_key(name, document).alias("k"))


@book.query("SELECT doc_id, len(list_distinct(list_filter(list_transform(string_split_regex('1. a' || chr(10) || '2) ' || lang || chr(10) || '3 - a' || chr(10) || '4. ' || source, '(^|\\n)[0-9]+ ?[.)-] '), lambda x: trim(x)), lambda x: x <> '')))::INTEGER AS parts FROM documents", roles=False)
def numbered_parts(spark, sf_dir):
    listed = F.concat(F.lit("1. a\n2) "), "lang", F.lit("\n3 - a\n4. "), "source")
    return tables.read(spark, sf_dir, "documents").select("doc_id", F.size(text.chunks(listed)).alias("parts"))


_RULES = "VALUES ('Forum de Sao Paulo', 'sao paulo'), ('St. Mary (north)', 'saint mary'), ('District of Mt Holly', 'mount holly'), ('D''Avila', 'davila'), ('Unit 007', 'unit 7'), ('City of the Lakes', 'city lakes'), ('A--B', 'a b'), ('  Court do Norte ', 'court norte'), (NULL, NULL)"


@book.query(f"SELECT raw, place FROM ({_RULES}) t(raw, place)", roles=False)
def place_rules(spark, sf_dir):
    """Each of the rules on a name that it changes; the twin has the results as literals."""
    return spark.sql(f"SELECT raw FROM ({_RULES.replace(chr(39) * 2, chr(92) + chr(39))}) t(raw, place)").select("raw", text.normalize_place(F.col("raw")).alias("place"))


_MENTIONS = "VALUES (1, 'registered under no. 11.222.333/0001-81', '11222333000181', 'registered'), (2, 'id: 11222333000181', '11222333000181', 'labelled'), (3, 'nothing 11.222.333/0001-82 here', NULL, NULL), (4, 'list 11222333000181, 11222333000181, 11222333000181', NULL, NULL), (5, 'seen (11.222.333/0001-81)', '11222333000181', 'bracketed')"


@book.query(f"SELECT k, firm, rule FROM ({_MENTIONS}) t(k, body, firm, rule) WHERE firm IS NOT NULL", roles=False)
def mentions(spark, sf_dir):
    rows = spark.sql(f"SELECT k, body FROM ({_MENTIONS}) t(k, body, firm, rule)")
    return records.extract_mentions(rows, "k", "body").select("k", "firm", "rule")
