"""The firm dimension: identifiers, keep-latest builds, match levels, edges, privacy exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon import tables
from quillon.functions import bands, ids
from quillon.operators import panel, registry, suppress
from quillon.plans.base import Book

book = Book()
KEY = b"a key for tests only"


def _weighted(text: str, weights: list[int]) -> str:
    return " + ".join(f"(ascii(substr({text}, {i + 1}, 1)) - 48) * {w}" for i, w in enumerate(weights))


def _digit(text: str, weights: list[int]) -> str:
    return f"CASE WHEN ({_weighted(text, weights)}) % 11 < 2 THEN 0 ELSE 11 - ({_weighted(text, weights)}) % 11 END"


@book.query(
    "WITH a AS (SELECT c_custkey, substr(c_mktsegment, 1, 4) || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS r FROM customer), b AS (SELECT *, r || CAST("
    + _digit("r", ids.FIRM_WEIGHTS[0])
    + " AS VARCHAR) AS r1 FROM a), c AS (SELECT *, r1 || CAST("
    + _digit("r1", ids.FIRM_WEIGHTS[1])
    + " AS VARCHAR) AS firm FROM b) SELECT c_custkey, firm, firm <> repeat(substr(firm, 1, 1), 14) AS ok, regexp_replace(firm, '^(.{2})(.{3})(.{3})(.{4})(.{2})$', '\\1.\\2.\\3/\\4-\\5') AS masked, substr(firm, 1, 13) || CAST((CAST(substr(firm, 14, 1) AS INTEGER) + 1) % 10 AS VARCHAR) AS wrong, false AS wrong_ok FROM c"
)
def check_digits(spark, sf_dir):
    a = tables.read(spark, sf_dir, "customer").select("c_custkey", ids.with_check_digits(F.concat(F.left("c_mktsegment", F.lit(4)), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))).alias("firm"))
    wrong = F.concat(F.substring("firm", 1, 13), ((F.substring("firm", 14, 1).cast("int") + 1) % 10).cast("string"))
    a = a.withColumn("wrong", wrong)
    return a.select("c_custkey", "firm", ids.firm_id_ok(F.col("firm")).alias("ok"), ids.firm_mask(F.col("firm")).alias("masked"), "wrong", ids.firm_id_ok(F.col("wrong")).alias("wrong_ok"))


#: What ids look like in the sources: letters, marks, lost zeros, and nothing at all.
_RAW_ID = "CASE c_custkey % 6 WHEN 0 THEN concat(' ab.', lpad(CAST(c_custkey AS {text}), 7, '0'), '/0001-') WHEN 1 THEN CAST(100000000000 + c_custkey AS {text}) WHEN 2 THEN CAST(c_custkey AS {text}) WHEN 3 THEN ' .-/ ' WHEN 4 THEN concat('AB', CAST(10000000000 + c_custkey AS {text})) ELSE concat('2.345.678/0001-', lpad(CAST(c_custkey % 100 AS {text}), 2, '0')) END"


@book.query(
    f"WITH r AS (SELECT c_custkey, regexp_replace(upper({_RAW_ID.format(text='VARCHAR')}), '[^0-9A-Z]', '', 'g') AS x FROM customer) SELECT c_custkey, CASE WHEN x = '' THEN NULL WHEN regexp_full_match(x, '[0-9]{{12,13}}') THEN lpad(x, 14, '0') ELSE x END AS firm FROM r"
)
def id_normalize(spark, sf_dir):
    return tables.read(spark, sf_dir, "customer").select("c_custkey", ids.normalize_id(F.expr(_RAW_ID.format(text="STRING"))).alias("firm"))


@book.query("SELECT CAST(CAST('0x' || substr(md5(c_name), 1, 8) AS BIGINT) % 16 AS BIGINT) AS bucket, count(*) AS n FROM customer GROUP BY ALL", roles=False)
def md5_buckets(spark, sf_dir):
    return tables.read(spark, sf_dir, "customer").groupBy(ids.bucket(F.col("c_name"), 16).alias("bucket")).agg(F.count("*").alias("n"))


def _hmac_sql(message: str) -> str:
    block = KEY.ljust(64, b"\0")
    inner, outer = ("".join(f"\\x{b ^ pad:02X}" for b in block) for pad in (0x36, 0x5C))
    return f"sha256('{outer}'::BLOB || unhex(sha256('{inner}'::BLOB || encode({message}))))"


@book.query("SELECT c_custkey, " + _hmac_sql("c_name") + " AS pseudonym FROM customer", roles=False)
def hmac_ids(spark, sf_dir):
    return tables.read(spark, sf_dir, "customer").select("c_custkey", ids.hmac_sha256(F.col("c_name"), KEY).alias("pseudonym"))


@book.query("SELECT firm_id, arg_min(debt_id, (-CAST(date_diff('day', DATE '1970-01-01', enrolled) AS BIGINT), debt_id)) AS debt_id FROM debts GROUP BY firm_id")
def dedupe_keep_latest(spark, sf_dir):
    return panel.keep_latest(tables.debts(spark, sf_dir), ["firm_id"], [F.desc("enrolled"), F.asc("debt_id")]).select("firm_id", "debt_id")


_PRESENT = "WITH e AS (SELECT firm_id FROM firms WHERE balance > 3000), r AS (SELECT DISTINCT place FROM firms WHERE balance > 9900), o AS (SELECT firm_id FROM firms WHERE firm_id % 3 = 0)"


@book.query(
    _PRESENT
    + " SELECT CASE WHEN e.firm_id IS NOT NULL THEN 'unit' WHEN r.place IS NOT NULL THEN 'root' ELSE 'none' END AS level, CASE WHEN e.firm_id IS NULL AND r.place IS NULL THEN NULL ELSE o.firm_id IS NOT NULL END AS option, count(*) AS n FROM firms f LEFT JOIN e USING (firm_id) LEFT JOIN r ON r.place = f.place LEFT JOIN o ON o.firm_id = f.firm_id GROUP BY ALL"
)
def match_level(spark, sf_dir):
    f = tables.firms(spark, sf_dir)
    e, r, o = f.where("balance > 3000").select("firm_id"), f.where("balance > 9900").select("place").distinct(), f.where("firm_id % 3 = 0").select("firm_id")
    return registry.match_level(f, e, "firm_id", r, "place", o).groupBy("level", "option").agg(F.count("*").alias("n"))


@book.query(
    "WITH y AS (SELECT firm_id, year(enrolled) AS y, string_agg(DISTINCT status, '+' ORDER BY status) AS s FROM debts GROUP BY ALL) SELECT firm_id, string_agg(y || ':' || s, '; ' ORDER BY y) AS regimes, arg_max(s, y) AS latest FROM y GROUP BY firm_id"
)
def regime_by_year(spark, sf_dir):
    d = tables.debts(spark, sf_dir).select("firm_id", F.year("enrolled").alias("year"), "status")
    return registry.regimes(d, "firm_id", "year", "status")


@book.query(
    """WITH e AS (SELECT DISTINCT o_custkey AS source, 's' || l_suppkey AS target FROM orders JOIN lineitem ON o_orderkey = l_orderkey), b AS (SELECT source AS id, count(*) AS degree FROM e GROUP BY ALL)
SELECT degree, count(*) AS nodes FROM b GROUP BY degree"""
)
def graph_degree(spark, sf_dir):
    o, line = tables.read(spark, sf_dir, "orders"), tables.read(spark, sf_dir, "lineitem")
    e = line.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target"))
    return registry.degrees(e).where("side = 'source'").groupBy("degree").agg(F.count("*").alias("nodes"))


_SETS = {"place": ["place"], "place+sector": ["place", "sector"], "region+decade": ["region", "decade"]}


@book.query(
    "WITH p AS (SELECT firm_id, place, sector, region, CAST(floor(firm_id % 97 / 10) AS BIGINT) AS decade FROM firms), "
    + ", ".join(f"s{i} AS (SELECT {', '.join(c)}, count(DISTINCT firm_id) AS n FROM p GROUP BY ALL)" for i, c in enumerate(_SETS.values()))
    + " ".join(
        f"{' UNION ALL' if i else ''} SELECT '{name}' AS quasi_identifiers, count(*) AS combinations, count(*) FILTER (WHERE n < 5) AS below_k, count(*) FILTER (WHERE n = 1) AS unique_combinations, CAST(coalesce(sum(n) FILTER (WHERE n < 5), 0) AS BIGINT) AS persons_below_k FROM s{i}"
        for i, name in enumerate(_SETS)
    )
)
def k_anonymity(spark, sf_dir):
    p = tables.firms(spark, sf_dir).withColumn("decade", F.floor(F.col("firm_id") % 97 / 10))
    return suppress.k_anonymity(p, "firm_id", _SETS)


@book.query(
    "WITH k AS (SELECT place, sector, count(*) AS n FROM firms GROUP BY ALL) SELECT "
    + _hmac_sql("CAST(firm_id AS VARCHAR)")
    + " AS firm, CASE WHEN n >= 12 THEN f.place END AS place, f.sector, CASE WHEN balance <= 0 THEN 'small' WHEN balance <= 5000 THEN 'medium' WHEN balance <= 9000 THEN 'large' ELSE 'top' END AS capital FROM firms f JOIN k ON k.place = f.place AND k.sector = f.sector"
)
def export_anonymized(spark, sf_dir):
    f = tables.firms(spark, sf_dir).withColumn("capital", bands.capital_band(F.col("balance"), (0, 5000, 9000)))
    out = registry.export(f, {"firm_id": "hash", "name": "remove", "place": "k", "region": "remove", "balance": "remove"}, KEY, quasi=["place", "sector"], k=12)
    return suppress.assert_public(out.withColumnRenamed("firm_id", "firm"))


book.sql(
    "key_collection",
    """WITH s AS (SELECT firm_id, segment, year(enrolled) * 100 + month(enrolled) AS snap, CAST(value AS DECIMAL(18,2)) AS v, year(enrolled) = 2000 AS at_reference FROM debts)
SELECT firm_id, segment, min(snap) AS first_snap, max(snap) AS last_snap, CAST(count(DISTINCT snap) AS BIGINT) AS snaps, CAST(count(*) FILTER (WHERE at_reference) AS BIGINT) AS n_reference, CAST(coalesce(sum(v) FILTER (WHERE at_reference), 0) AS DOUBLE) AS v_reference FROM s GROUP BY firm_id, segment""",
)
book.sql("uniqueness_assertion", "SELECT 'debts' AS name, count(*) = count(DISTINCT debt_id) AS is_unique FROM debts UNION ALL SELECT 'payments', count(*) = count(DISTINCT debt_id) FROM payments UNION ALL SELECT 'firms', count(*) = count(DISTINCT firm_id) FROM firms")
book.sql("duplicate_key_audit", "SELECT debt_id, paid_on, CAST(count(*) AS BIGINT) AS n FROM payments GROUP BY debt_id, paid_on HAVING count(*) > 1")
book.sql(
    "raw_against_deduplicated",
    "SELECT raw.n AS rows_raw, dedup.n AS rows_deduplicated, raw.paid AS paid_raw, dedup.paid AS paid_deduplicated FROM (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(amount) AS DOUBLE) AS paid FROM payments) raw CROSS JOIN (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(amount) AS DOUBLE) AS paid FROM (SELECT debt_id, paid_on, max(amount) AS amount FROM payments GROUP BY debt_id, paid_on)) dedup",
)
book.sql(
    "establishments_per_root",
    "SELECT region, CAST(count(*) AS BIGINT) AS units, CAST(count(*) FILTER (WHERE balance > 0) AS BIGINT) AS active, CAST(count(DISTINCT place) AS BIGINT) AS places FROM firms GROUP BY region",
)


@book.query("SELECT 'value' AS field, count(*) AS rows_seen, CAST(0 AS BIGINT) AS nulls, count(*) FILTER (WHERE enrolled < DATE '1996-01-01') AS before_window, count(*) FILTER (WHERE enrolled > DATE '2000-12-31') AS after_window, CAST(0 AS BIGINT) AS impossible FROM debts")
def date_quality(spark, sf_dir):
    return registry.date_profile(tables.debts(spark, sf_dir), {"value": F.col("enrolled")}, "1996-01-01", "2000-12-31")


@book.query("SELECT name AS field, n AS share FROM (SELECT round(avg(CASE WHEN trim(lang) = '' OR lang IS NULL THEN 1.0 ELSE 0 END), 6) AS lang, round(avg(CASE WHEN text IS NULL OR trim(text) = '' THEN 1.0 ELSE 0 END), 6) AS text, 0.0::DOUBLE AS n_chars FROM documents) UNPIVOT (n FOR name IN (lang, text, n_chars))")
def null_profile(spark, sf_dir):
    d = tables.read(spark, sf_dir, "documents").select("lang", "text", "n_chars")
    return registry.null_profile(d)


book.sql(
    "stratified_md5_sample",
    "WITH r AS (SELECT debt_id, segment, row_number() OVER (PARTITION BY segment ORDER BY md5(CAST(debt_id AS STRING)), debt_id) AS i FROM debts) SELECT debt_id, segment FROM r WHERE i <= 20",
    "WITH r AS (SELECT debt_id, segment, row_number() OVER (PARTITION BY segment ORDER BY md5(CAST(debt_id AS VARCHAR)), debt_id) AS i FROM debts) SELECT debt_id, segment FROM r WHERE i <= 20",
)


@book.query(
    """WITH n AS (SELECT segment, count(*) AS n FROM debts GROUP BY ALL), q AS (SELECT segment, n, 100 * n / (SELECT sum(n) FROM n) AS x FROM n), f AS (SELECT *, floor(x) AS base, x - floor(x) AS rest, row_number() OVER (ORDER BY x - floor(x) DESC, segment) AS i FROM q)
SELECT segment, CAST(base + CASE WHEN i <= 100 - (SELECT sum(base) FROM f) THEN 1 ELSE 0 END AS BIGINT) AS take FROM f"""
)
def largest_remainder(spark, sf_dir):
    sizes = tables.debts(spark, sf_dir).groupBy("segment").agg(F.count("*").alias("n"))
    return registry.largest_remainder(sizes, "segment", "n", 100)


@book.query(
    """WITH n AS (SELECT segment, count(*) AS n FROM debts GROUP BY ALL), q AS (SELECT segment, n, 100 * n / (SELECT sum(n) FROM n) AS x FROM n), f AS (SELECT *, floor(x) AS base, row_number() OVER (ORDER BY x - floor(x) DESC, segment) AS i FROM q),
t AS (SELECT segment, base + CASE WHEN i <= 100 - (SELECT sum(base) FROM f) THEN 1 ELSE 0 END AS take FROM f), r AS (SELECT debt_id, segment, row_number() OVER (PARTITION BY segment ORDER BY md5('7' || debt_id), debt_id) AS i FROM debts) SELECT debt_id, r.segment FROM r JOIN t USING (segment) WHERE i <= take"""
)
def stratified_draw(spark, sf_dir):
    d = tables.debts(spark, sf_dir).select("debt_id", "segment")
    take = registry.largest_remainder(d.groupBy("segment").agg(F.count("*").alias("n")), "segment", "n", 100)
    return registry.draw(d, take, "segment", F.md5(F.concat(F.lit("7"), "debt_id")), "debt_id")


@book.query(
    "WITH r AS (SELECT debt_id, firm_id, row_number() OVER (PARTITION BY firm_id ORDER BY md5('c' || debt_id), debt_id) AS i FROM debts), c AS (SELECT * FROM r WHERE i <= 3) SELECT debt_id, firm_id FROM c ORDER BY md5('t' || debt_id), debt_id LIMIT 200"
)
def cluster_sample(spark, sf_dir):
    d = tables.debts(spark, sf_dir).select("debt_id", "firm_id")
    one = d.groupBy("firm_id").agg(F.lit(3).cast("long").alias("take"))
    capped = registry.draw(d, one, "firm_id", F.md5(F.concat(F.lit("c"), "debt_id")), "debt_id")
    return capped.orderBy(F.md5(F.concat(F.lit("t"), "debt_id")), "debt_id").limit(200)


@book.query("SELECT segment, count(*) AS \"count\", count(DISTINCT firm_id) AS count_distinct_firm_id, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS sum_value, max(value) AS max_value FROM debts WHERE status = 'O' GROUP BY segment")
def dataset_aggregate(spark, sf_dir):
    d = tables.debts(spark, sf_dir)
    return registry.aggregate(d, ["segment"], "count,count_distinct:firm_id,sum:value,max:value", filters={"status": "O"})
