"""Text and records: exploding, classifying, redacting, linking, and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon import tables
from quillon.functions import bands, text
from quillon.operators import records
from quillon.plans.base import Book

book = Book()

RULES = (("(?i)total", "total"), ("(?i)pf|tz", "german_sound"), ("^[A-Z]{2}", "capitals"), ("[0-9]", "digits"), ("tion", "tion"))


@book.query("SELECT trim(split_part(ltrim(text), chr(10), 1)) AS line, count(*) AS n FROM documents GROUP BY ALL", roles=False)
def first_line_frequency(spark, sf_dir):
    d = tables.read(spark, sf_dir, "documents")
    return d.groupBy(text.first_line(F.col("text")).alias("line")).agg(F.count("*").alias("n"))


_CASE = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{label}'" for p, label in RULES) + " ELSE 'inconclusive' END"


@book.query(f"WITH c AS (SELECT {_CASE} AS klass FROM documents) SELECT klass, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4)::DOUBLE AS percent FROM c GROUP BY klass", roles=False)
def rule_labels(spark, sf_dir):
    d = tables.read(spark, sf_dir, "documents").select(text.first_rule(F.col("text"), RULES, "inconclusive").alias("klass"))
    per = d.groupBy("klass").agg(F.count("*").alias("n"))
    return per.select("klass", "n", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("percent"))


@book.query(
    f"WITH c AS (SELECT lang, {_CASE} = 'inconclusive' AS hit, quality FROM documents JOIN labels USING (doc_id)) SELECT lang, count(*) AS reviewed, count(*) FILTER (WHERE hit) AS flagged, round(count(*) FILTER (WHERE hit AND quality = 1) / nullif(count(*) FILTER (WHERE hit), 0), 6) AS precision_share, coalesce(count(*) FILTER (WHERE hit AND quality = 1) / nullif(count(*) FILTER (WHERE hit), 0) >= 0.7, false) AS promoted FROM c GROUP BY lang",
    roles=False,
)
def precision_gates(spark, sf_dir):
    d = tables.read(spark, sf_dir, "documents").select("doc_id", "lang", (text.first_rule(F.col("text"), RULES, "inconclusive") == "inconclusive").alias("hit"))
    rows = d.join(tables.read(spark, sf_dir, "labels"), "doc_id")
    return records.precision_by_stratum(rows, "lang", "hit", F.col("quality") == 1, gate=0.7)


@book.query("WITH t AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type FROM events) SELECT event_type, k, count(*) AS n FROM t GROUP BY ALL", roles=False)
def json_fields(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("k"))
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"))


_MOVES = "WITH m AS (SELECT conv_id, list({'turn': turn, 'role': role} ORDER BY turn) AS moves FROM conversations GROUP BY conv_id), a AS (SELECT c.conv_id, m.moves FROM (SELECT conv_id FROM conversations UNION SELECT -1 - conv_id FROM conversations) c LEFT JOIN m USING (conv_id))"


@book.query(
    _MOVES + " SELECT conv_id, x.turn AS turn, x.role AS role, md5(conv_id || '|' || coalesce(CAST(x.turn AS VARCHAR), '') || '|' || coalesce(x.role, '')) AS move_id FROM (SELECT conv_id, unnest(CASE WHEN moves IS NULL THEN [NULL] ELSE moves END) AS x FROM a)", roles=False
)
def json_explode(spark, sf_dir):
    c = tables.read(spark, sf_dir, "conversations")
    lists = c.groupBy("conv_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("turn", "role")))).alias("moves"))
    # every other parent, of a negative id, has no movements
    parents = c.select(F.explode(F.array("conv_id", -1 - F.col("conv_id"))).alias("conv_id")).distinct().join(lists, "conv_id", "left")
    return records.explode_moves(parents, "conv_id", "moves", "turn bigint, role string")


@book.query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS versions FROM events GROUP BY user_id", roles=False)
def newest_rescrape(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("event_id"), F.count("*").alias("versions"))


_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda x: x <> ''))"


@book.query(
    f"WITH b AS (SELECT item_id, {_TOKENS} AS t FROM benchmark) SELECT a.item_id AS first_item, b.item_id AS second_item, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard FROM b a JOIN b ON b.item_id = a.item_id + 1", roles=False
)
def token_jaccard(spark, sf_dir):
    b = tables.read(spark, sf_dir, "benchmark").select("item_id", text.tokens(F.col("text")).alias("t"))
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("second_item"), F.col("t").alias("t2"))
    return b.join(nxt, "item_id").select(F.col("item_id").alias("first_item"), "second_item", F.round(text.token_jaccard(F.col("t"), F.col("t2")), 6).alias("jaccard"))


@book.query(
    """WITH r AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+', '[EMAIL]', 'g'), '\\+[0-9][ ().0-9-]+[0-9]', '[PHONE]', 'g'), '[0-9]{16}', '[CARD]', 'g') AS t FROM documents)
SELECT doc_id, md5(t) AS digest, (length(t) - length(replace(t, '[EMAIL]', ''))) // 7 AS emails, (length(t) - length(replace(t, '[PHONE]', ''))) // 7 AS phones, (length(t) - length(replace(t, '[CARD]', ''))) // 6 AS cards FROM r""",
    roles=False,
)
def redaction_rules(spark, sf_dir):
    rules = ((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]"), (r"\+[0-9][ ().0-9-]+[0-9]", "[PHONE]"), (r"[0-9]{16}", "[CARD]"))
    out = records.redact(tables.read(spark, sf_dir, "documents").select("doc_id", "text"), "text", rules)
    return out.select("doc_id", F.md5("text").alias("digest"), F.col("n_email").cast("long").alias("emails"), F.col("n_phone").cast("long").alias("phones"), F.col("n_card").cast("long").alias("cards"))


@book.query("WITH s AS (SELECT conv_id, turn, role, text, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT before, role, count(*) AS n, max(length(text))::BIGINT AS longest FROM s GROUP BY before, role", roles=False)
def dialogue_transitions(spark, sf_dir):
    c = tables.read(spark, sf_dir, "conversations").withColumn("before", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.groupBy("before", "role").agg(F.count("*").alias("n"), F.max(F.length("text")).cast("long").alias("longest"))


@book.query("SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, count(*) AS pages, count(DISTINCT regexp_extract(html, '<title>([^<]*)', 1)) AS titles FROM pages GROUP BY ALL", roles=False)
def hosts_and_titles(spark, sf_dir):
    p = tables.read(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))
    return p.groupBy("host").agg(F.count("*").alias("pages"), F.count_distinct("title").alias("titles"))


@book.query("WITH k AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'R$ 1.' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || ',50' WHEN 1 THEN '-' WHEN 2 THEN NULL WHEN 3 THEN 'abc' ELSE CAST(c_custkey AS VARCHAR) END AS raw FROM customer) SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 1000.0 + c_custkey % 1000 + 0.5 WHEN 4 THEN c_custkey::DOUBLE END::DOUBLE AS amount FROM k", roles=False)
def currency_cleaning(spark, sf_dir):
    k = F.col("c_custkey")
    raw = F.when(k % 5 == 0, F.concat(F.lit("R$ 1."), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(",50"))).when(k % 5 == 1, "-").when(k % 5 == 2, F.lit(None)).when(k % 5 == 3, "abc").otherwise(k.cast("string"))
    return tables.read(spark, sf_dir, "customer").select("c_custkey", text.currency(raw).alias("amount"))


@book.query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 6 = 1 THEN NULL WHEN o_orderkey % 6 = 2 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS parsed, CAST(o_orderdate AS DATE) AS latest FROM orders", roles=False
)
def date_parsing(spark, sf_dir):
    o = tables.read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    k = F.col("o_orderkey") % 6
    raw = F.when(k == 0, "00000000").when(k == 1, " ").when(k == 2, "19991340").otherwise(F.date_format("d", "yyyyMMdd"))
    listed = F.concat(F.lit('["01/01/1990", "x", "'), F.date_format("d", "dd/MM/yyyy"), F.lit('"]'))
    return o.select("o_orderkey", text.parse_date(raw).alias("parsed"), text.latest_date(text.json_strings(listed)).alias("latest"))


@book.query("SELECT age_band, parcels, size_band, count(*) AS n FROM (SELECT CASE WHEN x <= 0 THEN NULL WHEN x <= 2 THEN '0-2' WHEN x <= 5 THEN '2-5' WHEN x <= 10 THEN '5-10' ELSE '>10' END AS age_band, CASE WHEN k <= 0 THEN NULL WHEN k <= 1 THEN '1' WHEN k <= 12 THEN '2-12' WHEN k <= 60 THEN '13-60' ELSE '>60' END AS parcels, CASE WHEN value <= 10000 THEN 'small' WHEN value <= 100000 THEN 'medium' WHEN value <= 1000000 THEN 'large' ELSE 'top' END AS size_band FROM (SELECT (debt_id % 25 - 1) / 2 AS x, debt_id % 70 - 2 AS k, value FROM debts)) GROUP BY ALL")
def banding(spark, sf_dir):
    d = tables.debts(spark, sf_dir)
    return d.groupBy(bands.age_band((F.col("debt_id") % 25 - 1) / 2).alias("age_band"), bands.instalment_band(F.col("debt_id") % 70 - 2).alias("parcels"), bands.capital_band(F.col("value")).alias("size_band")).agg(F.count("*").alias("n"))


@book.query("SELECT s_suppkey, coalesce(m[s_nationkey % 3], 'unknown') AS label, m[s_nationkey % 3] AS strict_label FROM (SELECT *, MAP {0: 'zero', 1: 'one'} AS m FROM supplier)", roles=False)
def label_map(spark, sf_dir):
    known = F.create_map(F.lit(0), F.lit("zero"), F.lit(1), F.lit("one"))
    label = F.try_element_at(known, F.col("s_nationkey") % 3)
    return tables.read(spark, sf_dir, "supplier").select("s_suppkey", F.coalesce(label, F.lit("unknown")).alias("label"), label.alias("strict_label"))


@book.query("SELECT firm_id, (firm_id % 7 = 0)::BOOLEAN AND CASE WHEN firm_id % 5 = 0 THEN NULL ELSE true END AS both_hold, NOT (place IS NOT DISTINCT FROM CASE WHEN firm_id % 3 = 0 THEN NULL ELSE place END) AS differs FROM firms")
def three_valued_logic(spark, sf_dir):
    k = F.col("firm_id")
    other = F.when(k % 3 != 0, F.col("place"))
    return tables.firms(spark, sf_dir).select("firm_id", ((k % 7 == 0) & F.when(k % 5 != 0, F.lit(True))).alias("both_hold"), (~F.col("place").eqNullSafe(other)).alias("differs"))


book.sql(
    "try_casts",
    "SELECT p_partkey, try_cast(substr(p_name, 1, 3) AS INT) AS no_number, try_cast(concat('1', p_size) AS INT) AS number, try_divide(CAST(p_size AS DOUBLE), p_size % 5) AS quotient FROM part",
    "SELECT p_partkey, try_cast(substr(p_name, 1, 3) AS INTEGER) AS no_number, try_cast('1' || p_size AS INTEGER) AS number, CAST(p_size AS DOUBLE) / nullif(p_size % 5, 0) AS quotient FROM part",
)
book.sql(
    "math_functions",
    "SELECT p_partkey, round(ln(p_retailprice), 9) AS l, round(log10(p_retailprice), 9) AS l10, round(log1p(p_size), 9) AS l1, round(asinh(p_size), 9) AS ash, round(sqrt(p_size), 9) AS root, CAST(greatest(p_size, 10) AS INT) AS high, CAST(least(p_size, 10) AS INT) AS low, round(ln((p_size + 0.5D) / (50 - p_size + 0.5D)), 9) AS log_odds FROM part WHERE p_size <= 50",
    "SELECT p_partkey, round(ln(p_retailprice), 9) AS l, round(log10(p_retailprice), 9) AS l10, round(ln(1 + p_size), 9) AS l1, round(asinh(p_size), 9) AS ash, round(sqrt(p_size), 9) AS root, greatest(p_size, 10) AS high, least(p_size, 10) AS low, round(ln((p_size + 0.5) / (50 - p_size + 0.5)), 9) AS log_odds FROM part WHERE p_size <= 50",
)
book.sql(
    "like_and_regex_predicates",
    "SELECT CAST(count(*) FILTER (WHERE p_type LIKE '%a%') AS BIGINT) AS has_a, CAST(count(*) FILTER (WHERE p_name ILIKE 'P%') AS BIGINT) AS starts_p, CAST(count(*) FILTER (WHERE rlike(p_brand, '^[A-Za-z]+#[0-9]+$')) AS BIGINT) AS shaped, CAST(count(*) FILTER (WHERE p_size BETWEEN 5 AND 9) AS BIGINT) AS between_sizes, CAST(count(*) FILTER (WHERE p_size IN (1, 2, 3)) AS BIGINT) AS in_sizes FROM part",
    "SELECT count(*) FILTER (WHERE p_type LIKE '%a%') AS has_a, count(*) FILTER (WHERE p_name ILIKE 'P%') AS starts_p, count(*) FILTER (WHERE regexp_matches(p_brand, '^[A-Za-z]+#[0-9]+$')) AS shaped, count(*) FILTER (WHERE p_size BETWEEN 5 AND 9) AS between_sizes, count(*) FILTER (WHERE p_size IN (1, 2, 3)) AS in_sizes FROM part",
)
book.sql(
    "string_functions",
    "SELECT c_custkey, upper(left(c_name, 4)) AS head, lpad(CAST(c_custkey AS STRING), 8, '0') AS padded, replace(c_name, '#', '-') AS changed, CAST(length(c_name) AS INT) AS size, concat(substr(c_mktsegment, 2, 3), '|', repeat('x', CAST(c_custkey % 3 AS INT))) AS built, startswith(c_name, 'C') AS c_first FROM customer",
    "SELECT c_custkey, upper(left(c_name, 4)) AS head, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS padded, replace(c_name, '#', '-') AS changed, CAST(length(c_name) AS INTEGER) AS size, substr(c_mktsegment, 2, 3) || '|' || repeat('x', c_custkey % 3) AS built, starts_with(c_name, 'C') AS c_first FROM customer",
)
book.sql(
    "array_functions",
    "SELECT firm_id, size(array_distinct(xs)) AS distinct_segments, array_max(xs) AS last_one, aggregate(transform(xs, x -> CAST(substr(x, 1, 1) AS INT)), 0, (a, x) -> a + x) AS total FROM (SELECT firm_id, collect_list(segment) AS xs FROM debts GROUP BY firm_id)",
    "SELECT firm_id, CAST(len(list_distinct(xs)) AS INTEGER) AS distinct_segments, list_max(xs) AS last_one, CAST(list_sum(list_transform(xs, lambda x: CAST(substr(x, 1, 1) AS INTEGER))) AS INTEGER) AS total FROM (SELECT firm_id, list(segment) AS xs FROM debts GROUP BY firm_id)",
)


@book.query("WITH r AS (SELECT doc_id, (doc_id % 5 < 2)::INTEGER AS a, quality AS b FROM labels), m AS (SELECT count(*) AS n, avg((a = b)::INTEGER) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe FROM r) SELECT n, round((po - pe) / (1 - pe), 6) AS kappa FROM m", roles=False)
def cohen_kappa(spark, sf_dir):
    rows = tables.read(spark, sf_dir, "labels").select((F.col("doc_id") % 5 < 2).cast("int").alias("a"), F.col("quality").alias("b"))
    return records.cohen_kappa(rows, "a", "b").select("n", F.round("kappa", 6).alias("kappa"))


@book.query("SELECT d.doc_id, coalesce(nullif(CASE WHEN l.quality = 0 THEN 'low' WHEN l.toxic = 1 THEN '' END, ''), d.lang) AS label FROM documents d LEFT JOIN labels l USING (doc_id)", roles=False)
def manual_edits(spark, sf_dir):
    l = tables.read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "").alias("edit"))  # noqa: E741
    return records.merge_edits(tables.read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label")), l, "doc_id", "label", "edit")


@book.query(
    "WITH f AS (SELECT split_part(c_name, '#', 1) || '-' || c_nationkey AS label, count(*) AS n FROM customer GROUP BY ALL), c AS (SELECT label, n, sum(n) OVER (ORDER BY n DESC, label ROWS UNBOUNDED PRECEDING) - n AS before, sum(n) OVER () AS total FROM f) SELECT label, n, CASE WHEN before < 0.8 * total THEN 1 ELSE 2 END AS round FROM c", roles=False
)
def review_rounds(spark, sf_dir):
    label = F.concat(F.substring_index("c_name", "#", 1), F.lit("-"), "c_nationkey")
    f = tables.read(spark, sf_dir, "customer").groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    return records.rounds(f, "label", "n", 0.8)


@book.query("SELECT source, reason, n FROM (SELECT source, CASE WHEN n_chars < 100 THEN 'short' WHEN lang <> 'en' THEN 'foreign' ELSE 'other' END AS reason, count(*) AS n FROM documents GROUP BY ALL)", roles=False)
def error_taxonomy(spark, sf_dir):
    reason = F.when(F.col("n_chars") < 100, "short").when(F.col("lang") != "en", "foreign").otherwise("other")
    return records.top_reasons(tables.read(spark, sf_dir, "documents").withColumn("reason", reason), "source", "reason", "doc_id").select("source", "reason", "n")


@book.query("SELECT s_suppkey, s_name AS name, lower(regexp_replace(regexp_replace(s_name, '[^A-Za-z0-9 ]+', ' ', 'g'), '\\b0+([0-9])', '\\1', 'g')) AS place FROM supplier", roles=False)
def place_names(spark, sf_dir):
    return tables.read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"), text.normalize_place(F.col("s_name")).alias("place"))
