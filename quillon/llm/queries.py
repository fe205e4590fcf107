"""One query per corpus operator, over its whole table with production parameters, and the DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from quillon.llm import decontaminate, mixing, neardup, pii, preferences, tokens, toxicity, urls, vectors, warc

#: Vocabulary files are never copied here; this is where the public ones are installed.
TOKENIZERS = "/opt/tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_output(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json", end_id=2)


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    return toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~toxicity.held_out("doc_id"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    rows = preferences.format_pairs(conversations, preferences.neighbours(conversations))
    told = lambda mask: F.array_join(F.transform(mask, lambda m: F.concat_ws(":", m["start"].cast("string"), m["length"].cast("string"))), ",").alias(mask)
    return rows.select("pair_id", "part", "prefix_turns", "prompt", "chosen", told("chosen_mask"), "rejected", told("rejected_mask"))


URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.decide(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.round_trip(table(spark, sf_dir, "pages"), with_payload=False)
    return captures.select(
        F.col("metadata.page_id").alias("page_id"),
        F.col("metadata.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("metadata.refers_to").alias("refers_to"),
    )


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


_ALL = (
    op1_token_output,
    op2_near_vectors,
    op3_toxicity,
    op4_decontaminate,
    op5_preferences,
    op6_url_filter,
    op7_personal_data,
    op8_mix_sources,
    op9_warc_transactions,
    op10_near_duplicates,
)
QUERIES = {f.__name__: f for f in _ALL}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Smallest id reachable over the undirected links (a, b), for ids from `nodes`.
_REACH = """two_way AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, m) AS (SELECT id, id FROM nodes UNION SELECT two_way.b, reach.m FROM reach JOIN two_way ON two_way.a = reach.id WHERE reach.m < two_way.b),
least_id AS (SELECT id, min(m) AS component_id FROM reach GROUP BY id)"""



def _rendered(side: str) -> str:
    return f"'<|' || {side}_role || '|>' || chr(10) || {side}_text || '<|end|>' || chr(10)"


def _completion(side: str, name: str) -> str:
    mine = f"NOT shared AND {side}_role IS NOT NULL"
    return (
        f"coalesce(string_agg({_rendered(side)}, '' ORDER BY turn) FILTER (WHERE {mine}), '') AS {name}, "
        f"coalesce(string_agg(({side}_before + length({side}_role) + 5) || ':' || (length({side}_text) + 8), ',' ORDER BY turn) FILTER (WHERE {mine} AND {side}_role = 'assistant'), '') AS {name}_mask"
    )


def _before(side: str) -> str:
    size = f"CASE WHEN NOT shared THEN length({side}_role) + length({side}_text) + 13 END"
    return f"CAST(coalesce(sum({size}) OVER (PARTITION BY pair_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS {side}_before"


def _url_twin(order: int = 5, strength: float = 4.0, least: int = 2) -> str:
    """The rules, both models, the ratio and the threshold, in one statement."""
    host, path = "regexp_extract(rest, '^[^/?#]*')", "regexp_extract(rest, '^[^/?#]*([^?#]*)', 1)"
    ordered = sorted(URL_RULES, key=lambda x: -len(x[1]))
    fits = lambda r: f"(host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')"
    chain = lambda what: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{what(kind, r)}'" for kind, r in ordered) + " END"
    pad = f"repeat('^', {order - 1}) || shape || '$'"
    parts = [
        "u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"h AS (SELECT page_id, translate({host}, '{_UPPER}', '{_LOWER}') AS host, {path} AS path, regexp_replace(lower(rest), '[0-9]', '0', 'g') AS shape FROM (SELECT page_id, coalesce(rest, '') AS rest FROM u))",
        f"r AS (SELECT *, {chain(lambda kind, r: r)} AS rule, {chain(lambda kind, r: kind)} AS said FROM h)",
        "k AS (SELECT shape, substr(md5(shape), 1, 1) < '4' AS held, count(*) FILTER (WHERE said = 'allow') AS a, count(*) FILTER (WHERE said = 'block') AS b FROM r GROUP BY shape)",
        f"g AS (SELECT shape, held, a, b, n, substr({pad}, i - n + 1, n) AS gram FROM (SELECT *, unnest(range({order}, length(shape) + {order + 1})) AS i FROM k), range(1, {order + 1}) t(n))",
        "c AS (SELECT gram, n, sum(a) AS a, sum(b) AS b FROM g WHERE NOT held AND a + b > 0 GROUP BY gram, n)",
        f"l1 AS (SELECT gram, (a + {strength} / v) / (ca + {strength}) AS pa, (b + {strength} / v) / (cb + {strength}) AS pb, ln(((a + {strength} / v) / (ca + {strength})) / ((b + {strength} / v) / (cb + {strength}))) AS gain FROM (SELECT *, sum(a) OVER () AS ca, sum(b) OVER () AS cb, count(*) OVER () AS v FROM c WHERE n = 1))",
    ]
    for n in range(2, order + 1):
        pa, pb = f"(x.a + {strength} * l.pa) / (x.ca + {strength})", f"(x.b + {strength} * l.pb) / (x.cb + {strength})"
        parts.append(
            f"l{n} AS (SELECT x.gram, {pa} AS pa, {pb} AS pb, ln(({pa}) / ({pb})) - ln(l.pa / l.pb) AS gain FROM (SELECT *, sum(a) OVER (PARTITION BY substr(gram, 1, {n - 1})) AS ca, sum(b) OVER (PARTITION BY substr(gram, 1, {n - 1})) AS cb FROM c WHERE n = {n}) x JOIN l{n - 1} l ON l.gram = substr(x.gram, 2) WHERE x.a + x.b >= {least})"
        )
    parts += [
        "m AS (" + " UNION ALL ".join(f"SELECT gram, gain FROM l{n}" for n in range(1, order + 1)) + ")",
        "s AS (SELECT shape, held, a, b, CASE WHEN shape = '' THEN 0 ELSE coalesce(sum(gain), 0) / (length(shape) + 1) END AS score FROM g LEFT JOIN m USING (gram) GROUP BY shape, held, a, b)",
        "z AS (SELECT CAST(floor((greatest(-10.0, least(10.0, score)) + 10) * 100) AS BIGINT) AS bin, sum(a) AS a, sum(b) AS b FROM s WHERE held GROUP BY 1)",
        "y AS (SELECT bin, coalesce(lead(bin) OVER (ORDER BY bin), bin + 1) AS following, (sum(a) OVER () - sum(a) OVER (ORDER BY bin)) / sum(a) OVER () + sum(b) OVER (ORDER BY bin) / sum(b) OVER () AS gain FROM z)",
        "t AS (SELECT CASE WHEN (SELECT coalesce(min(n), 0) FROM (SELECT sum(a) AS n FROM z UNION ALL SELECT sum(b) FROM z)) = 0 THEN 0 ELSE coalesce((SELECT (bin + 1 + following) / 2 * 0.01 - 10 FROM y WHERE gain > 1 + 1e-12 ORDER BY round(gain, 12) DESC, bin LIMIT 1), -10) END AS cut)",
    ]
    return f"WITH {', '.join(parts)} SELECT page_id, host, path, rule, coalesce(said, CASE WHEN score >= cut THEN 'allow' ELSE 'block' END) AS verdict FROM r JOIN s USING (shape), t"


ORACLES: dict[str, str] = {
    "op5_preferences": f"""WITH w AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS i FROM (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
c AS (SELECT conv_id // 2 AS pair_id, turn, role, text FROM w WHERE i = 1 AND conv_id % 2 = 0), r AS (SELECT conv_id // 2 AS pair_id, turn, role, text FROM w WHERE i = 1 AND conv_id % 2 = 1),
b AS (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.turn, r.turn) AS turn, c.role AS c_role, c.text AS c_text, r.role AS r_role, r.text AS r_text, coalesce(c.role = r.role AND c.text = r.text, false) AS same FROM c FULL JOIN r ON c.pair_id = r.pair_id AND c.turn = r.turn),
f AS (SELECT pair_id, min(turn) FILTER (WHERE NOT same) AS cut FROM b GROUP BY pair_id), p AS (SELECT b.*, cut IS NULL OR turn < cut AS shared FROM b JOIN f USING (pair_id)), q AS (SELECT *, {_before("c")}, {_before("r")} FROM p)
SELECT pair_id, CAST(0 AS BIGINT) AS part, count(*) FILTER (WHERE shared) AS prefix_turns, coalesce(string_agg({_rendered("c")}, '' ORDER BY turn) FILTER (WHERE shared), '') AS prompt, {_completion("c", "chosen")}, {_completion("r", "rejected")} FROM q GROUP BY pair_id""",
    "op6_url_filter": _url_twin(),
    "op2_near_vectors": f"""WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), u AS (SELECT id, x, sqrt(list_dot_product(x, x)) AS size FROM v),
nodes AS (SELECT id FROM u), links AS (SELECT p.id AS a, q.id AS b FROM u p JOIN u q ON p.id < q.id WHERE list_dot_product(p.x, q.x) >= 0.9 * p.size * q.size), {_REACH},
n AS (SELECT a AS id, count(*) AS n FROM two_way GROUP BY a)
SELECT u.id AS vec_id, coalesce(n.n, 0) AS n_links, component_id, u.id = component_id AS kept FROM u JOIN least_id USING (id) LEFT JOIN n USING (id)""",
    "op9_warc_transactions": """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN first_id END AS refers_to FROM f""",
    "op10_near_duplicates": f"""WITH RECURSIVE w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w),
c AS (SELECT id, count(*) AS n FROM s GROUP BY id), nodes AS (SELECT id FROM w),
k AS (SELECT p.id AS a, q.id AS b, count(*) AS n FROM s p JOIN s q ON p.s = q.s AND p.id < q.id GROUP BY p.id, q.id),
links AS (SELECT a, b FROM k JOIN c x ON x.id = a JOIN c y ON y.id = b WHERE 100 * k.n >= 85 * (x.n + y.n - k.n)), {_REACH}
SELECT w.id AS doc_id, coalesce(c.n, 0) AS n_shingles, component_id, w.id = component_id AS kept FROM w JOIN least_id USING (id) LEFT JOIN c USING (id)""",
}
