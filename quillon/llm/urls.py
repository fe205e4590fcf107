"""URL filters: longest-rule verdicts, and a character language-model ratio for URLs that no rule fits. DataFrame functions only.

Two variable-order Markov models, of URLs that rules allow and of URLs that rules block, are one table of n-grams of up to
`order` characters with counts of both kinds. Each n-gram's probabilities are smoothed with those of the n-gram without
its first character (Dirichlet prior of weight `strength`). A table row holds by how much its n-gram changes the
log-likelihood ratio over that shorter one; a URL's ratio is the sum over all of its n-grams in the table, so
each character counts with the longest context that was seen `least` times or more. The ratio divided by the length is
compared with a threshold. The models learn from the URLs with rules but a quarter of their shapes, by a hash; that
quarter gives the threshold: the one with the best mean of both kinds' recalls.

URLs are modelled from the host on, digits folded to 0, so that equal shapes are scored once however many rows have them.

Null URLs, and those without ://, have empty host and path and an empty shape, fit no rule, and score 0. If the quarter held out has no URLs
of one kind, the threshold is 0. Scores equal to the threshold are allowed. Repeated rows are judged alike. Very long URLs are scored
whole; their cost is linear. An empty table gives an empty result. Columns other than those asked for are dropped, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import materialize

#: More rules than this are joined by host suffix rather than written out as one expression.
INLINE_RULES = 256
BINS, SPAN = 2000, 10.0


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased."""
    found = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _split(rule: str) -> tuple[str, str]:
    name, slash, rest = rule.partition("/")
    return name, slash + rest


def with_rule(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds `rule` and `rule_verdict` to rows with `host` and `path`: those of the longest rule that fits, or null.

    rules: (verdict, host and path prefix). Of rules of one length the first listed wins.
    """
    ordered = sorted(enumerate(rules), key=lambda x: (-len(x[1][1]), x[0]))
    if len(rules) <= INLINE_RULES:
        rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
        for _, (kind, text) in reversed(ordered):
            name, start = _split(text)
            fits = ((F.col("host") == name) | F.col("host").endswith(f".{name}")) & F.col("path").startswith(start)
            rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
        return df.withColumns({"rule": rule, "rule_verdict": verdict})
    spark = df.sparkSession
    rows = [(*_split(text), text, kind, -i) for i, (_, (kind, text)) in enumerate(ordered)]
    known = spark.createDataFrame(rows, "suffix string, start string, rule string, rule_verdict string, rank int")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    by_host = df.select("host").distinct().select("host", F.explode(suffixes).alias("suffix")).join(known, "suffix")
    by_host = materialize(by_host.groupBy("host").agg(F.collect_list(F.struct("rank", "start", "rule", "rule_verdict")).alias("fits")), "rules")
    best = F.array_max(F.filter("fits", lambda r: F.col("path").startswith(r["start"])))
    return df.join(by_host, "host", "left").withColumn("best", best).select(*df.columns, "best.rule", "best.rule_verdict")


def shape(url: Column) -> Column:
    """What the models see of a URL."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)), "[0-9]", "0"), F.lit(""))


def held_out(shape_id: Column) -> Column:
    """A quarter of the shapes: an MD5 digest that begins with 0 to 3."""
    return F.left(shape_id, F.lit(1)) < "4"


def ngrams(df: DataFrame, text: str, order: int) -> DataFrame:
    """A row per n-gram of 1 to `order` characters; ^ stands for the start, $ for the end. Linear in the text; rows carry the other columns, not the text."""
    kept = [c for c in df.columns if c != text]
    chars = F.filter(F.split(F.concat(F.lit("^" * (order - 1)), F.col(text), F.lit("$")), ""), lambda c: c != "")
    rows = df.withColumn("_chars", chars).withColumn("_n1", F.slice("_chars", order, F.size("_chars")))
    for n in range(2, order + 1):  # a character more in front of each
        rows = rows.withColumn(f"_n{n}", F.zip_with(F.slice("_chars", order - n + 1, F.size("_n1")), f"_n{n - 1}", lambda a, b: F.concat(a, b)))
    tagged = F.array(*(F.struct(F.lit(n).alias("n"), F.col(f"_n{n}").alias("grams")) for n in range(1, order + 1)))
    rows = rows.select(*kept, F.explode(tagged).alias("_g"))
    return rows.select(*kept, F.col("_g.n").alias("_n"), F.explode("_g.grams").alias("gram"))


def train(shapes: DataFrame, order: int, strength: float, least: int) -> DataFrame:
    """(gram, gain) from (shape, allowed, blocked): the written table of both models."""
    seen = shapes.where("allowed + blocked > 0").select("shape", "allowed", "blocked")
    counts = materialize(ngrams(seen, "shape", order).groupBy("gram", F.col("_n").alias("n")).agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")), "counts")
    total = counts.where("n = 1").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("v")).first()
    spark, done = shapes.sparkSession, None
    n_a, n_b, size = total["a"] or 0, total["b"] or 0, max(1, total["v"])
    for n in range(1, order + 1):
        own = counts.where(F.col("n") == n).withColumn("context", F.expr(f"substr(gram, 1, {n - 1})"))
        if n == 1:
            level = own.selectExpr("gram", "a", "b", f"double({n_a}) as ca", f"double({n_b}) as cb", f"1D / {size} as la", f"1D / {size} as lb", "0D as old")
        else:
            contexts = own.groupBy("context").agg(F.sum("a").alias("ca"), F.sum("b").alias("cb"))
            lower = done.where(F.col("n") == n - 1).select(F.col("gram").alias("suffix"), F.col("pa").alias("la"), F.col("pb").alias("lb"))
            level = own.where(F.col("a") + F.col("b") >= least).join(contexts, "context").withColumn("suffix", F.expr("substr(gram, 2)")).join(lower, "suffix").withColumn("old", F.log(F.col("la") / F.col("lb")))
        level = level.withColumn("pa", (F.col("a") + strength * F.col("la")) / (F.col("ca") + strength)).withColumn("pb", (F.col("b") + strength * F.col("lb")) / (F.col("cb") + strength))
        level = materialize(level.select(F.lit(n).alias("n"), "gram", "pa", "pb", (F.log(F.col("pa") / F.col("pb")) - F.col("old")).alias("gain")), f"level{n}")
        done = level if done is None else done.union(level)
    return materialize(done.select("gram", "gain"), "model") if done is not None else spark.createDataFrame([], "gram string, gain double")


def threshold(scored: DataFrame) -> float:
    """The score from which on to allow: best mean of both kinds' recalls, by a histogram of fixed size."""
    bin_ = F.floor((F.greatest(F.lit(-SPAN), F.least(F.lit(SPAN), "score")) + SPAN) * (BINS / (2 * SPAN)))
    rows = scored.groupBy(bin_.alias("bin")).agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).orderBy("bin").collect()
    a, b = sum(r["a"] for r in rows), sum(r["b"] for r in rows)
    if not a or not b:
        return 0.0
    best, at, below_a, below_b = 1.0, -SPAN, 0, 0
    for i, r in enumerate(rows):
        below_a, below_b = below_a + r["a"], below_b + r["b"]
        if (gain := (a - below_a) / a + below_b / b) > best + 1e-12:
            following = rows[i + 1]["bin"] if i + 1 < len(rows) else r["bin"] + 1
            best, at = gain, (r["bin"] + 1 + following) / 2 * (2 * SPAN / BINS) - SPAN
    return at


def judge(pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url", order: int = 5, strength: float = 4.0, least: int = 2) -> DataFrame:
    """(key, host, path, rule, verdict, score): score is null where a rule decides."""
    rows = pages.select(F.col(key).alias(key), F.col(url).cast("string").alias("_url"))
    rows = rows.select(key, host(F.col("_url")).alias("host"), path(F.col("_url")).alias("path"), shape(F.col("_url")).alias("shape"))
    rows = with_rule(rows, rules)
    kinds = rows.groupBy("shape").agg(F.count_if(F.col("rule_verdict") == "allow").alias("allowed"), F.count_if(F.col("rule_verdict") == "block").alias("blocked"))
    kinds = materialize(kinds.withColumn("id", F.md5(F.col("shape").cast("binary"))), "shapes")
    model = train(kinds.where(~held_out(F.col("id"))), order, strength, least)
    sums = ngrams(kinds.select("id", "shape"), "shape", order).join(model, "gram").groupBy("id").agg(F.sum("gain").alias("gain"))
    scored = kinds.join(sums, "id", "left").select("id", "shape", "allowed", "blocked", F.when(F.col("shape") == "", 0.0).otherwise(F.coalesce("gain", F.lit(0.0)) / (F.length("shape") + 1)).alias("score"))
    scored = materialize(scored, "scores")
    cut = threshold(scored.where(held_out(F.col("id"))))
    out = rows.join(scored.select("shape", "score"), "shape", "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return out.select(key, "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("rule").isNull(), F.col("score")).alias("score"))
