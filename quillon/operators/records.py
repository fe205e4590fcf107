"""Rows from semi-structured records: exploding lists, redaction, review of labels, mention extraction."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def explode_moves(parents: DataFrame, key: str, moves: str, fields: str) -> DataFrame:
    """A row per element of a JSON list in text; invalid, null and empty lists give one row with null fields.

    move_id is the md5 of the key and the fields, so the same record has the same id in every run.
    """
    listed = F.from_json(F.col(moves), f"array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in fields.split(','))}>>")
    names = [f.split()[0] for f in fields.split(",")]
    rows = parents.withColumn("_x", F.explode_outer(listed)).select(key, *(F.col(f"_x.{n}").alias(n) for n in names))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key, *names)]
    return rows.withColumn("move_id", F.md5(F.concat_ws("|", *parts)))


def dedupe_moves(moves: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The last row of each move_id in the given order."""
    return moves.withColumn("_i", F.row_number().over(Window.partitionBy("move_id").orderBy(*order))).where("_i = 1").drop("_i")


def redact(rows: DataFrame, column: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Replace matches of ordered rules by their marks such as [EMAIL], and count each mark's replacements as n_email.

    For rules whose matches don't overlap; `redact_spans` settles overlaps.
    """
    out, counts = F.col(column), []
    for pattern, mark in rules:
        name = f"n_{mark.strip('[]').lower()}"
        counts.append(F.regexp_count(out, F.lit(pattern)).alias(name))
        out = F.regexp_replace(out, pattern, mark.replace("\\", "\\\\").replace("$", "\\$"))
    others = [c for c in rows.columns if c != column]
    return rows.select(*others, out.alias(column), *counts)


def resolve_spans(spans: Iterable[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Of overlapping (start, end, priority, mark) keep the earliest, then longest, then of lowest priority number."""
    kept: list[tuple[int, int, int, str]] = []
    for s in sorted(spans, key=lambda s: (s[0], -(s[1] - s[0]), s[2])):
        if not kept or s[0] >= kept[-1][1]:
            kept.append(s)
    return kept


def redact_spans(rows: DataFrame, column: str, rules: Sequence[tuple[str, str]], names: str | None = None, spared: str | None = None) -> DataFrame:
    """Redact by rules and by each row's list of known names; spans that touch an entity name (pattern `spared`) stay.

    Adds n_redacted. Overlaps are settled by `resolve_spans`; that is why this runs in Python, a batch at a time.
    """
    compiled = [(re.compile(p), mark) for p, mark in rules]
    entity = re.compile(spared) if spared else None

    def one(text: str | None, known: Sequence[str] | None) -> tuple[str | None, int]:
        if text is None:
            return None, 0
        spans = [(m.start(), m.end(), i, mark) for i, (p, mark) in enumerate(compiled) for m in p.finditer(text)]
        for name in known if known is not None else ():
            if name:
                spans += [(m.start(), m.end(), len(compiled), "[NAME]") for m in re.finditer(re.escape(name), text, re.IGNORECASE)]
        kept = resolve_spans(spans)
        if entity:
            safe = [m.span() for m in entity.finditer(text)]
            kept = [s for s in kept if not any(a < s[1] and s[0] < b for a, b in safe)]
        out, at = [], 0
        for start, end, _, mark in kept:
            out += [text[at:start], mark]
            at = end
        return "".join([*out, text[at:]]), len(kept)

    others = [f for f in rows.schema.fields if f.name != column]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), f"`{column}` string", "n_redacted long"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [one(t, k) for t, k in zip(b[column], b[names] if names else [None] * len(b), strict=True)]
            yield b.assign(**{column: [d[0] for d in done], "n_redacted": [d[1] for d in done]})[[*(f.name for f in others), column, "n_redacted"]]

    return rows.mapInPandas(run, schema)


#: What may stand before an identifier that is mentioned as a party, in order of trust.
MENTION_RULES = (
    (r"(?i)registered under (?:no\.?|number)\s*$", "registered", 0.95),
    (r"(?i)\bid\s*(?:no\.?|number|:)?\s*$", "labelled", 0.9),
    (r"(?i)\b(?:against|versus|v\.)\s+[^,.;]{2,60},?\s*$", "opponent", 0.8),
    (r"(?i)\b(?:company|firm)\s+[^,.;]{2,60},?\s*$", "company", 0.7),
    (r"\(\s*$", "bracketed", 0.5),
)
_CANDIDATE = re.compile(r"(?<![0-9A-Z])[0-9A-Z]{2}\.?[0-9A-Z]{3}\.?[0-9A-Z]{3}/?[0-9A-Z]{4}-?[0-9]{2}(?![0-9A-Z])")


def check_digits_hold(identifier: str) -> bool:
    from quillon.functions.ids import FIRM_WEIGHTS

    if len(set(identifier)) == 1:
        return False
    for n, weights in zip((12, 13), FIRM_WEIGHTS, strict=True):
        rest = sum((ord(c) - 48) * w for c, w in zip(identifier, weights, strict=False)) % 11
        if identifier[n] != str(0 if rest < 2 else 11 - rest):
            return False
    return True


def extract_mentions(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, start, firm, rule, confidence): identifiers with right check digits, and how their mention reads.

    A list of certificate numbers (three candidates or more in a row with nothing but separators between) is no mention.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, text in zip(b[key], b[column], strict=True):
                found = list(_CANDIDATE.finditer(text or ""))
                listed = [re.fullmatch(r"[\s,;/-]*", text[a.end() : c.start()]) is not None for a, c in itertools.pairwise(found)]
                for i, m in enumerate(found):
                    firm = re.sub(r"[^0-9A-Z]", "", m.group())
                    if not check_digits_hold(firm):
                        continue
                    if sum(listed[max(0, i - 2) : i + 3]) >= 2:
                        continue
                    before = text[max(0, m.start() - 80) : m.start()]
                    rule, confidence = next(((r, c) for p, r, c in MENTION_RULES if re.search(p, before)), ("other", 0.3))
                    out.append((k, m.start(), firm, rule, confidence))
            yield pd.DataFrame(out, columns=["key", "start", "firm", "rule", "confidence"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("key"), F.col(column).alias(column)).withColumnRenamed("key", key).mapInPandas(run, f"key {kind}, start int, firm string, rule string, confidence double").withColumnRenamed("key", key)


def precision_by_stratum(rows: DataFrame, stratum: str, hit: str, right: Column, gate: float) -> DataFrame:
    """Per stratum of reviewed rows: how many the heuristic flagged, the share of them that is right, and whether that reaches the gate."""
    flagged = F.count_if(F.col(hit))
    share = F.try_divide(F.count_if(F.col(hit) & right), F.when(flagged > 0, flagged))
    out = rows.groupBy(stratum).agg(F.count("*").alias("reviewed"), flagged.alias("flagged"), share.alias("_p"))
    return out.select(stratum, "reviewed", "flagged", F.round("_p", 6).alias("precision_share"), F.coalesce(F.col("_p") >= gate, F.lit(False)).alias("promoted"))


def cohen_kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two raters beyond chance, from the table of label pairs."""
    table = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = table.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left = table.groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("l"))
    right = table.groupBy(F.col("b").alias("k")).agg(F.sum("n").alias("r"))
    chance = left.join(right, "k").agg(F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("c"))
    both = total.crossJoin(chance)
    po, pe = F.col("same") / F.col("n"), F.col("c") / (F.col("n") * F.col("n"))
    return both.select("n", F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def merge_edits(rows: DataFrame, edits: DataFrame, key: str, column: str, edit: str) -> DataFrame:
    """A non-empty edit overrides the label."""
    return rows.join(edits.select(key, edit), key, "left").withColumn(column, F.coalesce(F.nullif(F.col(edit), F.lit("")), F.col(column))).drop(edit)


def rounds(frequencies: DataFrame, label: str, n: str, share: float) -> DataFrame:
    """Round 1 has the most frequent labels until `share` of all rows is covered, round 2 the rest."""
    w = Window.orderBy(F.desc(n), F.col(label)).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(n).over(w), F.lit(0))
    return frequencies.select(label, n, F.when(before < share * F.sum(n).over(Window.partitionBy()), 1).otherwise(2).alias("round"))


def top_reasons(rows: DataFrame, by: str, reason: str, example: str, examples: int = 3) -> DataFrame:
    """Counts of reasons with their first examples by id; examples are kept by a bounded window, not collected."""
    w = Window.partitionBy(by, reason).orderBy(example)
    first = rows.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= examples).groupBy(by, reason).agg(F.sort_array(F.collect_list(example)).alias("examples"))
    return rows.groupBy(by, reason).agg(F.count("*").alias("n")).join(first, [by, reason], "left")
