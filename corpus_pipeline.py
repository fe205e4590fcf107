"""From raw documents to token files: STAGES in order, each on what the one before it kept.

All stages keep rows with a null or repeated doc_id apart from one another, keep columns that they don't know whatever their names, read texts whole
however long, and give an empty table for an empty one. Null and empty texts aren't toxic, have no near copies and no
passages, and have no words, so the mix doesn't take them. Near copies are those with a similarity of 0.8 or more; of a group the smallest doc_id stays,
a null one only if there is no other. Equal keys of the mix are taken in the order of doc_id. A document that the mix takes twice is two documents in the token files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontaminate, mixing, neardup, tokens, toxicity
from quillon.llm.common import materialize
from quillon.llm.queries import TOKENIZERS, table, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3; the lexicon is learned from the labelled ones among all documents."""
    return toxicity.keep_clean(docs, toxicity_model(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of the mix, from its token files."""
    return tokens.token_output(docs, f"{TOKENIZERS}/word_bpe_49k.json", end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("tokens", write_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with a written table between one and the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
