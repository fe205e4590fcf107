"""All queries of the library and their DuckDB twins, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.plans import analytics, forms, portfolio, registry, series, statistics, stored, streams, texts

Query = Callable[[SparkSession, str], DataFrame]
BOOKS = (portfolio.book, analytics.book, series.book, registry.book, texts.book, forms.book, stored.book, statistics.book, streams.book)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual recovery by cohort and age band, small cells withheld."""
    return portfolio.recovery_by_cohort_band(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: q for book in BOOKS for name, q in book.queries.items()}


def oracles() -> dict[str, str]:
    return {name: text for book in BOOKS for name, text in book.oracles.items()}
