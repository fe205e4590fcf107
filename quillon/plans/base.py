"""How the modules of queries register what they have."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon import tables

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    """Queries and their DuckDB twins, by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, oracle: str | None = None, roles: bool = True) -> Callable[[Query], Query]:
        """Register a function; the oracle may use the roles debts, payments and firms as tables."""

        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if oracle:
                self.oracles[f.__name__] = _with_roles(oracle) if roles else oracle
            return f

        return add

    def sql(self, name: str, text: str, oracle: str | None = None) -> None:
        """Register a statement that Spark and DuckDB both take, or one for each."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tables.views(spark, sf_dir)
            return spark.sql(text)

        run.__name__ = name
        self.queries[name] = run
        self.oracles[name] = _with_roles(oracle or text)


def _with_roles(statement: str) -> str:
    body = statement.strip()
    if body.upper().startswith("WITH "):
        return tables.DUCK + ", " + body[5:]
    return tables.DUCK + body
