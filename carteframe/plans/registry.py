"""Names of all queries, with their SQL forms. Query modules register themselves when imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with the SQL that DuckDB can run."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def load() -> None:
    from . import catalog, drafts, exports, grammar, market, menus, prices, quality, relations, rules, text, variants, writes  # noqa: F401


load()
