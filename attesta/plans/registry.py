"""The library's registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attesta.sources.adapters import plain

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir), with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _oracles[name] = plain(sql)
        return f

    return add


def _load() -> None:
    from attesta.plans import anchoring, evidence, ingestion, questions, reports, scoring, streams  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["a03_rank_predictors"](spark, sf_dir)
