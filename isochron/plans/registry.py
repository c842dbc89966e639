"""Registered queries of the analytics library: each applies operators to the feed or the given tables, and has SQL
with the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from isochron.plans.feed import Feed

_QUERIES: dict[str, Callable[[Feed], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of the feed by its name."""

    def add(f: Callable[[Feed], DataFrame]):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def oracle_of(name: str) -> str:
    """The SQL of a query that is registered already, for SQL that goes on from its rows."""
    return _SQL[name]


def _load() -> None:
    from isochron.plans import queries_basic, queries_cards, queries_context, queries_feed, queries_gates, queries_latent, queries_model, queries_profile, queries_ratings  # noqa: F401  they register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, f=f: f(Feed(spark, sf_dir))) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["top_net_xg"](spark, sf_dir)
