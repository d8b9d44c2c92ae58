"""The registry of runnable queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from slotwise.functions.numbers import round_binary

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with the SQL that must return the same rows."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles computed from sums are compared to six places."""
    return df.withColumns({c: round_binary(F.col(c), digits) for c in columns})


def text(column: str) -> Column:
    """Dates and timestamps are compared as text."""
    return F.col(column).cast("string").alias(column)


def with_text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def with_double(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def sql_mean_money(amount: str = "amount") -> str:
    """Mean of a decimal rounded half up to cents, in integer arithmetic."""
    cents = f"({amount} * 100)::bigint"
    return f"(((2 * sum({cents}) + count(*)) // (2 * count(*)))::double / 100)"
