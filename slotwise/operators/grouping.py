"""Grouped results that stay safe when one group holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


SALTS = 32


def salted_join(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], salts: int = SALTS) -> DataFrame:
    """Rows with the one row of ``per_key`` for their keys.

    Where the small side can't be broadcast, a hot key's rows are dealt over ``salts`` tasks and the
    key's row is repeated that often.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    repeated = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(repeated, [*keys, "_salt"]).drop("_salt")


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Dataframe-library grouping leaves rows without a key out; SQL grouping keeps them."""
    return df.na.drop(subset=list(keys)) if keys else df


def modal_value(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Most frequent non-null value per group, the smallest on ties.

    Two algebraic aggregations: the first collapses a hot group to its distinct
    values before anything is shuffled.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(name))


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Frequencies of the non-null values, most frequent first (value breaks ties)."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    ordered = counts.orderBy(F.desc("n"), column)
    return ordered.limit(top) if top else ordered


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Long contingency table with the share of each cell in its row, in percent."""
    cells = drop_null_keys(df, [row, column]).groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(row))
    return cells.withColumn("row_pct", 100.0 * F.col("n") / total)


def crosstab_wide(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Contingency table with one count column per listed value, 0 where nothing was seen."""
    wide = drop_null_keys(df, [row, column]).groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1)))
    return wide.na.fill(0)


def pivot_with_margins(
    df: DataFrame, row: str, column: str, value: str, columns: Sequence[str], margin: str, rounded
) -> DataFrame:
    """Mean of ``value`` by row and column, plus a margin row and column.

    Margins are means of the underlying rows, not means of cells; the cube
    computes all four levels in one aggregation.
    """
    clean = drop_null_keys(df, [row, column, value])
    cells = clean.cube(row, column).agg(
        F.avg(value).alias("_mean"), F.grouping(row).alias("_all_rows"), F.grouping(column).alias("_all_cols")
    )
    labelled = cells.select(
        F.when(F.col("_all_rows") == 1, F.lit(margin)).otherwise(F.col(row)).alias(row),
        F.when(F.col("_all_cols") == 1, F.lit(margin)).otherwise(F.col(column)).alias(column),
        rounded(F.col("_mean")).alias("_mean"),
    )
    return labelled.groupBy(row).pivot(column, [*columns, margin]).agg(F.first("_mean"))


def invert_mapping(df: DataFrame, key: str, value: str) -> DataFrame:
    """Swap keys and values: rows ``value, key``, flagged where a value has several keys."""
    sizes = df.groupBy(value).agg((F.count(F.lit(1)) > 1).alias("duplicated"))
    return salted_join(df.select(value, key), sizes, [value])


def last_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group in a total order, numbered in ``row_in_group``.

    Spark prunes to ``n`` rows per group before the shuffle, so hot groups stay small.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("row_in_group", F.row_number().over(w)).where(F.col("row_in_group") <= n)
