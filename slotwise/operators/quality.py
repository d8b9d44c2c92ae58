"""Data-quality checks and repairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from slotwise.operators.quantiles import exact_quantiles


def uniqueness(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys and whether the key column is unique."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), (F.max("_n") == 1).alias("is_unique")
    )


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that break a primary-key or unique rule: repeated or NULL."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    has_null = F.lit(False)
    for k in keys:
        has_null = has_null | F.col(k).isNull()
    return counts.where((F.col("n") > 1) | has_null)


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows whose non-null reference has no parent."""
    rows = child.where(F.col(fk).isNotNull())
    return rows.join(parent, rows[fk] == parent[pk], "left_anti")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in a stated total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def null_count(columns: Sequence[str]) -> Column:
    """Number of NULLs in a row."""
    total = F.lit(0)
    for c in columns:
        total = total + F.col(c).isNull().cast("int")
    return total


def nulls_per_row(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many rows have 0, 1, 2 ... NULLs."""
    return df.groupBy(null_count(columns).alias("n_nulls")).agg(F.count(F.lit(1)).alias("n_rows"))


def nulls_per_column(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULLs per column, in one pass, as long rows."""
    one = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column", "n_nulls")


def drop_sparse(df: DataFrame, columns: Sequence[str], max_nulls: int) -> DataFrame:
    """Rows with at most ``max_nulls`` NULLs."""
    return df.where(null_count(columns) <= max_nulls)


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULLs replaced by the exact column median; the medians of all columns come from one pass."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns
    ])).alias("e")).select("e.*")
    medians = exact_quantiles(long, ["column"], "v", {"median": 0.5})
    table = medians.agg(F.map_from_entries(F.collect_list(F.struct("column", "median")))).scalar()
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.try_element_at(table, F.lit(c))) for c in columns
    })
