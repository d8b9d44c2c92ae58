"""Table changes as DataFrame transforms: each returns the changed table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def update(df: DataFrame, where: Column, **values) -> DataFrame:
    """Set columns in the rows that match; an unknown condition changes nothing."""
    new = {c: F.when(where, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()}
    return df.withColumns(new)


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Append rows; columns they lack become NULL."""
    typed = rows.select(*[F.col(c).cast(df.schema[c].dataType).alias(c) for c in rows.columns])
    return df.unionByName(typed, allowMissingColumns=True)


def insert_missing(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Append only the rows whose key is not there yet, once per key."""
    fresh = rows.dropDuplicates([key]).join(df.select(key), key, "left_anti")
    return insert(df, fresh)


def delete(df: DataFrame, where: Column) -> DataFrame:
    """Remove the rows that match; rows with an unknown condition stay."""
    return df.where(~F.coalesce(where, F.lit(False)))


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def add_column(df: DataFrame, name: str, type_: str) -> DataFrame:
    """New column of the given type, NULL everywhere."""
    return df.withColumn(name, F.lit(None).cast(type_))


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new)


def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Change column types; values that do not fit become NULL."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def reorder_first(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Move the named columns to the front."""
    return df.select(*names, *[c for c in df.columns if c not in names])


def rename_table(spark: SparkSession, old: str, new: str) -> None:
    spark.sql("ALTER TABLE IDENTIFIER(:old) RENAME TO " + f"`{new}`", args={"old": old})


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:name)", args={"name": name})
