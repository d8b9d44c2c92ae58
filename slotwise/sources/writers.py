"""Sinks: CSV reports, one folder per group, derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, one file for each task."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_per_group(
    df: DataFrame, path: str, group: str, folder: str = "group", files_per_group: int | None = None
) -> None:
    """CSV export with one folder per group value, blanks removed from its name.

    Every task writes its own share of each group. ``files_per_group`` gathers a group
    into that many files first; rows are dealt out by their hash.
    """
    named = df.withColumn(folder, F.replace(F.col(group), F.lit(" "), F.lit("")))
    if files_per_group:
        named = named.repartition(folder, F.pmod(F.xxhash64(*df.columns), F.lit(files_per_group)))
    named.write.mode("overwrite").option("header", True).option("escape", '"').partitionBy(folder).csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Materialise a derived table as parquet and return it read back, so later stages start from files."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def create_table(df: DataFrame, name: str) -> None:
    """Create or replace a catalog table."""
    df.write.mode("overwrite").saveAsTable(name)
