"""Readers for delimited files, header groups, text, JSON and GeoJSON, database tables and the catalog."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from slotwise.session import shared_folder
from slotwise.sources.writers import write_table

GEO_UNIT_TYPE = "DISTRICTE"  # fixed value: unit type kept from administrative layers


def read_csv(spark: SparkSession, path, schema: T.StructType | str | None = None, sep: str = ",") -> DataFrame:
    """Quoted CSV with a header line. Without a schema every column is text, never inferred."""
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(path)


def plain_names(df: DataFrame) -> DataFrame:
    """Dots in column names become underscores."""
    return df.select(*[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in df.columns])


def header_lines(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Header line and its SHA-1 per file of a folder tree.

    The first line is the one at byte offset zero, which only the split at the
    start of each file can hold, so whole files are never pulled into a row.
    """
    lines = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
        .select("value", F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"))
    )
    first = lines.where(F.col("block") == 0).groupBy("file").agg(F.min_by("value", "pos").alias("header"))
    header = F.regexp_replace("header", r"[\r\n]+$", "")
    return first.select("file", header.alias("header"), F.sha1(header.cast("binary")).alias("fingerprint"))


def header_groups(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """Files per distinct header."""
    return header_lines(spark, path, pattern).groupBy("fingerprint", "header").agg(F.count(F.lit(1)).alias("n_files"))


def read_header_groups(
    spark: SparkSession, path: str, columns: Sequence[str], pattern: str = "*.csv", sep: str = ","
) -> DataFrame:
    """All files of a tree as one table of text columns, one read per distinct header.

    Only file names and headers reach the driver, as for any file listing.
    Columns a group lacks are NULL; dots in names count as underscores.
    """
    groups: dict[str, list[str]] = {}
    for row in header_lines(spark, path, pattern).select("header", "file").collect():
        groups.setdefault(row["header"], []).append(row["file"])
    parts = []
    for header in sorted(groups):
        part = plain_names(read_csv(spark, sorted(groups[header]), sep=sep))
        parts.append(part.select(*[c for c in columns if c in part.columns]))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    missing = {c: F.lit(None).cast("string") for c in columns if c not in union.columns}
    return union.withColumns(missing).select(*columns)


def read_header_offset(
    spark: SparkSession, path: str, header_line: int, names: Sequence[str], sep: str = ","
) -> DataFrame:
    """CSV exports whose real header is further down: the lines up to it are dropped in every file.

    Lines are numbered once and written, so both sides of the join see the same numbers; line
    numbers are counted only in the first block of a file.
    """
    lines = write_table(spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
    ), shared_folder(spark, "numbered-lines"))
    head = Window.partitionBy("file").orderBy("pos")
    skip = (
        lines.where(F.col("block") == 0)
        .withColumn("line", F.row_number().over(head)).where(F.col("line") <= header_line)
        .groupBy("file").agg(F.max("pos").alias("last_skipped"))
    )
    body = lines.join(skip, "file", "left").where(
        (F.col("block") != 0) | F.col("last_skipped").isNull() | (F.col("pos") > F.col("last_skipped"))
    )
    fields = F.from_csv("value", ", ".join(f"`{n}` string" for n in names), {"sep": sep})
    return body.select(fields.alias("r")).select("r.*")


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """UTF-8 lines in column ``value``."""
    return spark.read.text(path)


def flatten_records(df: DataFrame, column: str, schema: str, records: str) -> DataFrame:
    """JSON text -> one row per element of its ``records`` array, with the fields of ``schema`` as columns."""
    parsed = F.from_json(column, f"{records} array<struct<{schema}>>")
    return df.select(*[c for c in df.columns if c != column], F.explode(parsed[records]).alias("r")).select(
        *[c for c in df.columns if c != column], "r.*"
    )


GEOJSON = (
    "features array<struct<properties: struct<TIPUS_UA: string, CODI_UA: string, NOM: string>, "
    "geometry: struct<type: string, coordinates: string>>>"
)


def parse_geojson(df: DataFrame, column: str = "value", unit_type: str = GEO_UNIT_TYPE) -> DataFrame:
    """FeatureCollection documents -> code, name and rings (x, y) of the units of one type.

    Multi-polygons contribute the rings of all their parts.
    """
    parsed = df.select(F.explode(F.from_json(column, GEOJSON)["features"]).alias("f"))
    kept = parsed.where(F.col("f.properties.TIPUS_UA") == unit_type)
    text = F.col("f.geometry.coordinates")
    pairs = F.when(
        F.col("f.geometry.type") == "MultiPolygon",
        F.flatten(F.from_json(text, "array<array<array<array<double>>>>")),
    ).otherwise(F.from_json(text, "array<array<array<double>>>"))
    rings = F.transform(pairs, lambda ring: F.transform(
        ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    ))
    return kept.select(
        F.col("f.properties.CODI_UA").alias("district_id"), F.col("f.properties.NOM").alias("district"),
        rings.alias("rings"),
    )


def read_geojson(spark: SparkSession, path: str, unit_type: str = GEO_UNIT_TYPE) -> DataFrame:
    """Administrative units of one type from GeoJSON files, one document per file."""
    return parse_geojson(spark.read.text(path, wholetext=True), "value", unit_type)


def read_jdbc_tables(
    spark: SparkSession, url: str, tables: Sequence[str], exclude: Sequence[str] = (), **options
) -> dict[str, DataFrame]:
    """One DataFrame per database table; pass ``partitionColumn`` and bounds to read in parallel."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    return {t: reader.option("dbtable", t).load() for t in tables if t not in exclude}


def catalog_tables(spark: SparkSession, exclude: Sequence[str] = ()) -> dict[str, DataFrame]:
    """One DataFrame per table or view of the current catalog."""
    return {t.name: spark.table(t.name) for t in spark.catalog.listTables() if t.name not in exclude}


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns per table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def describe_table(df: DataFrame) -> DataFrame:
    """Position, name and type of the columns."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields, start=1)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string")


def missing_tables(spark: SparkSession, required: Sequence[str]) -> list[str]:
    """Required tables the catalog does not have."""
    return [t for t in required if not spark.catalog.tableExists(t)]
