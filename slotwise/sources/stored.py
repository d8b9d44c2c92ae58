"""Stored tables: partitioned Parquet folders whose rows can be changed in place.

A change first finds the partitions it touches, with a scan of the columns its condition names, and rewrites
only these by Spark's dynamic partition overwrite: new files replace those of a partition when the job
commits, so a lost executor or a failed job leaves the table as it was. Files of other partitions stay as they are. A
partition that is left without rows is removed afterwards.

The driver sees partition values only, as it does whenever it lists the table's folders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.types import StructType

from slotwise.operators import mutate


class StoredTable:
    """A table under ``path``, partitioned by ``partition_by``. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, partition_by: Sequence[str]):
        self.spark, self.path, self.schema, self.partition_by = spark, path, schema, list(partition_by)

    @classmethod
    def create(cls, df: DataFrame, path: str, partition_by: Sequence[str]) -> StoredTable:
        table = cls(df.sparkSession, path, df.schema, partition_by)
        table._writer(df).mode("errorifexists").parquet(path)
        return table

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).select(*self.schema.names)

    def _writer(self, df: DataFrame):
        """Large partitions are cut into several files, small ones make one."""
        return df.hint("rebalance", *self.partition_by).write.partitionBy(*self.partition_by)

    def _within(self, partitions: Sequence[Row]) -> Column:
        """Whether a row lies in one of the partitions; a filter on partition columns, so other folders aren't listed."""
        if len(self.partition_by) == 1:
            name = self.partition_by[0]
            values = [p[name] for p in partitions]
            known = F.col(name).isin([v for v in values if v is not None])
            return known | F.col(name).isNull() if None in values else F.coalesce(known, F.lit(False))
        found = F.lit(False)
        for p in partitions:
            here = F.lit(True)
            for c in self.partition_by:
                here = here & F.col(c).eqNullSafe(F.lit(p[c]).cast(self.schema[c].dataType))
            found = found | here
        return found

    def _partitions(self, df: DataFrame) -> list[Row]:
        return df.select(*self.partition_by).distinct().collect()

    def rows_of(self, partitions: Sequence[Row]) -> DataFrame:
        return self.read().where(self._within(partitions))

    def replace(self, rows: DataFrame, partitions: Sequence[Row]) -> list[Row]:
        """The partitions hold exactly these rows from now on; rows of any other partition are an error."""
        filled = {tuple(p) for p in self._partitions(rows)} if partitions else set()
        if filled - {tuple(p) for p in partitions}:
            raise ValueError("rows lie outside the partitions to be replaced")
        if filled:
            writer = self._writer(rows.select(*self.schema.names)).mode("overwrite")
            writer.option("partitionOverwriteMode", "dynamic").parquet(self.path)
        self._remove([p for p in partitions if tuple(p) not in filled])
        return list(partitions)

    def _remove(self, partitions: Sequence[Row]) -> None:
        """Deletes the folders of emptied partitions by way of the file system that Spark uses for the table."""
        if not partitions:
            return
        folder = F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder")
        paths = self.spark.read.schema(self.schema).parquet(self.path).where(self._within(partitions)).select(folder).distinct()
        for row in paths.collect():  # one row per partition
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self.spark._jvm.java.net.URI(row.folder))
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def update(self, where: Column, **values) -> list[Row]:
        """Sets columns in the rows that match and returns the partitions written. Rows may move to another partition."""
        old = self._partitions(self.read().where(where))
        moved = [c for c in values if c in self.partition_by]
        after = mutate.update(self.rows_of(old), where, **values)
        new = self._partitions(after) if moved else []
        touched = list(dict.fromkeys([*old, *new]))
        return self.replace(mutate.update(self.rows_of(touched), where, **values), touched)

    def delete(self, where: Column) -> list[Row]:
        """Removes the rows that match; rows with an unknown condition stay."""
        touched = self._partitions(self.read().where(where))
        return self.replace(mutate.delete(self.rows_of(touched), where), touched)

    def insert(self, rows: DataFrame) -> None:
        """Adds files with the rows; columns they lack become NULL."""
        whole = mutate.insert(self.read().limit(0), rows)
        self._writer(whole.select(*self.schema.names)).mode("append").parquet(self.path)

    def insert_missing(self, rows: DataFrame, key: str) -> None:
        """Adds only the rows whose key is not there yet, once per key."""
        self.insert(rows.dropDuplicates([key]).join(self.read().select(key), key, "left_anti"))
