"""Row numbers over a total order without a window that holds a group."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from slotwise.session import shared_folder
from slotwise.sources.writers import write_table


def fresh(name: str) -> str:
    """A column name that no table brings along."""
    return f"_{name}_{uuid.uuid4().hex[:8]}"


def kept(df: DataFrame, purpose: str) -> DataFrame:
    """Write once below the shared folder and go on from the files, so that lost executors cost one step."""
    return write_table(df, shared_folder(df.sparkSession, purpose))


def numbered(df: DataFrame, order: Sequence[Column], within: Sequence[str], number: str, purpose: str) -> DataFrame:
    """Row numbers from 1 inside each group of ``within``, in the order ``order`` (which must start with the group).

    The table is sorted by ranges of the order, so a group of any size spreads over as many tasks
    as its rows need; rows are counted per (range, group), and these few counts are summed over
    the ranges.
    """
    row = fresh("row")
    table = kept(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(row, F.monotonically_increasing_id()),
        purpose,
    )
    part, first, rows, before = fresh("part"), fresh("first"), fresh("rows"), fresh("before")
    table = table.withColumn(part, F.shiftright(row, 33))
    counts = table.groupBy(part, *within).agg(F.min(row).alias(first), F.count(F.lit(1)).alias(rows))
    earlier = Window.partitionBy(*(F.col(c) for c in within)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn(before, F.coalesce(F.sum(rows).over(earlier), F.lit(0))).drop(rows)
    names = {c: fresh("key") for c in within}
    offsets = kept(offsets.withColumnsRenamed(names | {part: fresh("at")}), f"{purpose}-offsets")
    at = offsets.columns[0]
    same = table[part] == offsets[at]
    for c, k in names.items():
        same = same & table[c].eqNullSafe(offsets[k])
    joined = table.join(offsets, same)
    return joined.withColumn(number, F.col(row) - F.col(first) + F.col(before) + 1).drop(
        row, part, first, before, at, *names.values()
    )
