"""Samples that depend on the rows' keys only: the same rows at every partitioning, in every run and in SQL.

A row's draw is the first eight hexadecimal digits of the MD5 of seed and keys, so draws are even over 32 bits, and
samples of parts of a table together are the sample of the whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from slotwise.operators.grouping import last_n_per_group

DRAWS = 1 << 32


def draw(keys: Sequence[str], seed: int) -> Column:
    """A number from 0 to 2 ** 32 - 1; a missing key counts as an empty one."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def threshold_sample(df: DataFrame, keys: Sequence[str], wanted: int, rows: int, seed: int = 42) -> DataFrame:
    """About ``wanted`` of ``rows`` rows, each by its own draw; all rows where there are no more. Rows of equal keys stay or go together."""
    return df if rows <= wanted else df.where(draw(keys, seed) < wanted * DRAWS // rows)


def smallest_draws(df: DataFrame, keys: Sequence[str], groups: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """The ``n`` rows of each group with the smallest draws, ties by key. Spark keeps ``n`` rows per group and task before the shuffle."""
    order = [draw(keys, seed), *(F.col(k) for k in keys)]
    return last_n_per_group(df, groups, order, n).drop("row_in_group")
