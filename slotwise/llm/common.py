"""Helpers of the corpus operators: words and row packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from slotwise.operators.ranking import kept, numbered

__all__ = ["kept", "lower_ascii", "numbered", "packed", "unpacked", "word_array", "word_count"]

# Fixed by the contracts: words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def word_array(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != F.lit(""))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def packed(df: DataFrame, name: str, **derived: Column) -> DataFrame:
    """The whole row as one struct beside derived columns, so that no name can clash."""
    return df.select(F.struct("*").alias(name), *(c.alias(k) for k, c in derived.items()))


def unpacked(df: DataFrame, name: str, like: DataFrame, *more: Column) -> DataFrame:
    return df.select(*(F.col(name)[c].alias(c) for c in like.columns), *more)
