"""Text and array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from slotwise.constants import WORD_LETTERS


def all_digits(text: Column) -> Column:
    """True when the whole string is digits (``\\z``: a trailing line break is not accepted)."""
    return text.rlike(r"^[0-9]+\z")


def words(text: Column) -> Column:
    """Lower-case words in order; everything but the accepted letters separates words."""
    return F.filter(F.split(F.lower(text), f"[^{WORD_LETTERS}]+"), lambda w: w != "")


def mean_word_length(text: Column) -> Column:
    """Mean number of letters per word, 0.0 when there is none."""
    ws = words(text)
    return F.when(F.size(ws) > 0, F.length(F.array_join(ws, "")) / F.size(ws)).otherwise(F.lit(0.0))


def list_items(text: Column, sep: str = ",") -> Column:
    """Distinct trimmed, non-blank items of a delimited string."""
    return F.filter(F.array_distinct(F.transform(F.split(text, sep), lambda x: F.trim(x))), lambda x: x != "")


def count_items(text: Column, sep: str = ",") -> Column:
    """Number of positions in a delimited string: separators plus one."""
    return F.length(text) - F.length(F.replace(text, F.lit(sep), F.lit(""))) + 1


def nth_item(text: Column, n: int, sep: str = ",") -> Column:
    """Trimmed n-th item (1-based); the last one when the list is shorter."""
    head = F.substring_index(text, sep, n)
    return F.trim(F.substring_index(head, sep, -1))


def join_or_null(items: Column, sep: str = ", ") -> Column:
    """Joined list; NULL for a missing or empty list."""
    return F.when(F.size(items) > 0, F.array_join(items, sep))


def to_float_or_null(text: Column) -> Column:
    """Strings a general-purpose float parser accepts -> double, others NULL.

    Accepts digit groups with single underscores, surrounding blanks, exponents,
    inf and nan; refuses the type suffixes (``1d``, ``1f``) a SQL cast would take.
    """
    bare = F.trim(text)
    digits = r"[0-9](?:_?[0-9])*"
    number = rf"^[+-]?(?:(?:{digits})(?:\.(?:{digits})?)?|\.{digits})(?:[eE][+-]?{digits})?\z"
    special = r"(?i)^[+-]?(inf|infinity|nan)\z"
    return (
        F.when(bare.rlike(number), F.replace(bare, F.lit("_"), F.lit("")).try_cast("double"))
        .when(bare.rlike(special), F.regexp_replace(F.lower(bare), "^([+-]?)inf(inity)?$", "$1Infinity").try_cast("double"))
    )
