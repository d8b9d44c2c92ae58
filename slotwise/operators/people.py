"""Salary, age and family columns of an employee table, and its reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from slotwise.constants import GENDER_CODES
from slotwise.functions import dates
from slotwise.functions.numbers import parse_percent, round_even
from slotwise.operators.grouping import drop_null_keys
from slotwise.operators.quantiles import exact_quantiles


def full_name(first: Column, last: Column) -> Column:
    """First and last name with a blank; NULL when one is missing."""
    return F.concat(first, F.lit(" "), last)


def gender_label(code: Column) -> Column:
    """Spelled-out code; the not-stated code becomes NULL, unknown codes stay as they are."""
    label = F.when(F.lit(False), code)
    for short, long in GENDER_CODES.items():
        label = label.when(code == short, F.lit(long))
    return label.otherwise(code)


def has_children(yes: Column, no: Column) -> Column:
    """Merge the two indicator columns; NULL when neither is set."""
    return F.when(yes == 1.0, "Si").when(no == 1.0, "No")


def salary_summary(df: DataFrame, key: str, salary: str) -> DataFrame:
    """Mean, median, minimum and maximum per key, lowest mean first."""
    rows = drop_null_keys(df, [key])
    plain = rows.groupBy(key).agg(
        round_even(F.avg(salary), 2).alias("mean"), F.min(salary).alias("min"), F.max(salary).alias("max")
    )
    median = exact_quantiles(rows, [key], salary, {"median": 0.5})
    return plain.join(median, key, "left").withColumn("median", round_even(F.col("median"), 2)).orderBy("mean", key)


def raise_salaries(df: DataFrame, increments: DataFrame, group: str, salary: str) -> DataFrame:
    """Adds the increment text of the group and the raised salary (NULL for unlisted groups)."""
    joined = df.join(increments, group, "left")
    raised = F.col(salary) * (1 + parse_percent(F.col("increment")))
    return joined.withColumn("raised_salary", round_even(raised, 2))


def group_summary(df: DataFrame, key: str, salary: str, age: str) -> DataFrame:
    """Head count, mean salary and median age (whole years) per key."""
    rows = drop_null_keys(df, [key])
    plain = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_workers"), round_even(F.avg(salary), 2).alias("mean_salary")
    )
    median = exact_quantiles(rows, [key], age, {"median_age": 0.5})
    return plain.join(median, key, "left").withColumn("median_age", F.rint("median_age").cast("int"))


def with_age(df: DataFrame, on: date) -> DataFrame:
    """Birth date from its parts and completed years on the given day."""
    birth = dates.make_date_or_null(F.col("birth_year"), F.col("birth_month"), F.col("birth_day"))
    return df.withColumn("birth_date", birth).withColumn("age", dates.age_completed(F.col("birth_date"), on))
