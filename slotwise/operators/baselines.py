"""Reference predictions of the slot state and the table that compares them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from slotwise.constants import DAY_TYPE_WEEKEND, DAY_TYPE_WORKDAY, UNMODELLED_STATES
from slotwise.functions import dates
from slotwise.operators.grouping import modal_value

HISTORY_KEYS = ["station_id", "month", "week_of_month", "weekday", "hour", "half"]


def modelled(grid: DataFrame) -> DataFrame:
    return grid.where(~F.col("state").isin(*UNMODELLED_STATES))


def with_history_keys(grid: DataFrame) -> DataFrame:
    day = F.col("day")
    return grid.withColumns({
        "month": F.month(day),
        "week_of_month": dates.week_of_month(day),
        "weekday": dates.iso_weekday(day),
    })


def historical_mode(grid: DataFrame, keys: Sequence[str] = HISTORY_KEYS) -> DataFrame:
    """Most frequent modelled state per history key of the training rows passed in."""
    return modal_value(with_history_keys(modelled(grid)), keys, "state", "ha_pred")


def seasonal_naive(grid: DataFrame, days: int = 7) -> DataFrame:
    """Adds ``sn7_pred``: the state of the same station and slot ``days`` earlier.

    The preceding row of the same station and slot in the same phase of the cycle
    is the only candidate, so a lag replaces the self join; it counts only when it is exactly ``days`` old.
    """
    phase = F.pmod(F.unix_date("day"), F.lit(days))
    w = Window.partitionBy("station_id", "hour", "half", phase).orderBy("day")
    recent = F.date_add(F.lag("day").over(w), days) == F.col("day")
    return grid.withColumn("sn7_pred", F.when(recent, F.lag("state").over(w)))


def seasonal_naive_for(grid: DataFrame, first: date | Column, last: date | Column, days: int = 7) -> DataFrame:
    """``seasonal_naive`` for a test period; only the period and the ``days`` before it are read."""
    first, last = F.lit(first), F.lit(last)
    needed = grid.where(F.col("day").between(F.date_sub(first, days), last))
    return seasonal_naive(needed, days).where(F.col("day").between(first, last))


def evaluation_table(
    grid: DataFrame, history: DataFrame, first: date | Column, last: date | Column,
    keys: Sequence[str] = HISTORY_KEYS, weekend_from: int | None = None,
) -> DataFrame:
    """Real state of each modelled test slot beside both predictions.

    ``day_type`` marks Saturdays only, as published; ``weekend_from=6`` marks
    every day from that ISO weekday on.
    """
    rows = modelled(seasonal_naive_for(grid, first, last))
    iso = dates.iso_weekday(F.col("day"))
    weekend = iso == 6 if weekend_from is None else iso >= weekend_from
    keyed = with_history_keys(rows).withColumn(
        "day_type", F.when(weekend, DAY_TYPE_WEEKEND).otherwise(DAY_TYPE_WORKDAY)
    )
    return keyed.join(history, list(keys), "left").select(
        "station_id", "lat", "lon", "district_id", "district", "day", "hour", "half",
        "day_type", F.col("state").alias("real"), "sn7_pred", "ha_pred",
    )
