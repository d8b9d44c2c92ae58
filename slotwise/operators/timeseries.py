"""Station readings -> clean readings -> trips and the dense half-hour grid.

Column flow: raw text readings -> ``station_id, last_reported, bikes, docks`` -> deltas -> local time parts and district -> trips / half-hour slots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from slotwise.constants import (
    BOTH_EXTREMES, EMPTY, EPOCH_MAX, EPOCH_MIN, FULL, IN_SERVICE, LOCAL_ZONE, NO_READINGS,
    NORMAL, OTHER, PROBLEM_STATES, RENTING, STATE_COLOUR, DEFAULT_STATE_COLOUR, WEEKDAYS,
)
from slotwise.functions import dates
from slotwise.functions.numbers import pct, round_binary
from slotwise.functions.text import all_digits
from slotwise.operators.grouping import salted_join

SLOT = ["station_id", "day", "hour", "half"]
STATION = ["station_id", "lat", "lon", "district_id", "district"]
SECONDS_PER_DAY = 86_400


# ---------------------------------------------------------------- readings
def valid_readings(raw: DataFrame) -> DataFrame:
    """Rows of stations in service whose ids, counts and time are plain digits within range."""
    numbers = ("station_id", "num_bikes_available", "num_docks_available", "last_reported")
    keep = (F.col("status") == IN_SERVICE) & (F.col("is_renting") == RENTING)
    for name in numbers:
        keep = keep & all_digits(F.col(name))
    return raw.where(keep & F.col("last_reported").try_cast("bigint").between(EPOCH_MIN, EPOCH_MAX))


def typed_readings(raw: DataFrame) -> DataFrame:
    """Valid rows as numbers, with the time of their update."""
    return valid_readings(raw).select(
        F.col("station_id").try_cast("int").alias("station_id"),
        F.col("last_reported").try_cast("bigint").alias("last_reported"),
        F.col("num_bikes_available").try_cast("int").alias("bikes"),
        F.col("num_docks_available").try_cast("int").alias("docks"),
        F.col("last_updated").try_cast("bigint").alias("updated"),
    )


def latest_readings(typed: DataFrame) -> DataFrame:
    """One row per (station, time): the one with the latest update. Of rows reduced in parts, the result is the same."""
    reading = F.struct("bikes", "docks", "updated")
    order = F.when(F.col("updated").isNotNull(), F.struct("updated", "bikes", "docks"))
    latest = typed.groupBy("station_id", "last_reported").agg(F.max_by(reading, order).alias("r"))
    return latest.select("station_id", "last_reported", "r.bikes", "r.docks", "r.updated")


def clean(raw: DataFrame) -> DataFrame:
    """Valid rows, one per (station, time): the one with the latest update.

    Copies of a reading are reduced before the shuffle, and the key includes the
    time, so neither a busy station nor a much repeated reading fills one task.
    """
    return latest_readings(typed_readings(raw)).drop("updated")


def day_tails(chunked: DataFrame, chunk: str) -> DataFrame:
    """The last reading (time t, bikes b) of each station and chunk of time."""
    last = F.struct(F.col("last_reported").alias("t"), F.col("bikes").alias("b"))
    return chunked.groupBy("station_id", chunk).agg(F.max_by(last, "last_reported").alias("tail"))


def carried_tails(tails: DataFrame, chunk: str) -> DataFrame:
    """For each station and chunk, the last reading of the station's chunk before it."""
    across = Window.partitionBy("station_id").orderBy(chunk)
    return tails.select("station_id", chunk, F.lag("tail").over(across).alias("carry"))


def delta_within(chunked: DataFrame, carried: DataFrame, chunk: str) -> DataFrame:
    """Previous reading, seconds since it and change in bikes; the first reading of a chunk goes on from ``carried``."""
    within = Window.partitionBy("station_id", chunk).orderBy("last_reported")
    previous = F.struct(F.col("last_reported").alias("t"), F.col("bikes").alias("b"))
    return (
        chunked.withColumn("prev", F.lag(previous).over(within))
        .join(carried, ["station_id", chunk], "left")
        .withColumn("prev", F.coalesce("prev", "carry"))
        .select(
            "station_id", "last_reported", "bikes", "docks",
            F.col("prev.t").alias("prev_reported"),
            (F.col("last_reported") - F.col("prev.t")).alias("seconds_since_prev"),
            F.col("prev.b").alias("prev_bikes"),
            (F.col("bikes") - F.col("prev.b")).alias("delta_bikes"),
        )
    )


def with_delta(cleaned: DataFrame) -> DataFrame:
    """Previous reading of the station, seconds since it and change in bikes.

    Lags run inside (station, UTC day), which holds at most one reading per
    second; the first reading of a day takes its predecessor from a small table of
    last readings per day, so the history of one station is never in one task.
    """
    chunked = cleaned.withColumn("day_chunk", F.floor(F.col("last_reported") / SECONDS_PER_DAY).cast("int"))
    return delta_within(chunked, carried_tails(day_tails(chunked, "day_chunk"), "day_chunk"), "day_chunk")


def localize(readings: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    """UTC and local time of each reading, with the local day and hour."""
    local = readings.withColumn("ts_utc", dates.epoch_to_utc(F.col("last_reported"))).withColumn(
        "ts_local", dates.utc_to_local(F.col("ts_utc"), zone)
    )
    return local.withColumns({"day": F.to_date("ts_local"), "hour": F.hour("ts_local")})


def with_calendar(df: DataFrame) -> DataFrame:
    """Year, month, day, ISO weekday and season of the column ``day``."""
    month = F.month("day")
    return df.withColumns({
        "year": F.year("day"), "month": month, "day_of_month": F.dayofmonth("day"),
        "weekday": dates.iso_weekday(F.col("day")),
        "season": dates.season_number(month), "season_name": dates.season_name(month),
    })


def enrich(readings: DataFrame, stations: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    """Local time parts, season and station attributes; readings of unknown stations are dropped."""
    parts = with_calendar(localize(readings, zone))
    clock = parts.withColumns({"minute": F.minute("ts_local"), "second": F.second("ts_local")})
    return salted_join(clock, stations.select(*STATION), ["station_id"])


# ---------------------------------------------------------------- trips
def trips(deltas: DataFrame, stations: DataFrame, max_gap: int | None = None, zone: str = LOCAL_ZONE) -> DataFrame:
    """Bikes that left a station, per station and local hour, with calendar and station attributes.

    A drop counts in the hour of the later reading, whatever the gap, unless
    ``max_gap`` seconds is given. The first reading of a station adds nothing. The
    sums are formed on the three key columns; everything that depends on them is
    attached to the result.
    """
    drop = F.col("delta_bikes") < 0
    if max_gap is not None:
        drop = drop & (F.col("seconds_since_prev") <= max_gap)
    left = F.sum(F.when(drop, -F.col("delta_bikes")).otherwise(0))
    hourly = localize(deltas, zone).groupBy("station_id", "day", "hour").agg(left.alias("trips"))
    return with_calendar(hourly).join(stations.select(*STATION), "station_id")


def trip_totals(
    trip_table: DataFrame, keys: Sequence[str], from_year: int | None = 2022, until_year: int | None = None
) -> DataFrame:
    """Trips summed over ``keys``, optionally for a range of years."""
    rows = trip_table
    if from_year is not None:
        rows = rows.where(F.col("year") >= from_year)
    if until_year is not None:
        rows = rows.where(F.col("year") <= until_year)
    return rows.groupBy(*keys).agg(F.sum("trips").alias("trips"))


def mean_monthly_trips(trip_table: DataFrame, stations: DataFrame) -> DataFrame:
    """Mean of the monthly totals per station, with the station attributes."""
    monthly = trip_totals(trip_table, ["station_id", "year", "month"])
    means = monthly.groupBy("station_id").agg(F.avg("trips").alias("mean_monthly_trips"))
    return means.join(stations.select(*STATION), "station_id")


def weekday_hour_profile(trip_table: DataFrame, from_year: int = 2022, until_year: int = 2025) -> DataFrame:
    """Network trips per day and hour, averaged over the days of each weekday that have data."""
    daily = trip_totals(trip_table, ["day", "weekday", "hour"], from_year, until_year)
    return daily.groupBy("weekday", "hour").agg(F.avg("trips").alias("mean_trips"))


def trip_timeline(trip_table: DataFrame, from_year: int = 2020) -> DataFrame:
    """Trips per month with a flag on the lowest and the highest month (earliest on ties)."""
    months = trip_totals(trip_table, ["year", "month"], from_year).withColumn(
        "month_start", dates.first_of_month(F.col("year"), F.col("month"))
    )
    ends = months.agg(
        F.min_by("month_start", F.struct("trips", "month_start")).alias("lo"),
        F.min_by("month_start", F.struct(-F.col("trips"), F.col("month_start"))).alias("hi"),
    )
    lowest, highest = ends.select("lo").scalar(), ends.select("hi").scalar()
    return months.withColumns({
        "is_min": F.col("month_start") == lowest,
        "is_max": F.col("month_start") == highest,
    })


# ---------------------------------------------------------------- grid
def half_hour_slots(enriched: DataFrame, from_year: int = 2022) -> DataFrame:
    """Lowest, highest and mean bikes and docks per station and half hour with readings."""
    rows = enriched.where(F.col("year") >= from_year).withColumn("half", dates.half_hour(F.col("ts_local")))
    mean = lambda c: round_binary(F.avg(c), 2)
    return rows.groupBy(*SLOT).agg(
        F.min("bikes").alias("min_bikes"), F.max("bikes").alias("max_bikes"), mean("bikes").alias("avg_bikes"),
        F.min("docks").alias("min_docks"), F.max("docks").alias("max_docks"), mean("docks").alias("avg_docks"),
        mean(F.col("bikes") + F.col("docks")).alias("avg_capacity"),
    )


def calendar_bounds(raw: DataFrame, zone: str = LOCAL_ZONE) -> tuple[Column, Column]:
    """First and last half hour of the local days the valid raw readings cover, as scalar subqueries.

    Straight from the raw rows: duplicates do not move the ends, so the subquery
    is one scan with a partial aggregate.
    """
    seconds = F.col("last_reported").try_cast("bigint")
    ends = valid_readings(raw).agg(F.struct(F.min(seconds).alias("lo"), F.max(seconds).alias("hi"))).scalar()
    midnight = lambda t: F.to_date(dates.epoch_to_local(t, zone)).cast("timestamp_ntz")
    return midnight(ends["lo"]), midnight(ends["hi"]) + F.expr("interval 23 hours 30 minutes")


def with_slots(df: DataFrame, first: Column, last: Column) -> DataFrame:
    """Each row once per half hour from ``first`` to ``last``, both included and on the half hour.

    Each row expands itself, so a stations x slots grid needs no join. Rows are
    expanded to days and dealt out before the 48 slots of a day are added: the
    few station rows would otherwise sit in one partition that writes the whole grid.
    The series is zone-less: hours that daylight saving skips are present.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each_day = F.sequence(F.to_date(first), F.to_date(last), F.expr("interval 1 day"))
    days = df.withColumn("day", F.explode(each_day)).repartition(parts, *df.columns, "day")
    slots = days.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(47))))
    zero = F.lit(0)
    start = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(zero, zero, F.col("slot") * 30, zero)
    return slots.where(start.between(first, last)).select(
        *df.columns, "day", F.floor(F.col("slot") / 2).cast("int").alias("hour"), (F.col("slot") % 2).alias("half")
    )


def slot_state() -> Column:
    """State label; the first matching rule wins."""
    bikes, docks = F.col("min_bikes"), F.col("min_docks")
    return (
        F.when(bikes.isNull() & docks.isNull(), NO_READINGS)
        .when((bikes < 0) | (docks < 0), OTHER)
        .when((bikes == 0) & (docks == 0), BOTH_EXTREMES)
        .when(bikes == 0, EMPTY)
        .when(docks == 0, FULL)
        .otherwise(NORMAL)
    )


def dense_grid(slots: DataFrame, stations: DataFrame, first: Column, last: Column) -> DataFrame:
    """Every station x half hour with its indicators (NULL without readings) and state."""
    frame = with_slots(stations.select(*STATION), first, last)
    return frame.join(slots, SLOT, "left").withColumn("state", slot_state())


# ---------------------------------------------------------------- availability reports
def _count_state(*states: str) -> Column:
    return F.count(F.when(F.col("state").isin(*states), 1))


def availability(grid: DataFrame, keys: Sequence[Column | str]) -> DataFrame:
    """Measured slots and the share of empty, full and problem slots among them, per key."""
    measured = F.count(F.when(F.col("state") != NO_READINGS, 1))
    return grid.groupBy(*keys).agg(
        measured.alias("measured_slots"),
        pct(_count_state(EMPTY), measured).alias("pct_empty"),
        pct(_count_state(FULL), measured).alias("pct_full"),
        pct(_count_state(*PROBLEM_STATES), measured).alias("pct_problem"),
        pct(_count_state(NO_READINGS), F.count(F.lit(1))).alias("pct_unmeasured"),
        round_binary(F.avg("avg_capacity"), 1).alias("mean_capacity"),
    )


AVAILABILITY_KEYS = {
    "year": lambda: [F.year("day").alias("year")],
    "month": lambda: [F.year("day").alias("year"), F.month("day").alias("month")],
    "hour": lambda: ["hour"],
    "hour_year": lambda: [F.year("day").alias("year"), "hour"],
    "dow_hour": lambda: [dates.iso_weekday(F.col("day")).alias("weekday"), "hour"],
    "district": lambda: ["district"],
    "station": lambda: ["station_id", "district", "lat", "lon"],
}


def week_states(grid: DataFrame, first_day: Column, days: int = 7) -> DataFrame:
    """States of one calendar week, keyed by weekday and slot."""
    week = grid.where((F.col("day") >= first_day) & (F.col("day") < F.date_add(first_day, days)))
    return week.select(
        "station_id", dates.iso_weekday(F.col("day")).alias("weekday"), "hour", "half", "state"
    )


def animation_frames(week: DataFrame) -> DataFrame:
    """The frames of the week, one row per slot and station: label and counts of the slot, colour of the station."""
    slot = ["weekday", "hour", "half"]
    colour = dates.lookup(F.col("state"), STATE_COLOUR)
    cells = week.withColumn("colour", F.coalesce(colour, F.lit(DEFAULT_STATE_COLOUR)))
    counts = week.groupBy(*slot).agg(
        _count_state(EMPTY).alias("n_empty"), _count_state(FULL).alias("n_full")
    )
    label = F.format_string(
        "%s %02d:%02d", dates.lookup(F.col("weekday"), WEEKDAYS), F.col("hour"), F.col("half") * 30
    )
    return cells.join(counts, slot).select(*slot, label.alias("label"), "n_empty", "n_full", "station_id", "colour")
