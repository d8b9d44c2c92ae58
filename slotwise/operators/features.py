"""Behaviour features of stations, built from the dense grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from slotwise.constants import (
    BOTH_EXTREMES, DEFAULT_CAPACITY, EMPTY, EVENING_PEAK, FULL, MODEL_CLASSES, MORNING_PEAK,
    STATE_NUMBER, WEEKEND_BANDS, WORKDAY_BANDS,
)
from slotwise.functions import dates
from slotwise.functions.numbers import ratio
from slotwise.operators.grouping import last_n_per_group

STRUCTURE_KEYS = ["station_id", "lat", "lon", "district"]


def years(grid: DataFrame, first: int, last: int) -> DataFrame:
    return grid.where(F.year("day").between(first, last))


def fill_level() -> Column:
    """Share of the capacity taken by bikes; NULL without capacity."""
    return ratio(F.col("avg_bikes"), F.col("avg_capacity"))


def is_weekend(day: Column) -> Column:
    return dates.iso_weekday(day) >= 6


def structure(grid: DataFrame) -> DataFrame:
    """Mean capacity per station."""
    return grid.groupBy(*STRUCTURE_KEYS).agg(F.avg("avg_capacity").alias("mean_capacity"))


def _band_name(kind: str, start: int, end: int) -> str:
    return f"nab_{kind}_h{start:02d}_{end % 24:02d}"


def fill_profile(grid: DataFrame) -> DataFrame:
    """Mean fill level in bands of the day, for workdays and weekends.

    Two levels on purpose: each slot of the day is averaged first and then
    counts once in its band, however many readings it had.
    """
    weekend = is_weekend(F.col("day"))
    slots = grid.groupBy("station_id", "hour", "half").agg(
        F.avg(F.when(~weekend, fill_level())).alias("lab"),
        F.avg(F.when(weekend, fill_level())).alias("fest"),
    )
    bands = [("lab", b) for b in WORKDAY_BANDS] + [("fest", b) for b in WEEKEND_BANDS]
    return slots.groupBy("station_id").agg(*[
        F.avg(F.when(F.col("hour").between(start, end - 1), F.col(kind))).alias(_band_name(kind, start, end))
        for kind, (start, end) in bands
    ])


def _variability_rows(grid: DataFrame) -> DataFrame:
    workday = ~is_weekend(F.col("day"))
    return grid.withColumns({
        "nab": fill_level(),
        "bike_range": ratio(F.col("max_bikes") - F.col("min_bikes"), F.col("avg_capacity")),
        "dock_range": ratio(F.col("max_docks") - F.col("min_docks"), F.col("avg_capacity")),
        "morning": workday & F.col("hour").between(*MORNING_PEAK),
        "evening": workday & F.col("hour").between(*EVENING_PEAK),
    })


def _variability_aggregates() -> list[Column]:
    nab, peak = F.col("nab"), F.col("morning") | F.col("evening")
    in_state = lambda state: (F.col("state") == state).cast("double")
    morning, evening = F.when(F.col("morning"), nab), F.when(F.col("evening"), nab)
    return [
        F.stddev_samp(nab).alias("sd_nab"),
        F.avg(nab).alias("mean_nab"),
        F.stddev_samp(morning).alias("sd_nab_morning"),
        F.stddev_samp(evening).alias("sd_nab_evening"),
        F.avg("bike_range").alias("mean_bike_range"),
        F.avg("dock_range").alias("mean_dock_range"),
        F.avg(in_state(EMPTY)).alias("share_empty"),
        F.avg(in_state(FULL)).alias("share_full"),
        F.avg(in_state(BOTH_EXTREMES)).alias("share_extremes"),
        F.avg(F.when(peak, in_state(EMPTY))).alias("share_empty_peak"),
        F.avg(F.when(peak, in_state(FULL))).alias("share_full_peak"),
        F.avg(morning).alias("mean_nab_morning"),
        F.avg(evening).alias("mean_nab_evening"),
    ]


def variability(grid: DataFrame) -> DataFrame:
    """Spread, peak-hour level, range and state shares; shares are over all slots, measured or not."""
    return _variability_rows(grid).groupBy("station_id").agg(*_variability_aggregates())


def station_features(grid: DataFrame) -> DataFrame:
    """Ids plus 28 features per station. Capacity and variability come from one pass, the profile from another."""
    direct = _variability_rows(grid).groupBy(*STRUCTURE_KEYS).agg(
        F.avg("avg_capacity").alias("mean_capacity"), *_variability_aggregates()
    )
    profile = fill_profile(grid)
    order = [*STRUCTURE_KEYS, "mean_capacity", *profile.columns[1:], *direct.columns[len(STRUCTURE_KEYS) + 1:]]
    return direct.join(profile, "station_id", "left").select(*order)


def feature_columns(features: DataFrame) -> list[str]:
    return [c for c in features.columns if c not in STRUCTURE_KEYS]


# ---------------------------------------------------------------- next-state model
MODEL_FEATURES = [
    "hour", "half", "weekday", "month", "season", "weekend",
    "prev_bikes", "prev_docks", "prev_capacity", "prev_state",
    "delta_bikes", "delta_docks",
    "nab_mean", "nab_sd", "share_empty", "share_full", "capacity_mean",
    "cluster",
]
PROFILE_KEYS = ["station_id", "hour", "half", "weekend"]
PROFILE_VALUES = ["nab_mean", "nab_sd", "capacity_mean", "share_empty", "share_full"]


def slot_profile(grid: DataFrame) -> DataFrame:
    """History of each station, slot and day type, over modelled states only."""
    rows = grid.where(F.col("state").isin(*MODEL_CLASSES)).withColumn("weekend", is_weekend(F.col("day")).cast("tinyint"))
    share = lambda state: F.avg((F.col("state") == state).cast("double"))
    return rows.groupBy(*PROFILE_KEYS).agg(
        F.avg(fill_level()).cast("float").alias("nab_mean"),
        F.stddev_samp(fill_level()).cast("float").alias("nab_sd"),
        F.avg("avg_capacity").cast("float").alias("capacity_mean"),
        share(EMPTY).cast("float").alias("share_empty"),
        share(FULL).cast("float").alias("share_full"),
    )


def with_lags(grid: DataFrame) -> DataFrame:
    """Observations two and three modelled slots earlier, and the trend between them.

    Lags count rows: slots in other states are removed first and jumped over. The
    window holds one month of one station, behind the last three modelled slots of
    the months before, so no station's history is ever in one task.
    """
    modelled = grid.where(F.col("state").isin(*MODEL_CLASSES)).select("station_id", "day", "hour", "half", "state", "avg_bikes", "avg_docks", "avg_capacity")
    rows = modelled.withColumns({"_month": F.trunc("day", "month"), "_carried": F.lit(False)})
    rows = rows.unionByName(_carried_over(rows, 3))
    w = Window.partitionBy("station_id", "_month").orderBy("day", "hour", "half")
    two = lambda c: F.lag(c, 2).over(w)
    three = lambda c: F.lag(c, 3).over(w)
    capacity = F.coalesce(F.col("avg_capacity"), F.lit(DEFAULT_CAPACITY))
    month = F.month("day")
    lagged = rows.select(
        "_carried", "station_id", "day", "hour", "half", "state",
        month.alias("month"),
        dates.iso_weekday(F.col("day")).alias("weekday"),
        is_weekend(F.col("day")).cast("tinyint").alias("weekend"),
        dates.season_number(month).alias("season"),
        two("avg_bikes").cast("float").alias("prev_bikes"),
        two("avg_docks").cast("float").alias("prev_docks"),
        two(capacity).cast("float").alias("prev_capacity"),
        F.coalesce(dates.lookup(two("state"), STATE_NUMBER), F.lit(-1)).alias("prev_state"),
        (two("avg_bikes") - three("avg_bikes")).cast("float").alias("delta_bikes"),
        (two("avg_docks") - three("avg_docks")).cast("float").alias("delta_docks"),
    )
    return lagged.where(~F.col("_carried")).drop("_carried")


def _carried_over(rows: DataFrame, n: int) -> DataFrame:
    """For each station and month the last ``n`` rows of the months before, under that month.

    Only the last ``n`` rows of each month can be among them; these few rows are what the window
    over a station's months holds.
    """
    slot = ["day", "hour", "half"]
    last = last_n_per_group(rows, ["station_id", "_month"], [F.desc(c) for c in slot], n).drop("row_in_group")
    before = Window.partitionBy("station_id").orderBy(*slot).rowsBetween(-n, -1)
    first = Window.partitionBy("station_id", "_month").orderBy(*slot)
    cells = F.struct(*[c for c in rows.columns if c not in ("station_id", "_month", "_carried")])
    heads = last.withColumns({"_before": F.collect_list(cells).over(before), "_place": F.row_number().over(first)}).where("_place = 1")
    return heads.select("station_id", "_month", F.lit(True).alias("_carried"), F.inline("_before"))


def model_table(grid: DataFrame, profile: DataFrame, clusters: DataFrame, period: Column) -> DataFrame:
    """Features and target for the slots of ``period`` (a condition on ``day``).

    Lags are taken over the whole grid before the period is cut out. Slots without a
    history take the mean of all histories; stations without a cluster get -1.
    """
    lagged = with_lags(grid).where(
        F.col("prev_bikes").isNotNull() & F.col("delta_bikes").isNotNull() & period
    )
    overall = profile.agg(F.struct(*[F.avg(c).alias(c) for c in PROFILE_VALUES])).scalar()
    joined = lagged.join(profile, PROFILE_KEYS, "left").join(
        clusters.select("station_id", "cluster"), "station_id", "left"
    )
    filled = {c: F.coalesce(F.col(c).cast("double"), overall[c]) for c in PROFILE_VALUES}
    return joined.withColumns({**filled, "cluster": F.coalesce("cluster", F.lit(-1))})
