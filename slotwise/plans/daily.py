"""The station tables as stored tables by local day, brought up to date from new readings.

A refresh rewrites the days that have new readings, and of the trips also the day after, station by station: the
first reading there is compared with the last one before. That lag comes from ``tails``, one row per
station and day, so no older readings are read. Days that lie between known ones and have no
readings are in the grid only.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Row, SparkSession, Window, functions as F

from slotwise.operators import timeseries as ts
from slotwise.sources.stored import StoredTable


def _days(rows: Sequence[date]) -> list[Row]:
    return [Row(day=d) for d in rows]


class StationDays:
    """readings, tails, trips, slots and grid below one folder, each partitioned by local day."""

    def __init__(self, raw: DataFrame, stations: DataFrame, folder: str):
        self.spark: SparkSession = raw.sparkSession
        self.stations, self.folder = stations, folder
        readings = self._readings(ts.typed_readings(raw))
        self.readings = self._create("readings", readings)
        self.tails = self._create("tails", ts.day_tails(self.readings.read(), "day"))
        self.trips = self._create("trips", self._trips(self.readings.read()))
        self.slots = self._create("slots", self._slots(self.readings.read()))
        days = self._known_days()
        self.grid = self._create("grid", self._grid(days[0], days[-1]) if days else self._grid(date(1970, 1, 1), date(1970, 1, 1)).limit(0))

    def _create(self, name: str, df: DataFrame) -> StoredTable:
        return StoredTable.create(df, f"{self.folder}/{name}", ["day"])

    def _readings(self, typed: DataFrame) -> DataFrame:
        local = ts.localize(ts.latest_readings(typed))
        return local.select("station_id", "last_reported", "bikes", "docks", "updated", "day")

    def _known_days(self) -> list[date]:
        return sorted(r.day for r in self.tails.read().select("day").distinct().collect())

    def _trips(self, readings: DataFrame) -> DataFrame:
        deltas = ts.delta_within(readings, ts.carried_tails(self.tails.read(), "day"), "day")
        return ts.trips(deltas, self.stations)

    def _slots(self, readings: DataFrame) -> DataFrame:
        return ts.half_hour_slots(ts.enrich(readings.drop("day"), self.stations))

    def _grid(self, first: date, last: date) -> DataFrame:
        start, end = (F.lit(d).cast("timestamp_ntz") for d in (first, last))
        return ts.dense_grid(self.slots.read(), self.stations, start, end + F.expr("interval 23 hours 30 minutes"))

    def refresh(self, raw: DataFrame) -> dict[str, list[date]]:
        """Takes in new raw readings (late ones and corrections too) and returns the days rewritten of each table.

        Stations are those of the dimension the tables were made with.
        """
        typed = ts.typed_readings(raw)
        new = sorted(r.day for r in ts.localize(typed).select("day").distinct().collect())
        if not new:
            return {name: [] for name in ("readings", "tails", "trips", "slots", "grid")}
        days = _days(new)
        known = self.grid.read().agg(F.min("day").alias("low"), F.max("day").alias("high")).first()
        old = self.readings.rows_of(days).drop("day")
        self.readings.replace(self._readings(old.unionByName(typed)), days)
        self.tails.replace(ts.day_tails(self.readings.rows_of(days), "day"), days)
        after = F.lead("day").over(Window.partitionBy("station_id").orderBy("day"))
        following = self.tails.read().select("day", after.alias("next")).where(F.col("day").isin(new) & F.col("next").isNotNull())
        shifted = _days(sorted({*new, *(r.next for r in following.select("next").distinct().collect())}))
        self.trips.replace(self._trips(self.readings.rows_of(shifted)), shifted)
        self.slots.replace(self._slots(self.readings.rows_of(days)), days)
        low, high = min(new[0], known.low or new[0]), max(new[-1], known.high or new[-1])
        frame = self.spark.range(1).select(F.explode(F.sequence(F.lit(low), F.lit(high))).alias("day"))
        gaps = [r.day for r in frame.where(~F.col("day").between(F.lit(known.low), F.lit(known.high))).collect()] if known.low else []
        filled = sorted({*new, *gaps})
        within = self._grid(low, high).where(F.col("day").isin(filled))
        self.grid.replace(within, _days(filled))
        return {"readings": new, "tails": new, "trips": [r.day for r in shifted], "slots": new, "grid": filled}
