"""Hand-made readings through the station pipeline."""

from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from slotwise.constants import EMPTY, FULL, NORMAL, NO_READINGS
from slotwise.operators import baselines as B, evaluation as E, features as FT, timeseries as TS

RAW = "station_id string, last_reported string, last_updated string, num_bikes_available string, num_docks_available string, status string, is_renting string"


def epoch(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp())


def raw(spark, rows):
    """(station, time, updated, bikes, docks) in service and renting, unless two more fields say otherwise."""
    full = [tuple(None if x is None else str(x) for x in r) + (("IN_SERVICE", "1") if len(r) == 5 else ()) for r in rows]
    return spark.createDataFrame(full, RAW)


@pytest.fixture
def stations(spark):
    return spark.createDataFrame([(1, 41.0, 2.0, 1, "A"), (2, 41.1, 2.1, 2, "B")], "station_id int, lat double, lon double, district_id int, district string")


def test_clean_keeps_the_latest_update_and_drops_bad_rows(spark):
    t = epoch(2024, 1, 5, 10)
    rows = [
        (1, t, 100, 3, 7), (1, t, 90, 4, 6), (1, t + 300, 5, 1, 9), (1, t + 300, 5, 2, 8),
        ("1\r", t, 1, 1, 1), (1, t + 600, 1, -1, 1), (1, t + 900, 1, "", 1), (1, t + 900, 1, 1, None),
        (1, 946684799, 1, 1, 1), (1, 2145916801, 1, 1, 1), (1, "99999999999999999999", 1, 1, 1),
        (1, t + 1200, 1, 1, 1, "NOT_IN_SERVICE", "1"), (1, t + 1200, 1, 1, 1, "IN_SERVICE", "0"),
    ]
    got = {(r.last_reported, r.bikes, r.docks) for r in TS.clean(raw(spark, rows)).collect()}
    assert got == {(t, 3, 7), (t + 300, 2, 8)}


def test_delta_crosses_days_and_gaps(spark):
    times = [epoch(2024, 1, 1, 23, 55), epoch(2024, 1, 2, 0, 5), epoch(2024, 1, 2, 0, 10), epoch(2024, 1, 9, 12)]
    rows = [(1, t, 1, b, 10 - b) for t, b in zip(times, (8, 5, 6, 1))] + [(2, times[0], 1, 4, 4)]
    got = {(r.station_id, r.last_reported): (r.seconds_since_prev, r.delta_bikes) for r in TS.with_delta(TS.clean(raw(spark, rows))).collect()}
    assert got == {
        (1, times[0]): (None, None), (1, times[1]): (600, -3), (1, times[2]): (300, 1),
        (1, times[3]): (times[3] - times[2], -5), (2, times[0]): (None, None),
    }


def test_delta_equals_one_plain_window_on_a_hot_station(spark):
    base = epoch(2024, 1, 1)
    rows = spark.range(3000).select(
        F.lit(7).alias("station_id"), (F.lit(base) + F.col("id") * 977).alias("last_reported"),
        F.pmod(F.hash("id"), F.lit(20)).alias("bikes"), F.lit(1).alias("docks"))
    got = TS.with_delta(rows).select("last_reported", "delta_bikes")
    from pyspark.sql import Window
    w = Window.partitionBy("station_id").orderBy("last_reported")
    want = rows.select("last_reported", (F.col("bikes") - F.lag("bikes").over(w)).alias("delta_bikes"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_trips_count_drops_in_the_later_hour_and_respect_max_gap(spark, stations):
    times = [epoch(2024, 1, 1, 9, 58), epoch(2024, 1, 1, 10, 2), epoch(2024, 1, 1, 14)]
    deltas = TS.with_delta(TS.clean(raw(spark, [(1, t, 1, b, 5) for t, b in zip(times, (9, 6, 2))] + [(5, times[0], 1, 1, 1)])))
    by_hour = lambda df: {r.hour: r.trips for r in df.collect()}
    assert by_hour(TS.trips(deltas, stations)) == {10: 0, 11: 3, 15: 4}
    assert by_hour(TS.trips(deltas, stations, max_gap=3600)) == {10: 0, 11: 3, 15: 0}


def test_calendar_has_every_half_hour_of_the_published_period(spark):
    first, last = F.lit(datetime(2022, 1, 1)).cast("timestamp_ntz"), F.lit(datetime(2025, 9, 30, 23, 30)).cast("timestamp_ntz")
    ids = spark.range(2).select(F.col("id").alias("station_id"))
    assert TS.with_slots(ids, first, last).count() == 2 * 65_712


def test_autumn_hour_shares_its_slots_and_spring_slots_stay_empty(spark, stations):
    times = [epoch(2024, 10, 27, 0, 5), epoch(2024, 10, 27, 1, 5), epoch(2024, 3, 31, 0, 50), epoch(2024, 3, 31, 1, 5)]
    source = raw(spark, [(1, t, 1, b, 5) for t, b in zip(times, (0, 4, 3, 3))])
    slots = TS.half_hour_slots(TS.enrich(TS.clean(source), stations))
    got = {(str(r.day), r.hour, r.half): (r.min_bikes, r.max_bikes) for r in slots.collect()}
    assert got == {("2024-10-27", 2, 0): (0, 4), ("2024-03-31", 1, 1): (3, 3), ("2024-03-31", 3, 0): (3, 3)}


def test_state_rules_in_order(spark):
    rows = [(None, None), (-1, 0), (0, 0), (0, 3), (3, 0), (1, 1)]
    df = spark.createDataFrame(rows, "min_bikes int, min_docks int").withColumn("state", TS.slot_state())
    assert [r.state for r in df.collect()] == [NO_READINGS, "altres", "extremes", EMPTY, FULL, NORMAL]


def test_grid_is_complete_and_states_add_up(spark, stations):
    source = raw(spark, [(1, epoch(2024, 1, 1, 8), 1, 0, 9), (1, epoch(2024, 1, 2, 8), 1, 9, 0)])
    located = TS.enrich(TS.clean(source), stations)
    grid = TS.dense_grid(TS.half_hour_slots(located), stations, *TS.calendar_bounds(source))
    assert grid.count() == 2 * 2 * 48
    row = TS.availability(grid, [F.year("day").alias("year")]).first()
    assert (row.measured_slots, row.pct_empty, row.pct_full, row.pct_problem) == (2, 50.0, 50.0, 100.0)
    none = TS.availability(grid.where("station_id = 2"), ["station_id"]).first()
    assert none.measured_slots == 0 and none.pct_empty is None and none.pct_unmeasured == 100.0


def grid_rows(spark, rows):
    """(station, day, hour, half, state)"""
    df = spark.createDataFrame(rows, "station_id int, day date, hour int, half int, state string")
    extra = {c: F.lit(1.0) for c in ("lat", "lon", "avg_bikes", "avg_docks", "avg_capacity")}
    return df.withColumns({**extra, "district_id": F.lit(1), "district": F.lit("A")})


def test_fill_level_is_null_without_capacity(spark):
    df = spark.createDataFrame([(3.0, 0.0), (3.0, 6.0), (None, None)], "avg_bikes double, avg_capacity double")
    assert [r[0] for r in df.select(FT.fill_level()).collect()] == [None, 0.5, None]


def test_seasonal_naive_needs_exactly_seven_days(spark):
    rows = [(1, date(2024, 1, 1), 3, 0, EMPTY), (1, date(2024, 1, 8), 3, 0, FULL), (1, date(2024, 1, 22), 3, 0, NORMAL), (1, date(2024, 1, 9), 3, 0, NORMAL)]
    got = {str(r.day): r.sn7_pred for r in B.seasonal_naive(grid_rows(spark, rows)).collect()}
    assert got == {"2024-01-01": None, "2024-01-08": EMPTY, "2024-01-22": None, "2024-01-09": None}


def test_historical_mode_uses_the_full_key(spark):
    # Second Tuesday of May in three years; a fourth row in another week of the month does not count.
    days = [date(2022, 5, 10), date(2023, 5, 9), date(2024, 5, 14), date(2024, 5, 28)]
    rows = [(1, d, 8, 1, s) for d, s in zip(days, (EMPTY, FULL, FULL, EMPTY))] + [(1, days[0], 9, 0, "extremes")]
    got = {(r.month, r.week_of_month, r.weekday, r.hour): r.ha_pred for r in B.historical_mode(grid_rows(spark, rows)).collect()}
    assert got == {(5, 2, 2, 8): FULL, (5, 4, 2, 8): EMPTY}


def test_day_type_marks_saturday_only_unless_asked(spark):
    rows = [(1, date(2024, 1, d), 8, 0, NORMAL) for d in (19, 20, 21)]
    grid = grid_rows(spark, rows)
    history = B.historical_mode(grid)
    args = (grid, history, date(2024, 1, 19), date(2024, 1, 21))
    types = lambda df: [r.day_type for r in df.orderBy("day").collect()]
    assert types(B.evaluation_table(*args)) == ["lab", "fest", "lab"]
    assert types(B.evaluation_table(*args, weekend_from=6)) == ["lab", "fest", "fest"]


def test_lags_jump_over_removed_slots(spark):
    rows = [(1, date(2024, 1, 1), h, 0, s) for h, s in enumerate((NORMAL, EMPTY, NO_READINGS, FULL, NORMAL))]
    grid = grid_rows(spark, rows).withColumn("avg_bikes", F.col("hour") * 1.0)
    got = {r.hour: (r.prev_bikes, r.prev_state, r.delta_bikes) for r in FT.with_lags(grid).collect()}
    assert got == {0: (None, -1, None), 1: (None, -1, None), 3: (0.0, 1, None), 4: (1.0, 0, 1.0)}


def test_metrics_of_missing_classes(spark):
    rows = [(EMPTY, EMPTY)] * 3 + [(EMPTY, NORMAL)] + [(NORMAL, NORMAL)] * 4 + [(NORMAL, "extremes")] * 2 + [(NORMAL, None)]
    table = E.confusion(spark.createDataFrame(rows, "real string, p string"), "real", {"m": "p"})
    metrics = E.class_metrics(table, ["m"])
    got = {r.label: (r.tp, r.n_pred, r.n_real, r.precision, r.recall, r.f1) for r in metrics.collect()}
    assert got[EMPTY] == (3, 3, 4, 1.0, 0.75, pytest.approx(6 / 7))
    assert got[NORMAL][:5] == (4, 5, 6, 0.8, pytest.approx(4 / 6))
    assert got[FULL] == (0, 0, 0, None, None, None)
    f1 = (6 / 7 + 2 * 0.8 * (4 / 6) / (0.8 + 4 / 6))
    assert E.balanced_accuracy(metrics).first().macro_f1_pct == pytest.approx(100 * f1 / 2, abs=0.005)
    assert E.balanced_accuracy(metrics, undefined_as_zero=True).first().macro_f1_pct == pytest.approx(100 * f1 / 3, abs=0.005)
    assert E.balanced_accuracy(metrics).first().balanced_accuracy_pct == pytest.approx(100 * (0.75 + 4 / 6) / 2, abs=0.005)


def test_every_hour_is_scored_with_its_rows(spark):
    rows = [(1, EMPTY, EMPTY)] * 3 + [(2, EMPTY, NORMAL)]
    df = spark.createDataFrame(rows, "hour int, real string, p string")
    got = E.balanced_accuracy_by(df, "real", {"m": "p"}, "hour").collect()
    assert sorted((r.hour, r.n, r.balanced_accuracy) for r in got) == [(1, 3, 100.0), (2, 1, 0.0)]
