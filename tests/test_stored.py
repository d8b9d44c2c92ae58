"""Stored tables: changes rewrite the partitions they touch and no others; refreshed days equal the chain over all readings."""

import os

import pytest
from pyspark.sql import functions as F

from slotwise.operators import timeseries as TS
from slotwise.plans import daily, roles as R
from slotwise.sources.stored import StoredTable

ROWS = [(k, f"n{k}", "a b/c" if k % 4 == 0 else None if k % 4 == 1 else f"p{k % 4}", float(k)) for k in range(40)]


@pytest.fixture
def table(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "k long, name string, part string, v double")
    return StoredTable.create(df, f"{tmp_path}/t", ["part"])


def files(table):
    found = {}
    for folder, _, names in os.walk(table.path):
        for n in names:
            if n.endswith(".parquet"):
                found[os.path.join(folder, n)] = os.stat(os.path.join(folder, n)).st_mtime_ns
    return found


def rows(table):
    return sorted(tuple(r) for r in table.read().select("k", "name", "part", "v").collect())


def changed(before, after):
    return {os.path.basename(os.path.dirname(f)) for f in before.keys() ^ after.keys()}


def test_update_keeps_the_files_of_other_partitions(table):
    before = files(table)
    touched = table.update(F.col("k") == 6, name="six")
    after = files(table)
    assert [tuple(p) for p in touched] == [("p2",)] and changed(before, after) == {"part=p2"}
    assert all(before[f] == after[f] for f in before.keys() & after.keys())
    assert rows(table) == sorted((k, "six" if k == 6 else n, p, v) for k, n, p, v in ROWS)


def test_rows_move_between_partitions_and_empty_ones_go(table):
    before = files(table)
    table.update(F.col("part").isNull(), part="p3", v=0.0)
    assert changed(before, files(table)) == {"part=__HIVE_DEFAULT_PARTITION__", "part=p3"}
    table.delete(F.col("part") == "a b/c")
    table.delete(F.col("v") > 1000)
    want = [(k, n, "p3" if p is None else p, 0.0 if p is None else v) for k, n, p, v in ROWS if p != "a b/c"]
    assert rows(table) == sorted(want) and table.read().columns == ["k", "name", "part", "v"]
    assert {os.path.basename(os.path.dirname(f)) for f in files(table)} == {"part=p2", "part=p3"}


def test_unknown_conditions_change_nothing(table):
    before = files(table)
    assert table.update(F.col("part") == "none such", v=1.0) == [] and table.delete(F.lit(None).cast("boolean")) == []
    assert files(table) == before


def test_insert_missing_adds_files_only(spark, table):
    before = files(table)
    new = spark.createDataFrame([(3, "p9"), (100, "p9"), (100, "p9"), (101, None)], "k int, part string")
    table.insert_missing(new, "k")
    after = files(table)
    assert before.items() <= after.items()
    assert [r for r in rows(table) if r[0] >= 100] == [(100, None, "p9", None), (101, None, None, None)] and len(rows(table)) == 42


def test_rows_outside_the_partitions_are_refused(spark, table):
    with pytest.raises(ValueError):
        table.replace(table.read(), [p for p in table._partitions(table.read()) if p.part == "p2"])


# ---------------------------------------------------------------- station days
NAMES = ("readings", "tails", "trips", "slots", "grid")


def same(a, b):
    return a.exceptAll(b.select(a.columns)).isEmpty() and b.select(a.columns).exceptAll(a).isEmpty()


def test_refreshed_days_equal_the_chain_over_all_readings(spark, sf, tmp_path):
    raw = R.readings(spark, sf)
    stations = R.stations_of(raw)
    time = F.col("last_reported").cast("long")
    noon = raw.where("status = 'IN_SERVICE'").agg(F.min(time) + 10 * 86_400).first()[0]
    late = ((time > noon) & (time < noon + 40_000)) | (time > noon + 15 * 86_400)
    tables = daily.StationDays(raw.where(~late), stations, f"{tmp_path}/parts")
    before = {n: files(getattr(tables, n)) for n in NAMES}
    written = tables.refresh(raw.where(late))
    whole = daily.StationDays(raw, stations, f"{tmp_path}/whole")
    for n in NAMES:
        assert same(getattr(tables, n).read(), getattr(whole, n).read()), n
        old, new = before[n], files(getattr(tables, n))
        assert changed(old, new) <= {f"day={d}" for d in written[n]}, n  # other days stay the same files
        assert len(old.keys() & new.keys()) >= 5
    assert set(written["readings"]) < set(written["trips"])  # the day after a late reading, too
    assert same(TS.trips(TS.with_delta(TS.clean(raw)), stations), whole.trips.read())
    assert same(TS.dense_grid(TS.half_hour_slots(TS.enrich(TS.clean(raw), stations)), stations, *TS.calendar_bounds(raw)), whole.grid.read())
    again = {n: files(getattr(tables, n)) for n in NAMES}
    assert tables.refresh(raw.where("false")) == {n: [] for n in NAMES} and again == {n: files(getattr(tables, n)) for n in NAMES}


def test_corrections_of_a_reading_win_by_their_update(spark, sf, tmp_path):
    raw = R.readings(spark, sf)
    stations = R.stations_of(raw)
    one = raw.where("status = 'IN_SERVICE' and is_renting = '1'").orderBy("last_updated").limit(1)
    newer = one.withColumns({"last_updated": F.lit("999999999"), "num_bikes_available": F.lit("77")})
    older = one.withColumns({"last_updated": F.lit("0"), "num_bikes_available": F.lit("55")})
    tables = daily.StationDays(raw, stations, f"{tmp_path}/days")
    tables.refresh(newer.union(older))
    assert tables.readings.read().where("bikes = 77").count() == 1 and tables.readings.read().where("bikes = 55").isEmpty()
    assert same(tables.readings.read(), daily.StationDays(raw.union(newer).union(older), stations, f"{tmp_path}/all").readings.read())
