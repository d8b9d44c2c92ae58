"""Date and time columns. Local time is zone-less, so the session time zone never matters."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, functions as F

from slotwise.constants import LOCAL_ZONE, SEASONS

EPOCH_START = "timestamp_ntz'1970-01-01 00:00:00'"


def epoch_to_utc(seconds: Column) -> Column:
    """Epoch seconds -> zone-less UTC timestamp."""
    zero = F.lit(0)
    return F.expr(EPOCH_START) + F.make_dt_interval(zero, zero, zero, seconds)


def utc_to_local(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    """Zone-less UTC timestamp -> zone-less local timestamp (daylight saving applied)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def epoch_to_local(seconds: Column, zone: str = LOCAL_ZONE) -> Column:
    return utc_to_local(epoch_to_utc(seconds), zone)


def iso_weekday(day: Column) -> Column:
    """1 = Monday .. 7 = Sunday."""
    return F.weekday(day) + 1


def week_of_month(day: Column) -> Column:
    """1..5: days 1-7 are week one."""
    return F.ceil(F.dayofmonth(day) / 7.0).cast("int")


def half_hour(ts: Column) -> Column:
    """0 for the first half of the hour, 1 for the second."""
    return F.when(F.minute(ts) < 30, 0).otherwise(1)


def season_number(month: Column) -> Column:
    """Meteorological season, 1 = winter (December to February)."""
    return (F.floor(F.pmod(month, F.lit(12)) / 3) + 1).cast("int")


def season_name(month: Column) -> Column:
    return lookup(season_number(month), SEASONS)


def lookup(key: Column, names: dict) -> Column:
    """Value of a small fixed table, NULL when the key is absent."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.try_element_at(table, key)


def period_key(year: Column, month: Column) -> Column:
    """``YYYY-MM``."""
    return F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"))


def first_of_month(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))


def make_date_or_null(year: Column, month: Column, day: Column) -> Column:
    """Date from its parts; impossible dates give NULL instead of an error."""
    text = F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int"))
    return text.try_cast("date")


def age_completed(birth: Column, on: date | Column) -> Column:
    """Completed years on a given day; a 29 February birthday counts from 1 March."""
    ref = on if isinstance(on, Column) else F.lit(on)
    early = F.month(ref) * 100 + F.dayofmonth(ref) < F.month(birth) * 100 + F.dayofmonth(birth)
    return F.year(ref) - F.year(birth) - early.cast("int")


def age_approx(birth: Column, on: date | Column) -> Column:
    """Whole years of 365.25 days."""
    ref = on if isinstance(on, Column) else F.lit(on)
    return F.floor(F.datediff(ref, birth) / 365.25).cast("int")


def time_of_day(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")
