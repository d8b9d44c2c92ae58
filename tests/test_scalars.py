"""Edge cases of the column helpers."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from slotwise.functions import dates, numbers as N, text as X
from slotwise.operators import people as P


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", expression(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


def test_all_digits_rejects_line_breaks_signs_and_blanks(spark):
    assert column(spark, ["12", "12\r", "12\n", "-1", "", None], X.all_digits) == [True, False, False, False, False, None]


def test_rounding_rules(spark):
    values = [0.285, 1.005, 2.5, -2.5, 0.125]
    assert column(spark, values, lambda c: N.round_binary(c, 2), "double") == [0.28, 1.0, 2.5, -2.5, 0.13]
    assert column(spark, [0.5, 1.5, 2.5], lambda c: N.round_even(c, 0), "double") == [0.0, 2.0, 2.0]


def test_money_and_percent(spark):
    assert column(spark, ["1.234 €", "2.000.000€", "", " ", "x", None], N.clean_money) == [1234.0, 2000000.0, None, None, None, None]
    assert column(spark, ["5%", "3,5%", None], N.parse_percent) == pytest.approx([0.05, 0.035, None])


def test_bmi_bands(spark):
    df = spark.createDataFrame([(50.0, 1.70), (71.0, 1.70), (80.0, 1.70), (100.0, 1.70), (10.0, 1.7), (70.0, 3.0)], "w double, h double")
    rows = df.select(N.bmi(F.col("w"), F.col("h")).alias("b")).select("b", N.bmi_band(F.col("b")).alias("n")).collect()
    assert [r.n for r in rows] == ["Bajo peso", "Peso normal", "Sobrepeso", "Obesidad", None, None]
    edge = column(spark, [18.5, 24.9, 24.91, 29.9, 29.91], N.bmi_band, "double")
    assert edge == ["Peso normal", "Peso normal", "Sobrepeso", "Sobrepeso", "Obesidad"]


def test_temperatures(spark):
    got = column(spark, ["27,5 C", "40F", "300 k", "80 Re", "500 ra", "12 X", "C", "-40 f"], N.temperatures)
    assert got[0].asDict() == {"C": 27.5, "F": 81.5, "K": 300.6, "Ra": 541.2, "Re": 22.0}
    assert got[1]["C"] == 4.4 and got[2]["C"] == 26.9 and got[3]["C"] == 100.0 and got[4]["C"] == 4.6
    assert got[5] is None and got[6] is None and got[7]["C"] == -40.0


def test_dominant_problem(spark):
    df = spark.createDataFrame([(1.0, 0.5, 1.9), (10.0, 1.0, 20.0), (1.0, 10.0, 40.0), (5.0, 4.0, 10.0)], "e double, f double, p double")
    rows = [r.d for r in df.select(N.dominant_problem(F.col("e"), F.col("f"), F.col("p")).alias("d")).collect()]
    assert [r.kind for r in rows] == ["none", "empty", "full", "mixed"]
    assert [r.colour for r in rows] == ["#222222", "#ff0000", "#1414ff", "#f2d232"]
    assert rows[2].intensity == 1.0


def test_norm_of_flat_range(spark):
    assert column(spark, [3.0], lambda c: N.minmax_norm(c, F.lit(3.0), F.lit(3.0)), "double") == [0.5]


def test_completed_age_of_leap_day_birth(spark):
    births = [date(2000, 2, 29), date(2000, 2, 28), date(2000, 3, 1), None]
    assert column(spark, births, lambda c: dates.age_completed(c, date(2023, 2, 28)), "date") == [22, 23, 22, None]
    assert column(spark, births, lambda c: dates.age_completed(c, date(2023, 3, 1)), "date") == [23, 23, 23, None]


def test_impossible_dates_are_null(spark):
    df = spark.createDataFrame([(2023, 2, 29), (2024, 2, 29), (2024, 13, 1)], "y int, m int, d int")
    got = [r[0] for r in df.select(dates.make_date_or_null(F.col("y"), F.col("m"), F.col("d"))).collect()]
    assert got == [None, date(2024, 2, 29), None]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Europe/Madrid"])
def test_local_time_does_not_depend_on_the_session_zone(spark, zone):
    # 2024-03-31 01:00 UTC is where local clocks jump from 2 to 3; 2024-10-27 02:30 happens twice.
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        seconds = [1711846740, 1711846800, 1729989000, 1729992600]
        got = column(spark, seconds, lambda c: F.date_format(dates.epoch_to_local(c), "yyyy-MM-dd HH:mm"), "bigint")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == ["2024-03-31 01:59", "2024-03-31 03:00", "2024-10-27 02:30", "2024-10-27 02:30"]


def test_calendar_helpers(spark):
    days = [datetime(2024, 1, 1), datetime(2024, 12, 8), datetime(2024, 5, 29)]
    assert column(spark, days, dates.iso_weekday, "timestamp_ntz") == [1, 7, 3]
    assert column(spark, days, dates.week_of_month, "timestamp_ntz") == [1, 2, 5]
    assert column(spark, list(range(1, 13)), dates.season_number, "int") == [1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4, 1]
    assert column(spark, [12, 4], dates.season_name, "int") == ["Hivern", "Primavera"]


def test_words(spark):
    texts = ["The meter stopped. Nobody saw it; the log has 3 gaps.", "", "123 ... 4", "Niño niño, ÁRBOL"]
    assert column(spark, texts, X.mean_word_length) == pytest.approx([39 / 10, 0.0, 0.0, 13 / 3])
    assert column(spark, texts[3:], X.words) == [["niño", "niño", "árbol"]]


def test_list_items(spark):
    texts = ["1, 2, 2,3", "a,, b , ", "1,2,3,4,5,6,7"]
    assert column(spark, texts, X.list_items) == [["1", "2", "3"], ["a", "b"], list("1234567")]
    assert column(spark, texts, X.count_items) == [4, 4, 7]
    assert column(spark, texts, lambda c: X.nth_item(c, 2)) == ["2", "", "2"]


def test_float_strings(spark):
    texts = ["1d", "1f", "1_0", "1__0", " 7 ", ".5", "5.", "inf", "-Infinity", "", None]
    got = column(spark, texts, X.to_float_or_null)
    assert got == [None, None, 10.0, None, 7.0, 0.5, 5.0, float("inf"), float("-inf"), None, None]


def test_people_labels(spark):
    assert column(spark, ["H", "D", "A", "NC", "Z", None], P.gender_label) == ["Hombre", "Mujer", "Otros", None, "Z", None]
    df = spark.createDataFrame([(1.0, None), (None, 1.0), (None, None), (0.0, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(P.has_children(F.col("a"), F.col("b"))).collect()] == ["Si", "No", None, "No"]
