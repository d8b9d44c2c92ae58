"""Numeric column helpers: rounding rules, safe division, parsing, bands."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from slotwise.constants import (
    BMI_BANDS, DOMINANCE_FACTOR, FULL_INTENSITY_PCT, HEIGHT_RANGE, LOW_PROBLEM_COLOUR,
    LOW_PROBLEM_PCT, PROBLEM_RAMPS, WEIGHT_RANGE,
)


def round_binary(x: Column, digits: int) -> Column:
    """Round a double by scaling, half away from zero (0.285 -> 0.28, as the binary value is below the tie)."""
    m = float(10**digits)
    return F.when(x < 0, -(F.floor(-x * m + 0.5) / m)).otherwise(F.floor(x * m + 0.5) / m)


def round_even(x: Column, digits: int) -> Column:
    """Round a double by scaling, ties to even (dataframe-library rounding)."""
    m = float(10**digits)
    return F.rint(x * m) / m


def money(x: Column) -> Column:
    """Exact money type, so that sums do not depend on the order of rows."""
    return x.cast("decimal(18,2)")


def mean_money(x: Column) -> Column:
    """Mean of a decimal column to two places, computed in decimals and returned as double."""
    return F.round(F.avg(x), 2).cast("double")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division that yields NULL for a zero denominator."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def pct(numerator: Column, denominator: Column) -> Column:
    """``numerator`` in percent of ``denominator``, as the rounded report figure."""
    return round_binary(numerator.cast("double") * 100.0 / F.nullif(denominator.cast("double"), F.lit(0.0)), 2)


def clean_money(text: Column) -> Column:
    """``"1.234 €"`` -> 1234.0; blank or unparsable -> NULL."""
    bare = F.trim(F.regexp_replace(text, "[€.]", ""))
    return F.nullif(bare, F.lit("")).try_cast("double")


def parse_percent(text: Column) -> Column:
    """``"3,5%"`` -> 0.035."""
    return F.replace(F.replace(text, F.lit("%"), F.lit("")), F.lit(","), F.lit(".")).try_cast("double") / 100.0


def minmax_norm(x: Column, low: Column, high: Column) -> Column:
    """Position of ``x`` between ``low`` and ``high``; 0.5 when the range is flat."""
    return F.when(high > low, (x - low) / (high - low)).when(x.isNotNull(), F.lit(0.5))


def sqrt_radius(norm: Column, base: float = 3.0, span: float = 5.0) -> Column:
    """Marker radius whose area grows with the normalised value."""
    return F.lit(base) + F.lit(span) * F.sqrt(norm)


def bmi(weight: Column, height: Column) -> Column:
    """Body-mass index to two places; NULL outside the accepted input ranges."""
    valid = weight.between(*WEIGHT_RANGE) & height.between(*HEIGHT_RANGE)
    return F.when(valid, round_even(weight / (height * height), 2))


def bmi_band(index: Column) -> Column:
    """Name of the band; the lowest band is open above, the others closed."""
    (low, low_name), *middle, (_, last_name) = BMI_BANDS
    band = F.when(index.isNull(), None).when(index < low, low_name)
    for upper, name in middle:
        band = band.when(index <= upper, name)
    return band.otherwise(last_name)


def temperatures(text: Column) -> Column:
    """Parse ``"27,5 C"`` and convert to a struct of C, F, K, Ra and Re.

    The Celsius value is rounded to one decimal before the others are derived.
    NULL when the number or the unit is not recognised.
    """
    number = F.regexp_replace(F.regexp_extract(text, r"^\s*([+-]?[0-9]*[.,]?[0-9]*)\s*[A-Za-z]", 1), ",", ".").try_cast("double")
    unit = F.lower(F.trim(F.regexp_extract(text, r"([A-Za-z].*)$", 1)))
    celsius = round_even(
        F.when(unit == "c", number)
        .when(unit == "f", (number - 32.0) * 5.0 / 9.0)
        .when(unit == "k", number - 273.15)
        .when(unit == "ra", number * 5.0 / 9.0 - 273.15)
        .when(unit == "re", number * 5.0 / 4.0),
        1,
    )
    return F.when(
        celsius.isNotNull(),
        F.struct(
            celsius.alias("C"),
            round_even(celsius * 9.0 / 5.0 + 32.0, 1).alias("F"),
            round_even(celsius + 273.15, 1).alias("K"),
            round_even((celsius + 273.15) * 9.0 / 5.0, 1).alias("Ra"),
            round_even(celsius * 4.0 / 5.0, 1).alias("Re"),
        ),
    )


def dominant_problem(pct_empty: Column, pct_full: Column, pct_problem: Column) -> Column:
    """Struct of kind (none/empty/full/mixed), intensity 0..1 and hex colour for a map marker."""
    intensity = F.least(pct_problem / float(FULL_INTENSITY_PCT), F.lit(1.0))
    kind = (
        F.when(pct_problem < LOW_PROBLEM_PCT, "none")
        .when(pct_empty > pct_full * DOMINANCE_FACTOR, "empty")
        .when(pct_full > pct_empty * DOMINANCE_FACTOR, "full")
        .otherwise("mixed")
    )
    colour = F.when(kind == "none", LOW_PROBLEM_COLOUR)
    for name, channels in PROBLEM_RAMPS.items():
        levels = [F.floor(F.lit(float(base)) + F.lit(float(change)) * intensity) for base, change in channels]
        colour = colour.when(kind == name, F.format_string("#%02x%02x%02x", *levels))
    return F.struct(kind.alias("kind"), intensity.alias("intensity"), colour.alias("colour"))
