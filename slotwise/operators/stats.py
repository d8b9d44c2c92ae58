"""Descriptive statistics behind the usual plots, as tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, functions as F, types as T

from slotwise.operators.grouping import salted_join, value_counts
from slotwise.operators.quantiles import exact_quantiles
from slotwise.operators.ranking import numbered
from slotwise.operators.sampling import smallest_draws

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum, one row per column."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns
    ])).alias("e")).select("e.*").where(F.col("v").isNotNull())
    plain = long.groupBy("column").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"),
        F.min("v").alias("min"), F.max("v").alias("max"),
    )
    return plain.join(exact_quantiles(long, ["column"], "v", QUARTILES), "column")


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Equal-width bins over the observed range; the last bin is closed. Empty bins are kept."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    low, high = values.agg(F.min("v")).scalar(), values.agg(F.max("v")).scalar()
    width = (high - low) / bins
    index = F.when(high > low, F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = values.groupBy(index.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return edges.join(counts, "bin", "left").select(
        "bin", (low + F.col("bin") * width).alias("left_edge"), F.coalesce("n", F.lit(0)).alias("n")
    )


def density(df: DataFrame, column: str, points: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density on an even grid, Scott bandwidth.

    Equal values are counted first; one aggregation then has a sum for each grid point, so no row is multiplied.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("w")
    )
    shape = df.agg(
        (F.stddev_samp(column) * F.pow(F.count(column), F.lit(-0.2))).alias("h"),
        F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"),
        F.count(column).alias("n"),
    )
    h, lo, hi, n = (shape.select(c).scalar() for c in ("h", "lo", "hi", "n"))
    start, step = lo - cut * h, (hi - lo + 2 * cut * h) / (points - 1)
    z = lambda i: (F.col("start") + i * F.col("step") - F.col("v")) / F.col("h")
    kernels = counts.withColumns({"h": h, "start": start, "step": step}).agg(
        *[F.sum(F.col("w") * F.exp(-0.5 * z(i) * z(i))).alias(f"s{i}") for i in range(points)]
    )
    grid = F.posexplode(F.array(*[f"s{i}" for i in range(points)])).alias("i", "s")
    sums = kernels.select(grid).where(F.col("s").isNotNull())
    scale = n * h * F.sqrt(F.lit(2.0) * F.pi())
    return sums.select("i", (start + F.col("i") * step).alias("x"), (F.col("s") / scale).alias("density"))


def box_stats(df: DataFrame, category: str, value: str, top: int | None = None) -> DataFrame:
    """Quartiles, whisker ends (last value within 1.5 IQR) and outlier count per category.

    ``top`` keeps the most frequent categories, name as tie-break.
    """
    rows = df.select(category, F.col(value).cast("double").alias("v")).na.drop()
    if top:
        rows = salted_join(rows, value_counts(rows, category, top).select(category), [category])
    quartiles = exact_quantiles(rows, [category], "v", QUARTILES)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("v").between(F.col("q1") - reach, F.col("q3") + reach)
    return salted_join(rows, quartiles, [category]).groupBy(category, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("v"))).alias("low_whisker"),
        F.max(F.when(inside, F.col("v"))).alias("high_whisker"),
        F.count(F.when(~inside, 1)).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"),
    )


def outliers(df: DataFrame, category: str, value: str) -> DataFrame:
    """The rows beyond 1.5 IQR of their category."""
    rows = df.where(F.col(category).isNotNull() & F.col(value).isNotNull())
    quartiles = exact_quantiles(rows, [category], value, {"q1": 0.25, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return salted_join(rows, quartiles, [category]).where(
        ~F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    ).drop("q1", "q3")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson matrix as long rows, over the rows complete in all columns, in one pass."""
    complete = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    pairs = list(combinations_with_replacement(columns, 2))
    one = complete.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    entries = F.array(*[
        F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"{i}").alias("r"))
        for i, (a, b) in enumerate(pairs) for x, y in dict.fromkeys([(a, b), (b, a)])
    ])
    return one.select(F.explode(entries).alias("e")).select("e.*")


def regression(df: DataFrame, y: str, x: str) -> DataFrame:
    """Least-squares line of a joint view with its correlation and number of pairs."""
    yv, xv = F.col(y).cast("double"), F.col(x).cast("double")
    return df.agg(
        F.regr_slope(yv, xv).alias("slope"), F.regr_intercept(yv, xv).alias("intercept"),
        F.corr(yv, xv).alias("r"), F.regr_count(yv, xv).alias("n"),
    )


def scatter_points(
    df: DataFrame, x: str, y: str, hue: str | None = None, keys: Sequence[str] = (), per_hue: int | None = None, seed: int = 42
) -> DataFrame:
    """Complete pairs for a scatter plot; with ``per_hue`` a sample of so many rows of each hue, drawn by ``keys``."""
    points = df.na.drop(subset=[x, y])
    if per_hue is not None:
        points = smallest_draws(points, keys, [hue] if hue else [], per_hue, seed)
    return points.select(x, y, *([hue] if hue else []))


def category_codes(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the alphabetical position of the category (from 0); a missing category gets -1.

    Only distinct categories are ranked, by ranges of the alphabet, so no task sees the whole list.
    """
    distinct = df.where(F.col(column).isNotNull()).select(column).distinct()
    place = numbered(distinct, [F.col(column)], [], name, "category-codes").select(column, (F.col(name) - 1).cast("int").alias(name))
    return df.join(place, column, "left").withColumn(name, F.coalesce(name, F.lit(-1)))


def class_distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows and share of each class, in percent."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", 100.0 * F.col("n") / counts.agg(F.sum("n")).scalar())


def auto_profile(df: DataFrame, bins: int = 10) -> DataFrame:
    """A summary per column by type: numbers as histogram, dates per year, text by value.

    Long rows ``column, kind, bucket, n``; columns of other types are left out.
    """
    parts = []
    for field in df.schema.fields:
        name, kind = field.name, field.dataType
        if isinstance(kind, T.NumericType):
            part = histogram(df, name, bins).select(
                F.lit("histogram").alias("kind"), F.col("bin").cast("string").alias("bucket"), "n"
            )
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            years = df.where(F.col(name).isNotNull()).groupBy(F.year(name).alias("y")).agg(F.count(F.lit(1)).alias("n"))
            part = years.select(F.lit("years").alias("kind"), F.col("y").cast("string").alias("bucket"), "n")
        elif isinstance(kind, T.StringType):
            counts = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
            part = counts.select(F.lit("values").alias("kind"), F.col(name).alias("bucket"), "n")
        else:
            continue
        parts.append(part.withColumn("column", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)
