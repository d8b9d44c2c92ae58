"""Exact quantiles by repeated refinement of histograms, without gathering or ordering a group.

Every wanted rank has a bracket, at first the group's smallest and largest value. A round cuts each open
bracket into ``CELLS`` cells of equal width, counts the rows and the ends of the values in each cell with one
aggregation, and goes on with the cell that holds the rank; its ends are the next bracket. A bracket
is done when it holds one value. The two ends of a bracket never share a cell, so every round gets closer;
some three rounds do for a billion evenly spread values.

Nothing of a group is kept but its cells: at most ``CELLS`` rows for each of its brackets, summed in the map tasks
before they are shuffled. Raw values meet the brackets on (group, salt), so a hot group is never one task.
Infinite values and NaN (the largest) fall into cells of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from slotwise.operators.grouping import drop_null_keys, salted_join
from slotwise.operators.ranking import kept

CELLS = 4_096
INFINITE = float("inf")


def _cell(v: Column, low: Column, high: Column, cells: int) -> Column:
    """Number of the cell of ``low`` < ``high`` that holds ``v``; never falls as ``v`` rises."""
    finite = ~F.isnan(high) & (high < INFINITE) & (low > -INFINITE)
    kind = F.when(F.isnan(v), 3).when(v == INFINITE, 2).when(v == -INFINITE, 0).otherwise(1)
    share = F.when(high - low < INFINITE, (v - low) / (high - low)).otherwise((v / 2 - low / 2) / (high / 2 - low / 2))
    return F.when(finite, F.least(F.floor(share * cells), F.lit(cells - 1))).otherwise(kind).cast("int")


def _holding(rank: Column, cells: Column) -> Column:
    """The cell that holds a rank: ``cells`` are (cell, rows, low, high) in order; gives (before, low, high)."""
    start = F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))

    def step(found: Column, cell: Column) -> Column:
        here = F.struct(found["before"].alias("before"), cell["low"].alias("low"), cell["high"].alias("high"))
        later = F.struct((found["before"] + cell["rows"]).alias("before"), found["low"].alias("low"), found["high"].alias("high"))
        return F.when(found["low"].isNotNull(), found).when(rank < found["before"] + cell["rows"], here).otherwise(later)

    return F.aggregate(cells, start, step)


def refined(rows: DataFrame, group: Sequence[str], targets: DataFrame, cells: int = CELLS) -> DataFrame:
    """One round: ``rows`` has the group and _v, ``targets`` the group, _rank (inside the bracket), _low and _high."""
    brackets = targets.where("_low < _high").select(*group, "_low", "_high").distinct()
    v = F.col("_v")
    counts = salted_join(rows, brackets, group).where(v.between(F.col("_low"), F.col("_high")))
    counts = counts.groupBy(*group, "_low", "_high", _cell(v, F.col("_low"), F.col("_high"), cells).alias("cell")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("_v").alias("low"), F.max("_v").alias("high")
    )
    lists = counts.groupBy(*group, "_low", "_high").agg(F.array_sort(F.collect_list(F.struct("cell", "rows", "low", "high"))).alias("_cells"))
    joined = targets.join(lists, [*group, "_low", "_high"], "left").withColumn("_found", _holding(F.col("_rank"), F.col("_cells")))
    moved = F.col("_cells").isNotNull()
    return joined.withColumns({
        "_rank": F.when(moved, F.col("_rank") - F.col("_found.before")).otherwise(F.col("_rank")),
        "_low": F.when(moved, F.col("_found.low")).otherwise(F.col("_low")),
        "_high": F.when(moved, F.col("_found.high")).otherwise(F.col("_high")),
    }).drop("_cells", "_found")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], cells: int = CELLS) -> DataFrame:
    """Linearly interpolated quantiles of the non-null values: one column per entry of ``probs``.

    Groups with a null key are left out, groups without a value have no row. The table is read once for the
    bounds and once per round.
    """
    group = list(keys) or ["_all"]
    base = drop_null_keys(df, keys) if keys else df.withColumn("_all", F.lit(0))
    rows = base.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v"))

    bounds = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_total"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    position = {name: F.lit(float(p)) * (F.col("_total") - 1) for name, p in probs.items()}
    wanted = [
        F.struct(F.lit(f"{name} {edge}").alias("_name"), f(position[name]).cast("long").alias("_rank"))
        for name in probs for edge, f in (("low", F.floor), ("high", F.ceil))
    ]
    targets = kept(bounds.select(*group, "_total", "_low", "_high", F.inline(F.array(*wanted))), "quantiles")
    while not targets.where("_low < _high").isEmpty():
        targets = kept(refined(rows, group, targets, cells), "quantiles")

    at = lambda name, edge: F.max(F.when(F.col("_name") == f"{name} {edge}", F.col("_low"))).alias(f"_{edge}_{name}")
    found = targets.groupBy(*group, "_total").agg(*[at(name, edge) for name in probs for edge in ("low", "high")])
    columns = []
    for name in probs:
        low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        share = position[name] - F.floor(position[name])
        columns.append(F.when(low == high, low).otherwise(low + (high - low) * share).alias(name))
    return found.select(*keys, *columns)
