"""The chain of station tables, each written once to a shared folder.

Later stages start from files, not from the lineage of all earlier ones, so a
lost executor costs at most the stage it worked on, and the dense grid, which
most reports read, is computed a single time.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, functions as F

from slotwise.operators import baselines, features, ml, timeseries as ts
from slotwise.sources.writers import write_table


def station_tables(
    raw: DataFrame, stations: DataFrame, folder: str, train_end: date, test_start: date, test_end: date,
    history_keys: Sequence[str] = baselines.HISTORY_KEYS,
) -> dict[str, DataFrame]:
    """Readings, trips, half-hour slots, grid, features, clusters, history, evaluation and the model's tables.

    The grid is partitioned by year, the column its consumers filter on.
    """
    tables: dict[str, DataFrame] = {}

    def keep(name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        tables[name] = write_table(df, f"{folder}/{name}", partition_by)
        return tables[name]

    readings = keep("readings", ts.clean(raw))
    keep("trips", ts.trips(ts.with_delta(readings), stations))
    slots = keep("slots", ts.half_hour_slots(ts.enrich(readings, stations)))
    dense = ts.dense_grid(slots, stations, *ts.calendar_bounds(raw))
    grid = keep("grid", dense.withColumn("year", F.year("day")), ["year"])
    training = grid.where((F.col("year") <= train_end.year) & (F.col("day") <= train_end))
    behaviour = keep("features", features.station_features(training))
    grouped, _ = ml.cluster_rows(behaviour, features.feature_columns(behaviour), order_by="mean_capacity")
    clusters = keep("clusters", grouped.select("station_id", "cluster"))
    profile = features.slot_profile(training)
    keep("model_train", features.model_table(grid, profile, clusters, F.col("day") <= train_end))
    keep("model_test", features.model_table(grid, profile, clusters, F.col("day").between(test_start, test_end)))
    history = keep("history", baselines.historical_mode(training, history_keys))
    keep("evaluation", baselines.evaluation_table(grid, history, test_start, test_end, history_keys))
    return tables
