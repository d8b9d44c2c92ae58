"""The physical plans: scans are pruned and filtered, nothing is paired without a key."""

import re

import pytest

from slotwise.plans import QUERIES


def plan_of(df, mode="simple"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


KEYED = [
    "ts_gap_fill", "ts_trips", "ts_avail_hour", "ft_join", "bl_eval_table", "rf_features_train", "join_cross",
    "join_cross_scalar", "q_companies_above_avg", "q_same_country_subquery", "geo_within_left_join",
    "arr_bridge_table", "dq_impute_median", "st_kde", "fn_minmax_norm", "ml_zscore",
]


@pytest.mark.parametrize("name", KEYED)
def test_no_pairing_without_a_key(spark, sf, name):
    plan = plan_of(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_reach_the_scan(spark, sf):
    plan = plan_of(QUERIES["flt_isin_notin"](spark, sf), "formatted")
    assert "In(o_orderstatus, [F,O])" in plan and "Not(In(o_orderpriority" in plan


def test_only_needed_columns_are_read(spark, sf):
    plan = plan_of(QUERIES["ts_avail_hour"](spark, sf), "formatted")
    schemas = set(re.findall(r"ReadSchema: struct<([^>]*)>", plan))
    assert schemas and not any("props" in s for s in schemas)
    lines = plan_of(QUERIES["agg_filter_avg_std"](spark, sf), "formatted")
    assert re.search(r"ReadSchema: struct<l_quantity:double,l_returnflag:string,l_linestatus:string>", lines)


def test_copies_of_a_reading_are_reduced_before_the_shuffle(spark, sf):
    plan = plan_of(QUERIES["ts_clean"](spark, sf))
    assert plan.index("Exchange hashpartitioning(station_id") < plan.index("partial_max_by")


def test_grid_is_dealt_out_by_station_and_day(spark, sf):
    assert "REPARTITION_BY_NUM" in plan_of(QUERIES["ts_gap_fill"](spark, sf))


def test_one_lag_replaces_the_weekly_self_join(spark, sf):
    from slotwise.operators import baselines as B, timeseries as TS
    from slotwise.plans import roles as R

    grid = R.grid(spark, sf)
    joins = lambda df: plan_of(df).count("Join")
    assert joins(B.seasonal_naive(grid)) == joins(grid)


def raw_exchanges(plan, keys):
    """Exchanges on exactly these keys that don't stand on a partial aggregate; the written ranks of quantiles, some rows per group, don't count."""
    lines = plan.splitlines()
    found = []
    for i, line in enumerate(lines):
        if re.search(rf"Exchange hashpartitioning\({keys}, \d+\)", line) and "Aggregate" not in lines[i + 1] + (lines[i + 2] if "Sort" in lines[i + 1] else ""):
            scan = next((x for x in lines[i:] if "FileScan" in x), "")
            if "_name:string" not in scan:
                found.append(line)
    return found


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name,keys", [
    ("st_describe", r"column#\d+"), ("dq_impute_median", r"column#\d+"), ("st_box", r"\w+#\d+"),
    ("agg_median", r"\w+#\d+"), ("ts_enrich", r"station_id#\d+L?"), ("win_lag2_lag3", r"station_id#\d+L?"),
])
def test_no_raw_rows_are_dealt_by_a_hot_key(spark, sf, no_broadcast, name, keys):
    plan = plan_of(QUERIES[name](spark, sf))
    allowed = 1 if name == "win_lag2_lag3" else 0  # the last three rows of each month, for the carry-over
    assert len(raw_exchanges(plan, keys)) <= allowed, raw_exchanges(plan, keys)
