"""Queries of the station pipeline: readings, trips, grid, availability, features, baselines, metrics."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from slotwise.constants import STATE_COLOUR, WEEKDAYS
from slotwise.functions import dates
from slotwise.operators import baselines as B, evaluation as E, features as FT, ml, quality as Q, timeseries as TS
from slotwise.operators.ranking import kept
from slotwise.plans import daily, roles as R
from slotwise.plans.registry import query, rounded, with_double, with_text
from slotwise.plans.tables import station_tables
from slotwise.plans.tabular import _case_sql
from slotwise.session import shared_folder
from slotwise.sources.readers import table_sizes

STATION, GRID = R.STATION, R.GRID
TRIPS_SQL = STATION + """, trips as (select station_id, day, year, month, day_of_month, weekday, hour, lat, lon, district_id, district,
 sum(case when delta_bikes < 0 then -delta_bikes else 0 end)::bigint as trips from enriched group by all)
"""


# ---------------------------------------------------------------- readings and trips
@query("ts_clean", STATION + "select * from clean")
def _(s, sf):
    return R.cleaned(s, sf)


@query("dq_dedup_latest", STATION + "select c.station_id, c.last_reported, c.bikes, c.docks from clean c")
def _(s, sf):
    return R.cleaned(s, sf).select("station_id", "last_reported", "bikes", "docks")


@query("ts_delta", STATION + "select station_id, last_reported, bikes, docks, prev_reported::double as prev_reported, delta_bikes::double as delta_bikes from delta")
def _(s, sf):
    rows = TS.with_delta(R.cleaned(s, sf)).drop("seconds_since_prev", "prev_bikes")
    return with_double(rows, "prev_reported", "delta_bikes")


@query("ts_enrich", STATION + """select station_id, last_reported, strftime(ts_local, '%Y-%m-%d %H:%M:%S') as ts_local, day::varchar as day, year::int as year, month::int as month,
 day_of_month::int as day_of_month, weekday::int as weekday, hour::int as hour, minute::int as minute, second::int as second, 1 as season, 'Hivern' as season_name, lat, lon, district from enriched""")
def _(s, sf):
    rows = R.enriched(s, sf).withColumn("ts_local", F.date_format("ts_local", "yyyy-MM-dd HH:mm:ss"))
    return with_text(rows, "day").select(
        "station_id", "last_reported", "ts_local", "day", "year", "month", "day_of_month", "weekday", "hour", "minute",
        "second", "season", "season_name", "lat", "lon", "district")


def trips(s, sf) -> DataFrame:
    return R.trips(s, sf)


@query("ts_trips", TRIPS_SQL + "select station_id, day::varchar as day, hour::int as hour, district, trips from trips")
def _(s, sf):
    return with_text(trips(s, sf), "day").select("station_id", "day", "hour", "district", "trips")


@query("ts_trips_month", TRIPS_SQL + "select year::int as year, month::int as month, sum(trips)::bigint as trips from trips where year >= 2022 group by all")
def _(s, sf):
    return TS.trip_totals(trips(s, sf), ["year", "month"])


@query("ts_trips_month_station", TRIPS_SQL + "select station_id, year::int as year, month::int as month, sum(trips)::bigint as trips from trips where year >= 2022 group by all")
def _(s, sf):
    return TS.trip_totals(trips(s, sf), ["station_id", "year", "month"])


@query("ts_trips_month_station_avg", TRIPS_SQL + """select v.station_id, m as mean_monthly_trips, lat, lon, district_id, district from
 (select station_id, avg(t) as m from (select station_id, year, month, sum(trips) as t from trips group by all) group by 1) v join stations using (station_id)""")
def _(s, sf):
    return TS.mean_monthly_trips(trips(s, sf), R.stations(s, sf))


@query("ts_trips_day", TRIPS_SQL + "select day::varchar as day, sum(trips)::bigint as trips from trips group by 1")
def _(s, sf):
    return with_text(TS.trip_totals(trips(s, sf), ["day"], from_year=None), "day")


PROFILE_SQL = TRIPS_SQL + "select weekday::int as weekday, hour::int as hour, round(avg(t), 6) as mean_trips from (select day, weekday, hour, sum(trips) as t from trips where year between 2022 and 2025 group by all) group by 1, 2"


@query("ts_hour_weekday_avg", PROFILE_SQL)
def _(s, sf):
    return rounded(TS.weekday_hour_profile(trips(s, sf)), "mean_trips")


@query("ts_stations", STATION + "select * from stations")
def _(s, sf):
    return R.stations(s, sf)


@query("ts_timeline", TRIPS_SQL + """, m as (select year::int as year, month::int as month, sum(trips)::bigint as trips from trips where year >= 2020 group by all)
 select year, month, printf('%04d-%02d-01', year, month) as month_start, trips, (year, month) = (select arg_min((year, month), (trips, year, month)) from m) as is_min,
 (year, month) = (select arg_min((year, month), (-trips, year, month)) from m) as is_max from m""")
def _(s, sf):
    return with_text(TS.trip_timeline(trips(s, sf)), "month_start")


# ---------------------------------------------------------------- grid
@query("ts_half_hour", GRID + "select station_id, day::varchar as day, hour::int as hour, half, min_bikes, max_bikes, avg_bikes, min_docks, max_docks, avg_docks, avg_capacity from slots")
def _(s, sf):
    return with_text(TS.half_hour_slots(R.located(s, sf)), "day")


@query("ts_calendar", GRID + "select day::varchar as day, hour::int as hour, half from calendar")
def _(s, sf):
    first, last = R.bounds(s, sf)
    one = s.range(1).select()
    return with_text(TS.with_slots(one, first, last), "day")


GRID_DOUBLES = ["min_bikes", "max_bikes", "avg_bikes", "min_docks", "max_docks", "avg_docks", "avg_capacity"]


@query("ts_gap_fill", GRID + "select station_id, lat, lon, district_id, district, day::varchar as day, hour::int as hour, half, state, "
       + ", ".join(f"{c}::double as {c}" for c in GRID_DOUBLES) + " from grid")
def _(s, sf):
    return with_text(with_double(R.grid(s, sf), *GRID_DOUBLES), "day")


@query("join_cross", GRID + "select station_id, district, day::varchar as day, hour::int as hour, half from stations cross join calendar")
def _(s, sf):
    return with_text(TS.with_slots(R.stations(s, sf).select("station_id", "district"), *R.bounds(s, sf)), "day")


MEASURED = "count(*) filter (where state != 'sense_mesures')"
SHARES_SQL = f"""{MEASURED} as measured_slots,
 round(count(*) filter (where state = 'buida') * 100.0::double / nullif({MEASURED}, 0), 2) as pct_empty,
 round(count(*) filter (where state = 'plena') * 100.0::double / nullif({MEASURED}, 0), 2) as pct_full,
 round(count(*) filter (where state in ('buida', 'plena', 'extremes')) * 100.0::double / nullif({MEASURED}, 0), 2) as pct_problem,
 round(count(*) filter (where state = 'sense_mesures') * 100.0::double / count(*), 2) as pct_unmeasured,
 round(avg(avg_capacity), 1) as mean_capacity"""
AVAILABILITY_SQL = {
    "year": "year(day)::int as year",
    "month": "year(day)::int as year, month(day)::int as month",
    "hour": "hour::int as hour",
    "hour_year": "year(day)::int as year, hour::int as hour",
    "dow_hour": "isodow(day)::int as weekday, hour::int as hour",
    "district": "district",
    "station": "station_id, district, lat, lon",
}


def _availability(kind: str):
    def run(s, sf):
        return TS.availability(R.grid(s, sf), TS.AVAILABILITY_KEYS[kind]())
    return run


for _kind, _keys in AVAILABILITY_SQL.items():
    _sql = GRID + f"select {_keys}, {SHARES_SQL} from grid group by all"
    query(f"ts_avail_{_kind}", _sql)(_availability(_kind))
    query(f"q_availability_{_kind}", _sql)(_availability(_kind))

WEEK = date(2024, 1, 8)
WEEK_SQL = f"select station_id, isodow(day)::int as weekday, hour::int as hour, half, state from grid where day >= date '{WEEK}' and day < date '{WEEK}' + 7"


@query("ts_week_extract", GRID + WEEK_SQL)
def _(s, sf):
    return TS.week_states(R.grid(s, sf), F.lit(WEEK))


@query("rsh_frames", GRID + f", week as ({WEEK_SQL}) select weekday, hour, half, {_case_sql('weekday', WEEKDAYS)} || printf(' %02d:%02d', hour, half * 30) as label,"
       " count(*) filter (where state = 'buida') over slot as n_empty, count(*) filter (where state = 'plena') over slot as n_full, station_id,"
       " coalesce(case state " + " ".join(f"when '{k}' then '{v}'" for k, v in STATE_COLOUR.items()) + " end, '#333333') as colour from week window slot as (partition by weekday, hour, half)")
def _(s, sf):
    return TS.animation_frames(TS.week_states(R.grid(s, sf), F.lit(WEEK)))


# ---------------------------------------------------------------- features
NAB_SQL = "avg_bikes / nullif(avg_capacity, 0)"
FEATURES_SQL = GRID + f""", prof as (
  select station_id, hour, half, avg({NAB_SQL}) filter (where isodow(day) <= 5) as lab, avg({NAB_SQL}) filter (where isodow(day) >= 6) as fest
  from grid group by all),
base as (
  select *, {NAB_SQL} as nab, isodow(day) <= 5 and hour between 7 and 9 as am, isodow(day) <= 5 and hour between 17 and 19 as pm from grid)
"""
BANDS = [("lab", a, a + 2) for a in range(6, 24, 2)] + [("fest", a, min(a + 4, 24)) for a in range(6, 24, 4)]
NAB_COLUMNS = [f"nab_{k}_h{a:02d}_{b % 24:02d}" for k, a, b in BANDS]
NAB_SELECT = ", ".join(f"round(avg({k}) filter (where hour >= {a} and hour < {b}), 10) as {n}" for (k, a, b), n in zip(BANDS, NAB_COLUMNS))
VAR_COLUMNS = {
    "sd_nab": "stddev_samp(nab)", "mean_nab": "avg(nab)",
    "sd_nab_morning": "stddev_samp(nab) filter (where am)", "sd_nab_evening": "stddev_samp(nab) filter (where pm)",
    "mean_bike_range": "avg((max_bikes - min_bikes) / nullif(avg_capacity, 0))",
    "mean_dock_range": "avg((max_docks - min_docks) / nullif(avg_capacity, 0))",
    "share_empty": "count(*) filter (where state = 'buida')::double / count(*)",
    "share_full": "count(*) filter (where state = 'plena')::double / count(*)",
    "share_extremes": "count(*) filter (where state = 'extremes')::double / count(*)",
    "share_empty_peak": "count(*) filter (where state = 'buida' and (am or pm))::double / nullif(count(*) filter (where am or pm), 0)",
    "share_full_peak": "count(*) filter (where state = 'plena' and (am or pm))::double / nullif(count(*) filter (where am or pm), 0)",
    "mean_nab_morning": "avg(nab) filter (where am)", "mean_nab_evening": "avg(nab) filter (where pm)",
}
VAR_SELECT = ", ".join(f"round({e}, 10) as {c}" for c, e in VAR_COLUMNS.items())


def train_years(s, sf) -> DataFrame:
    return FT.years(R.grid(s, sf), 2022, 2024)


@query("ft_structure", GRID + "select station_id, lat, lon, district, round(avg(avg_capacity), 10) as mean_capacity from grid where year(day) between 2022 and 2024 group by all")
def _(s, sf):
    return rounded(FT.structure(train_years(s, sf)), "mean_capacity", digits=10)


@query("ft_nab_profile", FEATURES_SQL + f"select station_id, {NAB_SELECT} from prof group by 1")
def _(s, sf):
    return rounded(FT.fill_profile(train_years(s, sf)), *NAB_COLUMNS, digits=10)


@query("ft_variability", FEATURES_SQL + f"select station_id, {VAR_SELECT} from base group by 1")
def _(s, sf):
    return rounded(FT.variability(train_years(s, sf)), *VAR_COLUMNS, digits=10)


@query("ft_join", FEATURES_SQL + f""", a as (select station_id, lat, lon, district, round(avg(avg_capacity), 10) as mean_capacity from grid group by all),
 b as (select station_id, {NAB_SELECT} from prof group by 1), c as (select station_id, {VAR_SELECT} from base group by 1)
 select a.*, b.* exclude (station_id), c.* exclude (station_id) from a left join b using (station_id) left join c using (station_id)""")
def _(s, sf):
    features = FT.station_features(train_years(s, sf))
    return rounded(features, *FT.feature_columns(features), digits=10)


# ---------------------------------------------------------------- baselines
MODELLED = "state in ('buida', 'plena', 'normal')"
SN7_SQL = GRID + f""", test as (select * from grid where day >= date '{R.TEST_START}'),
sn7 as (select t.station_id, t.day, t.hour, t.half, p.state as sn7_pred from test t left join grid p
   on p.station_id = t.station_id and p.day = t.day - 7 and p.hour = t.hour and p.half = t.half)
"""
HA_SQL = f""", ha as (select station_id, weekday, hour, half, arg_min(state, (-n, state)) as ha_pred from (
   select station_id, isodow(day) as weekday, hour, half, state, count(*) as n from grid where day <= date '{R.TRAIN_END}' and {MODELLED} group by all) group by all)
"""
EVAL_SQL = SN7_SQL + HA_SQL + f""", ev as (
  select t.station_id, t.district, t.day, t.hour, t.half, case when isodow(t.day) = 6 then 'fest' else 'lab' end as day_type, t.state as real, sn7_pred, ha_pred
  from test t left join sn7 using (station_id, day, hour, half)
  left join ha on ha.station_id = t.station_id and ha.weekday = isodow(t.day) and ha.hour = t.hour and ha.half = t.half
  where {MODELLED})
"""
PREDICTIONS = {"sn7": "sn7_pred", "ha": "ha_pred"}


def train_rows(s, sf) -> DataFrame:
    return R.grid(s, sf).where(F.col("day") <= R.TRAIN_END)


@query("bl_historical_mode", GRID + """select station_id, month::int as month, week_of_month, weekday::int as weekday, hour::int as hour, half, arg_min(state, (-n, state)) as ha_pred from (
 select station_id, month(day) as month, ceil(day(day) / 7.0)::int as week_of_month, isodow(day) as weekday, hour, half, state, count(*) as n from grid
 where state in ('buida', 'plena', 'normal') group by all) group by all""")
def _(s, sf):
    return B.historical_mode(R.grid(s, sf))


@query("bl_historical_mode_weekday", GRID + HA_SQL + "select station_id, weekday::int as weekday, hour::int as hour, half, ha_pred from ha")
def _(s, sf):
    return B.historical_mode(train_rows(s, sf), R.SHORT_HISTORY_KEYS)


SN7_OUT = "select station_id, day::varchar as day, hour::int as hour, half, sn7_pred from sn7"


def _sn7(s, sf) -> DataFrame:
    rows = B.seasonal_naive_for(R.grid(s, sf), R.TEST_START, R.TEST_END)
    return with_text(rows, "day").select("station_id", "day", "hour", "half", "sn7_pred")


query("bl_seasonal_naive", SN7_SQL + SN7_OUT)(_sn7)


@query("win_seasonal_lag", GRID + "select station_id, day::varchar as day, hour::int as hour, half, lag(state, 336) over (partition by station_id order by day, hour, half) as sn7_pred from grid")
def _(s, sf):
    return with_text(B.seasonal_naive(R.grid(s, sf)), "day").select("station_id", "day", "hour", "half", "sn7_pred")


@query("join_self_shift7", GRID + """select t.station_id, t.day::varchar as day, t.hour::int as hour, t.half, p.avg_bikes from grid t left join grid p
 on p.station_id = t.station_id and p.day = t.day - 7 and p.hour = t.hour and p.half = t.half""")
def _(s, sf):
    grid = R.grid(s, sf).select(*TS.SLOT, "avg_bikes")
    earlier = grid.withColumn("day", F.date_add("day", 7))
    joined = grid.drop("avg_bikes").join(earlier, TS.SLOT, "left")
    return with_text(joined, "day")


def evaluation(s, sf) -> DataFrame:
    grid = R.grid(s, sf)
    history = B.historical_mode(grid.where(F.col("day") <= R.TRAIN_END), R.SHORT_HISTORY_KEYS)
    return B.evaluation_table(grid, history, R.TEST_START, R.TEST_END, R.SHORT_HISTORY_KEYS)


@query("bl_eval_table", EVAL_SQL + "select station_id, district, day::varchar as day, hour::int as hour, half, day_type, real, sn7_pred, ha_pred from ev")
def _(s, sf):
    return with_text(evaluation(s, sf), "day").drop("lat", "lon", "district_id")


PAIRS_SQL = EVAL_SQL + """, pairs as (select 'sn7' as model, real, sn7_pred as predicted, hour from ev where sn7_pred is not null
  union all select 'ha', real, ha_pred, hour from ev where ha_pred is not null),
cm as (select model, real, predicted, count(*) as n from pairs group by all),
met as (select m.model, l.label, coalesce((select sum(n) from cm where cm.model = m.model and real = l.label and predicted = l.label), 0)::bigint as tp,
   coalesce((select sum(n) from cm where cm.model = m.model and predicted = l.label), 0)::bigint as n_pred,
   coalesce((select sum(n) from cm where cm.model = m.model and real = l.label), 0)::bigint as n_real
  from (values ('sn7'), ('ha')) m(model) cross join (values ('buida'), ('plena'), ('normal')) l(label)),
ratios as (select *, tp::double / nullif(n_pred, 0) as p, tp::double / nullif(n_real, 0) as r from met)
"""


@query("ev_confusion", PAIRS_SQL + "select model, real, predicted, n, round(100.0::double * n / sum(n) over (partition by model, real), 2) as pct_of_real from cm")
def _(s, sf):
    return E.confusion_pct(E.confusion(evaluation(s, sf), "real", PREDICTIONS))


def metrics(s, sf) -> DataFrame:
    return E.class_metrics(E.confusion(evaluation(s, sf), "real", PREDICTIONS), list(PREDICTIONS))


@query("ev_class_metrics", PAIRS_SQL + """select model, label, tp, n_pred, n_real, round(100 * p, 2) as precision_pct, round(100 * r, 2) as recall_pct,
 round(100 * (2 * p * r / nullif(p + r, 0)), 2) as f1_pct from ratios""")
def _(s, sf):
    return E.metrics_in_pct(metrics(s, sf))


SCORES_SQL = PAIRS_SQL + """, scores as (select model, round(100 * avg(r), 2) as balanced_accuracy_pct, round(100 * avg(2 * p * r / nullif(p + r, 0)), 2) as macro_f1_pct from ratios group by 1)
"""


@query("ev_balanced_accuracy", SCORES_SQL + "select * from scores")
def _(s, sf):
    return E.balanced_accuracy(metrics(s, sf))


@query("q_baseline_scores", SCORES_SQL + "select * from scores")
def _(s, sf):
    return E.balanced_accuracy(metrics(s, sf)).orderBy("model")


@query("ev_compare", SCORES_SQL + "select *, round((select balanced_accuracy_pct from scores where model = 'ha') - balanced_accuracy_pct, 1) as gain_points from scores")
def _(s, sf):
    return E.compare_models(E.balanced_accuracy(metrics(s, sf)), "ha")


@query("ev_common_rows", EVAL_SQL + "select station_id, day::varchar as day, hour::int as hour, half, real, sn7_pred, ha_pred from ev where sn7_pred is not null and ha_pred is not null")
def _(s, sf):
    table = evaluation(s, sf)
    first = table.select(*TS.SLOT, "real", "sn7_pred")
    second = table.select(*TS.SLOT, "ha_pred")
    return with_text(E.common_rows(first, second, TS.SLOT, ["sn7_pred", "ha_pred"]), "day")


@query("ev_by_hour", EVAL_SQL + """, c as (select * from ev where sn7_pred is not null and ha_pred is not null),
 p as (select hour, 'sn7' as model, real, sn7_pred as predicted from c union all select hour, 'ha', real, ha_pred from c),
 q as (select hour, model, real, count(*) as k, count(*) filter (where real = predicted)::double / count(*) as recall from p group by all)
 select hour::int as hour, model, sum(k)::bigint as n, round(100 * avg(recall), 6) as balanced_accuracy from q group by all""")
def _(s, sf):
    rows = evaluation(s, sf).na.drop(subset=["sn7_pred", "ha_pred"])
    return rounded(E.balanced_accuracy_by(rows, "real", PREDICTIONS, "hour"), "balanced_accuracy")


@query("ev_confusion_labels", """select q as real, t as predicted, n, round(100.0::double * n / sum(n) over (partition by q), 2) as pct_of_real
 from (select case quality when 1 then 'good' else 'poor' end as q, case toxic when 1 then 'poor' else 'good' end as t, count(*) as n from labels group by all)""")
def _(s, sf):
    rows = R.table(s, sf, "labels").select(
        F.when(F.col("quality") == 1, "good").otherwise("poor").alias("real"),
        F.when(F.col("toxic") == 1, "poor").otherwise("good").alias("predicted"))
    return E.confusion_pct(E.confusion(rows, "real", {"toxic": "predicted"})).drop("model")


# ---------------------------------------------------------------- model features
PROFILE_RF_SQL = GRID + f""", pf as (
  select station_id, hour, half, (isodow(day) >= 6)::int as weekend, avg({NAB_SQL})::float as nab_mean, stddev_samp({NAB_SQL})::float as nab_sd,
   avg(avg_capacity)::float as capacity_mean, avg((state = 'buida')::int)::float as share_empty, avg((state = 'plena')::int)::float as share_full
  from grid where {MODELLED} and day <= date '{R.TRAIN_END}' group by all)
"""
RF_VALUES = ["nab_mean", "nab_sd", "capacity_mean", "share_empty", "share_full"]


@query("rf_profile", PROFILE_RF_SQL + "select station_id, hour::int as hour, half, weekend, "
       + ", ".join(f"round({c}::double, 5) as {c}" for c in RF_VALUES) + " from pf")
def _(s, sf):
    rows = FT.slot_profile(train_rows(s, sf)).withColumn("weekend", F.col("weekend").cast("int"))
    return rounded(with_double(rows, *RF_VALUES), *RF_VALUES, digits=5)


LAG_SQL = GRID + f""", lagged as (
  select station_id, day, hour, half, state, month(day)::int as month, isodow(day)::int as weekday, (isodow(day) >= 6)::int as weekend, 1 as season,
   lag(avg_bikes, 2) over w as prev_bikes, lag(avg_docks, 2) over w as prev_docks, lag(coalesce(avg_capacity, 20.0), 2) over w as prev_capacity,
   case lag(state, 2) over w when 'buida' then 0 when 'normal' then 1 when 'plena' then 2 else -1 end as prev_state,
   lag(avg_bikes, 2) over w - lag(avg_bikes, 3) over w as delta_bikes, lag(avg_docks, 2) over w - lag(avg_docks, 3) over w as delta_docks
  from grid where {MODELLED} window w as (partition by station_id order by day, hour, half))
"""
LAGGED = ["prev_bikes", "prev_docks", "prev_capacity", "delta_bikes", "delta_docks"]


@query("win_lag2_lag3", LAG_SQL + "select station_id, day::varchar as day, hour::int as hour, half, state, prev_state, "
       + ", ".join(f"round({c}, 4) as {c}" for c in LAGGED) + " from lagged")
def _(s, sf):
    rows = with_double(FT.with_lags(R.grid(s, sf)), *LAGGED)
    return with_text(rounded(rows, *LAGGED, digits=4), "day").select("station_id", "day", "hour", "half", "state", "prev_state", *LAGGED)


def clustered_stations(s, sf):
    """Stations by their behaviour in the training period, and the model."""
    features = FT.station_features(train_rows(s, sf))
    return ml.cluster_rows(features, FT.feature_columns(features), order_by="mean_capacity")


@query("ml_station_clusters", STATION + "select (select count(*) from stations) as n, true as sizes_add_up, true as nearest, true as cost")
def _(s, sf):
    """The clustering chain over the stations' features: sizes, nearest centres and cost, each held against its definition."""
    return ml.cluster_checks(*clustered_stations(s, sf))


def model_tables(s, sf) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of the next-state model."""
    grid, clusters = R.grid(s, sf), kept(clustered_stations(s, sf)[0].select("station_id", "cluster"), "clusters")
    training = F.col("day") <= R.TRAIN_END
    profile = FT.slot_profile(grid.where(training))
    return tuple(FT.model_table(grid, profile, clusters, period) for period in (training, F.col("day") >= R.TEST_START))


def model_rows(s, sf, train: bool) -> DataFrame:
    return model_tables(s, sf)[0 if train else 1]


OVERALL_SQL = ", ".join(f"(select avg({c}) from pf) as g_{c}" for c in RF_VALUES)
MODEL_SQL = (
    LAG_SQL + PROFILE_RF_SQL[len(GRID):] + f", g as (select {OVERALL_SQL}) "
    + "select l.station_id, l.day::varchar as day, l.hour::int as hour, l.half, state, month, l.weekday, l.weekend, season, prev_state, "
    + ", ".join(f"round({c}, 4) as {c}" for c in LAGGED) + ", "
    + ", ".join(f"round(coalesce(pf.{c}::double, g_{c}), 4) as {c}" for c in RF_VALUES)
    + ", true as cluster_known from lagged l cross join g left join pf on pf.station_id = l.station_id and pf.hour = l.hour and pf.half = l.half and pf.weekend = l.weekend"
    + " where prev_bikes is not null and delta_bikes is not null and "
)


def _model_query(train: bool):
    def run(s, sf):
        rows = with_double(model_rows(s, sf, train), *LAGGED)
        rows = with_text(rounded(rows, *LAGGED, *RF_VALUES, digits=4), "day")
        known = F.col("cluster").between(0, 4).alias("cluster_known")
        return rows.withColumns({"weekend": F.col("weekend").cast("int")}).select("*", known).drop("cluster")
    return run


query("rf_features_train", MODEL_SQL + f"l.day <= date '{R.TRAIN_END}'")(_model_query(True))
query("rf_features_test", MODEL_SQL + f"l.day >= date '{R.TEST_START}'")(_model_query(False))


@query("join_cross_scalar", PROFILE_RF_SQL + """, g as (select avg(nab_mean) as overall from pf)
 select station_id, hour::int as hour, half, weekend, round(nab_mean::double - overall, 5) as above_overall from pf cross join g""")
def _(s, sf):
    profile = FT.slot_profile(train_rows(s, sf))
    overall = profile.agg(F.avg("nab_mean")).scalar()
    rows = profile.withColumns({"above_overall": F.col("nab_mean").cast("double") - overall, "weekend": F.col("weekend").cast("int")})
    return rounded(rows.select("station_id", "hour", "half", "weekend", "above_overall"), "above_overall", digits=5)


@query("sink_station_tables", EVAL_SQL + LAG_SQL[len(GRID):] + f"""select 'readings' as name, (select count(*) from clean) as n union all select 'trips', (select count(*) from (select distinct station_id, day, hour from enriched))
 union all select 'slots', (select count(*) from slots) union all select 'grid', (select count(*) from grid)
 union all select 'features', (select count(*) from stations) union all select 'history', (select count(*) from ha) union all select 'evaluation', (select count(*) from ev)
 union all select 'clusters', (select count(*) from stations)
 union all select 'model_train', (select count(*) from lagged where prev_bikes is not null and delta_bikes is not null and day <= date '{R.TRAIN_END}')
 union all select 'model_test', (select count(*) from lagged where prev_bikes is not null and delta_bikes is not null and day >= date '{R.TEST_START}')""")
def _(s, sf):
    """All tables of the chain, each written once and read by the stages after it."""
    raw = R.readings(s, sf)
    written = station_tables(raw, R.stations_of(raw), shared_folder(s, "chain"), R.TRAIN_END, R.TEST_START, R.TEST_END, R.SHORT_HISTORY_KEYS)
    return table_sizes(written).select(F.col("table_name").alias("name"), F.col("n_rows").alias("n"))


# ---------------------------------------------------------------- stored days
def stored_days(s, sf) -> daily.StationDays:
    """The tables by day, made from two thirds of the readings (the newest, the oldest and scattered ones are missing) and refreshed with the rest."""
    raw = R.readings(s, sf)
    later = F.pmod(F.col("last_updated").cast("long"), F.lit(7)).isin(2, 5) | (F.dayofmonth(F.timestamp_seconds(F.col("last_reported").cast("long"))).isin(1, 30, 31))
    tables = daily.StationDays(raw.where(~later), R.stations_of(raw), shared_folder(s, "days"))
    tables.refresh(raw.where(later))
    return tables


@query("sink_stored_trips", TRIPS_SQL + "select station_id, day::varchar as day, hour::int as hour, district, trips from trips")
def _(s, sf):
    """Trips of the stored tables after a refresh, equal to the chain over all readings."""
    return with_text(stored_days(s, sf).trips.read(), "day").select("station_id", "day", "hour", "district", "trips")


@query("sink_stored_grid", GRID + "select station_id, district, day::varchar as day, hour::int as hour, half, state, min_bikes::double as min_bikes, avg_docks::double as avg_docks from grid")
def _(s, sf):
    """The dense grid of the stored tables after a refresh."""
    rows = with_text(with_double(stored_days(s, sf).grid.read(), "min_bikes", "avg_docks"), "day")
    return rows.select("station_id", "district", "day", "hour", "half", "state", "min_bikes", "avg_docks")
