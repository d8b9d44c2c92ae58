"""Queries for geometry, routes, clustering and the next-state classifier."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from slotwise.functions import numbers as N
from slotwise.operators import baselines as B, evaluation as E, features as FT, geo, grouping as G, ml, quality as Q, routes, sampling as SM, stats as S, timeseries as TS
from slotwise.operators.ranking import kept
from slotwise.plans import roles as R, station as ST
from slotwise.plans.registry import query, rounded, with_double, with_text
from slotwise.plans.relational import FLOWS_SQL, flow_edges

T = R.table

# ---------------------------------------------------------------- geometry
# Customers on a 10 x 10 plane; nations as diamonds with a diamond-shaped hole, on a 5 x 5 lattice.
OUTER, INNER = 0.9013, 0.3007
POINTS_SQL = "pts as (select c_custkey as id, (c_custkey * 37 % 1009) / 100.9::double as lon, (c_acctbal + 1000) / 1100 as lat from customer)"
NEAR_SQL = "dia as (select n_nationkey as k, n_name, 1.0::double + 2 * (n_nationkey % 5) as cx, 1.0::double + 2 * (n_nationkey // 5) as cy from nation)"


def points(s, sf) -> DataFrame:
    return T(s, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        (F.pmod(F.col("c_custkey") * 37, F.lit(1009)) / 100.9).alias("lon"),
        ((F.col("c_acctbal") + 1000) / 1100).alias("lat"),
    )


def diamonds(s, sf) -> DataFrame:
    cx = F.lit(1.0) + 2 * F.pmod(F.col("n_nationkey"), F.lit(5))
    cy = F.lit(1.0) + 2 * F.floor(F.col("n_nationkey") / 5)
    corner = lambda dx, dy: F.struct((cx + dx).alias("lon"), (cy + dy).alias("lat"))
    ring = lambda r: F.array(corner(r, 0), corner(0, r), corner(-r, 0), corner(0, -r), corner(r, 0))
    return T(s, sf, "nation").select("n_name", F.array(ring(OUTER), ring(INNER)).alias("rings"))


WITHIN_SQL = f"""with {POINTS_SQL}, {NEAR_SQL} select id, n_name from pts left join dia
 on abs(lon - cx) + abs(lat - cy) < {OUTER}::double and abs(lon - cx) + abs(lat - cy) > {INNER}::double"""


def within_nation(s, sf) -> DataFrame:
    return geo.within_left_join(points(s, sf), diamonds(s, sf), cell=2.0).select("id", "n_name")


query("geo_within_left_join", WITHIN_SQL)(within_nation)
query("join_spatial_within", WITHIN_SQL)(within_nation)


@query("geo_points", "select c_custkey as id, printf('POINT (%.3f %.3f)', (c_custkey % 97)::double / 8, (c_custkey % 89)::double / 8) as wkt from customer")
def _(s, sf):
    rows = T(s, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        geo.point(F.pmod(F.col("c_custkey"), F.lit(97)) / 8, F.pmod(F.col("c_custkey"), F.lit(89)) / 8).alias("p"))
    return rows.select("id", F.format_string("POINT (%.3f %.3f)", "p.lon", "p.lat").alias("wkt"))


def _series(sign: str, factors, term: str) -> str:
    return " ".join(f"{sign} {b!r}::double * {term.format(2 * j)}" for j, b in enumerate(factors, start=1))


_SPHERE = f"({geo.SCALE}::double * {geo.RADIUS!r}::double)"
INVERSE_SQL = f"""with p as (select c_custkey as id, 400000.0::double + c_custkey * 7 % 100000 as x, 4570000.0::double + c_custkey * 13 % 50000 as y from customer),
a as (select id, y / {_SPHERE} as xi, (x - 500000) / {_SPHERE} as eta from p),
b as (select id, xi {_series('-', geo.BETA, 'sin({0} * xi) * cosh({0} * eta)')} as xi, eta {_series('-', geo.BETA, 'cos({0} * xi) * sinh({0} * eta)')} as eta from a),
c as (select *, asin(sin(xi) / cosh(eta)) as chi from b)
select id, round(degrees(chi {_series('+', geo.DELTA, 'sin({0} * chi)')}), 7) as lat, round(3 + degrees(atan2(sinh(eta), cos(xi))), 7) as lon from c"""


@query("geo_reproject", INVERSE_SQL)
def _(s, sf):
    key = F.col("c_custkey")
    ring = F.array(F.array(F.struct(
        (400000.0 + F.pmod(key * 7, F.lit(100000))).alias("x"), (4570000.0 + F.pmod(key * 13, F.lit(50000))).alias("y"))))
    rows = T(s, sf, "customer").select(key.alias("id"), F.get(F.get(geo.reproject_rings(ring), F.lit(0)), F.lit(0)).alias("p"))
    return rounded(rows.select("id", "p.lat", "p.lon"), "lat", "lon", digits=7)


LOCATED_SQL = f"with {POINTS_SQL}, reg as (select id, lon, lat, n_name, c_mktsegment from pts join customer on c_custkey = id join nation on n_nationkey = c_nationkey) "


def located_customers(s, sf) -> DataFrame:
    nation = T(s, sf, "nation").select("n_nationkey", "n_name")
    customer = T(s, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"), "n_name", "c_mktsegment", "c_acctbal")
    return points(s, sf).join(customer, "id")


@query("geo_centroid", LOCATED_SQL + "select n_name, round(avg(lat), 6) as lat, round(avg(lon), 6) as lon from reg group by 1")
def _(s, sf):
    return rounded(geo.centroids(located_customers(s, sf), "n_name"), "lat", "lon")


# A point is a hull vertex exactly when it is extreme in some direction; the check compares the
# bounding box, which the hull must reach, and the shape kind. The hull itself is tested by brute force.
@query("geo_hull", LOCATED_SQL + "select c_mktsegment, count(*) as n, 'polygon' as shape, min(lon) as lo_lon, max(lon) as hi_lon, min(lat) as lo_lat, max(lat) as hi_lat from reg group by 1")
def _(s, sf):
    zones = geo.hulls(located_customers(s, sf), "c_mktsegment", scale=1.0)
    extent = lambda pick, axis: N.round_binary(pick(F.transform("ring", lambda p: p[axis])), 9)
    exact = geo.hull_points(located_customers(s, sf), "c_mktsegment").groupBy("c_mktsegment").agg(
        F.min("lon").alias("lo_lon"), F.max("lon").alias("hi_lon"), F.min("lat").alias("lo_lat"), F.max("lat").alias("hi_lat"))
    return zones.select("c_mktsegment", "n", "shape").join(exact, "c_mktsegment")


@query("geo_hull_vertices")
def _(s, sf):
    """Vertices of the enlarged zone per segment, in order; no SQL counterpart."""
    zones = geo.hulls(located_customers(s, sf), "c_mktsegment")
    return rounded(zones.select("c_mktsegment", F.posexplode("ring").alias("position", "p")).select("c_mktsegment", "position", "p.lon", "p.lat"), "lon", "lat")


@query("geo_map_layer", ST.TRIPS_SQL + """, v as (select station_id, avg(t) as m from (select station_id, year, month, sum(trips) as t from trips group by all) group by 1),
 r as (select min(m) as lo, max(m) as hi from v)
 select station_id, lat, lon, (['#E63946', '#457B9D', '#F4A261'])[1 + district_id] as colour, round(3 + 5 * sqrt((m - lo) / (hi - lo)), 6) as radius,
  printf('Station %d | %s | %.1f trips a month', station_id, district, m) as tooltip from v join stations using (station_id), r""")
def _(s, sf):
    means = TS.mean_monthly_trips(ST.trips(s, sf), R.stations(s, sf))
    ends = means.agg(F.struct(F.min("mean_monthly_trips").alias("lo"), F.max("mean_monthly_trips").alias("hi"))).scalar()
    norm = N.minmax_norm(F.col("mean_monthly_trips"), ends["lo"], ends["hi"])
    tooltip = F.format_string("Station %d | %s | %.1f trips a month", "station_id", "district", "mean_monthly_trips")
    layer = means.select(
        "station_id", "lat", "lon", geo.palette_colour(F.col("district_id")).alias("colour"),
        N.sqrt_radius(norm).alias("radius"), tooltip.alias("tooltip"))
    return rounded(layer, "radius")


# ---------------------------------------------------------------- routes
ROUTES_SQL = FLOWS_SQL.replace("with edges as", "with recursive edges as").rstrip() + """,
walk(matrix, origin, here, route, km) as (
  select distinct matrix, src, src, [src], 0.0::double from edges where src in (select dst from edges) or true
  union all
  select w.matrix, w.origin, arg_min(e.dst, (e.km, e.dst)), list_append(w.route, arg_min(e.dst, (e.km, e.dst))), w.km + min(e.km)
  from walk w join edges e on e.matrix = w.matrix and e.src = w.here and e.dst != e.src and not list_contains(w.route, e.dst)
  group by w.matrix, w.origin, w.here, w.route, w.km),
routes as (select matrix, origin, arg_max(route, len(route)) as route, arg_max(km, len(route)) as km from walk group by 1, 2)
"""


@query("rt_nearest_neighbour_routes", ROUTES_SQL + "select matrix, origin, array_to_string(route, ' > ') as route, round(km, 3) as km from routes")
def _(s, sf):
    rows = routes.nearest_neighbour_routes(flow_edges(s, sf))
    return rounded(rows.withColumn("route", F.array_join("route", " > ")), "km", digits=3)


@query("rt_best_origin", ROUTES_SQL + "select matrix, arg_min(origin, (km, origin)) as origin, round(min(km), 3) as km from routes group by 1")
def _(s, sf):
    best = routes.best_origin(routes.nearest_neighbour_routes(flow_edges(s, sf)))
    return rounded(best.select("matrix", "origin", "km"), "km", digits=3)


# ---------------------------------------------------------------- clustering
Z = ["l_quantity", "l_extendedprice", "l_discount"]


@query("ml_zscore", "select l_orderkey, l_linenumber, " + ", ".join(
    f"round(({c} - (select avg({c}) from lineitem)) / (select stddev_pop({c}) from lineitem), 6) as {c}" for c in Z) + " from lineitem")
def _(s, sf):
    return rounded(ml.zscore(T(s, sf, "lineitem").select("l_orderkey", "l_linenumber", *Z), Z), *Z)


def embedding_points(s, sf) -> DataFrame:
    return T(s, sf, "embeddings").withColumn("features", F.col("embedding").cast("array<double>"))


@query("ml_k_sweep")
def _(s, sf):
    """Inertia and silhouette per k over all embeddings; ``ml_k_sweep_checks`` holds them against their definitions."""
    return ml.k_sweep(embedding_points(s, sf), range(2, 13))


@query("ml_k_sweep_checks", """select k::int as k, (select count(*) from embeddings) as n, true as sizes_add_up, true as nearest, true as cost, true as centres_are_means
 from range(2, 13) r(k)""")
def _(s, sf):
    """For the best model of every k over all embeddings: rows, whether sizes add up, each row's centre is its nearest, the cost is the
    sum of squared distances, and every centre is the mean of its rows."""
    with ml.persisted(embedding_points(s, sf)) as points:
        best = ml.swept(points, range(2, 13))
        checks = [
            ml.cluster_checks(rows, model).select(F.lit(k).alias("k"), "*", ml.centre_checks(rows, model).scalar().alias("centres_are_means"))
            for k, model in best.items()
            for rows in [points.select("features", model.nearest().alias("prediction")).withColumn("cluster", F.col("prediction"))]
        ]
        return kept(reduce(DataFrame.union, checks), "sweep-checks")


def clustered(s, sf) -> DataFrame:
    """Embeddings with a cluster number; clusters are numbered by their mean first coordinate."""
    rows = embedding_points(s, sf)
    model = ml.fit_kmeans(rows.select("features"), k=5)
    labelled = rows.withColumn("cluster", model.nearest()).withColumn("x", F.get("embedding", F.lit(0)).cast("double"))
    return ml.order_clusters(labelled, "x")


@query("ml_kmeans")
def _(s, sf):
    return clustered(s, sf).select("vec_id", "cluster")


@query("ml_centroids")
def _(s, sf):
    """Means of all coordinates per named cluster of embeddings, in original units, as long rows."""
    size = T(s, sf, "embeddings").agg(F.max(F.size("embedding"))).first()[0] or 0
    columns = [f"x{i}" for i in range(size)]
    rows = clustered(s, sf).withColumns({c: F.get("embedding", F.lit(i)).cast("double") for i, c in enumerate(columns)})
    means = ml.name_clusters(ml.cluster_means(rows, columns))
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("mean")) for c in columns])
    return rounded(means.select("cluster", "cluster_name", "n", F.explode(cells).alias("cell")).select("cluster", "cluster_name", "n", "cell.*"), "mean")


@query("ml_cluster_district")
def _(s, sf):
    return G.crosstab(clustered(s, sf), "cluster", "label")


@query("ml_cluster_means_by_label", "select label as cluster, count(*) as n, round(avg(embedding[1]::double), 6) as x0, round(avg(embedding[2]::double), 6) as x1 from embeddings group by 1")
def _(s, sf):
    rows = T(s, sf, "embeddings").withColumns({f"x{i}": F.get("embedding", F.lit(i)).cast("double") for i in range(2)})
    return rounded(ml.cluster_means(rows, ["x0", "x1"], "label").withColumnRenamed("label", "cluster"), "x0", "x1")


@query("ml_scaled_centres", """with c as (select label as cluster, count(*) as n, avg(embedding[1]::double) as x0, avg(embedding[2]::double) as x1 from embeddings group by 1)
 select cluster, n, round((x0 - (select min(x0) from c)) / ((select max(x0) from c) - (select min(x0) from c)), 6) as x0,
  round((x1 - (select min(x1) from c)) / ((select max(x1) from c) - (select min(x1) from c)), 6) as x1 from c""")
def _(s, sf):
    rows = T(s, sf, "embeddings").withColumns({f"x{i}": F.get("embedding", F.lit(i)).cast("double") for i in range(2)})
    centres = ml.cluster_means(rows.withColumnRenamed("label", "cluster"), ["x0", "x1"])
    return rounded(ml.scaled_centres(centres, ["x0", "x1"]), "x0", "x1")


@query("ml_cluster_summary", """select label as cluster, count(*) as n, round(avg(embedding[1]::double), 6) as x0,
 (select arg_min(p, (-k, p)) from (select 'part ' || (vec_id % 4) as p, count(*) as k from embeddings e2 where e2.label = e.label group by 1)) as top_district from embeddings e group by label""")
def _(s, sf):
    rows = T(s, sf, "embeddings").select(
        F.col("label").alias("cluster"), F.get("embedding", F.lit(0)).cast("double").alias("x0"),
        F.concat(F.lit("part "), F.pmod(F.col("vec_id"), F.lit(4)).cast("string")).alias("district"))
    return rounded(ml.cluster_summary(rows, ["x0"], "district"), "x0")


# ---------------------------------------------------------------- classifier
@query("ml_sample", """select l_orderkey, l_linenumber from lineitem, (select count(*) as n from lineitem) where n <= 1
 or ('0x' || md5('42:' || l_orderkey || ':' || l_linenumber)[1:8])::ubigint < (greatest(1, n // 10)::hugeint * 4294967296) // n""")
def _(s, sf):
    """About a tenth of the lines (a sampling operator), drawn by their keys."""
    lines = T(s, sf, "lineitem").select("l_orderkey", "l_linenumber")
    n = lines.count()
    return SM.threshold_sample(lines, ["l_orderkey", "l_linenumber"], max(1, n // 10), n)


@query("ml_fillna0_cast", "select l_orderkey, l_linenumber, round(coalesce(nullif(l_discount, 0.0), 0)::float::double, 6) as a, round(coalesce(nullif(l_tax, 0.0), 0)::float::double, 6) as b from lineitem")
def _(s, sf):
    zero = F.lit(0.0)
    rows = T(s, sf, "lineitem").select("l_orderkey", "l_linenumber", F.nullif("l_discount", zero).alias("a"), F.nullif("l_tax", zero).alias("b"))
    return rounded(with_double(ml.fill_zero_float(rows, ["a", "b"]), "a", "b"), "a", "b")


@query("ml_class_weights", "select o_orderstatus, count(*) as n, round((select count(*) from orders)::double / ((select count(distinct o_orderstatus) from orders) * count(*)), 6) as weight from orders group by 1")
def _(s, sf):
    rows = ml.balanced_weights(T(s, sf, "orders").select("o_orderstatus"), "o_orderstatus")
    return rounded(rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight")), "weight")


def fit_and_predict(s, sf):
    """The forest at its full size (100 trees of depth 20, leaves of 20), and its predictions of the test period."""
    train, test = ST.model_tables(s, sf)
    model = ml.fit_forest(train, FT.MODEL_FEATURES, keys=TS.SLOT)
    return model, ml.predict_state(model, test, FT.MODEL_FEATURES)


@query("ml_random_forest")
def _(s, sf):
    """Predicted states of the test period by the class-balanced forest."""
    return with_text(fit_and_predict(s, sf)[1].select(*TS.SLOT, "state", "rf_pred"), "day")


@query("ml_importance")
def _(s, sf):
    return ml.importances(s, fit_and_predict(s, sf)[0], FT.MODEL_FEATURES)


@query("ev_model_comparison")
def _(s, sf):
    """Forest against both baselines on the rows all three predict."""
    predicted = fit_and_predict(s, sf)[1]
    table = ST.evaluation(s, sf).select(*TS.SLOT, "real", "sn7_pred", "ha_pred")
    rows = E.common_rows(predicted.select(*TS.SLOT, "rf_pred"), table, TS.SLOT, ["sn7_pred", "ha_pred"])
    models = {"rf": "rf_pred", "sn7": "sn7_pred", "ha": "ha_pred"}
    metrics = E.class_metrics(E.confusion(rows, "real", models), list(models))
    return E.compare_models(E.balanced_accuracy(metrics, undefined_as_zero=True), "rf")
