"""Grouping, quantiles, commerce, quality, mutations, geometry, routes, files."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotwise.operators import commerce as C, geo, grouping as G, ml, mutate as M, quality as Q, routes, stats as S, texts as TX
from slotwise.operators.clustering import Clusters, silhouettes
from slotwise.operators.quantiles import exact_quantiles
from slotwise.plans import QUERIES, roles as R
from slotwise.session import shared_folder
from slotwise.sources import readers as RD, writers as WR


# ---------------------------------------------------------------- grouping
def test_inverse_mapping_flags_duplicates(spark):
    df = spark.createDataFrame([("oak", 12), ("elm", 5), ("fir", 12), ("yew", 40)], "k string, v int")
    got = {(r.v, r.k): r.duplicated for r in G.invert_mapping(df, "k", "v").collect()}
    assert got == {(5, "elm"): False, (40, "yew"): False, (12, "oak"): True, (12, "fir"): True}


def test_salted_join_keeps_every_row_of_a_hot_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2500, "hot").otherwise("cold").alias("k"), "id")
    per_key = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, w int")
    got = G.salted_join(rows, per_key, ["k"])
    assert got.count() == 3000 and got.groupBy("k").agg(F.max("w").alias("w")).orderBy("k").collect() == [("cold", 2), ("hot", 1)]



def test_mode_takes_the_smallest_on_ties_and_ignores_null(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (1, None), (1, None), (2, "z")], "k int, v string")
    assert {r.k: r.m for r in G.modal_value(df, ["k"], "v", "m").collect()} == {1: "a", 2: "z"}


def test_null_keys_are_left_out_of_crosstabs(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), (None, "x"), ("a", "x"), ("a", "y")], "r string, c string")
    assert {(r.r, r.c): (r.n, round(r.row_pct, 2)) for r in G.crosstab(df, "r", "c").collect()} == {("a", "x"): (2, 66.67), ("a", "y"): (1, 33.33)}
    assert G.crosstab_wide(df, "r", "c", ["x", "y", "z"]).collect() == [("a", 2, 1, 0)]


@pytest.mark.parametrize("cells", [1024, 16])
def test_quantiles_are_exact_on_skewed_groups(spark, cells):
    rng = random.Random(3)
    data = [("hot", rng.gauss(0, 1)) for _ in range(3000)] + [("same", 5.0)] * 400 + [("one", 2.5)]
    data += [("few", float(i % 3)) for i in range(7)] + [("null", None)] + [("mix", float(rng.choice([0, 0, 0, 1, 9]))) for _ in range(500)]
    probs = {"a": 0.0, "q1": 0.25, "m": 0.5, "q3": 0.75, "p99": 0.99, "z": 1.0}
    got = {r.k: r for r in exact_quantiles(spark.createDataFrame(data, "k string, v double"), ["k"], "v", probs, cells).collect()}
    assert set(got) == {"hot", "same", "one", "few", "mix"}
    for key, row in got.items():
        values = [v for k, v in data if k == key]
        for name, p in probs.items():
            assert row[name] == pytest.approx(np.quantile(values, p), abs=1e-12), (key, name)


def test_quantiles_of_one_value_and_of_odd_values(spark):
    one = spark.range(1_000_000).select(F.lit("same").alias("k"), F.lit(0.1).alias("v"))
    odd = [("odd", v) for v in (float("inf"), float("-inf"), 1e308, -1e308, 5e-324, 0.0, -5e-324)]
    nan = [("nan", v) for v in (float("nan"), 1.0, 2.0)]
    none = [("none", None), (None, 1.0)]
    rows = one.union(spark.createDataFrame(odd + nan + none, "k string, v double"))
    got = {r.k: (r.low, r.m, r.high) for r in exact_quantiles(rows, ["k"], "v", {"low": 0.0, "m": 0.5, "high": 1.0}).collect()}
    assert got.pop("same") == (0.1, 0.1, 0.1)
    assert got.pop("odd") == (float("-inf"), 0.0, float("inf"))
    low, middle, high = got.pop("nan")
    assert (low, middle) == (1.0, 2.0) and high != high and not got


def test_quantile_rounds_shuffle_cells_only(spark, monkeypatch):
    """A round has no window, and what is dealt by the group is a partial aggregate or a bracket."""
    from slotwise.operators import quantiles as Q
    from tests.test_plans import plan_of, raw_exchanges

    plans = []

    def watched(*a, f=Q.refined):
        plans.append(plan_of(f(*a)))
        return f(*a)

    monkeypatch.setattr(Q, "refined", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = spark.range(20_000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 10_007).alias("v"))
        found = {r.k: r.m for r in exact_quantiles(rows, ["k"], "v", {"m": 0.5}).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == {k: np.median([i * 7 % 10_007 for i in range(k, 20_000, 3)]) for k in range(3)}
    assert 1 <= len(plans) <= 4
    for plan in plans:
        assert "Window" not in plan and not raw_exchanges(plan, r"k#\d+L?")


def test_quantile_of_everything(spark):
    assert exact_quantiles(spark.range(10).select(F.col("id").alias("v")), [], "v", {"m": 0.5}).collect() == [(4.5,)]


def test_last_rows_are_pruned_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = G.last_n_per_group(df, ["k"], [F.desc("id")], 2)
    assert "WindowGroupLimit" in plan._sc._jvm.PythonSQLUtils.explainString(plan._jdf.queryExecution(), "simple")
    assert sorted(r.id for r in plan.collect()) == [94, 95, 96, 97, 98, 99]


# ---------------------------------------------------------------- commerce
def tx_frame(spark, rows):
    return spark.createDataFrame(rows, "id int, card_id string, timestamp timestamp_ntz, declined int, product_ids string")


def test_card_status_needs_three_declined(spark):
    from datetime import datetime as d
    day = lambda n: d(2024, 1, n)
    rows = [(1, "a", day(1), 0, ""), (2, "a", day(2), 1, ""), (3, "a", day(3), 1, ""), (4, "a", day(4), 1, ""),
            (5, "b", day(1), 1, ""), (6, "b", day(2), 1, ""), (7, "c", day(1), 1, ""), (8, "c", day(1), 0, ""), (9, "c", day(1), 1, ""), (10, "c", day(1), 1, "")]
    assert {r.card_id: r.status for r in C.card_status(tx_frame(spark, rows)).collect()} == {"a": "inactive", "b": "active", "c": "active"}


def test_product_bridge_takes_the_whole_list(spark):
    from datetime import datetime as d
    tx = tx_frame(spark, [(1, "a", d(2024, 1, 1), 0, "1, 2, 2, , 3, 9, 4, 4"), (2, "a", d(2024, 1, 1), 1, "4")])
    products = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id int")
    pairs = {(r.transaction_id, r.product_id) for r in C.product_bridge(tx, products).collect()}
    assert pairs == {(1, "1"), (1, "2"), (1, "3"), (1, "4"), (2, "4")}
    assert {r.product_id: r.quantity for r in C.product_sales(C.product_bridge(tx, products), tx).collect()} == {"1": 1, "2": 1, "3": 1, "4": 1}


def test_companies_without_transactions_literal(spark):
    company = spark.createDataFrame([(1, "a"), (2, "b")], "id int, company_name string")
    tx = spark.createDataFrame([(1,)], "company_id int")
    names = lambda df: sorted(r[0] for r in df.collect())
    assert names(C.companies_without_transactions(tx, company)) == ["b"]
    assert names(C.companies_without_transactions(tx, company, literal=True)) == []
    assert names(C.companies_without_transactions(tx.where("false"), company, literal=True)) == ["a", "b"]


# ---------------------------------------------------------------- quality, statistics, changes
def test_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d")], "k int, v string")
    assert {(r.k, r.n) for r in Q.repeated_keys(df, ["k"]).collect()} == {(1, 2), (None, 1)}
    parent = spark.createDataFrame([(1,)], "p int")
    assert [r.v for r in Q.orphans(df, "k", parent, "p").collect()] == ["d"]


def test_category_codes(spark):
    df = spark.createDataFrame([("beta",), ("alpha",), (None,), ("betamax",), ("alpha",)], "c string")
    assert sorted(((r.c, r.n) for r in S.category_codes(df, "c", "n").collect()), key=str) == sorted(
        [("alpha", 0), ("alpha", 0), ("beta", 1), ("betamax", 2), (None, -1)], key=str)


def test_histogram_keeps_empty_bins_and_closes_the_last(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 10)], "v double")
    assert [r.n for r in S.histogram(df, "v", 5).orderBy("bin").collect()] == [2, 0, 0, 0, 1]


def test_density_integrates_to_one(spark):
    rows = S.density(spark.range(200).select((F.col("id") % 17).alias("v")), "v", points=300).orderBy("i").collect()
    step = rows[1].x - rows[0].x
    assert sum(r.density for r in rows) * step == pytest.approx(1.0, abs=5e-3)


def test_changes_are_null_safe(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    assert sorted(r.v for r in M.update(df, F.col("k") == 1, v="x").collect()) == ["b", "x"]
    assert [r.v for r in M.delete(df, F.col("k") == 1).collect()] == ["b"]
    assert M.insert(df, spark.createDataFrame([(7,)], "k int")).where("k = 7").first().v is None
    again = M.insert_missing(df, spark.createDataFrame([(1,), (5,), (5,)], "k int"), "k")
    assert again.count() == 3
    assert M.cast_columns(df, {"v": "int"}).where("v is not null").count() == 0
    assert M.reorder_first(df, ["v"]).columns == ["v", "k"]


# ---------------------------------------------------------------- text
def test_match_lines(spark):
    lines = ["A\t1-2\tB", " C \t 3 - 3 \t D ", "A\t1-2", "A\tx-2\tB", "A\t-1-2\tB", "", "A\t1-2\tB\tC", "A\t1-2\t", "A\t\t1-2\tB"]
    got = TX.parse_matches(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert {tuple(r) for r in got.collect()} == {("A", 1, "B", 2), ("C", 3, "D", 3)}
    assert [(r.team, r.points) for r in TX.league_table(got).collect()] == [("B", 3), ("C", 1), ("D", 1), ("A", 0)]


def test_split_convertible(spark):
    df = spark.createDataFrame([(["1.3", "one", "2"],)], "v array<string>")
    assert [(r.item, r.number) for r in TX.split_convertible(df, "v").collect()] == [("1.3", 1.3), ("one", None), ("2", 2.0)]


def test_index_by_initial_keeps_all_words(spark):
    df = spark.createDataFrame([(" ".join(f"a{c}" for c in "bcdefghij") + " bb bb",)], "t string")
    got = {(r.initial, r.word): r.n for r in TX.index_by_initial(df, "t").collect()}
    assert got == {("a", f"a{c}"): 1 for c in "bcdefghij"} | {("b", "bb"): 2}


# ---------------------------------------------------------------- geometry
SQUARE = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]]
RINGS = "array<array<struct<lon:double,lat:double>>>"


def test_points_on_edges_and_in_holes_are_outside(spark):
    polygons = spark.createDataFrame([("sq", SQUARE)], f"name string, rings {RINGS}")
    cases = {(3.0, 3.0): "sq", (1.5, 1.5): None, (4.0, 2.0): None, (0.0, 0.0): None, (1.0, 1.5): None, (9.0, 9.0): None, (0.5, 1.0): "sq", (None, 1.0): None}
    points = spark.createDataFrame([p for p in cases], "lon double, lat double")
    for cell in (0.7, 10.0):
        got = {(r.lon, r.lat): r.name for r in geo.within_left_join(points, polygons, cell).collect()}
        assert got == cases


def test_reprojection_of_known_trees(spark):
    known = [(430700.647, 4587547.432, 41.4365081, 2.1705107), (430035.239, 4587693.836, 41.4377690, 2.1625299)]
    df = spark.createDataFrame(known, "x double, y double, lat double, lon double")
    for r in df.withColumn("p", geo.utm_to_geographic(F.col("x"), F.col("y"))).collect():
        assert r.p.lat == pytest.approx(r.lat, abs=2e-6) and r.p.lon == pytest.approx(r.lon, abs=2e-6)


def test_hull_against_brute_force(spark):
    rng = random.Random(1)
    pts = [("g", rng.random(), rng.random()) for _ in range(150)] + [("two", 0.0, 0.0), ("two", 1.0, 1.0)]
    df = spark.createDataFrame(pts, "g string, lon double, lat double")
    got = {(r.lon, r.lat) for r in geo.hull_points(df, "g", spread=4).where("g = 'g'").collect()}
    own = [p[1:] for p in pts if p[0] == "g"]
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    edges = [(a, b) for a, b in itertools.permutations(own, 2) if all(side(a, b, c) >= 0 for c in own)]
    assert got == {a for a, _ in edges}
    zones = {r.g: r for r in geo.hulls(df, "g").collect()}
    assert zones["two"]["shape"] == "circle" and zones["two"].radius == 300.0 and zones["two"].ring is None
    ring = zones["g"].ring
    assert zones["g"]["shape"] == "polygon" and ring[0] == ring[-1] and len(ring) == len(got) + 1


# ---------------------------------------------------------------- routes
def test_routes_against_brute_force(spark):
    rng = random.Random(5)
    names = list("ABCDEF")
    km = {(m, a, b): float(rng.randint(1, 9)) for m in "xy" for a in names for b in names if a != b}
    edges = spark.createDataFrame([(*k, v) for k, v in km.items()], "matrix string, src string, dst string, km double")
    got = {(r.matrix, r.origin): (r.route, r.km) for r in routes.nearest_neighbour_routes(edges).collect()}
    for m in "xy":
        for origin in names:
            route, total = [origin], 0.0
            while len(route) < len(names):
                step, nxt = min((km[m, route[-1], b], b) for b in names if b not in route)
                route.append(nxt)
                total += step
            assert got[m, origin] == (route, total)
    best = {r.matrix: r.km for r in routes.best_origin(routes.nearest_neighbour_routes(edges)).collect()}
    assert best == {m: min(v[1] for k, v in got.items() if k[0] == m) for m in "xy"}


# ---------------------------------------------------------------- clustering
def test_silhouette_matches_the_definition_over_squared_distances(spark):
    rng = random.Random(2)
    labels = [i % 3 for i in range(15)]
    pts = [[5.0 * c + rng.random(), rng.random()] for c in labels]
    df = spark.createDataFrame(list(zip(pts, labels)), "features array<double>, prediction int")
    total = 0.0
    for i, p in enumerate(pts):
        mean = {k: [math.dist(p, q) ** 2 for j, q in enumerate(pts) if labels[j] == k and j != i] for k in set(labels)}
        a = sum(mean[labels[i]]) / len(mean[labels[i]])
        b = min(sum(v) / len(v) for k, v in mean.items() if k != labels[i])
        total += (b - a) / max(a, b)
    centres = np.array([np.mean([p for p, c in zip(pts, labels) if c == k], axis=0) for k in range(3)])
    lone = Clusters(np.array([[0.0, 0.0]]), 0.0, 0)
    assert silhouettes(df.repartition(4), [Clusters(centres, 0.0, 0), lone]) == pytest.approx([total / len(pts), 0.0])


def test_cluster_numbers_follow_the_stable_rule(spark):
    df = spark.createDataFrame([(7, 1.0), (7, 2.0), (3, 9.0), (5, 4.0)], "cluster int, x double")
    assert sorted((r.cluster, r.x) for r in ml.order_clusters(df, "x").collect()) == [(0, 1.0), (0, 2.0), (1, 4.0), (2, 9.0)]


def test_balanced_weights(spark):
    df = ml.balanced_weights(spark.createDataFrame([("a",)] * 3 + [("b",)], "t string"), "t")
    assert {r.t: r.weight for r in df.collect()} == {"a": pytest.approx(4 / 6), "b": pytest.approx(2.0)}


# ---------------------------------------------------------------- files
def test_header_groups_and_union(spark):
    base = shared_folder(spark, "test-tree")
    one = spark.createDataFrame([("1", "x")], "`a.b` string, c string")
    two = spark.createDataFrame([("2", "y,\"z\"", "q")], "c string, d string, extra string")
    for i in range(2):
        WR.write_csv(one.coalesce(1), f"{base}/m{i}")
    WR.write_csv(two.coalesce(1), f"{base}/deep/er/n")
    groups = {r.header: r.n_files for r in RD.header_groups(spark, base).collect()}
    assert groups == {"a.b,c": 2, "c,d,extra": 1}
    got = sorted(map(tuple, RD.read_header_groups(spark, base, ["a_b", "c", "d", "none"]).collect()), key=str)
    assert got == sorted([("1", "x", None, None)] * 2 + [(None, "2", 'y,"z"', None)], key=str)


def test_partitioned_export_names_folders_without_blanks(spark):
    path = shared_folder(spark, "test-groups")
    WR.write_per_group(spark.createDataFrame([("Grup A", 1), ("Grup B", 2), ("Grup A", 3)], "g string, v int"), path, "g", files_per_group=1)
    back = spark.read.option("header", True).csv(path)
    assert {(r.group, r.v) for r in back.collect()} == {("GrupA", "1"), ("GrupB", "2"), ("GrupA", "3")}


def test_geojson_keeps_districts_only(spark):
    doc = '{"type":"FeatureCollection","features":[{"properties":{"TIPUS_UA":"DISTRICTE","CODI_UA":"01","NOM":"X"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1]]],[[[5,5],[6,5],[6,6]]]]}},{"properties":{"TIPUS_UA":"BARRI","CODI_UA":"02","NOM":"Y"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]]]}}]}'
    rows = RD.parse_geojson(spark.createDataFrame([(doc,)], "value string")).collect()
    assert [(r.district_id, r.district, len(r.rings), r.rings[1][0].x) for r in rows] == [("01", "X", 2, 5.0)]


def test_rename_and_drop_table(spark):
    spark.range(3).write.mode("overwrite").saveAsTable("t_old")
    M.drop_table(spark, "t_new")
    M.rename_table(spark, "t_old", "t_new")
    assert spark.table("t_new").count() == 3 and RD.missing_tables(spark, ["t_old", "t_new"]) == ["t_old"]
    M.drop_table(spark, "t_new")
    assert not spark.catalog.tableExists("t_new")


# ---------------------------------------------------------------- samples
def test_samples_are_the_same_at_every_partitioning(spark):
    import hashlib

    from slotwise.operators import sampling as SM

    df = spark.range(5000).select((F.col("id") % 2500).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("hue"), F.lit("x").alias("row"))
    draw = lambda k: int(hashlib.md5(f"7:{k}".encode()).hexdigest()[:8], 16)
    want = sorted(k for k in [*range(2500)] * 2 if draw(k) < 500 * 2**32 // 5000)
    for parts in (1, 7):
        assert sorted(r.k for r in SM.threshold_sample(df.repartition(parts), ["k"], 500, 5000, 7).collect()) == want
    assert 400 < len(want) < 600 and SM.threshold_sample(df, ["k"], 5000, 5000).count() == 5000
    one = spark.range(600).select(F.col("id").alias("k"), F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("hue"))
    hue = lambda k: k % 3 if k % 5 else None
    want = sorted((str(h), k) for h in (0, 1, 2, None) for k in sorted((k for k in range(600) if hue(k) == h), key=draw)[:9])
    for parts in (1, 6):
        assert sorted((str(r.hue), r.k) for r in SM.smallest_draws(one.repartition(parts), ["k"], ["hue"], 9, 7).collect()) == want


def test_a_match_line_is_cut_once(spark, sf):
    from tests.test_plans import plan_of

    lines = spark.createDataFrame([("a\t1-0\tb",), ("c\t1-0-2\td",), (None,), ("e\t1-\tf",), (" g \t 2 - 2 \t h ",), ("one",)], "value string")
    matches = TX.parse_matches(lines)
    assert sorted(tuple(r) for r in matches.collect()) == [("a", 1, "b", 0), ("g", 2, "h", 2)]
    assert plan_of(TX.league_table(matches)).count("split(") == 2


def test_inverse_of_a_hot_value_is_salted(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 > 0, F.lit("hot")).otherwise(F.concat(F.lit("v"), F.col("id"))).alias("v"))
    rows = G.invert_mapping(df, "k", "v")
    assert rows.count() == 3000 and rows.where("duplicated").select("v").distinct().collect() == [("hot",)]


def test_scatter_has_every_complete_point(spark, sf):
    tx = R.transactions(spark, sf)
    whole = tx.where("lat is not null and amount is not null").groupBy("declined").count().collect()
    assert max(r["count"] for r in whole) > 500
    assert sorted(QUERIES["st_scatter_sample"](spark, sf).groupBy("declined").count().collect()) == sorted(whole)
