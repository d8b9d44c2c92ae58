import random

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from slotwise.operators import clustering as C, ml
from slotwise.plans import QUERIES


def test_sweep_covers_all_embeddings_and_every_k(spark, sf, monkeypatch):
    asked = {}

    def sweep(points, ks, **options):
        asked.update(n=points.count(), ks=list(ks), options=options)
        return points

    monkeypatch.setattr(ml, "k_sweep", sweep)
    QUERIES["ml_k_sweep"](spark, sf)
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert asked == {"n": n, "ks": list(range(2, 13)), "options": {}} and n > 10


def test_centroids_cover_all_coordinates_of_all_embeddings(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = QUERIES["ml_centroids"](spark, sf).collect()
    assert {r.feature for r in rows} == {f"x{i}" for i in range(table.select(F.size("embedding")).first()[0])}
    total = {r.cluster: r.n for r in rows}
    assert len(total) == 5 and sum(total.values()) == table.count()
    for i in (0, 40):  # means of all rows follow from those of the clusters
        mean = table.agg(F.avg(F.get("embedding", F.lit(i)).cast("double"))).first()[0]
        assert abs(sum(r.n * r.mean for r in rows if r.feature == f"x{i}") / table.count() - mean) < 1e-5


def blobs(n, seed=4):
    rng = random.Random(seed)
    places = [(rng.uniform(-20, 20), rng.uniform(-20, 20), rng.uniform(-20, 20)) for _ in range(6)]
    return [[rng.gauss(x, 1) for x in rng.choice(places)] for _ in range(n)]


def slow_cost(points, centres):
    points, centres = np.array(points), np.array(centres)
    return ((points[:, None] - centres[None]) ** 2).sum(2).min(1).sum()


def test_all_models_advance_in_the_same_scans(spark, monkeypatch):
    scans = []
    scan = C._Points.scan
    monkeypatch.setattr(C._Points, "scan", lambda self, centres, *a: scans.append(len(centres)) or scan(self, centres, *a))
    data = blobs(600)
    df = spark.createDataFrame([(p,) for p in data], "features array<double>").repartition(3).persist()
    sizes = [2, 3, 6, 6, 6, 6, 9]
    models = C.fit_many(df, sizes, max_iter=100)
    # one draw of first points, two scans per seeding round, one for the weights, one per iteration of the slowest model, one for the costs
    assert len(scans) == 1 + 2 * C.SEED_ROUNDS + 1 + max(m.iterations for m in models) + 1
    assert [len(m.centres) for m in models] == sizes and min(scans[-2:]) < len(sizes)
    for m in models:
        assert m.cost == pytest.approx(slow_cost(data, m.centres))
    library = KMeans(k=6, maxIter=100, seed=1).fit(df.select(array_to_vector("features").alias("features"))).summary.trainingCost
    assert min(m.cost for m in models if len(m.centres) == 6) <= 1.001 * library
    rows = df.withColumn("own", models[2].nearest()).collect()
    away = ((np.array([r.features for r in rows])[:, None] - models[2].centres[None]) ** 2).sum(2)
    assert [r.own for r in rows] == away.argmin(1).tolist()


def test_clusters_of_copies_gaps_and_few_points(spark):
    crowd = [[1.0, 1.0]] * 5000 + [[5.0, 5.0], None, [9.0, 1.0]]
    df = spark.createDataFrame([(p,) for p in crowd], "features array<double>").repartition(4)
    three, seven = C.fit_many(df, [3, 7])
    assert sorted(three.centres.tolist()) == [[1.0, 1.0], [5.0, 5.0], [9.0, 1.0]] and three.cost == 0
    assert len(seven.centres) == 3  # no more centres than different points
    assert C.fit_many(df.where("features is null"), [3]) == []
    again = C.fit_many(df.repartition(9), [3])[0]
    assert sorted(again.centres.tolist()) == sorted(three.centres.tolist())


def test_points_of_one_partition_are_dealt_over_all_cores(spark):
    rows = 16 * C.SLICE * spark.sparkContext.defaultParallelism
    df = spark.range(0, rows, 1, 1).selectExpr("array(double(id), double(id % 7)) as features")
    with C._Points(df, "features") as points:
        tasks = points.scan([], lambda blocks, _: [sum(len(x) for x, _ in blocks)]).collect()
    assert sum(tasks) == rows and max(tasks) * spark.sparkContext.defaultParallelism <= 2 * rows


def test_nearest_of_points_with_gaps_and_ties(spark):
    model = C.Clusters(np.array([[0.0, 0.0], [2.0, 0.0], [0.0, 0.0]]), 0.0, 1)
    data = [([1.0, 0.0], 0), ([2.0, 1.0], 1), (None, None), ([None, 1.0], None), ([1.0], None), ([0.0, 0.0], 0)]
    df = spark.createDataFrame(data, "features array<double>, want int").repartition(3)
    assert all(r.got == r.want for r in df.withColumn("got", model.nearest()).collect())
    assert df.where("features is null").withColumn("got", model.nearest()).first().got is None
