"""Clustering of stations and the next-state classifier, on the MLlib estimators."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from slotwise.constants import CLUSTER_NAMES, MODEL_CLASSES
from slotwise.functions.dates import lookup
from slotwise.functions.numbers import minmax_norm
from slotwise.operators.clustering import TOLERANCE, Clusters, fit_many, silhouettes
from slotwise.operators.grouping import modal_value
from slotwise.operators.quality import drop_sparse, impute_median
from slotwise.operators.ranking import kept
from slotwise.operators.sampling import threshold_sample

#: Bound on the rows a forest is fitted on, as published for the original model.
FIT_ROWS = 1_500_000


def zscore(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns centred and divided by their population deviation (a constant column only centred)."""
    moments = lambda c: F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd")).alias(c)
    stats = df.agg(F.struct(*[moments(c) for c in columns])).scalar()
    scale = lambda sd: F.when(sd == 0, F.lit(1.0)).otherwise(sd)
    return df.withColumns({c: (F.col(c) - stats[c]["mean"]) / scale(stats[c]["sd"]) for c in columns})


def assemble(df: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=name).transform(df)


def fill_zero_float(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing model inputs become 0, all inputs single precision."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")) for c in columns})


@contextmanager
def persisted(df: DataFrame):
    """Keep an estimator's input (memory, then disk) while it iterates; lost blocks are recomputed."""
    already = df.is_cached
    if not already:
        df = df.persist()
    try:
        yield df
    finally:
        if not already:
            df.unpersist()


def fit_kmeans(df: DataFrame, k: int, restarts: int = 20, max_iter: int = 500, seed: int = 42) -> Clusters:
    """Best of several k-means runs by within-cluster cost, the earlier on ties; ``df`` needs an array ``features``."""
    with persisted(df.select("features")) as points:
        return min(fit_many(points, [k] * restarts, max_iter, seed), key=lambda m: m.cost)


def cluster_rows(
    df: DataFrame, columns: Sequence[str], k: int = 5, max_nulls: int = 10, order_by: str | None = None, **options
) -> tuple[DataFrame, Clusters]:
    """The clustering chain: rows with too many gaps go, other gaps take the column's median, columns are
    z-scored and clustered; clusters are numbered by their mean of ``order_by`` (in original units).

    Returns the kept rows with ``features`` (scaled, an array) and ``cluster``, and the model, whose centres keep the model's
    own numbers in ``prediction``.
    """
    # Each step reads a written table: medians and moments enter by scalar subqueries, one reference per column.
    whole = kept(impute_median(kept(drop_sparse(df, columns, max_nulls), "cluster-rows"), columns), "cluster-whole")
    scaled = zscore(whole.withColumns({f"_z{i}": F.col(c) for i, c in enumerate(columns)}), [f"_z{i}" for i in range(len(columns))])
    named = [f"_z{i}" for i in range(len(columns))]
    points = kept(scaled.withColumn("features", F.array(*named)).drop(*named), "cluster-points")
    model = fit_kmeans(points, k, **options)
    labelled = points.withColumn("prediction", model.nearest()).withColumn("cluster", F.col("prediction"))
    return order_clusters(labelled, order_by or columns[0]), model


def cluster_checks(clustered: DataFrame, model: Clusters) -> DataFrame:
    """One row: rows clustered, whether the sizes add up, whether each row's own centre is its nearest, and whether the
    model's cost is the sum of squared distances."""
    own, least = F.get("_away", F.col("prediction")), F.array_min("_away")
    sizes = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n")).scalar()
    # A column of its own, so that the distances are worked out once a row.
    return clustered.select("prediction", F.array(*model.distances("features")).alias("_away")).agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) == sizes).alias("sizes_add_up"), F.min((own <= least + 1e-9)).alias("nearest"),
        (F.abs(F.sum(own) - F.lit(float(model.cost))) <= 1e-6 * F.greatest(F.sum(own), F.lit(1.0))).alias("cost"),
    )


def centre_checks(clustered: DataFrame, model: Clusters) -> DataFrame:
    """One row: whether every centre is the mean of its rows, as far as a converged model's centres may still move."""
    width = model.centres.shape[1]
    means = clustered.groupBy("prediction").agg(F.array(*[F.avg(F.get("features", F.lit(i))) for i in range(width)]).alias("mean"))
    centres = F.array(*[F.lit([float(x) for x in c]) for c in model.centres])
    gaps = F.zip_with("mean", F.get(centres, F.col("prediction")), lambda a, b: F.abs(a - b))
    return means.agg((F.max(F.array_max(gaps)) <= TOLERANCE).alias("centres_are_means"))


def swept(points: DataFrame, ks: Sequence[int], restarts: int = 20, max_iter: int = 500, seed: int = 42) -> dict[int, Clusters]:
    """The cheapest of ``restarts`` models for every k, all fitted by the same scans."""
    sizes = [k for k in ks for _ in range(restarts)]
    runs = fit_many(points, sizes, max_iter, seed)
    return {k: min((m for size, m in zip(sizes, runs, strict=True) if size == k), key=lambda m: m.cost) for k in ks} if runs else {}


def k_sweep(df: DataFrame, ks: Sequence[int], restarts: int = 20, max_iter: int = 500, seed: int = 42) -> DataFrame:
    """Inertia and squared-Euclidean silhouette per k. ``df`` needs an array ``features``."""
    with persisted(df.select("features")) as points:
        best = swept(points, ks, restarts, max_iter, seed)
        scores = silhouettes(points, list(best.values())) if best else []
    rows = [(k, m.cost, score) for (k, m), score in zip(best.items(), scores, strict=True)]
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette_squared_euclidean double")


def order_clusters(df: DataFrame, by: str, cluster: str = "cluster") -> DataFrame:
    """Renumber arbitrary cluster labels by the cluster mean of ``by``, lowest first."""
    means = df.groupBy(cluster).agg(F.avg(by).alias("_m"))
    ranked = means.agg(F.sort_array(F.collect_list(F.struct("_m", cluster))).alias("_o"))
    order = ranked.select(F.posexplode("_o").alias("_new", "e")).select("_new", F.col(f"e.{cluster}").alias(cluster))
    return df.join(order, cluster).withColumn(cluster, F.col("_new")).drop("_new")


def cluster_means(df: DataFrame, columns: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Centres in original units with cluster sizes."""
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns])


def name_clusters(df: DataFrame, names: dict[int, str] = CLUSTER_NAMES, cluster: str = "cluster") -> DataFrame:
    """Adds ``cluster_name``. Numbers are only comparable to the names after a stable ordering."""
    return df.withColumn("cluster_name", lookup(F.col(cluster), names))


def scaled_centres(centres: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Centres with each column scaled to 0..1 over the clusters, 0.5 where all agree."""
    ends = centres.agg(F.struct(*[
        F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in columns
    ])).scalar()
    return centres.withColumns({c: minmax_norm(F.col(c), ends[c]["lo"], ends[c]["hi"]) for c in columns})


def cluster_summary(df: DataFrame, columns: Sequence[str], district: str, cluster: str = "cluster") -> DataFrame:
    """Size, most frequent district and feature means per cluster."""
    return cluster_means(df, columns, cluster).join(modal_value(df, [cluster], district, "top_district"), cluster)


def class_index(state: str = "state"):
    labels = F.array(*[F.lit(c) for c in MODEL_CLASSES])
    return (F.array_position(labels, F.col(state)) - 1).cast("double")


def class_name(prediction: str = "prediction"):
    return F.get(F.array(*[F.lit(c) for c in MODEL_CLASSES]), F.col(prediction).cast("int"))


def balanced_weights(df: DataFrame, target: str) -> DataFrame:
    """Adds ``weight`` = rows / (classes x rows of the class).

    The class counts, one entry per class, come from a scalar subquery.
    """
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    table = counts.agg(F.struct(
        F.map_from_entries(F.collect_list(F.struct(target, "n"))).alias("n"),
        (F.sum("n") / F.count(F.lit(1))).alias("even"),
    )).scalar()
    return df.withColumn("weight", table["even"] / F.element_at(table["n"], F.col(target)))


def fit_forest(
    train: DataFrame, columns: Sequence[str], trees: int = 100, depth: int = 20, min_leaf: int = 20,
    seed: int = 42, bins: int = 64, memory_mb: int = 1024, fit_rows: int = FIT_ROWS, keys: Sequence[str] | None = None,
) -> RandomForestClassificationModel:
    """Class-balanced random forest on the modelled states, fitted on a sample of about ``fit_rows`` rows drawn by their ``keys`` (or all columns)."""
    train = threshold_sample(train, keys or train.columns, fit_rows, train.count(), seed)
    rows = balanced_weights(fill_zero_float(train, columns).withColumn("label", class_index()), "label")
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, weightCol="weight", seed=seed,
        maxBins=bins, maxMemoryInMB=memory_mb,
    )
    with persisted(assemble(rows, columns).select("features", "label", "weight")) as training:
        return forest.fit(training)


def predict_state(model: RandomForestClassificationModel, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds ``rf_pred`` with the predicted state."""
    scored = model.transform(assemble(fill_zero_float(rows, columns), columns))
    return scored.withColumn("rf_pred", class_name()).drop("features", "rawPrediction", "probability", "prediction")


def importances(spark, model: RandomForestClassificationModel, columns: Sequence[str]) -> DataFrame:
    """Features by impurity reduction."""
    rows = [(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
