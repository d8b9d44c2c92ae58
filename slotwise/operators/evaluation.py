"""Confusion tables and the metrics derived from them.

Every metric starts from one pass over the predictions that counts
(model, real, predicted); all later steps work on that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from slotwise.constants import MODEL_CLASSES
from slotwise.functions.numbers import ratio, round_binary


def confusion(df: DataFrame, real: str, predictions: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Counts per model, real and predicted class; rows without a prediction are left out."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(model).alias("model"), F.col(column).alias("predicted"))
        for model, column in predictions.items()
    ]))
    long = df.select(*by, F.col(real).alias("real"), pairs.alias("p")).select(*by, "real", "p.model", "p.predicted")
    counts = long.where(F.col("predicted").isNotNull()).groupBy(*by, "model", "real", "predicted")
    return counts.agg(F.count(F.lit(1)).alias("n"))


def confusion_pct(table: DataFrame) -> DataFrame:
    """Adds the share of each prediction in its real class, in percent."""
    total = F.sum("n").over(Window.partitionBy("model", "real"))
    return table.withColumn("pct_of_real", round_binary(100.0 * F.col("n") / total, 2))


def class_metrics(
    table: DataFrame, models: Sequence[str], classes: Sequence[str] = MODEL_CLASSES, by: Sequence[str] = ()
) -> DataFrame:
    """Hits, predicted and real counts, precision, recall and F1 per model and class.

    Each confusion cell contributes to its real and to its predicted class, and the
    empty (model, class) pairs are unioned in, so no joins are needed.
    Predictions outside ``classes`` lower recall only.
    """
    zero = F.lit(0).cast("bigint")
    entry = lambda label, hits, predicted, actual: F.struct(
        label.alias("label"), hits.alias("tp"), predicted.alias("n_pred"), actual.alias("n_real")
    )
    n = F.col("n")
    hit = F.when(F.col("real") == F.col("predicted"), n).otherwise(zero)
    cells = table.select(*by, "model", F.explode(F.array(
        entry(F.col("real"), hit, zero, n), entry(F.col("predicted"), zero, n, zero)
    )).alias("e")).select(*by, "model", "e.*")
    if not by:
        spine = table.sparkSession.createDataFrame(
            [(m, c, 0, 0, 0) for m in models for c in classes],
            "model string, label string, tp bigint, n_pred bigint, n_real bigint",
        )
        cells = cells.unionByName(spine)
    totals = cells.where(F.col("label").isin(*classes)).groupBy(*by, "model", "label").agg(
        *[F.sum(c).alias(c) for c in ("tp", "n_pred", "n_real")]
    )
    precision, recall = ratio(F.col("tp"), F.col("n_pred")), ratio(F.col("tp"), F.col("n_real"))
    return totals.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1", ratio(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )


def metrics_in_pct(metrics: DataFrame, digits: int = 2) -> DataFrame:
    """The three ratios as rounded percentages."""
    return metrics.select(
        "model", "label", "tp", "n_pred", "n_real",
        *[round_binary(100.0 * F.col(c), digits).alias(f"{c}_pct") for c in ("precision", "recall", "f1")],
    )


def balanced_accuracy(metrics: DataFrame, by: Sequence[str] = (), undefined_as_zero: bool = False) -> DataFrame:
    """Mean recall and mean F1 over classes, in percent.

    An undefined F1 is skipped (SQL averages) or counted as zero (``undefined_as_zero``).
    """
    f1 = F.coalesce("f1", F.lit(0.0)) if undefined_as_zero else F.col("f1")
    return metrics.groupBy(*by, "model").agg(
        round_binary(100.0 * F.avg("recall"), 2).alias("balanced_accuracy_pct"),
        round_binary(100.0 * F.avg(f1), 2).alias("macro_f1_pct"),
    )


def common_rows(
    model_predictions: DataFrame, evaluation: DataFrame, keys: Sequence[str],
    predictions: Sequence[str], classes: Sequence[str] = MODEL_CLASSES,
) -> DataFrame:
    """Rows every model has predicted, with a real state among ``classes``."""
    joined = model_predictions.join(evaluation, list(keys)).na.drop(subset=list(predictions))
    return joined.where(F.col("real").isin(*classes))


def balanced_accuracy_by(df: DataFrame, real: str, predictions: dict[str, str], key: str) -> DataFrame:
    """Balanced accuracy per value of ``key`` and model over the classes present, with the rows it rests on."""
    table = confusion(df, real, predictions, [key])
    classes = table.groupBy(key, "model", "real").agg(
        F.sum("n").alias("n_real"),
        F.sum(F.when(F.col("real") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"),
    )
    return classes.groupBy(key, "model").agg(
        F.sum("n_real").alias("n"),
        (100.0 * F.avg(ratio(F.col("tp"), F.col("n_real")))).alias("balanced_accuracy"),
    )


def compare_models(scores: DataFrame, base: str, digits: int = 1) -> DataFrame:
    """Scores of all models with the gain of ``base`` over each of them, in points.

    The window spans the score table, which has one row per model.
    """
    all_models = Window.partitionBy()
    own = F.max(F.when(F.col("model") == base, F.col("balanced_accuracy_pct"))).over(all_models)
    return scores.withColumn("gain_points", round_binary(own - F.col("balanced_accuracy_pct"), digits))
