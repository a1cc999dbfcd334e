"""Exact classification metrics, cross-validation summaries and threshold search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics
from .ranking import join_on_same, running_totals


def predict(score: Column, threshold: float = 0.5, strict: bool = False) -> Column:
    """0/1 label from a score: ``score >= threshold``, or ``>`` when strict."""
    hit = score > F.lit(threshold) if strict else score >= F.lit(threshold)
    return hit.cast("int")


def classification_metrics(df: DataFrame, label: str, predicted: Column, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1, in one aggregate."""
    found = metrics.counts(F.col(label), predicted)
    counted = df.groupBy(*by).agg(*[c.alias(n) for n, c in found.items()])
    return counted.select(*by, *found, *metrics.ratio_columns())


def classification_report(df: DataFrame, label: str, predicted: Column) -> DataFrame:
    """Per class precision, recall, F1 and support, then accuracy, macro and weighted averages.

    Works on the ``(label, predicted)`` counts, which have at most classes² rows.
    """
    pairs = df.groupBy(F.col(label).cast("string").alias("a"), predicted.cast("string").alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    hit = F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(F.lit(0))
    sides = F.array(
        F.struct(F.col("a").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("said"), hit.alias("tp")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("said"), F.lit(0).cast("bigint").alias("tp")),
    )
    classes = (
        pairs.select(F.inline(sides))
        .groupBy("class")
        .agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("tp").alias("tp"))
        .select(
            "class",
            "tp",
            metrics.ratio(F.col("tp"), F.col("said")).alias("precision"),
            metrics.ratio(F.col("tp"), F.col("support")).alias("recall"),
            metrics.ratio(2 * F.col("tp"), F.col("said") + F.col("support")).alias("f1"),
            "support",
        )
    )
    total = F.sum("support")
    summary = classes.agg(
        total.alias("support"),
        metrics.ratio(F.sum("tp"), total).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[metrics.ratio(F.sum(F.col(m) * F.col("support")), total).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")],
    )

    def line(name: str, *values: str) -> Column:
        named = zip(("precision", "recall", "f1"), values)
        return F.struct(F.lit(name).alias("class"), *[F.col(v).alias(m) for m, v in named], F.col("support"))

    averages = summary.select(
        F.inline(
            F.array(
                line("accuracy", "accuracy", "accuracy", "accuracy"),
                line("macro avg", "macro_precision", "macro_recall", "macro_f1"),
                line("weighted avg", "weighted_precision", "weighted_recall", "weighted_f1"),
            )
        )
    )
    return classes.drop("tp").unionByName(averages)


def roc_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve, tied scores counted half; null when a class is absent.

    Rows shrink to one per distinct score; each positive then needs the number of negatives
    scored lower, a running total that is range-partitioned by score.
    """
    distinct = (
        df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*by, F.col(score).alias("_score"))
        .agg(F.count(F.when(F.col(label) == 1, 1)).alias("_pos"), F.count(F.when(F.col(label) != 1, 1)).alias("_neg"))
    )
    ranked = running_totals(distinct, by, ["_score"], {"_below": "_neg"})
    wins = F.col("_pos") * (F.col("_below").cast("double") - F.col("_neg") / F.lit(2.0))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
    return ranked.groupBy(*by).agg(F.try_divide(F.sum(wins), pairs).alias("roc_auc"))


def fold_metrics(df: DataFrame, fold: str, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Every metric per fold."""
    counted = classification_metrics(df, label, predict(F.col(score), threshold), [fold])
    return join_on_same(counted.select(fold, *metrics.NAMES), roc_auc(df, score, label, [fold]), [fold], "left")


def cv_summary(folds: DataFrame, names: Sequence[str] = (*metrics.NAMES, "roc_auc")) -> DataFrame:
    """Mean and population deviation per metric over the folds that have it."""
    one = folds.agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names])
    rows = F.array(
        *[F.struct(F.lit(n).alias("metric"), F.col(f"m_{n}").alias("mean"), F.col(f"s_{n}").alias("std")) for n in names]
    )
    return one.select(F.inline(rows))


def pooled_f1(df: DataFrame, label: str, predicted: Column, by: Sequence[str] = ()) -> DataFrame:
    """F1 over the predictions of all folds together."""
    return classification_metrics(df, label, predicted, by).select(*by, F.col("f1").alias("pooled_f1"))


def params_key(params: Column) -> Column:
    """A parameter map as JSON text that does not depend on the order of its entries."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params))))


def best_params(df: DataFrame, params: Column, label: str, predicted: Column) -> DataFrame:
    """The parameter set with the best pooled F1, the first in text order on ties."""
    per_set = pooled_f1(df.withColumn("params_key", params_key(params)), label, predicted, ["params_key"])
    return per_set.agg(
        F.min_by("params_key", F.struct(-F.col("pooled_f1"), F.col("params_key"))).alias("best_params"),
        F.max("pooled_f1").alias("pooled_f1"),
    )


# Thresholds


def threshold_curve(df: DataFrame, label: str, score: str, first: int = 1, last: int = 99, step: float = 0.01) -> DataFrame:
    """Confusion counts and metrics at the thresholds ``i * step`` for ``i`` in ``first..last``.

    One pass gives every row the highest threshold index it reaches; the at most ``last + 1``
    resulting counts are then summed from the top.
    """
    p = F.col(score)
    guess = F.floor(p / F.lit(step)).cast("int")
    # The division may land one step off; compare with the exact threshold on both sides.
    reached = (
        F.when(p >= (guess + 1) * F.lit(step), guess + 1).when(p < guess * F.lit(step), guess - 1).otherwise(guess)
    )
    bucket = F.greatest(F.least(reached, F.lit(last)), F.lit(first - 1))
    counted = (
        df.where(p.isNotNull() & F.col(label).isNotNull())
        .groupBy(bucket.alias("i"))
        .agg(F.count(F.when(F.col(label) == 1, 1)).alias("pos"), F.count(F.when(F.col(label) != 1, 1)).alias("neg"))
    )
    steps = df.sparkSession.range(first - 1, last + 1).select(F.col("id").cast("int").alias("i"))
    at_least = Window.partitionBy(F.lit(0)).orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(F.lit(0))
    swept = (
        steps.join(counted, "i", "left")
        .fillna(0, ["pos", "neg"])
        .select(
            "i",
            F.sum("pos").over(at_least).alias("tp"),
            F.sum("neg").over(at_least).alias("fp"),
            F.sum("pos").over(everything).alias("_p"),
            F.sum("neg").over(everything).alias("_n"),
        )
        .withColumns({"fn": F.col("_p") - F.col("tp"), "tn": F.col("_n") - F.col("fp")})
        .where(F.col("i") >= first)
    )
    threshold = (F.col("i") * F.lit(step)).alias("threshold")
    return swept.select("i", threshold, "tp", "fp", "fn", "tn", *metrics.ratio_columns())


def best_threshold(df: DataFrame, label: str, score: str, first: int = 1, last: int = 99, step: float = 0.01) -> DataFrame:
    """The lowest threshold with the best F1; 0.5 and 0 when no threshold scores above 0."""
    curve = threshold_curve(df, label, score, first, last, step)
    best = curve.agg(
        F.min_by("threshold", F.struct(-F.col("f1"), F.col("i"))).alias("threshold"), F.max("f1").alias("f1")
    )
    found = F.coalesce(F.col("f1") > 0, F.lit(False))
    return best.select(
        F.when(found, F.col("threshold")).otherwise(F.lit(0.5)).alias("threshold"),
        F.when(found, F.col("f1")).otherwise(F.lit(0.0)).alias("f1"),
    )


# Retraining


def retrain_evaluation(results: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Totals, successes, failures, models that meet the F1 threshold, and the best of those.

    ``results`` holds ``model, status, f1``; the best score must be above 0.
    """
    ok = F.col("status") == "success"
    meets = ok & (F.coalesce("f1", F.lit(0.0)) >= threshold)
    ranked = F.when(meets & (F.col("f1") > 0), F.struct(-F.col("f1"), F.col("model")))
    return results.agg(
        F.count(F.lit(1)).alias("total_models"),
        F.count(F.when(ok, 1)).alias("successful_models"),
        F.count(F.when(~ok, 1)).alias("failed_models"),
        F.count(F.when(meets, 1)).alias("models_meeting_threshold"),
        F.min_by("model", ranked).alias("best_model"),
        F.coalesce(F.max(F.when(meets, F.col("f1"))), F.lit(0.0)).alias("best_score"),
    )


def best_model(results: DataFrame, metric: str) -> DataFrame:
    """The candidate with the highest primary metric, the first by name on ties."""
    return results.agg(
        F.min_by("model", F.struct(-F.col(metric), F.col("model"))).alias("best_model"), F.max(metric).alias(metric)
    )
