"""Registry of binary classification metrics over the counts ``tp, fp, fn, tn``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(top: Column, bottom: Column) -> Column:
    """A ratio that is 0 where it is undefined."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def counts(label: Column, predicted: Column) -> dict[str, Column]:
    """Aggregates for the four confusion counts of 0/1 columns."""

    def n(a: int, b: int) -> Column:
        return F.count(F.when((label == a) & (predicted == b), 1))

    return {"tp": n(1, 1), "fp": n(0, 1), "fn": n(1, 0), "tn": n(0, 0)}


def ratios(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    return {
        "accuracy": _ratio(tp + tn, tp + fp + fn + tn),
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
    }


NAMES = ("accuracy", "precision", "recall", "f1")


def ratio_columns() -> list[Column]:
    """The metrics over columns already named ``tp, fp, fn, tn``."""
    return [c.alias(n) for n, c in ratios(*[F.col(x) for x in ("tp", "fp", "fn", "tn")]).items()]


def ratio(top: Column, bottom: Column) -> Column:
    return _ratio(top, bottom)
