"""Dataset statistics and the comparison of two data sets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import is_numeric, value_counts
from .ranking import beside


def shares(df: DataFrame, column: str) -> DataFrame:
    """``(value, n, share)`` of the non-null values of a column.

    The total is a scalar subquery over the counts; no window runs over the ungrouped result.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("value", "n", (F.col("n") / total).alias("share"))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Counts and shares per class, with the smallest share."""
    balance = shares(df, target)
    return balance.withColumn("min_share", balance.agg(F.min("share")).scalar())


def category_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of every value of every categorical column among its non-null values."""
    counts = value_counts(df, list(columns))
    # One row per listed column.
    totals = F.broadcast(counts.groupBy("column").agg(F.sum("n").alias("total")))
    return counts.join(totals, "column").select(
        F.col("column").alias("column_name"), "value", "n", (F.col("n") / F.col("total")).alias("share")
    )


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """``(column, n_distinct)`` of non-null values.

    Exact counting groups ``(column, value)`` rows, which spreads every column over all tasks and
    needs no row expansion after the shuffle; ``approximate`` uses sketches in one aggregate.
    """
    columns = list(columns)
    if approximate:
        row = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
        return row.unpivot([], columns, "column", "n_distinct")
    found = value_counts(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(found, "column", "left").select("column", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


def feature_types(df: DataFrame, target: str, exclude: Sequence[str] = (), counts: str | None = None) -> DataFrame:
    """``(column_name, kind)``: two-valued numbers are binary, other numbers continuous.

    A number is two-valued when none differs from both its minimum and its maximum, which takes two aggregates and
    no shuffle of values.  ``counts`` adds ``n_distinct``, ``"exact"`` or ``"approximate"``.
    """
    names = [c for c in df.columns if c != target and c not in exclude]
    numeric = [c for c, t in df.dtypes if is_numeric(t) and c in names]
    two = set(_two_valued(df, numeric))
    rows = [(c, "categorical" if c not in numeric else "binary" if c in two else "continuous") for c in names]
    kinds = df.sparkSession.createDataFrame(rows, "column_name string, kind string")
    if counts is None:
        return kinds
    found = distinct_counts(df, names, counts == "approximate")
    return kinds.join(found.withColumnRenamed("column", "column_name"), "column_name")


def _two_valued(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns with exactly two distinct values: one aggregate for the ends, one for the rest."""
    if not columns:
        return []
    ends = df.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]).first()
    open_ends = [c for c in columns if ends[f"lo_{c}"] != ends[f"hi_{c}"]]
    if not open_ends:
        return []
    between = df.agg(
        *[F.count(F.when(~F.col(c).isin(ends[f"lo_{c}"], ends[f"hi_{c}"]), 1)).alias(c) for c in open_ends]
    ).first()
    return [c for c in open_ends if between[c] == 0]


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(first, second, covariance, correlation)`` of every column pair, over the rows where both hold a number.

    After one aggregate of the means, one pass sums the centred values, squares and products of all pairs at once as
    matrix products; a task sends on one row per pair.
    """
    columns = list(columns)
    means = df.agg(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    centre = np.array([m if m is not None and np.isfinite(m) else 0.0 for m in means])
    first, second = np.triu_indices(len(columns), 1)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, len(first)))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(float) - centre
            known = np.isfinite(x)
            x, k = np.where(known, x, 0.0), known.astype(float)
            for i, m in enumerate((k.T @ k, x.T @ k, k.T @ x, (x * x).T @ k, k.T @ (x * x), x.T @ x)):
                sums[i] += m[first, second]
        rows = [pa.array(first.astype("i4")), pa.array(second.astype("i4")), *[pa.array(s) for s in sums]]
        yield pa.RecordBatch.from_arrays(rows, ["a", "b", "n", "sa", "sb", "saa", "sbb", "sab"])

    typed = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    parts = typed.mapInArrow(moments, "a int, b int, n double, sa double, sb double, saa double, sbb double, sab double")
    total = parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    names = F.array(*[F.lit(c) for c in columns])
    spread = F.expr("sqrt((saa - sa * sa / n) * (sbb - sb * sb / n))")
    together = F.expr("sab - sa * sb / n")
    return total.select(
        names[F.col("a")].alias("first"),
        names[F.col("b")].alias("second"),
        F.when(F.col("n") > 1, together / (F.col("n") - 1)).alias("covariance"),
        F.when(F.col("n") > 1, F.try_divide(together, spread)).alias("correlation"),
    )


def distribution_diff(reference: DataFrame, live: DataFrame, column: str, mode: str = "complete") -> DataFrame:
    """Sum of absolute share differences of a column.

    ``complete`` counts a value seen on one side only with its whole share; ``matched`` sums over
    the values both sides have.
    """
    left = shares(reference, column).select("value", F.col("share").alias("a"))
    right = shares(live, column).select("value", F.col("share").alias("b"))
    if mode == "matched":
        both = left.join(right, "value")
        return both.agg(F.coalesce(F.sum(F.abs(F.col("a") - F.col("b"))), F.lit(0.0)).alias("difference"))
    both = left.join(right, "value", "full_outer")
    gap = F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))
    return both.agg(F.coalesce(F.sum(gap), F.lit(0.0)).alias("difference"))


def compare_datasets(
    original: DataFrame,
    other: DataFrame,
    target: str,
    continuous: Sequence[str],
    categorical: Sequence[str],
) -> DataFrame:
    """``(metric, feature, value)``: target difference, relative mean differences, kept categories, correlation."""
    parts = [
        distribution_diff(original, other, target, "matched").select(
            F.lit("target_difference").alias("metric"), F.lit(target).alias("feature"), F.col("difference").alias("value")
        )
    ]
    continuous = list(continuous)
    if continuous:
        with_corr = len(continuous) >= 2

        def moments(df: DataFrame, tag: str) -> DataFrame:
            aggregates = [F.avg(c).alias(f"{tag}{i}") for i, c in enumerate(continuous)]
            if with_corr:
                aggregates.append(F.corr(continuous[0], continuous[1]).alias(f"{tag}corr"))
            return df.agg(*aggregates)

        both = beside(moments(original, "a"), moments(other, "b"))
        rows = []
        for i, c in enumerate(continuous):
            gap = F.abs(F.col(f"a{i}") - F.col(f"b{i}"))
            relative = F.when(F.col(f"a{i}") != 0, gap / F.col(f"a{i}")).otherwise(gap)
            rows.append(("mean_difference", c, relative))
        if with_corr:
            rows.append(
                ("correlation_difference", f"{continuous[0]}~{continuous[1]}", F.abs(F.col("acorr") - F.col("bcorr")))
            )
        listed = F.array(
            *[F.struct(F.lit(m).alias("metric"), F.lit(f).alias("feature"), v.alias("value")) for m, f, v in rows]
        )
        parts.append(both.select(F.inline(listed)))
    if categorical:
        a = distinct_counts(original, categorical).withColumnRenamed("n_distinct", "a")
        b = distinct_counts(other, categorical).withColumnRenamed("n_distinct", "b")
        kept = F.when(F.col("a") > 0, F.col("b") / F.col("a")).otherwise(F.lit(1.0))
        parts.append(
            a.join(b, "column").select(
                F.lit("category_preservation").alias("metric"), F.col("column").alias("feature"), kept.alias("value")
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def missing_categories(reference: DataFrame, live: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values the reference has and the live data lacks, per column."""
    seen = value_counts(live, list(columns)).select("column", "value")
    wanted = value_counts(reference, list(columns)).select("column", "value")
    return wanted.join(seen, ["column", "value"], "left_anti").select(F.col("column").alias("column_name"), "value")


def churn_by_segment(df: DataFrame, segment: str, target: str, measure: str) -> DataFrame:
    """Customers, churn rate and mean of a measure per segment."""
    return df.groupBy(segment).agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg(F.col(target).cast("double")).alias("churn_rate"),
        F.avg(measure).alias(f"mean_{measure}"),
    )
