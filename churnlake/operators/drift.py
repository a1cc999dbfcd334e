"""Drift between a reference and live data: population stability, distribution shift, alerts.

Definitions (the published formulas):

* PSI of a feature: the sum over bins of ``(live - ref) * ln(live / ref)`` of the bin shares, each
  at least 1e-4.  Numeric bins are the reference deciles with open ends, a bin number being the
  number of edges at or below the value; categories and nulls are bins of their own.
* Covariate shift: the share of numeric features whose two-sample KS distance exceeds its 5 %
  critical value ``1.358 * sqrt((n + m) / (n * m))``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles, is_numeric
from .ranking import beside, running_totals

FLOOR = 1e-4
FEATURE_LIMIT = 0.2
TARGET_LIMIT = 0.1
SHIFT_LIMIT = 0.5
KS_FACTOR = 1.358
_DECILES = [i / 10 for i in range(1, 10)]


def bin_edges(reference: DataFrame, columns: Sequence[str]) -> dict[str, list[float]]:
    """Distinct deciles of the reference per numeric column."""
    found = exact_quantiles(reference, columns, _DECILES)
    return {c: sorted({e for e in edges if e is not None}) for c, edges in found.items()}


def bin_of(column: str, edges: Sequence[float] | None) -> Column:
    """Bin label: the number of edges at or below a number, ``=`` and the text of a category, ``null`` for null."""
    c = F.col(column)
    if edges is None:
        label = F.concat(F.lit("="), c.cast("string"))
    else:
        index = F.lit(0)
        for e in edges:
            index = index + (c >= F.lit(float(e))).cast("int")
        label = index.cast("string")
    return F.when(c.isNull(), F.lit("null")).otherwise(label)


def binned(df: DataFrame, bins: Mapping[str, Sequence[float] | None], keep: Sequence[str] = ()) -> DataFrame:
    """``(keep…, feature, bin)``, one row per feature of every input row."""
    labels = df.select(*keep, *[bin_of(c, e).alias(c) for c, e in bins.items()])
    return labels.unpivot([F.col(k) for k in keep], list(bins), "feature", "bin")


def plan_bins(reference: DataFrame, columns: Sequence[str]) -> dict[str, list[float] | None]:
    """Edges for numeric columns, ``None`` for categories."""
    kinds = dict(reference.dtypes)
    numeric = [c for c in columns if is_numeric(kinds[c])]
    edges = bin_edges(reference, numeric)
    return {c: edges.get(c) for c in columns}


def bin_counts(reference: DataFrame, live: DataFrame, bins: Mapping[str, Sequence[float] | None]) -> DataFrame:
    """``(feature, bin, ref, live)`` counts of both sides from one grouping.

    Both sides are stacked rather than joined, so a bin seen on one side only needs no outer join
    and the rows are counted before they are shuffled.
    """
    a = binned(reference, bins).withColumn("side", F.lit(0))
    b = binned(live, bins).withColumn("side", F.lit(1))
    return (
        a.unionByName(b)
        .groupBy("feature", "bin")
        .agg(F.count(F.when(F.col("side") == 0, 1)).alias("ref"), F.count(F.when(F.col("side") == 1, 1)).alias("live"))
    )


def term(live: Column, ref: Column) -> Column:
    """Contribution of one bin to the PSI; shares are floored."""
    a, b = F.greatest(live, F.lit(FLOOR)), F.greatest(ref, F.lit(FLOOR))
    return (a - b) * F.log(a / b)


def psi(reference: DataFrame, live: DataFrame, columns: Sequence[str], limit: float = FEATURE_LIMIT) -> DataFrame:
    """``(feature, psi, drifted)``."""
    counts = bin_counts(reference, live, plan_bins(reference, columns))
    # One row per feature, so the totals are as many as the columns listed by the caller.
    totals = F.broadcast(counts.groupBy("feature").agg(F.sum("ref").alias("n"), F.sum("live").alias("m")))
    share = term(F.try_divide(F.col("live"), F.col("m")), F.try_divide(F.col("ref"), F.col("n")))
    scored = counts.join(totals, "feature").groupBy("feature").agg(F.sum(share).alias("psi"))
    return scored.withColumn("drifted", F.col("psi") > limit)


def ks(reference: DataFrame, live: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, ks, critical, shifted)`` for numeric columns, nulls skipped.

    Both sides are counted per distinct value; the two distribution functions are running totals
    over those values, range-partitioned within each feature.
    """

    def long(df: DataFrame, side: int) -> DataFrame:
        typed = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
        return typed.unpivot([], list(columns), "feature", "value").withColumn("side", F.lit(side))

    counts = (
        long(reference, 0)
        .unionByName(long(live, 1))
        .where(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count(F.when(F.col("side") == 0, 1)).alias("ref"), F.count(F.when(F.col("side") == 1, 1)).alias("live"))
    )
    swept = running_totals(
        counts, ["feature"], ["value"], {"ref_up": "ref", "live_up": "live"}, totals={"n": "ref", "m": "live"}
    )
    gap = F.abs(F.try_divide(F.col("ref_up"), F.col("n")) - F.try_divide(F.col("live_up"), F.col("m")))
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    return (
        swept.groupBy("feature", "n", "m")
        .agg(F.coalesce(F.max(gap), F.lit(0.0)).alias("ks"))
        .withColumn("critical", F.lit(KS_FACTOR) * F.sqrt(F.try_divide(n + m, n * m)))
        .select("feature", "ks", "critical", F.coalesce(F.col("ks") > F.col("critical"), F.lit(False)).alias("shifted"))
    )


def ks_of_groups(counts: DataFrame, reference: DataFrame, sizes: Mapping[str, int], keys: Sequence[str]) -> DataFrame:
    """``(keys…, feature, ks, shifted)`` of the numeric features of each group, from bin counts ``(keys…, feature, bin, n)``.

    The distance is taken at the reference deciles, the bins' edges, so it never exceeds the one over all values.
    ``sizes`` has the number of reference values per numeric feature; nulls are left out.
    """
    numbered = F.col("bin").rlike("^[0-9]+$")
    entry = lambda c: F.map_from_entries(F.collect_list(F.struct(F.col("bin").cast("int"), F.col(c))))
    ref = reference.where(numbered).groupBy("feature").agg(entry("ref_share").alias("ref"), F.sum("ref_share").alias("whole"))
    listed = reference.sparkSession.createDataFrame(list(sizes.items()), "feature string, m bigint")
    ref = F.broadcast(ref.join(listed, "feature"))  # one row per column listed by the caller
    live = counts.where(numbered).groupBy(*keys, "feature").agg(entry("n").alias("live"), F.sum("n").alias("rows"))
    ks = f"""aggregate(sequence(0, {len(_DECILES)}), named_struct('r', 0D, 'l', 0D, 'd', 0D), (a, i) ->
      named_struct('r', a.r + coalesce(ref[i] / whole, 0D), 'l', a.l + coalesce(live[i] / rows, 0D), 'd',
        greatest(a.d, abs(a.r + coalesce(ref[i] / whole, 0D) - a.l - coalesce(live[i] / rows, 0D)))), a -> a.d)"""
    n, m = F.col("rows").cast("double"), F.col("m").cast("double")
    critical = F.lit(KS_FACTOR) * F.sqrt((n + m) / (n * m))
    scored = live.join(ref, "feature").withColumn("ks", F.expr(ks))
    return scored.select(*keys, "feature", "ks", (F.col("ks") > critical).alias("shifted"))


def covariate_shift(ks_result: DataFrame, limit: float = SHIFT_LIMIT) -> DataFrame:
    """One row: shifted share of the features and the verdict."""
    share = F.coalesce(F.avg(F.col("shifted").cast("double")), F.lit(0.0))
    return ks_result.agg(share.alias("shift_share")).withColumn("shift_detected", F.col("shift_share") >= limit)


def summary(features: DataFrame, target: DataFrame, shift: DataFrame) -> DataFrame:
    """One row with the overall status, the three verdicts, and the drifted count and ratio.

    Target drift is CRITICAL, feature drift WARNING; distribution drift alone stays STABLE.
    """
    f = features.agg(
        F.count(F.lit(1)).alias("total_features"),
        F.count(F.when(F.col("drifted"), 1)).alias("drifted_features"),
    )
    t = target.agg(F.coalesce(F.bool_or("drifted"), F.lit(False)).alias("target_drift"), F.max("psi").alias("target_psi"))
    s = shift.select(F.col("shift_detected").alias("distribution_drift"))
    feature_drift = F.col("drifted_features") > 0
    status = F.when(F.col("target_drift"), "CRITICAL").when(feature_drift, "WARNING").otherwise("STABLE")
    return (
        beside(f, t, s)
        .select(
            status.alias("status"),
            "target_drift",
            feature_drift.alias("feature_drift"),
            "distribution_drift",
            "target_psi",
            "total_features",
            "drifted_features",
            F.coalesce(F.try_divide(F.col("drifted_features"), F.col("total_features")), F.lit(0.0)).alias("drift_ratio"),
            requires_action(status, F.col("target_drift")).alias("requires_action"),
        )
    )


def requires_action(status: Column, target_drift: Column) -> Column:
    return (status == "CRITICAL") | target_drift


# Alert types, the summary column that raises each, and their level.
ALERTS = [
    ("target_drift", "target_drift", "CRITICAL"),
    ("feature_drift", "feature_drift", "WARNING"),
    ("distribution_drift", "distribution_drift", "INFO"),
]


def alerts(summaries: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per raised alert with its type and level."""
    raised = F.array_compact(
        F.array(
            *[
                F.when(F.col(c), F.struct(F.lit(kind).alias("alert_type"), F.lit(level).alias("level")))
                for kind, c, level in ALERTS
            ]
        )
    )
    return summaries.select(*keep, "status", "requires_action", F.inline(raised))


def band(value: Column, yellow: float, red: float) -> Column:
    return F.when(value >= red, "red").when(value >= yellow, "yellow").otherwise("green")


def ratio_band(value: Column) -> Column:
    return band(value, 0.1, 0.3)


def psi_band(value: Column) -> Column:
    return band(value, 0.1, 0.2)


def reference_bins(reference: DataFrame, bins: Mapping[str, Sequence[float] | None]) -> DataFrame:
    """``(feature, bin, ref_share)`` of the reference."""
    counts = binned(reference, bins).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))
    totals = F.broadcast(counts.groupBy("feature").agg(F.sum("n").alias("total")))
    return counts.join(totals, "feature").select("feature", "bin", (F.col("n") / F.col("total")).alias("ref_share"))


def psi_of_groups(counts: DataFrame, reference: DataFrame, keys: Sequence[str], limit: float = FEATURE_LIMIT) -> DataFrame:
    """PSI per group of live bin counts ``(keys…, feature, bin, n)`` against fixed reference bins.

    A bin missing from a group counts with the floor share.  Instead of pairing every group with
    every reference bin, each feature starts from the PSI of an empty group and every bin that is
    present replaces its share of that.
    """
    nothing = F.lit(FLOOR)
    empty = reference.groupBy("feature").agg(F.sum(term(nothing, F.col("ref_share"))).alias("empty_psi"))
    totals = counts.groupBy(*keys, "feature").agg(F.sum("n").alias("rows"))
    ref_share = F.coalesce("ref_share", F.lit(0.0))
    moved = term(F.col("n") / F.col("rows"), ref_share) - term(nothing, ref_share)
    return (
        counts.join(totals, [*keys, "feature"])
        .join(reference, ["feature", "bin"], "left")
        .groupBy(*keys, "feature", "rows")
        .agg(F.sum(moved).alias("moved"))
        .join(empty, "feature", "left")
        .select(*keys, "feature", "rows", (F.col("moved") + F.coalesce("empty_psi", F.lit(0.0))).alias("psi"))
        .withColumn("drifted", F.col("psi") > limit)
    )
