"""Metrics, thresholds, drift scores and their invariants."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlake.operators import drift as dr
from churnlake.operators import evaluate as ev
from churnlake.operators.ranking import running_totals, spread_rank


def _scores(spark, n=2000, seed=1, ties=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        p = min(max(rng.gauss(0.4 + 0.2 * y, 0.2), 0.0), 1.0)
        rows.append((i, y, round(p, 2) if ties else p, i % 5))
    return rows, spark.createDataFrame(rows, "id int, y int, p double, fold int").repartition(6)


def _auc(rows):
    pos = np.array([p for _, y, p, _ in rows if y])
    neg = np.array([p for _, y, p, _ in rows if not y])
    d = pos[:, None] - neg[None, :]
    return ((d > 0).sum() + 0.5 * (d == 0).sum()) / d.size


@pytest.mark.parametrize("ties", [True, False])
def test_auc_is_exact_and_complements(spark, ties):
    rows, df = _scores(spark, ties=ties)
    got = ev.roc_auc(df, "p", "y").first()["roc_auc"]
    assert got == pytest.approx(_auc(rows), abs=1e-12)
    flipped = ev.roc_auc(df.withColumn("p", -F.col("p")), "p", "y").first()["roc_auc"]
    assert got + flipped == pytest.approx(1.0, abs=1e-12)


def test_auc_per_group_and_one_class(spark):
    rows, df = _scores(spark)
    df = df.withColumn("y", F.when(F.col("fold") == 4, 0).otherwise(F.col("y")))
    got = {r["fold"]: r["roc_auc"] for r in ev.roc_auc(df, "p", "y", ["fold"]).collect()}
    assert got[4] is None
    assert got[2] == pytest.approx(_auc([r for r in rows if r[3] == 2]), abs=1e-12)
    summary = {r["metric"]: r["mean"] for r in ev.cv_summary(ev.fold_metrics(df, "fold", "y", "p")).collect()}
    assert summary["roc_auc"] == pytest.approx(np.mean([got[k] for k in range(4)]), abs=1e-12)


def test_auc_of_no_rows(spark):
    df = spark.createDataFrame([], "p double, y int")
    assert ev.roc_auc(df, "p", "y").first()["roc_auc"] is None


def test_threshold_matches_brute_force(spark):
    rows, df = _scores(spark)
    best, at = 0.0, 0.5
    for t in [i * 0.01 for i in range(1, 100)]:
        tp = sum(1 for _, y, p, _ in rows if y and p >= t)
        fp = sum(1 for _, y, p, _ in rows if not y and p >= t)
        fn = sum(1 for _, y, p, _ in rows if y and p < t)
        f1 = 2 * tp / (2 * tp + fp + fn) if tp else 0.0
        if f1 > best:
            best, at = f1, t
    got = ev.best_threshold(df, "y", "p").first()
    assert (got["threshold"], got["f1"]) == (at, pytest.approx(best, abs=1e-12))


def test_threshold_defaults_without_positives(spark):
    df = spark.createDataFrame([(0, 0.3), (0, 0.9)], "y int, p double")
    assert tuple(ev.best_threshold(df, "y", "p").first()) == (0.5, 0.0)
    assert tuple(ev.best_threshold(df.limit(0), "y", "p").first()) == (0.5, 0.0)


def test_zero_division_is_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, s int")
    row = ev.classification_metrics(df, "y", F.col("s")).first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1"]) == (1.0, 0.0, 0.0, 0.0)


def test_strict_and_inclusive_threshold(spark):
    df = spark.createDataFrame([(0.5,)], "p double")
    row = df.select(ev.predict(F.col("p")).alias("a"), ev.predict(F.col("p"), strict=True).alias("b")).first()
    assert tuple(row) == (1, 0)


def test_params_key_ignores_order(spark):
    df = spark.sql("SELECT map('b', '2', 'a', '1') AS x, map('a', '1', 'b', '2') AS y")
    row = df.select(ev.params_key(F.col("x")).alias("x"), ev.params_key(F.col("y")).alias("y")).first()
    assert row["x"] == row["y"] == '{"a":"1","b":"2"}'


def test_retrain_evaluation_needs_threshold(spark):
    df = spark.createDataFrame([("a", "success", 0.6), ("b", "failed", None)], "model string, status string, f1 double")
    row = ev.retrain_evaluation(df).first().asDict()
    assert row == {
        "total_models": 2, "successful_models": 1, "failed_models": 1, "models_meeting_threshold": 0,
        "best_model": None, "best_score": 0.0,
    }


def test_running_totals_over_many_slices(spark):
    df = spark.range(10_000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"), F.lit(1).alias("one"))
    got = running_totals(df.repartition(7), ["k"], ["v"], {"up": "one"})
    assert got.where(F.col("up") != F.floor(F.col("v") / 3) + 1).count() == 0
    assert got.count() == 10_000


def test_ranks_keep_null_groups_and_hot_groups(spark):
    """One label holds most rows and some rows have no label; nobody is lost and ranks are dense."""
    df = spark.range(6000).select("id", F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 10 < 9, "a").otherwise("b").alias("g"))
    got = spread_rank(df, ["g"], ["id"], 42, size="n")
    per = {r["g"]: (r["n"], r["lo"], r["hi"], r["d"], r["size"]) for r in got.groupBy("g").agg(
        F.count("*").alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi"),
        F.count_distinct("rank").alias("d"), F.max("n").alias("size")).collect()}
    assert per == {None: (600, 1, 600, 600, 600), "a": (4800, 1, 4800, 4800, 4800), "b": (600, 1, 600, 600, 600)}


# Drift


def _live(spark, shift=0.0):
    rng = np.random.default_rng(5)
    rows = [(float(v), "abc"[i % 3], i % 2) for i, v in enumerate(rng.normal(shift, 1.0, 3000))]
    return spark.createDataFrame(rows, "x double, c string, t int")


def test_no_drift_against_itself(spark):
    df = _live(spark)
    assert all(r["psi"] == 0.0 and not r["drifted"] for r in dr.psi(df, df, ["x", "c", "t"]).collect())
    assert all(r["ks"] == 0.0 and not r["shifted"] for r in dr.ks(df, df, ["x"]).collect())


def test_drift_is_found_and_summarised(spark):
    ref, live = _live(spark), _live(spark, 1.5)
    features, target = dr.psi(ref, live, ["x", "c"]), dr.psi(ref, live, ["t"], dr.TARGET_LIMIT)
    shift = dr.covariate_shift(dr.ks(ref, live, ["x"]))
    row = dr.summary(features, target, shift).first()
    assert (row["status"], row["drifted_features"], row["drift_ratio"]) == ("WARNING", 1, 0.5)
    assert not row["requires_action"] and row["distribution_drift"]
    kinds = [r["alert_type"] for r in dr.alerts(dr.summary(features, target, shift)).collect()]
    assert kinds == ["feature_drift", "distribution_drift"]


def test_constant_reference_nulls_and_new_categories(spark):
    ref = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (None, "b")], "x double, c string")
    live = spark.createDataFrame([(0.0, "z"), (2.0, None)], "x double, c string")
    assert dr.plan_bins(ref, ["x", "c"]) == {"x": [1.0], "c": None}
    counts = {(r["feature"], r["bin"]): (r["ref"], r["live"]) for r in dr.bin_counts(ref, live, dr.plan_bins(ref, ["x", "c"])).collect()}
    assert counts == {
        ("x", "0"): (0, 1), ("x", "1"): (2, 1), ("x", "null"): (1, 0),
        ("c", "=a"): (2, 0), ("c", "=b"): (1, 0), ("c", "=z"): (0, 1), ("c", "null"): (0, 1),
    }


def test_grouped_psi_equals_single_psi(spark):
    ref, live = _live(spark), _live(spark, 0.4)
    bins = dr.plan_bins(ref, ["x", "c"])
    counts = dr.binned(live.withColumn("w", F.lit(1)), bins, ["w"]).groupBy("w", "feature", "bin").agg(F.count("*").alias("n"))
    grouped = dr.psi_of_groups(counts, dr.reference_bins(ref, bins), ["w"])
    a = {r["feature"]: r["psi"] for r in grouped.collect()}
    b = {r["feature"]: r["psi"] for r in dr.psi(ref, live, ["x", "c"]).collect()}
    assert a == pytest.approx(b, abs=1e-9)


def test_ks_against_numpy(spark):
    ref, live = _live(spark), _live(spark, 0.3)
    a, b = (np.sort([r["x"] for r in d.collect()]) for d in (ref, live))
    grid = np.concatenate([a, b])
    want = np.abs(np.searchsorted(a, grid, "right") / len(a) - np.searchsorted(b, grid, "right") / len(b)).max()
    assert dr.ks(ref, live, ["x"]).first()["ks"] == pytest.approx(want, abs=1e-12)


def test_bands(spark):
    df = spark.createDataFrame([(0.05,), (0.1,), (0.25,), (0.3,)], "v double")
    got = [tuple(r) for r in df.select(dr.ratio_band(F.col("v")), dr.psi_band(F.col("v"))).collect()]
    assert got == [("green", "green"), ("yellow", "yellow"), ("yellow", "red"), ("red", "red")]


def test_null_and_the_category_null_are_different_bins(spark):
    ref = spark.createDataFrame([("null",)] * 50 + [("x",)] * 50, "c string")
    live = spark.createDataFrame([(None,)] * 50 + [("x",)] * 50, "c string")
    assert dr.psi(ref, live, ["c"]).first()["drifted"]
    assert not dr.psi(ref, ref, ["c"]).first()["drifted"]


def test_binned_distance_of_windows(spark):
    ref = spark.createDataFrame([(float(i), "k") for i in range(1000)], "v double, c string")
    rows = [(1, float(i), "k") for i in range(0, 1000, 3)] + [(2, 600.0 + i / 10, "k") for i in range(400)] + [(2, None, "k")]
    live = spark.createDataFrame(rows, "w int, v double, c string")
    bins = dr.plan_bins(ref, ["v", "c"])
    counts = dr.binned(live, bins, ["w"]).groupBy("w", "feature", "bin").count().withColumnRenamed("count", "n")
    out = {r["w"]: r for r in dr.ks_of_groups(counts, dr.reference_bins(ref, bins), {"v": 1000}, ["w"]).collect()}
    assert not out[1]["shifted"] and out[1]["ks"] < 0.02
    assert out[2]["shifted"] and abs(out[2]["ks"] - 0.6) < 0.02
