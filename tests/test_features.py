"""Derived features, imputation, encoding, scaling and the fitted pipeline."""

import math

import numpy as np
import pytest
from compare import DATA
from pyspark.sql import functions as F

from churnlake.functions import fields, formulas
from churnlake.operators import features as ft
from churnlake.operators.quantiles import column_modes, exact_quantiles
from churnlake.plans import preprocess as pp
from churnlake.plans.bindings import wide
from churnlake.plans.catalog.shared import CATEGORIES, NUMBERS
from churnlake.session import scratch_path, stage

# Two example customers and their derived features.
_NO_CHURN = {
    "revenue": 42.58250046, "mou": 387.0, "recchrge": 44.99000168, "directas": 0.495000005, "overage": 17.75,
    "changem": -95.0, "changer": -7.59250021, "dropvce": 10.33333302, "blckvce": 0.666666687, "unansvce": 31.33333397,
    "custcare": 0.666666687, "mourec": 124.3799973, "outcalls": 43.33333206, "incalls": 0.0, "peakvce": 94.33333588,
    "opeakvce": 130.0, "dropblk": 11.0, "months": 9.0, "models": 1.0, "eqpdays": 108.0, "age1": 0.0, "age2": 0.0,
    "children": 0.0, "credita": 1.0, "creditaa": 0.0, "prizmub": 1.0, "prizmtwn": 0.0, "refurb": 0.0, "truck": 0.0,
    "rv": 0.0, "occprof": 0.0, "occcler": 0.0, "occcrft": 0.0, "occret": 0.0, "occself": 0.0, "ownrent": 0.0,
    "marryyes": 0.0, "travel": 0.0, "pcown": 0.0, "creditcd": 1.0, "retcalls": 0.0, "retaccpt": 0.0, "newcelly": 0.0,
    "newcelln": 0.0, "refer": 0.0, "income": 2.0,
}
_GOLDEN = {
    "engagement_index": 4.333333, "model_change_rate": 0.1, "overage_ratio": 0.407274,
    "call_activity_score": 645.213331, "call_quality_issues": 53.333334, "cust_engagement_score": 0.666667,
    "overuse_behavior": 40.492501, "device_tenure_index": 1.58, "demographic_index": 0.0002, "socio_tier": 2.0,
    "occupation_class": 0.0, "household_lifestyle_score": 1.0, "churn_change_score": -102.5925,
}


def test_golden_row(spark):
    df = spark.createDataFrame([tuple(_NO_CHURN.values())], list(_NO_CHURN))
    row = ft.derive(df, ft.fit_derive(df)).first()
    assert {n: round(row[n], 6) for n in formulas.REGISTRY} == pytest.approx(_GOLDEN, abs=1e-6)


def test_rate_is_null_at_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0, -1.0)], "outcalls double, incalls double, months double")
    assert ft.derive(df, ["engagement_index"]).first()["engagement_index"] is None


def test_feature_skipped_for_nulls_and_missing_columns(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (1.0, 2.0, 3.0)], "models double, months double, eqpdays double")
    assert ft.fit_derive(df) == []
    out = ft.derive_production(df, ["model_change_rate", "device_tenure_index"])
    assert "model_change_rate" not in out.columns
    assert [r["device_tenure_index"] for r in out.collect()] == [0.0, 0.0]


def test_apply_equals_fit(spark):
    df = stage(wide(spark, f"{DATA}/sf0.001"), "t")
    params = pp.fit_preprocess(df, NUMBERS, CATEGORIES)
    fitted = pp.run_preprocess(df, params, keep=["customer_id"]).drop("churn")
    path = scratch_path(spark, "t-params")
    pp.save_params(params, spark, path)
    loaded = pp.load_params(spark, path)
    assert (loaded.fills, loaded.features, loaded.classes, loaded.scales) == (
        params.fills, params.features, params.classes, params.scales,
    )
    applied = pp.apply_preprocess(df, loaded, keep=["customer_id"])
    assert applied.columns == fitted.columns
    assert sorted(map(tuple, applied.collect())) == sorted(map(tuple, fitted.collect()))


def test_apply_is_a_projection(spark):
    df = stage(wide(spark, f"{DATA}/sf0.001"), "t")
    params = pp.fit_preprocess(df, NUMBERS, CATEGORIES)
    plan = pp.apply_preprocess(df, params)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_null_gate(spark):
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    with pytest.raises(pp.NullsRemain):
        pp.require_complete(df)
    assert {r["column"]: r["nulls"] for r in pp.null_gate(df).collect()} == {"a": 0, "b": 1}


def test_all_null_column_and_empty_frame(spark):
    schema = "a double, b double, c string, d int"
    df = spark.createDataFrame([(None, 1.0, None, None), (None, 3.0, None, 2)], schema)
    fills = ft.fit_median_mode(df, ["a", "b"], ["c", "d"])
    assert fills == {"c": "Unknown", "d": 2}
    assert ft.fit_mean_mode(df, drop=["d"]) == {}
    empty = spark.createDataFrame([], schema)
    assert ft.fit_median_mode(empty, ["a", "b"], ["c", "d"]) == {}
    assert ft.fit_scale(empty, ["a", "b"]) == {}
    assert exact_quantiles(empty, ["a"], [0.5]) == {"a": [None]}


def test_mode_ties_take_the_smallest(spark):
    df = spark.createDataFrame([(10, "b", 2.5), (9, "a", 1.5), (10, "b", 1.5), (9, "a", 2.5)], "i int, s string, d double")
    assert column_modes(df, ["i", "s", "d"]) == {"i": 9, "s": "a", "d": 1.5}


@pytest.mark.parametrize("kind", ["spread", "ties", "two_heavy"])
def test_quantiles_by_narrowing(spark, kind):
    rng = np.random.default_rng(3)
    n = 20_000
    values = {
        "spread": rng.normal(size=n),
        "ties": np.round(rng.exponential(size=n), 1),
        "two_heavy": np.where(rng.random(n) < 0.6, 1.0, rng.random(n) + 1.0),
    }[kind]
    extra = [(None,), (float("nan"),)]
    df = spark.createDataFrame([(float(v),) for v in values] + extra, "v double").repartition(5)
    probs = [0.1, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, ["v"], probs, accuracy=16)["v"]
    assert got == pytest.approx(list(np.quantile(values, probs)), rel=0, abs=1e-12)
    assert exact_quantiles(df, ["v"], probs)["v"] == pytest.approx(got, abs=1e-12)


def test_labels_as_list_and_as_table_agree(spark):
    rows = [(i, f"v{i % 70:03d}", None if i % 9 == 0 else chr(97 + i % 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, wide string, narrow string")
    inline = ft.encode_labels(df, ft.fit_labels(df, ["wide", "narrow"]))
    table = ft.fit_labels(df, ["wide", "narrow"], inline=10)
    joined = ft.encode_labels(df, table, ["wide", "narrow"])
    a, b = (sorted(map(tuple, x.collect())) for x in (inline, joined))
    assert a == b
    assert all(r[1] == r[0] % 70 for r in a)
    assert all((r[2] == -1) == (r[0] % 9 == 0) for r in a)


def test_constant_column_scales_by_one(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "a double")
    scales = ft.fit_scale(df, ["a"])
    assert scales == {"a": (2.0, 1.0)}
    assert [r["a"] for r in ft.scale(df, scales).collect()] == [0.0, 0.0]


def test_numeric_target_is_cast(spark):
    df = spark.createDataFrame([(1.0,), (0.0,)], "churn double")
    assert [r["churn"] for r in ft.encode_target(df).collect()] == [1, 0]


def test_field_lists_are_consistent():
    assert (len(fields.NUMERIC), len(fields.CATEGORICAL), len(fields.DERIVED)) == (32, 34, 13)
    assert set(formulas.REGISTRY) == set(fields.DERIVED)
    assert sorted(n for g in formulas.GROUPS.values() for n in g) == sorted(fields.DERIVED)
    assert len(fields.NON_NEGATIVE) == 27 and len(fields.BINARY) == 33
    contract = fields.column_contract()
    assert len(contract) == 77 and not contract["revenue"]["allow_null"] and contract["age1"]["allow_null"]


def test_derived_null_propagates_per_row(spark):
    df = spark.createDataFrame([(1.0, 9.0), (None, 9.0)], "models double, months double")
    out = ft.derive(df, ["model_change_rate"]).select(F.col("model_change_rate").alias("x")).collect()
    assert out[0]["x"] == 0.1 and out[1]["x"] is None
    assert not math.isnan(out[0]["x"])


def test_a_heavy_value_of_a_wide_column_makes_no_heavy_task(spark):
    """Half of all rows hold one value and an eighth none: the join's tasks stay even, and codes equal the plain ones."""
    n = 8000
    rows = spark.range(n).select(
        "id", F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 8 == 1, None).otherwise(F.concat(F.lit("v"), F.col("id"))).alias("wide")
    )
    table = ft.fit_labels(rows, ["wide"], inline=10)
    assert table.where("share >= 0.25").select("value").collect() == [("hot",)]
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        coded = ft.encode_labels(rows, table, ["wide"])
        sizes = [r["n"] for r in coded.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        got = {r["id"]: r["wide"] for r in coded.collect()}
    finally:
        for k in keys:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 8 and max(sizes) <= 2 * sorted(sizes)[4]
    values = {r["id"]: r["wide"] for r in rows.collect()}
    order = {v: i for i, v in enumerate(sorted({v for v in values.values() if v is not None}))}
    assert got == {i: order.get(v, -1) for i, v in values.items()}
