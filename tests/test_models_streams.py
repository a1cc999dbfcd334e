"""Training, registry, retraining and streaming flows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlake.operators import models as md
from churnlake.operators import registry as rg
from churnlake.plans import retrain as rt
from churnlake.plans import scoring as sc
from churnlake.session import scratch_path, scratch_root
from churnlake.streaming import flows as fl
from churnlake.streaming import windows as wn

FOREST = {"numTrees": [10], "maxDepth": [2, 4], "featureSubsetStrategy": ["sqrt"], "minInstancesPerNode": [1]}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        a, b = rng.normal(size=2)
        rows.append((i, float(a), float(b), int(a + 0.5 * rng.normal() > 0.3)))
    return spark.createDataFrame(rows, "id bigint, a double, b double, y int")


def test_grid_and_draws():
    assert len(md.grid(md.FOREST_GRID)) == 16
    points = md.draws(md.BOOST_SPACE, 10)
    assert len(points) == 10 and points == md.draws(md.BOOST_SPACE, 10)
    assert all(1e-5 <= p["stepSize"] <= 1e-2 for p in md.draws(md.NETWORK_SPACE, 5))


def test_forest_finds_the_signal(spark, data):
    trained = md.train_forest(data, ["a", "b"], "y", "id", FOREST)
    assert trained.scores.count() == 400 and trained.folds.count() == 3
    assert trained.candidates.count() == 2
    metrics = {r["metric"]: r["mean"] for r in md.metric_rows(trained).collect()}
    assert metrics["roc_auc"] > 0.8 and set(metrics) == {"accuracy", "precision", "recall", "f1", "roc_auc"}
    row = sc.evaluate_model(data, trained.model, "y").first()
    assert row["roc_auc"] > 0.8 and row["tp"] + row["fp"] + row["fn"] + row["tn"] == 400


def test_boosted_and_network_find_the_signal(spark, data):
    boost = {"stepSize": [0.1], "maxDepth": [2, 3], "maxIter": [5], "subsamplingRate": [0.8], "featureSubsetStrategy": ["all"]}
    trained = md.train_boosted(data, ["a", "b"], "y", "id", boost, n=2, folds=2, inner=2, balance=False)
    assert trained.scores.select("id").distinct().count() == 400
    assert {r["metric"]: r["mean"] for r in md.metric_rows(trained).collect()}["roc_auc"] > 0.8
    net = md.train_network(data, ["a", "b"], "y", "id", {**md.NETWORK_SPACE, "units": [32]}, n=1, folds=2, balance=False)
    assert {r["metric"]: r["mean"] for r in md.metric_rows(net).collect()}["roc_auc"] > 0.8


def test_draws_give_the_whole_of_a_small_space():
    space = {"a": [1, 2, 3], "b": [1, 2]}
    assert len(md.draws(space, 10)) == 6 and len(md.draws(space, 4)) == 4
    assert len({str(p) for p in md.draws(space, 4)}) == 4


def test_learning_rate_of_the_network_matters(spark, data):
    def weights(rate):
        params = {"layers": 1, "units": 4, "stepSize": rate, "maxIter": 5}
        return md.pipeline("neural_net", params, ["a", "b"], "y").fit(data).stages[-1].weights.toArray()

    assert not np.allclose(weights(1e-5), weights(1e-2))


def test_threshold_is_kept_with_the_version(spark, data):
    root = scratch_path(spark, "models")
    model = md.pipeline("random_forest", {"numTrees": 3, "maxDepth": 2}, ["a", "b"], "y").fit(data)
    rg.register_model(model, root, "random_forest", "v1", {}, spark)
    assert rg.load_scorer(spark, root, "random_forest")[1] == 0.5
    rg.register_model(model, root, "random_forest", "v2", {}, spark, 0.31)
    assert rg.load_scorer(spark, root, "random_forest")[1] == 0.31


def test_registry_returns_the_newest(spark, data):
    root = scratch_path(spark, "models")
    model = md.pipeline("random_forest", {"numTrees": 3, "maxDepth": 2}, ["a", "b"], "y").fit(data)
    for version in ("v1", "v2"):
        rg.register_model(model, root, "random_forest", version, {"f1": 0.5}, spark)
    newest = rg.latest_models(rg.registry(spark, root)).first()
    assert newest["version"] == "v2" and newest["metrics"] == {"f1": 0.5}
    loaded = rg.load_latest(spark, root, "random_forest")
    a, b = (sc.score_rows(data.select("id", "a", "b"), m).orderBy("id").collect() for m in (model, loaded))
    assert a == b
    with pytest.raises(LookupError):
        rg.load_latest(spark, root, "other")


def test_known_label_is_the_prediction(spark, data):
    model = md.pipeline("random_forest", {"numTrees": 3, "maxDepth": 2}, ["a", "b"], "y").fit(data)
    known = data.select("id", "a", "b", F.when(F.col("id") < 10, 1 - F.col("y")).alias("k"), "y")
    out = sc.score_rows(known, model, known="k").where("id < 10").collect()
    assert all(r["prediction"] == 1 - r["y"] and r["confidence"] == 1.0 for r in out)


def test_retraining_reports_failures_and_stops_at_the_gate(spark, data):
    def broken(*_):
        raise RuntimeError("no")

    trainers = {"random_forest": lambda d, f, y, i: md.train_forest(d, f, y, i, {**FOREST, "maxDepth": [3]}, folds=2, balance=False), "bad": broken}
    report = rt.run_retraining(data, trainers, ["a", "b"], "y", "id", scratch_path(spark, "rt"), "r1").first()
    assert report["overall_status"] == "success"
    assert (report["evaluation"]["successful_models"], report["evaluation"]["failed_models"]) == (1, 1)
    with pytest.raises(rt.QualityGateFailed, match="class_balance, no_nulls"):
        holes = data.where("y = 0 OR id < 20").withColumn("a", F.when(F.col("id") != 5, F.col("a")))
        rt.run_retraining(holes, trainers, ["a", "b"], "y", "id", "/tmp/unused", "r2")


def _events(spark, parts):
    """Write events in several files; each holds one later stretch of time."""
    path = scratch_path(spark, "events")
    for i in range(parts):
        df = spark.range(i * 300, (i + 1) * 300).select(
            F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 20).alias("ts"),
            (F.col("id") % 11).cast("double").alias("value"),
            F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("kind"),
        )
        df.coalesce(1).write.mode("append").parquet(path)
    return path, df.schema


def test_sliding_stream_equals_batch_over_many_triggers(spark):
    path, schema = _events(spark, 4)
    batch = wn.sliding_counts(spark.read.schema(schema).parquet(path), "ts", ["kind"])
    stream = fl.read_files(spark, path, schema, per_batch=1)
    streamed = fl.collect_stream(wn.sliding_counts(stream, "ts", ["kind"], watermark="10 minutes"), "slide")
    got = {tuple(r) for r in streamed.collect()}
    want = {tuple(r) for r in batch.collect()}
    assert got and got <= want
    last = max(r[1] for r in got)
    assert got == {r for r in want if r[1] <= last}


def test_sliding_counts_cover_every_event(spark):
    path, schema = _events(spark, 1)
    out = wn.sliding_counts(spark.read.schema(schema).parquet(path), "ts", ["kind"])
    assert out.agg(F.sum("n")).first()[0] == 300 * 12


def test_ingest_stream_counts_add_up(spark):
    records = [(i, "Yes" if i % 2 else "maybe", str(30 - i), "1", "0") for i in range(40)]
    raw = spark.createDataFrame(records, "`Cust ID` int, Truck string, `Minutes of use` string, newcelly string, newcelln string")
    raw = raw.withColumnRenamed("Cust ID", "Cust_ID")
    path = scratch_path(spark, "raw")
    raw.repartition(3).write.json(path)
    root = scratch_path(spark, "flow")
    fl.run(fl.ingest_records(fl.read_files(spark, path, raw.schema, "json", per_batch=1), root, "json"))
    good = fl.written(spark, root, "good", "customer_id int, truck int, mou double").collect()
    bad = fl.written(spark, root, "quarantine", "customer_id int, errors array<string>").collect()
    log = fl.written(spark, root, "log", "records_processed bigint, records_saved bigint, records_failed bigint")
    totals = log.agg(*[F.sum(c) for c in log.columns]).first()
    assert tuple(totals) == (40, len(good), len(bad)) and len(bad) == 9
    assert all(r["errors"] == ["mou_non_negative"] for r in bad)
    assert all(r["truck"] == r["customer_id"] % 2 for r in good)


def test_dedupe_stream_keeps_one_per_key(spark):
    path = scratch_path(spark, "dup")
    df = spark.range(300).select((F.col("id") % 50).alias("k"), F.timestamp_seconds(F.col("id") % 50 + 1_700_000_000).alias("ts"))
    df.write.parquet(path)
    out = fl.collect_stream(fl.dedupe(fl.read_files(spark, path, df.schema), ["k", "ts"], "ts"), "dd")
    assert out.count() == 50 and out.select("k").distinct().count() == 50


def test_scratch_folder_is_configured_or_local(spark):
    assert scratch_root(spark) == scratch_root(spark)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
