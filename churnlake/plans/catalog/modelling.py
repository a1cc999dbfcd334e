"""Queries for training, scoring and the model registry.

Training runs over all customers with balanced classes and searches the declared spaces in full.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.scalars import pack
from ...functions.scalars import r6 as _r6
from ...operators import models as md
from ...operators import registry as rg
from ...operators import trees as tr
from ...operators.sampling import stratified_split
from ...session import scratch_path, stage
from ...sources import tables as tb
from .. import preprocess as pp
from .. import retrain as rt
from .. import scoring as sc
from ..bindings import prelude, view, wide
from .base import QUERIES, query, r6
from .shared import CATEGORIES, FLAGS, NUMBERS, W_SQL, landed


def table(spark, sf):
    """The preprocessed training table, written once, and its parameters."""
    data, params, _ = prepared(spark, sf)
    return data, params


def prepared(spark, sf):
    """Training table, parameters and the customer table they come from."""
    df = landed(spark, sf)
    params = pp.fit_preprocess(df, NUMBERS, CATEGORIES)
    return stage(pp.run_preprocess(df, params, keep=["customer_id"]), "features"), params, df


def _summary(trained):
    return md.metric_rows(trained).withColumns({c: _r6(F.col(c)) for c in ("mean", "std")})


@query("train_rf")
def _(spark, sf):
    data, params = table(spark, sf)
    return _summary(md.train_forest(data, params.features, "churn", "customer_id"))


@query("train_gbt")
def _(spark, sf):
    data, params = table(spark, sf)
    return _summary(md.train_boosted(data, params.features, "churn", "customer_id"))


@query("train_mlp")
def _(spark, sf):
    data, params = table(spark, sf)
    return _summary(md.train_network(data, params.features, "churn", "customer_id"))


def _quick_model(data, params):
    return md.pipeline("random_forest", {"numTrees": 20, "maxDepth": 5}, params.features, "churn").fit(data)


@query("evaluate_model")
def _(spark, sf):
    """A model fitted on the training side, judged on rows it has not seen."""
    data, params = table(spark, sf)
    split = stage(stratified_split(data, "churn", ["customer_id"], name="_test"), "split")
    model = _quick_model(split.where(~F.col("_test")), params)
    return sc.evaluate_model(split.where("_test"), model, "churn")


_RAW_FIELDS = [*NUMBERS, *FLAGS, "prizm_cluster", "segment"]


@query("score_batch")
def _(spark, sf):
    data, params, df = prepared(spark, sf)
    schema = ", ".join(f"{c} {t}" for c, t in df.select(*_RAW_FIELDS).dtypes)
    known = F.when(F.col("nationkey") % 4 == 0, F.col("churn")).alias("known")
    # The store holds the customers in batches by nation; one of them is scored with the registered model.
    root, models = scratch_path(spark, "store"), scratch_path(spark, "models")
    stored = df.select(
        F.col("customer_id").alias("record_id"),
        F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, customer_id % 100)").alias("ts"),
        F.concat(F.lit("BATCH_"), (F.col("nationkey") % 5).cast("string")).alias("batch_id"),
        known,
        pack(_RAW_FIELDS).alias("features"),
    )
    tb.create_store(stored, root)
    rg.register_model(_quick_model(data, params), models, "random_forest", "v1", {}, spark, 0.3)
    model, threshold = rg.load_scorer(spark, models, "random_forest")
    store = tb.read_store(spark, root, stored.schema)
    scored = sc.score_stored_batch(store, "BATCH_3", schema, params, model, threshold, known="known")
    return scored.select("record_id", "ts", "prediction", _r6(F.col("confidence")).alias("confidence"))


@query(
    "score_batch_rows",
    f"""{W_SQL} SELECT customer_id AS record_id, CASE WHEN nationkey % 4 = 0 THEN churn END AS known_prediction,
    CASE WHEN nationkey % 4 = 0 THEN 1e0 END AS known_confidence, true AS consistent FROM w WHERE nationkey % 5 = 3""",
)
def _(spark, sf):
    """All of a scored batch but the model's own numbers: its rows, the known labels, and that labels follow scores."""
    scored = QUERIES["score_batch"](spark, sf)
    known = wide(spark, sf, ["customer_id", "nationkey"]).withColumnRenamed("customer_id", "record_id")
    given = F.col("nationkey") % 4 == 0
    follows = (F.col("prediction") == 1) | (F.col("confidence") >= 0.699999)
    return scored.join(known, "record_id").select(
        "record_id",
        F.when(given, F.col("prediction")).alias("known_prediction"),
        F.when(given, F.col("confidence")).alias("known_confidence"),
        (given | follows).alias("consistent"),
    )


# Trees as a table: two splits at the means of two columns each, leaves with the churn rate of their customers.
_PAIRS = [("months", "outcalls"), ("eqpdays", "models"), ("incalls", "uniqsubs")]
NODE_FEATURES = [c for pair in _PAIRS for c in pair]


def _tree_sql(number: int, first: str, second: str) -> str:
    mean = "(SELECT avg({0}) FROM {{w}})"
    above, over = f"{first} > {mean.format(first)}", f"{second} > {mean.format(second)}"
    leaf = f"SELECT {number}, {{0}}, -1, 0e0, avg(churn) - 0.5e0 FROM {{{{w}}}} WHERE {{1}}"
    parts = [
        f"SELECT {number} AS tree, 0 AS node, {2 * number} AS feature, avg({first}) AS threshold, 0e0 AS value FROM {{w}}",
        f"SELECT {number}, 1, {2 * number + 1}, avg({second}), 0e0 FROM {{w}}",
        leaf.format(2, above).replace("{{w}}", "{w}"),
        leaf.format(3, f"NOT {above} AND NOT {over}").replace("{{w}}", "{w}"),
        leaf.format(4, f"NOT {above} AND {over}").replace("{{w}}", "{w}"),
    ]
    return " UNION ALL ".join(parts)


_NODES = " UNION ALL ".join(_tree_sql(i, a, b) for i, (a, b) in enumerate(_PAIRS))
_SCORED = f"""{W_SQL}, nodes AS ({_NODES.format(w="w")}),
  rows AS (SELECT customer_id, churn, [{", ".join(f"CAST({c} AS DOUBLE)" for c in NODE_FEATURES)}] AS x FROM w)"""
_WALK = """walk AS (
    SELECT customer_id, churn, x, tree, node, feature, threshold, value FROM rows, nodes WHERE node = 0
    UNION ALL SELECT customer_id, churn, x, n.tree, n.node, n.feature, n.threshold, n.value FROM walk w JOIN nodes n
      ON n.tree = w.tree AND n.node = 2 * w.node + 1 + CAST(x[w.feature + 1] > w.threshold AS INTEGER) WHERE w.feature >= 0
  ), p AS (SELECT customer_id, any_value(churn) AS churn, 1 / (1 + exp(-sum(value))) AS p FROM walk WHERE feature < 0 GROUP BY customer_id)"""
_P_SQL = _SCORED.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _WALK
NODE_SCORES_SQL = f"""{_P_SQL} SELECT customer_id, CAST(p >= 0.5 AS INTEGER) AS prediction, {r6("greatest(p, 1 - p)")} AS confidence FROM p"""


def node_table_model(spark, df):
    """The ensemble of the node table that Spark derives from the customers."""
    nodes = spark.sql(_NODES, w=df)
    return tr.Ensemble.from_table(nodes, NODE_FEATURES, "logistic")


@query("score_nodes", NODE_SCORES_SQL)
def _(spark, sf):
    df = landed(spark, sf, ["customer_id", "churn", *NODE_FEATURES])
    scored = sc.score_rows(df, node_table_model(spark, df))
    return scored.select("customer_id", "prediction", _r6(F.col("confidence")).alias("confidence"))


@query(
    "evaluate_nodes",
    f"""{_P_SQL}, c AS (SELECT count(*) FILTER (churn = 1 AND p >= 0.4) AS tp, count(*) FILTER (churn = 0 AND p >= 0.4) AS fp,
    count(*) FILTER (churn = 1 AND p < 0.4) AS fn, count(*) FILTER (churn = 0 AND p < 0.4) AS tn FROM p),
  s AS (SELECT round(p, 9) AS p, count(*) FILTER (churn = 1) AS pos, count(*) FILTER (churn = 0) AS neg FROM p GROUP BY 1),
  u AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s),
  a AS (SELECT sum(pos * (below + neg / 2e0)) / (sum(pos) * sum(neg)) AS auc FROM u)
  SELECT tp, fp, fn, tn, {r6("(tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE)")} AS accuracy, {r6("tp / CAST(tp + fp AS DOUBLE)")} AS precision,
    {r6("tp / CAST(tp + fn AS DOUBLE)")} AS recall, {r6("2 * tp / CAST(2 * tp + fp + fn AS DOUBLE)")} AS f1, {r6("auc")} AS roc_auc FROM c, a""",
)
def _(spark, sf):
    df = landed(spark, sf, ["customer_id", "churn", *NODE_FEATURES])
    found = sc.evaluate_model(df, node_table_model(spark, df), "churn", 0.4)
    ratios = ("accuracy", "precision", "recall", "f1", "roc_auc")
    return found.select("tp", "fp", "fn", "tn", *[_r6(F.col(c)).alias(c) for c in ratios])


@query(
    "score_passthrough",
    f"""{prelude("scores")} SELECT customer_id, CASE WHEN fold < 2 THEN label ELSE CAST(p >= 0.5 AS INTEGER) END AS prediction,
    CASE WHEN fold < 2 THEN 1e0 ELSE {r6("greatest(p, 1 - p)")} END AS confidence FROM scores""",
)
def _(spark, sf):
    scores = view(spark, sf, "scores").withColumn("known", F.when(F.col("fold") < 2, F.col("label")))
    p = F.col("p")
    out = sc.pass_through(scores, "known", p >= 0.5, _r6(F.greatest(p, 1 - p)))
    return out.select(
        "customer_id", F.col("final_prediction").alias("prediction"), F.col("final_confidence").alias("confidence")
    )


@query(
    "training_schema_record",
    f"""{W_SQL}, c AS (SELECT churn, count(*) AS n FROM w GROUP BY churn)
  SELECT 'random_forest' AS model_type, 'v1' AS model_version, 'months:double,revenue:double,children:int' AS columns,
    'churn' AS target_column, '1.0' AS schema_version, 3 AS feature_count, CAST(sum(n) AS BIGINT) AS sample_count,
    string_agg(churn || '=' || n, ',' ORDER BY churn) AS class_distribution FROM c""",
)
def _(spark, sf):
    df = wide(spark, sf, ["months", "revenue", "children", "churn"])
    record = rg.training_schema_record(df, "random_forest", "v1", "churn")
    columns = F.transform("required_columns", lambda c: F.concat_ws(":", c, F.element_at("dtypes", c)))
    classes = F.transform(F.map_entries("class_distribution"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return record.select(
        "model_type", "model_version", F.concat_ws(",", columns).alias("columns"), "target_column", "schema_version",
        "feature_count", "sample_count", F.concat_ws(",", classes).alias("class_distribution"),
    )


# A registry with one version per priority class and month.
_MODELS = """SELECT o_orderpriority AS model_type, concat('v', CAST(year(o_orderdate) AS STRING),
    lpad(CAST(month(o_orderdate) AS STRING), 2, '0')) AS version, max(o_orderdate) AS created_at,
    count(*) AS trained_rows FROM {orders} GROUP BY 1, 2"""
_MODELS_SQL = f"WITH m AS ({_MODELS.format(orders='orders')})"


@query(
    "latest_models",
    f"""{_MODELS_SQL} SELECT model_type, version, created_at, trained_rows FROM (SELECT *, row_number() OVER
    (PARTITION BY model_type ORDER BY created_at DESC, version DESC) AS rn FROM m) WHERE rn = 1""",
)
def _(spark, sf):
    return rg.latest_models(spark.sql(_MODELS, orders=view(spark, sf, "orders")))


@query(
    "list_models",
    f"""{_MODELS_SQL} SELECT model_type, count(*) AS versions, min(created_at) AS first_created, max(created_at) AS last_created,
    arg_max(version, (created_at, version)) AS latest_version FROM m GROUP BY model_type""",
)
def _(spark, sf):
    return rg.list_models(spark.sql(_MODELS, orders=view(spark, sf, "orders")))


@query("retrain_run")
def _(spark, sf):
    data, params = table(spark, sf)
    trainers = {
        "random_forest": md.train_forest,
        "gradient_boosting": md.train_boosted,
        "neural_net": md.train_network,
    }
    root = scratch_path(spark, "retrain")
    report = rt.run_retraining(data, trainers, params.features, "churn", "customer_id", root, "run_1")
    return report.select("retraining_id", "overall_status", "evaluation.*")
