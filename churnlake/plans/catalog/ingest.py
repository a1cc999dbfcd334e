"""Queries that write and read back: scans, snapshots, logs, exports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions import fields
from ...functions.scalars import r6 as _r6
from ...operators import evaluate as ev
from ...operators import features as ft
from ...operators.ranking import beside
from ...session import scratch_path
from ...sources import readers as rd
from ...sources import writers as wr
from .. import preprocess as pp
from ..bindings import view, wide
from . import evaluation, monitoring
from .base import listed, query, r6
from .shared import CATEGORIES, FILLED_SQL, NUMBERS, W_SQL, derived_sql, filled, landed


@query("scan_csv", f"{W_SQL} SELECT * FROM w")
def _(spark, sf):
    df = wide(spark, sf)
    path = scratch_path(spark, "csv")
    df.write.option("sep", ";").option("header", True).option("escape", '"').csv(path)
    return rd.read_csv(spark, path, df.schema, sep=";")


@query(
    "scan_configured",
    """SELECT type, count(*) AS orders, CAST(sum(o_custkey) AS BIGINT) AS customers, min(o_orderpriority) AS first_priority,
    max(o_orderdate) AS last_date FROM orders CROSS JOIN (SELECT unnest(['csv', 'json', 'orc', 'parquet', 'table']) AS type)
    GROUP BY type""",
)
def _(spark, sf):
    """The same orders through every kind of configured reader that needs no database."""
    df = view(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    parts = []
    for kind in ("csv", "json", "orc", "parquet", "table"):
        path = scratch_path(spark, kind)
        if kind == "csv":
            df.write.option("sep", "|").option("header", True).csv(path)
        elif kind != "table":
            df.write.format(kind).save(path)
        else:
            df.createOrReplaceTempView("configured_orders")
        config = {"type": kind, "path": path, "name": "configured_orders", "schema": df.schema, "delimiter": "|"}
        parts.append(rd.read_configured(spark, config).withColumn("type", F.lit(kind)))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("type").agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("o_custkey").alias("customers"),
        F.min("o_orderpriority").alias("first_priority"),
        F.max("o_orderdate").alias("last_date"),
    )


@query(
    "scan_train_test",
    f"""{W_SQL} SELECT customer_id, revenue, months, CASE WHEN churn = 1 THEN churn END AS churn,
    CASE WHEN churn = 1 THEN 'train' ELSE 'test' END AS dataset FROM w""",
)
def _(spark, sf):
    df = landed(spark, sf, ["customer_id", "revenue", "months", "churn"])
    train, test = scratch_path(spark, "train"), scratch_path(spark, "test")
    df.where("churn = 1").write.option("header", True).csv(train)
    unlabelled = df.where("churn = 0").drop("churn")
    unlabelled.write.option("header", True).csv(test)
    return rd.read_train_test(rd.read_csv(spark, train, df.schema), rd.read_csv(spark, test, unlabelled.schema))


@query(
    "scan_with_fallback",
    f"{W_SQL} SELECT customer_id, segment, 'csv' AS data_source FROM w ORDER BY customer_id LIMIT 100",
)
def _(spark, sf):
    df = wide(spark, sf, ["customer_id", "segment"])
    missing, path = scratch_path(spark, "missing"), scratch_path(spark, "fallback")
    df.write.option("header", True).csv(path)
    sources = [
        ("database", lambda: spark.read.parquet(missing)),
        ("csv", lambda: rd.read_csv(spark, path, df.schema)),
    ]
    return rd.read_with_fallback(sources, max_rows=100, order=["customer_id"])


_SAMPLE = ["months", "recchrge"]


@query(
    "scan_samples_json",
    f"""{W_SQL} SELECT 's' || customer_id AS sample_id, churn AS target, months, recchrge, 'lines' AS layout FROM w
  UNION ALL SELECT NULL, CASE WHEN segment = 'BUILDING' THEN 0 ELSE churn END, months, recchrge, 'flat' FROM w""",
)
def _(spark, sf):
    df = landed(spark, sf, ["customer_id", "segment", "churn", *_SAMPLE])
    nested, flat = scratch_path(spark, "nested"), scratch_path(spark, "flat")
    df.select(
        F.struct(*_SAMPLE).alias("features"),
        F.col("churn").alias("target"),
        F.concat(F.lit("s"), F.col("customer_id").cast("string")).alias("sample_id"),
    ).write.json(nested)
    # Flat records; those of one segment carry no target.
    df.select(*_SAMPLE, F.when(F.col("segment") != "BUILDING", F.col("churn")).alias("target")).write.json(flat)
    parts = [
        rd.read_samples(spark, path, lines=True).withColumn("layout", F.lit(layout))
        for path, layout in ((nested, "lines"), (flat, "flat"))
    ]
    values = [F.element_at("features", F.lit(c)).alias(c) for c in _SAMPLE]
    return parts[0].unionByName(parts[1]).select("sample_id", "target", *values, "layout")


# Sinks

# All columns of orders; the price as a decimal, whose text both engines write alike.
_ORDERS = {"o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "o_orderstatus": "o_orderstatus",
           "o_totalprice": "CAST(o_totalprice AS DECIMAL(18,2))", "o_orderdate": "o_orderdate",
           "o_orderpriority": "o_orderpriority"}
_HASHED = " || ".join(
    f"coalesce(length(CAST({e} AS VARCHAR)) || ':' || CAST({e} AS VARCHAR), 'n')" for e in _ORDERS.values()
)
_FINGERPRINT = f"CAST(sum(CAST(('0x' || substr(md5({_HASHED}), 1, 15))::BIGINT AS HUGEINT)) AS VARCHAR)"


def _orders(spark, sf):
    return view(spark, sf, "orders").selectExpr(*[f"{e} AS {n}" for n, e in _ORDERS.items()])


@query("content_fingerprint", f"SELECT count(*) AS record_count, {_FINGERPRINT} AS fingerprint FROM orders")
def _(spark, sf):
    return wr.content_fingerprint(_orders(spark, sf))


@query(
    "snapshot_write",
    f"""SELECT 'snapshot' AS copy, count(*) AS record_count, {_FINGERPRINT} AS fingerprint FROM orders
  UNION ALL SELECT 'backup', count(*), {_FINGERPRINT} FROM orders
  UNION ALL SELECT 'metadata', count(*), {_FINGERPRINT} FROM orders""",
)
def _(spark, sf):
    orders = _orders(spark, sf)
    root = scratch_path(spark, "raw")
    snapshot = wr.write_snapshot(orders, root, "20240101_000000", "csv")
    backup = wr.current(spark, f"{root}/backup")
    logged = spark.read.parquet(f"{root}/metadata").select(F.lit("metadata").alias("copy"), "record_count", "fingerprint")
    out = logged
    for name, df in (("snapshot", snapshot), ("backup", backup)):
        out = out.unionByName(wr.content_fingerprint(df).withColumn("copy", F.lit(name)))
    return out


@query("processed_write", f"{W_SQL} SELECT 'v2' AS version, count(*) AS row_count, 14 AS feature_count FROM w")
def _(spark, sf):
    df = landed(spark, sf)
    params = pp.fit_preprocess(df, NUMBERS, CATEGORIES)
    root = scratch_path(spark, "processed")
    wr.publish(pp.run_preprocess(df, params).where("churn = 1"), root, "v1")
    wr.publish(pp.run_preprocess(df, params), root, "v2")
    table = wr.current(spark, root)
    newest = wr.versions(spark, root).where("version = 'v2'").select("version", "feature_count")
    return beside(newest, table.agg(F.count(F.lit(1)).alias("row_count")))


@query(
    "monitor_log",
    f"""{monitoring._DRIFT}, {monitoring._SUMMARY} SELECT status, target_drift, feature_drift, distribution_drift,
    {r6("target_psi")} AS target_psi, total_features, drifted_features, {r6("drift_ratio")} AS drift_ratio,
    requires_action FROM sy""",
)
def _(spark, sf):
    path = scratch_path(spark, "monitor")
    out = monitoring._summary(spark, sf)
    wr.append_log(out, path)
    log = spark.read.schema(out.schema).json(path)
    return log.withColumns({c: _r6(F.col(c)) for c in ("target_psi", "drift_ratio")})


@query(
    "export_test_samples",
    f"""{FILLED_SQL}, d AS (SELECT customer_id, churn, {derived_sql(fields.DERIVED[:9])} FROM wi),
  t AS (SELECT *, row_number() OVER (PARTITION BY churn ORDER BY md5('42|' || customer_id), customer_id)
    <= floor(count(*) OVER (PARTITION BY churn) * 0.2e0 + 0.5e0) AS is_test FROM d)
  SELECT 'test_' || (row_number() OVER (ORDER BY md5('42|' || customer_id), customer_id) - 1) AS sample_id,
    churn AS target, {listed(fields.DERIVED[:9], r6('{0}') + ' AS {0}')} FROM t WHERE is_test""",
)
def _(spark, sf):
    names = fields.DERIVED[:9]
    path = scratch_path(spark, "samples")
    wr.test_samples(ft.derive(filled(spark, sf), names), "churn", "customer_id", names).write.json(path)
    back = rd.read_samples(spark, path, lines=True)
    return back.select("sample_id", "target", *[_r6(F.element_at("features", F.lit(n))).alias(n) for n in names])


@query(
    "retrain_report",
    f"""{evaluation._SCORES}, {evaluation._RESULTS}
  SELECT 'run_1' AS retraining_id, 'success' AS overall_status, count(*) AS total_models, count(*) AS reported,
    {r6("max(CASE WHEN status = 'success' AND f1 >= 0.7 THEN f1 END)")} AS best_score FROM r""",
)
def _(spark, sf):
    results = evaluation._results(spark, sf)
    report = wr.retrain_report(results, ev.retrain_evaluation(results), "run_1", 1.0)
    path = scratch_path(spark, "report")
    report.write.json(path)
    return (
        spark.read.schema(T.StructType(report.schema.fields))
        .json(path)
        .select(
            "retraining_id",
            "overall_status",
            "evaluation.total_models",
            F.size("results").cast("bigint").alias("reported"),
            _r6(F.col("evaluation.best_score")).alias("best_score"),
        )
    )
