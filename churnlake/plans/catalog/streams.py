"""Queries that run a stream to completion and return what its sinks received.

A window reaches an append sink once the watermark passes its end, so the oracles stop at the last
window that closed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import fields
from ...functions.scalars import r6 as _r6
from ...operators import models as md
from ...operators import store as st
from ...session import scratch_path
from ...streaming import flows as fl
from ...streaming import windows as wn
from ..bindings import table, view, wide
from .base import query, r6
from .modelling import NODE_FEATURES, NODE_SCORES_SQL, node_table_model
from .modelling import table as feature_table
from .monitoring import WINDOWED_SQL
from .quality import _ERRORS_SQL
from .shared import W_SQL, landed

_CLOSED = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)"


def _events(spark, sf):
    return fl.read_files(spark, sf, table(spark, sf, "events").schema, pattern="events.parquet")


@query(
    "stream_rates",
    f"""SELECT * FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*) AS n,
    ROUND(count(*) / 300e0, 6) AS per_second FROM events GROUP BY 1, 2)
  WHERE window_start + INTERVAL 5 MINUTE <= {_CLOSED}""",
)
def _(spark, sf):
    rates = wn.tumbling_rates(_events(spark, sf), "ts", "5 minutes", 300, ["event_type"], watermark="10 minutes")
    out = wn.plain_times(fl.collect_stream(rates, "rates"))
    return out.withColumn("per_second", F.round("per_second", 6)).drop("window_end")


@query(
    "stream_avg",
    f"""SELECT * FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS n,
    {r6("sum(value) / count(*)")} AS mean_value FROM events GROUP BY 1) WHERE window_start + INTERVAL 5 MINUTE <= {_CLOSED}""",
)
def _(spark, sf):
    means = wn.tumbling_avg(_events(spark, sf), "ts", "5 minutes", "value", watermark="10 minutes")
    out = wn.plain_times(fl.collect_stream(means, "means"))
    return out.withColumn("mean_value", _r6(F.col("mean_value"))).drop("window_end")


_COLUMNS = ["value", "event_type", "label"]
_SPLIT = "TIMESTAMP_NTZ '2024-01-16 00:00:00'"


def _run_drift(spark, sf):
    """Stream the live half of the events against the reference half."""
    label = F.col("label").cast("string").alias("label")
    reference = view(spark, sf, "drift").where("side = 'ref'").select("value", "event_type", label)
    # The label as the view of the events defines it.
    live_label = F.when((F.col("ts") >= F.expr(_SPLIT)) | (F.col("event_id") % 5 == 0), 1).otherwise(0)
    live = (
        _events(spark, sf)
        .where(F.col("ts") >= F.expr(_SPLIT))
        .select("ts", "value", "event_type", live_label.cast("string").alias("label"))
    )
    root = scratch_path(spark, "drift")
    fl.run(fl.monitor_drift(live, reference, _COLUMNS, root, target="label"))
    return root


_WINDOW_KS = """m AS (SELECT count(*) AS m FROM drift WHERE side = 'ref'),
  kc AS (SELECT lt.window_start, lt.rows, k.i, coalesce(lc.n, 0) AS n, coalesce(rs.s, 0) AS s FROM lt CROSS JOIN range(0, 10) k(i)
    LEFT JOIN lc ON lc.window_start = lt.window_start AND lc.feature = 'value' AND lc.bin = CAST(k.i AS VARCHAR)
    LEFT JOIN rs ON rs.feature = 'value' AND rs.bin = CAST(k.i AS VARCHAR) WHERE lt.feature = 'value'),
  ku AS (SELECT window_start, rows, abs(sum(n) OVER up * 1e0 / rows - sum(s) OVER up) AS gap FROM kc
    WINDOW up AS (PARTITION BY window_start ORDER BY i)),
  kd AS (SELECT window_start, max(gap) > 1.358e0 * sqrt((max(rows) + max(m)) / (max(rows) * 1e0 * max(m))) AS shifted
    FROM ku CROSS JOIN m GROUP BY 1)"""


_TIMES = "window_start timestamp, window_end timestamp"


@query(
    "stream_drift",
    f"""{WINDOWED_SQL} SELECT window_start, feature, rows, {r6("psi")} AS psi, psi > 0.2 AS drifted FROM wp
  WHERE window_start + INTERVAL 1 HOUR <= {_CLOSED}""",
)
def _(spark, sf):
    root = _run_drift(spark, sf)
    scored = fl.written(spark, root, "psi", f"{_TIMES}, feature string, rows bigint, psi double, drifted boolean")
    return wn.plain_times(scored).withColumn("psi", _r6(F.col("psi"))).drop("window_end")


@query(
    "stream_alerts",
    f"""{WINDOWED_SQL}, {_WINDOW_KS}, s AS (SELECT window_start, bool_or(feature = 'label' AND psi > 0.1) AS target,
    bool_or(feature <> 'label' AND psi > 0.2) AS feature, bool_or(shifted) AS shifted FROM wp JOIN kd USING (window_start) GROUP BY 1)
  SELECT window_start, 'target_drift' AS alert_type, 'CRITICAL' AS level FROM s
    WHERE target AND window_start + INTERVAL 1 HOUR <= {_CLOSED}
  UNION ALL SELECT window_start, 'distribution_drift', 'INFO' FROM s
    WHERE target AND shifted AND window_start + INTERVAL 1 HOUR <= {_CLOSED}
  UNION ALL SELECT window_start, 'feature_drift', 'WARNING' FROM s
    WHERE target AND feature AND window_start + INTERVAL 1 HOUR <= {_CLOSED}""",
)
def _(spark, sf):
    root = _run_drift(spark, sf)
    schema = f"{_TIMES}, status string, requires_action boolean, alert_type string, level string"
    raised = fl.written(spark, root, "alerts", schema)
    return wn.plain_times(raised).select("window_start", "alert_type", "level")


@query(
    "stream_summary",
    f"""{WINDOWED_SQL}, {_WINDOW_KS}, s AS (SELECT window_start, bool_or(shifted) AS distribution_drift, count(*) FILTER (WHERE feature <> 'label') AS total_features,
    count(*) FILTER (WHERE feature <> 'label' AND psi > 0.2) AS drifted_features,
    bool_or(feature = 'label' AND psi > 0.1) AS target_drift FROM wp JOIN kd USING (window_start) GROUP BY 1)
  SELECT *, CASE WHEN target_drift THEN 'CRITICAL' WHEN drifted_features > 0 THEN 'WARNING' ELSE 'STABLE' END AS status
  FROM s WHERE window_start + INTERVAL 1 HOUR <= {_CLOSED}""",
)
def _(spark, sf):
    root = _run_drift(spark, sf)
    schema = f"{_TIMES}, total_features bigint, drifted_features bigint, target_drift boolean, distribution_drift boolean, status string"
    return wn.plain_times(fl.written(spark, root, "summary", schema)).drop("window_end")


# Raw records land as JSON files under alias names, as an upstream system would send them.
_SENT_AS = {name: many[0] for name, many in fields.ALIASES.items() if name != "churn"}


def _landed(spark, sf):
    df = wide(spark, sf).drop("segment", "nationkey")
    sent = df.select(*[F.col(c).alias(_SENT_AS.get(c, c).upper()) for c in df.columns])
    path = scratch_path(spark, "landing")
    sent.write.json(path)
    return fl.read_files(spark, path, sent.schema, "json", per_batch=4)


@query(
    "stream_ingest",
    f"""{W_SQL}, e AS (SELECT *, {_ERRORS_SQL} AS errors FROM w)
  SELECT customer_id, CASE WHEN errors = '' THEN 'good' ELSE 'quarantine' END AS side, errors FROM e""",
)
def _(spark, sf):
    root = scratch_path(spark, "ingest")
    fl.run(fl.ingest_records(_landed(spark, sf), root, "json"))
    good = fl.written(spark, root, "good", "customer_id bigint")
    bad = fl.written(spark, root, "quarantine", "customer_id bigint, errors array<string>")
    return good.select("customer_id", F.lit("good").alias("side"), F.lit("").alias("errors")).unionByName(
        bad.select("customer_id", F.lit("quarantine").alias("side"), F.concat_ws(",", "errors").alias("errors"))
    )


@query("stream_dedupe", "SELECT DISTINCT o_custkey AS customer_id, o_orderdate AS ts FROM orders")
def _(spark, sf):
    orders = fl.read_files(spark, sf, table(spark, sf, "orders").schema, pattern="orders.parquet")
    keys = orders.select(F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("ts"))
    return wn.plain_times(fl.collect_stream(fl.dedupe(keys, ["customer_id", "ts"], "ts"), "dedupe"))


@query("stream_score")
def _(spark, sf):
    data, params = feature_table(spark, sf)
    model = md.pipeline("random_forest", {"numTrees": 20, "maxDepth": 5}, params.features, "churn").fit(data)
    path = scratch_path(spark, "unscored")
    data.drop("churn").write.parquet(path)
    stream = fl.read_files(spark, path, data.drop("churn").schema)
    scored = fl.collect_stream(fl.score(stream, model).select("customer_id", "prediction", "confidence"), "scored")
    return scored.withColumn("confidence", _r6(F.col("confidence")))


@query("stream_score_nodes", NODE_SCORES_SQL)
def _(spark, sf):
    """The node table scores a stream as it scores a table."""
    df = landed(spark, sf, ["customer_id", "churn", *NODE_FEATURES])
    path = scratch_path(spark, "unscored")
    df.drop("churn").write.parquet(path)
    stream = fl.score(fl.read_files(spark, path, df.drop("churn").schema), node_table_model(spark, df))
    scored = fl.collect_stream(stream.select("customer_id", "prediction", "confidence"), "scored")
    return scored.withColumn("confidence", _r6(F.col("confidence")))


@query(
    "stream_status",
    """SELECT event_type AS monitor, arg_max(CASE WHEN value > 200 THEN 'CRITICAL' WHEN value > 100 THEN 'WARNING'
      ELSE 'STABLE' END, {'t': date_trunc('hour', ts), 'i': event_id}) AS status, max(date_trunc('hour', ts)) AS last_ts,
    max(CASE WHEN value <= 200 THEN date_trunc('hour', ts) END) AS last_success
  FROM events GROUP BY event_type""",
)
def _(spark, sf):
    value = F.col("value")
    status = F.when(value > 200, "CRITICAL").when(value > 100, "WARNING").otherwise("STABLE")
    checks = wn.event_time(_events(spark, sf), "ts").select(
        F.col("event_type").alias("monitor"),
        F.date_trunc("hour", "ts").alias("ts"),
        "event_id",
        status.alias("status"),
        (value <= 200).alias("ok"),
    )
    latest = wn.latest_status(checks, "monitor", "ts", tie=["event_id"])
    root = scratch_path(spark, "status")
    fl.run(fl.write_batches(latest, root, lambda batch, _: {"status": batch}, mode="update"))
    # Every batch repeats the monitors it changed; the newest row of each is its status.
    told = fl.written(spark, root, "status", latest.schema)
    return wn.plain_times(st.one_per_key(told, ["monitor"], ["last_ts", "event_id"], last=True)).drop("event_id")
