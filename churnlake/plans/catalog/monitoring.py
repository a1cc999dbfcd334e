"""Queries for drift, alerts and windowed monitoring over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.scalars import r6 as _r6
from ...operators import drift as dr
from ...operators.ranking import small_side
from ...session import stage
from ...streaming import windows as wn
from ..bindings import prelude, view
from .base import query, r6

_DRIFT = prelude("drift")
_NUMBERS = ["value", "value_drifted"]


def sides(spark, sf):
    drift = view(spark, sf, "drift")
    return drift.where("side = 'ref'"), drift.where("side = 'live'")


def _bin_sql(column: str) -> str:
    """Decile bin of a numeric column against the reference edges."""
    return (
        f"CASE WHEN {column} IS NULL THEN 'null' ELSE CAST((SELECT count(DISTINCT e) FROM (SELECT unnest(q) AS e FROM "
        f"q_{column}) WHERE e <= {column}) AS VARCHAR) END"
    )


def _edges_sql(column: str) -> str:
    return (
        f"q_{column} AS (SELECT quantile_cont({column}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q "
        f"FROM drift WHERE side = 'ref')"
    )


_BINNED = f"""{", ".join(_edges_sql(c) for c in _NUMBERS)},
  binned AS (SELECT side, '{_NUMBERS[0]}' AS feature, {_bin_sql(_NUMBERS[0])} AS bin FROM drift
    UNION ALL SELECT side, '{_NUMBERS[1]}', {_bin_sql(_NUMBERS[1])} FROM drift
    UNION ALL SELECT side, 'event_type', event_type FROM drift),
  labels AS (SELECT side, 'label' AS feature, CAST(label AS VARCHAR) AS bin FROM drift)"""


def _psi_sql(source: str, name: str) -> str:
    return f"""{name} AS (SELECT feature, sum((l - r) * ln(l / r)) AS psi FROM (
    SELECT feature, bin, greatest(a * 1e0 / sum(a) OVER (PARTITION BY feature), 1e-4) AS r,
      greatest(b * 1e0 / sum(b) OVER (PARTITION BY feature), 1e-4) AS l
    FROM (SELECT feature, bin, count(*) FILTER (WHERE side = 'ref') AS a, count(*) FILTER (WHERE side = 'live') AS b
      FROM {source} GROUP BY feature, bin)) GROUP BY feature)"""


_PSI = f"{_BINNED}, {_psi_sql('binned', 'pf')}, {_psi_sql('labels', 'pt')}"

_KS = """kv AS (SELECT 'value' AS feature, side, value AS v FROM drift
    UNION ALL SELECT 'value_drifted', side, value_drifted FROM drift),
  kc AS (SELECT feature, v, count(*) FILTER (WHERE side = 'ref') AS a, count(*) FILTER (WHERE side = 'live') AS b
    FROM kv GROUP BY feature, v),
  ku AS (SELECT feature, sum(a) OVER (PARTITION BY feature ORDER BY v) * 1e0 / sum(a) OVER (PARTITION BY feature) AS fa,
    sum(b) OVER (PARTITION BY feature ORDER BY v) * 1e0 / sum(b) OVER (PARTITION BY feature) AS fb,
    sum(a) OVER (PARTITION BY feature) * 1e0 AS n, sum(b) OVER (PARTITION BY feature) * 1e0 AS m FROM kc),
  ks AS (SELECT feature, max(abs(fa - fb)) AS ks, max(1.358e0 * sqrt((n + m) / (n * m))) AS critical FROM ku GROUP BY feature),
  sh AS (SELECT avg(CASE WHEN ks > critical THEN 1e0 ELSE 0e0 END) AS share FROM ks)"""


def _features(spark, sf):
    ref, live = sides(spark, sf)
    return dr.psi(ref, live, [*_NUMBERS, "event_type"])


def _target(spark, sf):
    ref, live = sides(spark, sf)
    label = F.col("label").cast("string").alias("label")
    return dr.psi(ref.select(label), live.select(label), ["label"], dr.TARGET_LIMIT)


def _shift(spark, sf):
    ref, live = sides(spark, sf)
    return dr.ks(ref, live, _NUMBERS)


@query("psi_features", f"{_DRIFT}, {_PSI} SELECT feature, {r6('psi')} AS psi, psi > 0.2 AS drifted FROM pf")
def _(spark, sf):
    return _features(spark, sf).withColumn("psi", _r6(F.col("psi")))


@query("psi_target", f"{_DRIFT}, {_PSI} SELECT feature, {r6('psi')} AS psi, psi > 0.1 AS drifted FROM pt")
def _(spark, sf):
    return _target(spark, sf).withColumn("psi", _r6(F.col("psi")))


@query(
    "ks_features",
    f"{_DRIFT}, {_KS} SELECT feature, {r6('ks')} AS ks, {r6('critical')} AS critical, ks > critical AS shifted FROM ks",
)
def _(spark, sf):
    return _shift(spark, sf).withColumns({"ks": _r6(F.col("ks")), "critical": _r6(F.col("critical"))})


@query("covariate_shift", f"{_DRIFT}, {_KS} SELECT {r6('share')} AS shift_share, share >= 0.5 AS shift_detected FROM sh")
def _(spark, sf):
    return dr.covariate_shift(_shift(spark, sf)).withColumn("shift_share", _r6(F.col("shift_share")))


_SUMMARY = f"""{_PSI}, {_KS}, sm AS (SELECT (SELECT bool_or(psi > 0.1) FROM pt) AS target_drift,
    (SELECT bool_or(psi > 0.2) FROM pf) AS feature_drift, (SELECT share >= 0.5 FROM sh) AS distribution_drift,
    (SELECT max(psi) FROM pt) AS target_psi, (SELECT count(*) FROM pf) AS total_features,
    (SELECT count(*) FROM pf WHERE psi > 0.2) AS drifted_features),
  sy AS (SELECT *, CASE WHEN target_drift THEN 'CRITICAL' WHEN feature_drift THEN 'WARNING' ELSE 'STABLE' END AS status,
    drifted_features * 1e0 / total_features AS drift_ratio, target_drift AS requires_action FROM sm)"""


def _summary(spark, sf):
    return dr.summary(_features(spark, sf), _target(spark, sf), dr.covariate_shift(_shift(spark, sf)))


@query(
    "drift_summary",
    f"""{_DRIFT}, {_SUMMARY} SELECT status, target_drift, feature_drift, distribution_drift, {r6("target_psi")} AS target_psi,
    total_features, drifted_features, {r6("drift_ratio")} AS drift_ratio, requires_action FROM sy""",
)
def _(spark, sf):
    out = _summary(spark, sf)
    return out.withColumns({"target_psi": _r6(F.col("target_psi")), "drift_ratio": _r6(F.col("drift_ratio"))})


@query(
    "drift_alerts",
    f"""{_DRIFT}, {_SUMMARY} SELECT status, requires_action, 'target_drift' AS alert_type, 'CRITICAL' AS level FROM sy
    WHERE target_drift
  UNION ALL SELECT status, requires_action, 'feature_drift', 'WARNING' FROM sy WHERE feature_drift
  UNION ALL SELECT status, requires_action, 'distribution_drift', 'INFO' FROM sy WHERE distribution_drift""",
)
def _(spark, sf):
    return dr.alerts(_summary(spark, sf))


@query(
    "drift_bands",
    f"""{_DRIFT}, {_SUMMARY}, v AS (SELECT 'psi' AS panel, feature, psi AS value, 0.1 AS y, 0.2 AS r FROM pf
    UNION ALL SELECT 'psi', feature, psi, 0.1, 0.2 FROM pt UNION ALL SELECT 'drift_ratio', 'all', drift_ratio, 0.1, 0.3 FROM sy)
  SELECT panel, feature, {r6("value")} AS value,
    CASE WHEN value >= r THEN 'red' WHEN value >= y THEN 'yellow' ELSE 'green' END AS band FROM v""",
)
def _(spark, sf):
    features = _features(spark, sf)
    scores = features.unionByName(_target(spark, sf)).select(
        F.lit("psi").alias("panel"), "feature", F.col("psi").alias("value"), dr.psi_band(F.col("psi")).alias("band")
    )
    ratio = features.agg(F.avg(F.col("drifted").cast("double")).alias("value")).select(
        F.lit("drift_ratio").alias("panel"), F.lit("all").alias("feature"), "value", dr.ratio_band(F.col("value")).alias("band")
    )
    return scores.unionByName(ratio).withColumn("value", _r6(F.col("value")))


# Windows over the event table


@query(
    "recent_window_scan",
    """SELECT event_id, ts, user_id, event_type, value FROM events
  WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR ORDER BY ts DESC, event_id LIMIT 1000""",
)
def _(spark, sf):
    events = view(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return wn.recent(events, "ts", 1, 1000, ["event_id"])


@query(
    "tumbling_rates",
    """SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*) AS n,
    ROUND(count(*) / 300e0, 6) AS per_second FROM events GROUP BY 1, 2""",
)
def _(spark, sf):
    out = wn.tumbling_rates(view(spark, sf, "events"), "ts", "5 minutes", 300, ["event_type"])
    return wn.plain_times(out).withColumn("per_second", F.round("per_second", 6)).drop("window_end")


@query(
    "tumbling_avg",
    f"""SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS n, {r6("sum(value) / count(*)")} AS mean_value
  FROM events GROUP BY 1""",
)
def _(spark, sf):
    out = wn.tumbling_avg(view(spark, sf, "events"), "ts", "5 minutes", "value")
    return wn.plain_times(out).withColumn("mean_value", _r6(F.col("mean_value"))).drop("window_end")


WINDOWED_SQL = f"""{_DRIFT}, {_edges_sql("value")},
  b AS (SELECT side, ts, 'value' AS feature, {_bin_sql("value")} AS bin FROM drift
    UNION ALL SELECT side, ts, 'event_type', event_type FROM drift
    UNION ALL SELECT side, ts, 'label', CAST(label AS VARCHAR) FROM drift),
  rc AS (SELECT feature, bin, count(*) AS n FROM b WHERE side = 'ref' GROUP BY 1, 2),
  rs AS (SELECT feature, bin, n * 1e0 / sum(n) OVER (PARTITION BY feature) AS s FROM rc),
  p AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS pane, feature, bin, count(*) AS n FROM b WHERE side = 'live' GROUP BY 1, 2, 3),
  lc AS (SELECT pane - k * INTERVAL 5 MINUTE AS window_start, feature, bin, CAST(sum(n) AS BIGINT) AS n
    FROM p CROSS JOIN range(0, 12) r(k) GROUP BY 1, 2, 3),
  lt AS (SELECT window_start, feature, CAST(sum(n) AS BIGINT) AS rows FROM lc GROUP BY 1, 2),
  cells AS (SELECT lt.window_start, lt.feature, lt.rows, k.bin FROM lt JOIN
    (SELECT DISTINCT feature, bin FROM rc UNION SELECT DISTINCT feature, bin FROM lc) k ON k.feature = lt.feature),
  sc AS (SELECT cells.window_start, cells.feature, cells.rows, greatest(coalesce(lc.n, 0) * 1e0 / cells.rows, 1e-4) AS l,
    greatest(coalesce(rs.s, 0), 1e-4) AS r FROM cells
    LEFT JOIN lc ON lc.window_start = cells.window_start AND lc.feature = cells.feature AND lc.bin = cells.bin
    LEFT JOIN rs ON rs.feature = cells.feature AND rs.bin = cells.bin),
  wp AS (SELECT window_start, feature, rows, sum((l - r) * ln(l / r)) AS psi FROM sc GROUP BY 1, 2, 3)"""


@query("windowed_psi", f"{WINDOWED_SQL} SELECT window_start, feature, rows, {r6('psi')} AS psi, psi > 0.2 AS drifted FROM wp")
def _(spark, sf):
    ref, live = sides(spark, sf)
    label = F.col("label").cast("string").alias("label")
    columns = ["value", "event_type", "label"]
    bins = dr.plan_bins(ref.select("value", "event_type", label), columns)
    reference = small_side(dr.reference_bins(ref.select("value", "event_type", label), bins), "reference-bins")
    counts = wn.sliding_counts(dr.binned(live.select("ts", "value", "event_type", label), bins, ["ts"]), "ts", ["feature", "bin"])
    out = dr.psi_of_groups(stage(counts, "window-counts"), reference, ["window_start", "window_end"])
    return wn.plain_times(out).withColumn("psi", _r6(F.col("psi"))).drop("window_end")


@query(
    "latest_status",
    """SELECT event_type AS monitor, arg_max(CASE WHEN value > 200 THEN 'CRITICAL' WHEN value > 100 THEN 'WARNING'
      ELSE 'STABLE' END, {'t': date_trunc('hour', ts), 'i': event_id}) AS status, max(date_trunc('hour', ts)) AS last_ts,
    max(CASE WHEN value <= 200 THEN date_trunc('hour', ts) END) AS last_success
  FROM events GROUP BY event_type""",
)
def _(spark, sf):
    value = F.col("value")
    status = F.when(value > 200, "CRITICAL").when(value > 100, "WARNING").otherwise("STABLE")
    checks = view(spark, sf, "events").select(
        F.col("event_type").alias("monitor"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"),  # many checks at one time
        "event_id",
        status.alias("status"),
        (value <= 200).alias("ok"),
    )
    return wn.latest_status(checks, "monitor", "ts", tie=["event_id"]).drop("event_id")
