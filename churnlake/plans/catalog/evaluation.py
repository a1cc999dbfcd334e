"""Queries for classification metrics and threshold search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import metrics
from ...functions.scalars import r6 as _r6
from ...operators import evaluate as ev
from ...session import stage
from ..bindings import prelude, view, wide
from .base import query, r6

_SCORES = prelude("scores")
_COUNTS = """count(*) FILTER (WHERE label = 1 AND p >= 0.5e0) AS tp, count(*) FILTER (WHERE label = 0 AND p >= 0.5e0) AS fp,
    count(*) FILTER (WHERE label = 1 AND p < 0.5e0) AS fn, count(*) FILTER (WHERE label = 0 AND p < 0.5e0) AS tn"""
_RATIOS = ", ".join(
    f"{r6(f'coalesce({top} * 1e0 / nullif({bottom}, 0), 0)')} AS {name}"
    for name, top, bottom in [
        ("accuracy", "(tp + tn)", "(tp + fp + fn + tn)"),
        ("precision", "tp", "(tp + fp)"),
        ("recall", "tp", "(tp + fn)"),
        ("f1", "2 * tp", "(2 * tp + fp + fn)"),
    ]
)


def _auc_sql(group: str = "") -> str:
    """Mann-Whitney form: average rank of the positives."""
    part = f"PARTITION BY {group}" if group else ""
    head = f"{group}, " if group else ""
    tail = f"GROUP BY {group}" if group else ""
    return f"""SELECT {head}(sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / 2e0)
      / nullif(sum(label) * 1e0 * sum(1 - label), 0) AS roc_auc
    FROM (SELECT *, rank() OVER ({part} ORDER BY p)
      + (count(*) OVER (PARTITION BY {head}p) - 1) / 2e0 AS rk FROM scores) {tail}"""


def _rounded(df, names):
    return df.withColumns({n: _r6(F.col(n)) for n in names})


def _hit():
    return ev.predict(F.col("p"))


@query("classification_metrics", f"{_SCORES}, c AS (SELECT {_COUNTS} FROM scores) SELECT *, {_RATIOS} FROM c")
def _(spark, sf):
    return _rounded(ev.classification_metrics(view(spark, sf, "scores"), "label", _hit()), metrics.NAMES)


@query(
    "classification_report",
    f"""{_SCORES}, s AS (SELECT nationkey % 4 AS a, CASE WHEN prizm_cluster IS NULL THEN 0 WHEN mou IS NULL THEN 1
      ELSE nationkey % 4 END AS b FROM w),
  k AS (SELECT DISTINCT a AS c FROM s UNION SELECT DISTINCT b FROM s),
  r AS (SELECT c, (SELECT count(*) FROM s WHERE a = c AND b = c) AS tp, (SELECT count(*) FROM s WHERE b = c) AS said,
    (SELECT count(*) FROM s WHERE a = c) AS support FROM k),
  m AS (SELECT CAST(c AS VARCHAR) AS class, coalesce(tp * 1e0 / nullif(said, 0), 0) AS precision,
    coalesce(tp * 1e0 / nullif(support, 0), 0) AS recall, coalesce(2e0 * tp / nullif(said + support, 0), 0) AS f1,
    support, tp FROM r)
  SELECT class, {r6("precision")} AS precision, {r6("recall")} AS recall, {r6("f1")} AS f1, support FROM m
  UNION ALL SELECT 'accuracy', {r6("sum(tp) * 1e0 / sum(support)")}, {r6("sum(tp) * 1e0 / sum(support)")},
    {r6("sum(tp) * 1e0 / sum(support)")}, CAST(sum(support) AS BIGINT) FROM m
  UNION ALL SELECT 'macro avg', {r6("avg(precision)")}, {r6("avg(recall)")}, {r6("avg(f1)")},
    CAST(sum(support) AS BIGINT) FROM m
  UNION ALL SELECT 'weighted avg', {r6("sum(precision * support) / sum(support)")},
    {r6("sum(recall * support) / sum(support)")}, {r6("sum(f1 * support) / sum(support)")},
    CAST(sum(support) AS BIGINT) FROM m""",
)
def _(spark, sf):
    truth = F.col("nationkey") % 4
    said = F.when(F.col("prizm_cluster").isNull(), 0).when(F.col("mou").isNull(), 1).otherwise(truth)
    df = wide(spark, sf, ["nationkey", "prizm_cluster", "mou"]).select(truth.alias("a"), said.alias("b"))
    return _rounded(ev.classification_report(df, "a", F.col("b")), ["precision", "recall", "f1"])


@query("roc_auc", f"{_SCORES}, r AS ({_auc_sql()}) SELECT {r6('roc_auc')} AS roc_auc FROM r")
def _(spark, sf):
    return _rounded(ev.roc_auc(view(spark, sf, "scores"), "p", "label"), ["roc_auc"])


_FOLDS = f"""c AS (SELECT fold, {_COUNTS} FROM scores GROUP BY fold), r AS ({_auc_sql("fold")}),
  f AS (SELECT c.fold, coalesce((tp + tn) * 1e0 / nullif(tp + fp + fn + tn, 0), 0) AS accuracy,
    coalesce(tp * 1e0 / nullif(tp + fp, 0), 0) AS precision, coalesce(tp * 1e0 / nullif(tp + fn, 0), 0) AS recall,
    coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, r.roc_auc FROM c JOIN r ON c.fold = r.fold)"""
_ALL = [*metrics.NAMES, "roc_auc"]


@query("fold_metrics", f"{_SCORES}, {_FOLDS} SELECT fold, {', '.join(f'{r6(n)} AS {n}' for n in _ALL)} FROM f")
def _(spark, sf):
    return _rounded(ev.fold_metrics(stage(view(spark, sf, "scores"), "scores"), "fold", "label", "p"), _ALL)


@query(
    "cv_summary",
    f"{_SCORES}, {_FOLDS} "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS metric, {r6(f'avg({n})')} AS mean, {r6(f'stddev_pop({n})')} AS std FROM f" for n in _ALL
    ),
)
def _(spark, sf):
    folds = ev.fold_metrics(stage(view(spark, sf, "scores"), "scores"), "fold", "label", "p")
    return _rounded(ev.cv_summary(folds), ["mean", "std"])


_F1 = r6("coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0)")


@query("pooled_f1", f"{_SCORES}, c AS (SELECT {_COUNTS} FROM scores) SELECT {_F1} AS pooled_f1 FROM c")
def _(spark, sf):
    return _rounded(ev.pooled_f1(view(spark, sf, "scores"), "label", _hit()), ["pooled_f1"])


@query(
    "best_params",
    f"""{_SCORES}, c AS (SELECT '{{"depth":"' || split_part(params, '=', 2) || '"}}' AS k, {_COUNTS} FROM scores GROUP BY 1),
  f AS (SELECT k, {_F1} AS f1 FROM c)
  SELECT k AS best_params, f1 AS pooled_f1 FROM f ORDER BY f1 DESC, k LIMIT 1""",
)
def _(spark, sf):
    params = F.str_to_map(F.col("params"), F.lit(","), F.lit("="))
    return _rounded(ev.best_params(view(spark, sf, "scores"), params, "label", _hit()), ["pooled_f1"])


_CURVE = """t AS (SELECT CAST(i AS INTEGER) AS i, i * 0.01e0 AS threshold FROM range(1, 100) r(i)),
  c AS (SELECT t.i, t.threshold, count(*) FILTER (WHERE label = 1 AND p >= threshold) AS tp,
    count(*) FILTER (WHERE label = 0 AND p >= threshold) AS fp, count(*) FILTER (WHERE label = 1 AND p < threshold) AS fn,
    count(*) FILTER (WHERE label = 0 AND p < threshold) AS tn FROM t CROSS JOIN scores GROUP BY 1, 2)"""


@query("threshold_curve", f"{_SCORES}, {_CURVE} SELECT *, {_RATIOS} FROM c")
def _(spark, sf):
    return _rounded(ev.threshold_curve(view(spark, sf, "scores"), "label", "p"), metrics.NAMES)


@query(
    "best_threshold",
    f"""{_SCORES}, {_CURVE}, f AS (SELECT i, threshold, 2e0 * tp / (2 * tp + fp + fn) AS f1 FROM c)
  SELECT threshold, {r6("f1")} AS f1 FROM f ORDER BY f1 DESC, i LIMIT 1""",
)
def _(spark, sf):
    return _rounded(ev.best_threshold(view(spark, sf, "scores"), "label", "p"), ["f1"])


# Retraining results: every segment is a candidate model scored on its customers; a candidate with an
# odd number of customers counts as failed.
_RESULTS = f"""c AS (SELECT CAST(w.nationkey AS VARCHAR) || '-' || w.segment AS model,
    count(*) FILTER (WHERE s.label = 1 AND p >= 0.5e0) AS tp, count(*) FILTER (WHERE s.label = 0 AND p >= 0.5e0) AS fp,
    count(*) FILTER (WHERE s.label = 1 AND p < 0.5e0) AS fn, count(*) AS n
    FROM w JOIN scores s ON s.customer_id = w.customer_id GROUP BY 1),
  r AS (SELECT model, CASE WHEN n % 2 = 0 THEN 'success' ELSE 'failed' END AS status,
    {r6("coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0)")} AS f1 FROM c)"""


def _results(spark, sf):
    w = wide(spark, sf, ["customer_id", "nationkey", "segment"]).select(
        "customer_id", F.concat_ws("-", F.col("nationkey").cast("string"), "segment").alias("model")
    )
    scored = view(spark, sf, "scores").join(w, "customer_id")
    per = ev.classification_metrics(scored, "label", _hit(), ["model"])
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    status = F.when(n % 2 == 0, "success").otherwise("failed")
    return per.select("model", status.alias("status"), _r6(F.col("f1")).alias("f1"))


@query(
    "retrain_evaluation",
    f"""{_SCORES}, {_RESULTS}, b AS (SELECT model, f1 FROM r WHERE status = 'success' AND f1 >= 0.7 ORDER BY f1 DESC, model LIMIT 1)
  SELECT count(*) AS total_models, count(*) FILTER (WHERE status = 'success') AS successful_models,
    count(*) FILTER (WHERE status <> 'success') AS failed_models,
    count(*) FILTER (WHERE status = 'success' AND f1 >= 0.7) AS models_meeting_threshold,
    (SELECT model FROM b) AS best_model, coalesce((SELECT f1 FROM b), 0) AS best_score FROM r""",
)
def _(spark, sf):
    return ev.retrain_evaluation(_results(spark, sf))


@query("best_model", f"{_SCORES}, {_RESULTS} SELECT model AS best_model, f1 FROM r ORDER BY f1 DESC, model LIMIT 1")
def _(spark, sf):
    return ev.best_model(_results(spark, sf), "f1")
