"""Queries for splits, samples, neighbours and class balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.scalars import r6 as _r6
from ...operators import neighbors as nb
from ...operators import sampling as sp
from ...session import stage
from ..bindings import prelude, view
from .base import query, r6
from .shared import W_SQL, landed

_SCORES = prelude("scores")


def _labels(spark, sf):
    """Ids and labels, written once because ranking reads them twice."""
    return stage(view(spark, sf, "scores").select("customer_id", "label"), "labels")


@query(
    "stratified_folds",
    f"""{_SCORES} SELECT customer_id, label, CAST((row_number() OVER (PARTITION BY label
    ORDER BY md5('42|' || customer_id), customer_id) - 1) % 5 AS INTEGER) AS fold FROM scores""",
)
def _(spark, sf):
    return sp.stratified_folds(_labels(spark, sf), "label", ["customer_id"], 5)


@query(
    "stratified_split",
    f"""{_SCORES} SELECT customer_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || customer_id), customer_id)
    <= floor(count(*) OVER (PARTITION BY label) * 0.2e0 + 0.5e0) AS is_test FROM scores""",
)
def _(spark, sf):
    return sp.stratified_split(_labels(spark, sf), "label", ["customer_id"])


@query(
    "stratified_sample",
    f"""{_SCORES}, z AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM scores GROUP BY label),
  q AS (SELECT label, least(n, greatest(30, CAST(floor(101 * n / (total * 1e0)) AS BIGINT))) AS quota, total FROM z),
  r AS (SELECT s.customer_id, s.label, row_number() OVER (PARTITION BY s.label ORDER BY md5('42|' || customer_id), customer_id)
    AS rk, quota, total FROM scores s JOIN q ON q.label = s.label),
  e AS (SELECT customer_id, label, row_number() OVER (ORDER BY md5('42+|' || customer_id), customer_id) AS rk
    FROM r WHERE rk > quota)
  SELECT customer_id, label FROM r WHERE rk <= quota OR total < 101
  UNION ALL SELECT customer_id, label FROM e WHERE rk <= 101 - (SELECT sum(quota) FROM q) AND (SELECT max(total) FROM q) >= 101""",
)
def _(spark, sf):
    return sp.stratified_sample(_labels(spark, sf), "label", ["customer_id"], 101, min_per_class=30)


_PAIRS = """pairs AS (SELECT a.vec_id AS left_id, b.vec_id AS right_id,
    list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS distance, a.label AS la, b.label AS lb
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
  near AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY distance, right_id) AS rk FROM pairs)"""


@query(
    "knn_join",
    f"WITH {_PAIRS} SELECT left_id, right_id, {r6('distance')} AS distance, CAST(rk AS INTEGER) AS rank FROM near WHERE rk <= 5",
)
def _(spark, sf):
    vectors = view(spark, sf, "embeddings")
    near = nb.knn(vectors, vectors, "vec_id", "embedding", 5, exclude_self=True, block=512)
    return near.withColumn("distance", _r6(F.col("distance")))


@query(
    "tomek_links",
    f"""WITH {_PAIRS}, one AS (SELECT * FROM near WHERE rk = 1)
  SELECT a.left_id AS first_id, a.right_id AS second_id FROM one a JOIN one b ON a.left_id = b.right_id AND a.right_id = b.left_id
  WHERE a.left_id < a.right_id AND a.la <> a.lb""",
)
def _(spark, sf):
    return sp.tomek_links(view(spark, sf, "embeddings"), "label", "vec_id", "embedding")


_FEATURES = ["outcalls", "incalls", "months", "uniqsubs", "eqpdays", "models"]
_SMOTE = f"""{W_SQL}, z AS (SELECT churn, count(*) AS n FROM w GROUP BY churn),
  mino AS (SELECT w.customer_id, {", ".join(f"w.{c}" for c in _FEATURES)}, w.churn FROM w
    WHERE churn = (SELECT churn FROM z ORDER BY n, churn LIMIT 1)),
  k AS (SELECT min(n) AS small, max(n) - min(n) AS wanted FROM z),
  base AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || customer_id), customer_id) AS rk FROM mino),
  near AS (SELECT a.customer_id AS id, b.customer_id AS other, row_number() OVER (PARTITION BY a.customer_id
      ORDER BY {" + ".join(f"(a.{c} - b.{c}) ** 2" for c in _FEATURES)}, b.customer_id) AS slot
    FROM mino a JOIN mino b ON a.customer_id <> b.customer_id),
  cp AS (SELECT base.*, unnest(range(1, CAST(wanted // small + CASE WHEN rk <= wanted % small THEN 1 ELSE 0 END AS BIGINT) + 1))
    AS copy, small FROM base CROSS JOIN k),
  pk AS (SELECT *, CAST(floor(('0x' || substr(md5('42n|' || customer_id || '|' || copy), 1, 8))::BIGINT / 4294967296e0 * 5) + 1
      AS BIGINT) AS slot, ('0x' || substr(md5('42u|' || customer_id || '|' || copy), 1, 8))::BIGINT / 4294967296e0 AS u FROM cp),
  pool AS (SELECT customer_id, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _FEATURES)}, churn, false AS is_synthetic FROM w
  UNION ALL SELECT CAST(-((copy - 1) * small + rk) AS BIGINT), {", ".join(f"pk.{c} + u * (o.{c} - pk.{c})" for c in _FEATURES)},
    pk.churn, true FROM pk JOIN near ON near.id = pk.customer_id AND near.slot = pk.slot JOIN mino o ON o.customer_id = near.other)"""
_ROUNDED = f'SELECT customer_id, {", ".join(f"{r6(c)} AS {c}" for c in _FEATURES)}, churn, is_synthetic FROM pool'


@query("smote", f"{_SMOTE} {_ROUNDED}")
def _(spark, sf):
    out = sp.smote(landed(spark, sf, ["customer_id", "churn", *_FEATURES]), "churn", "customer_id", _FEATURES)
    return out.withColumns({c: _r6(F.col(c)) for c in _FEATURES})


_TOMEK = f"""{_SMOTE}, closest AS (SELECT a.customer_id AS id, a.churn AS la, b.churn AS lb, b.customer_id AS other, row_number() OVER (
      PARTITION BY a.customer_id ORDER BY sqrt({" + ".join(f"(a.{c} - b.{c}) ** 2" for c in _FEATURES)}), b.customer_id) AS slot
    FROM pool a JOIN pool b ON a.customer_id <> b.customer_id),
  one AS (SELECT * FROM closest WHERE slot = 1),
  ends AS (SELECT a.id FROM one a JOIN one b ON a.other = b.id AND b.other = a.id WHERE a.la <> a.lb)
  {_ROUNDED} WHERE customer_id NOT IN (SELECT id FROM ends)"""


@query("smote_tomek", _TOMEK)
def _(spark, sf):
    df = landed(spark, sf, ["customer_id", "churn", *_FEATURES])
    return sp.smote_tomek(df, "churn", "customer_id", _FEATURES).withColumns({c: _r6(F.col(c)) for c in _FEATURES})
