"""Queries for dataset statistics and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import formulas
from ...functions.scalars import r6 as _r6
from ...operators import features as ft
from ...operators import profile as pf
from ..bindings import prelude, view, wide
from .base import query, r6
from .shared import CATEGORIES, FLAGS, FORMULA_SQL, NUMBERS, TEXTS, W_SQL, filled_sql, landed

_NEEDED = ["months", "outcalls", "incalls"]


@query(
    "churn_rate_by_segment",
    f"""{W_SQL}, {filled_sql()}
  SELECT segment, count(*) AS customers, {r6("avg(CAST(churn AS DOUBLE))")} AS churn_rate,
    {r6(f"avg({FORMULA_SQL['engagement_index']})")} AS mean_engagement_index FROM wi GROUP BY segment""",
)
def _(spark, sf):
    df = wide(spark, sf, ["segment", "churn", *formulas.REGISTRY["engagement_index"].sources])
    df = ft.impute(df, ft.fit_median_mode(df, _NEEDED, []))
    out = pf.churn_by_segment(ft.derive(df, ["engagement_index"]), "segment", "churn", "engagement_index")
    return out.withColumns({c: _r6(F.col(c)) for c in ("churn_rate", "mean_engagement_index")})


@query(
    "class_balance",
    f"""{W_SQL}, c AS (SELECT churn AS value, count(*) AS n FROM w GROUP BY churn), t AS (SELECT sum(n) AS total FROM c)
  SELECT value, n, {r6("n * 1e0 / total")} AS share,
    {r6("(SELECT min(n) FROM c) * 1e0 / total")} AS min_share FROM c CROSS JOIN t""",
)
def _(spark, sf):
    out = pf.class_balance(wide(spark, sf, ["churn"]), "churn")
    return out.withColumns({c: _r6(F.col(c)) for c in ("share", "min_share")})


_LONG = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM w" for c in CATEGORIES)


@query(
    "category_profile",
    f"""{W_SQL}, l AS ({_LONG}), c AS (SELECT column_name, value, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY 1, 2),
  t AS (SELECT column_name, sum(n) AS total FROM c GROUP BY 1)
  SELECT column_name, value, n, {r6("n * 1e0 / total")} AS share FROM c JOIN t USING (column_name)""",
)
def _(spark, sf):
    return pf.category_profile(wide(spark, sf, CATEGORIES), CATEGORIES).withColumn("share", _r6(F.col("share")))


_TYPED = ["nationkey", *NUMBERS, *FLAGS, *TEXTS]


@query(
    "feature_types",
    f"{W_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, "
        + ("'categorical'" if c in TEXTS else f"CASE WHEN count(DISTINCT {c}) = 2 THEN 'binary' ELSE 'continuous' END")
        + f" AS kind, count(DISTINCT {c}) AS n_distinct FROM w"
        for c in _TYPED
    ),
)
def _(spark, sf):
    return pf.feature_types(landed(spark, sf), "churn", exclude=["customer_id"], counts="exact")


@query(
    "feature_kinds",
    f"{W_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, "
        + ("max('categorical')" if c in TEXTS else f"CASE WHEN count(DISTINCT {c}) = 2 THEN 'binary' ELSE 'continuous' END")
        + " AS kind FROM w"
        for c in _TYPED
    ),
)
def _(spark, sf):
    return pf.feature_types(landed(spark, sf), "churn", exclude=["customer_id"])


_PAIRED = NUMBERS


def _short(e: str) -> str:
    """Eight leading digits and the power of ten, as covariances differ by many; a constant column has 0."""
    power = f"(floor(log10(abs({e}))) - 7)"
    return (
        f"CAST(CASE WHEN abs({e}) < 1e-6 THEN 0 ELSE round({e} / pow(10e0, {power})) END AS BIGINT) AS covariance_digits, "
        f"CAST(CASE WHEN abs({e}) < 1e-6 THEN 0 ELSE {power} END AS INTEGER) AS covariance_power"
    )


_PAIRS = [(a, b) for i, a in enumerate(_PAIRED) for b in _PAIRED[i + 1 :]]


@query(
    "correlation_pairs",
    f"{W_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS first, '{b}' AS second, {_short(f'covar_samp({a}, {b})')}, "
        f"{r6(f'corr({a}, {b})')} AS correlation FROM w"
        for a, b in _PAIRS
    ),
)
def _(spark, sf):
    out = pf.correlation_pairs(landed(spark, sf, _PAIRED), _PAIRED)
    covariance = F.coalesce(F.col("covariance"), F.lit(0.0))
    power = F.floor(F.log10(F.abs(covariance))) - 7
    none = F.abs(covariance) < 1e-6
    return out.select(
        "first",
        "second",
        F.when(none, 0).otherwise(F.round(covariance / F.pow(F.lit(10.0), power))).cast("bigint").alias("covariance_digits"),
        F.when(none, 0).otherwise(power).cast("int").alias("covariance_power"),
        _r6(F.col("correlation")).alias("correlation"),
    )


_SIDES = """a AS (SELECT event_type AS v, count(*) * 1e0 / (SELECT count(*) FROM drift WHERE side = 'ref' AND label = 1) AS s
    FROM drift WHERE side = 'ref' AND label = 1 GROUP BY 1),
  b AS (SELECT event_type AS v, count(*) * 1e0 / (SELECT count(*) FROM drift WHERE side = 'live') AS s
    FROM drift WHERE side = 'live' GROUP BY 1)"""


@query(
    "distribution_diff",
    f"""{prelude("drift")}, {_SIDES}
  SELECT 'complete' AS mode, {r6("sum(abs(coalesce(a.s, 0) - coalesce(b.s, 0)))")} AS difference
  FROM a FULL OUTER JOIN b ON a.v = b.v
  UNION ALL SELECT 'matched', {r6("sum(abs(a.s - b.s))")} FROM a JOIN b ON a.v = b.v""",
)
def _(spark, sf):
    drift = view(spark, sf, "drift")
    ref, live = drift.where("side = 'ref' AND label = 1"), drift.where("side = 'live'")
    out = [
        pf.distribution_diff(ref, live, "event_type", mode).select(F.lit(mode).alias("mode"), "difference")
        for mode in ("complete", "matched")
    ]
    return out[0].unionByName(out[1]).withColumn("difference", _r6(F.col("difference")))


_COMPARED = ["recchrge", "months", "eqpdays"]


@query(
    "compare_datasets",
    f"""{W_SQL}, a AS (SELECT * FROM w WHERE nationkey < 12), b AS (SELECT * FROM w WHERE nationkey >= 12),
  ta AS (SELECT churn AS v, count(*) * 1e0 / (SELECT count(*) FROM a) AS s FROM a GROUP BY 1),
  tb AS (SELECT churn AS v, count(*) * 1e0 / (SELECT count(*) FROM b) AS s FROM b GROUP BY 1),
  m AS (SELECT {", ".join(f"avg(a.{c}) AS {c}" for c in _COMPARED)}, corr(recchrge, months) AS r FROM a),
  k AS (SELECT {", ".join(f"avg(b.{c}) AS {c}" for c in _COMPARED)}, corr(recchrge, months) AS r FROM b)
  SELECT 'target_difference' AS metric, 'churn' AS feature, {r6("sum(abs(ta.s - tb.s))")} AS value FROM ta JOIN tb ON ta.v = tb.v
  UNION ALL SELECT 'correlation_difference', 'recchrge~months', {r6("abs(m.r - k.r)")} FROM m CROSS JOIN k
  """
    + " ".join(
        f"UNION ALL SELECT 'mean_difference', '{c}', {r6(f'abs(m.{c} - k.{c}) / m.{c}')} FROM m CROSS JOIN k" for c in _COMPARED
    )
    + " "
    + " ".join(
        f"UNION ALL SELECT 'category_preservation', '{c}', "
        f"{r6(f'(SELECT count(DISTINCT {c}) FROM b) * 1e0 / (SELECT count(DISTINCT {c}) FROM a)')}"
        for c in ("segment", "prizm_cluster", "nationkey")
    ),
)
def _(spark, sf):
    df = landed(spark, sf, ["churn", "segment", "prizm_cluster", "nationkey", *_COMPARED])
    out = pf.compare_datasets(
        df.where("nationkey < 12"), df.where("nationkey >= 12"), "churn", _COMPARED, ["segment", "prizm_cluster", "nationkey"]
    )
    return out.withColumn("value", _r6(F.col("value")))


@query(
    "missing_categories",
    """SELECT DISTINCT 'p_type' AS column_name, p_type AS value FROM part WHERE p_type NOT IN
    (SELECT p_type FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity >= 50)
  UNION ALL SELECT DISTINCT 'p_brand', p_brand FROM part WHERE p_brand NOT IN
    (SELECT p_brand FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity >= 50)""",
)
def _(spark, sf):
    part = view(spark, sf, "part").select("p_partkey", "p_type", "p_brand")
    sold = view(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 50").select("l_partkey")
    live = part.join(sold, F.col("p_partkey") == F.col("l_partkey"), "left_semi")
    return pf.missing_categories(part, live, ["p_type", "p_brand"])
