"""Queries for record normalisation and feature preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import fields, formulas, scalars
from ...functions.scalars import r6 as _r6
from ...operators import features as ft
from ...operators import normalize as nz
from ...session import scratch_path
from .. import preprocess as pp
from ..bindings import prelude, view, wide
from .base import listed, query, r6
from .shared import (
    CATEGORIES,
    FILLED_SQL,

    FORMULA_SQL,
    GAPS,
    NUMBERS,
    TRAINING_SQL,
    W_SQL,
    derived_sql,
    filled,
    filled_sql,
    landed,
    training_part,
)

RAW_SQL = prelude("raw")


def _rounded(df, names):
    return df.withColumns({n: _r6(F.col(n)) for n in names})


# Normalisation

_MESSY = {
    "customer_id": " Customer_ID ", "children": "Children", "tenure": "TENURE", "minutes_of_use": "Minutes of Use",
    "prizm": " Prizm", "churndep": "ChurnDep", "x": "X",
}


@query("normalize_columns", f"{RAW_SQL} SELECT * FROM raw")
def _(spark, sf):
    raw = view(spark, sf, "raw")
    return nz.normalize_columns(raw.toDF(*[_MESSY[c] for c in raw.columns]))


@query(
    "canonical_rename",
    f"{RAW_SQL} SELECT customer_id, children, tenure AS months, minutes_of_use AS mou, prizm AS prizm_cluster, "
    "churndep AS churn, x FROM raw",
)
def _(spark, sf):
    return nz.canonical_rename(view(spark, sf, "raw"))


@query("drop_columns", f"{RAW_SQL} SELECT customer_id, children, tenure, minutes_of_use, prizm, churndep FROM raw")
def _(spark, sf):
    return nz.drop_columns(view(spark, sf, "raw"))


@query(
    "coerce_boolean",
    f"""{RAW_SQL} SELECT customer_id,
  CASE WHEN children IN ('Yes', 'yes', 'YES', 'Y', 'y', '1') THEN 1 ELSE 0 END AS children,
  CASE WHEN churndep IN ('Yes', 'yes', 'YES', 'Y', 'y', '1') THEN 1 ELSE 0 END AS churndep FROM raw""",
)
def _(spark, sf):
    raw = view(spark, sf, "raw").select("customer_id", "children", "churndep")
    return nz.coerce_boolean(raw, ["children", "churndep"])


@query(
    "coerce_numeric",
    f"""{RAW_SQL} SELECT customer_id, coalesce(CASE WHEN abs(TRY_CAST(tenure AS DOUBLE)) < 9e18 THEN
    CAST(trunc(TRY_CAST(tenure AS DOUBLE)) AS BIGINT) END, 0) AS months,
  CASE WHEN NOT isnan(TRY_CAST(minutes_of_use AS DOUBLE)) THEN TRY_CAST(minutes_of_use AS DOUBLE) END AS mou FROM raw""",
)
def _(spark, sf):
    raw = nz.canonical_rename(view(spark, sf, "raw"))
    return nz.coerce_numeric(raw.select("customer_id", "months", "mou"))


@query(
    "clean_category",
    f"""{RAW_SQL} SELECT customer_id,
  nullif(lower(regexp_replace(CASE WHEN prizm IN ('nan', 'None') THEN '' ELSE prizm END, '{scalars.WHITE_ENDS}', '', 'g')), '')
    AS prizm_cluster FROM raw""",
)
def _(spark, sf):
    raw = nz.canonical_rename(view(spark, sf, "raw"))
    return nz.clean_category(raw.select("customer_id", "prizm_cluster"))


@query(
    "nan_to_null",
    "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events",
)
def _(spark, sf):
    holes = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return nz.nan_to_null(view(spark, sf, "events").select("event_id", holes.alias("value")))


_OCCUPATIONS = ["professional", "clerical", "craft", "student", "homemaker", "retired", "self-employed"]
_OCC_FLAGS = ["occprof", "occcler", "occcrft", "occstud", "occhmkr", "occret", "occself"]


@query(
    "expand_categories",
    f"""{W_SQL}, c AS (SELECT customer_id, prizm_cluster,
    {"".join(f"CASE WHEN nationkey % 9 = {i} THEN '{o}' ELSE " for i, o in enumerate(_OCCUPATIONS))}NULL{" END" * 7}
      AS occupation, CASE WHEN marryyes = 1 THEN 'married' WHEN customer_id % 7 = 0 THEN 'unknown' ELSE 'unmarried' END
      AS marital_status FROM w)
  SELECT customer_id,
    CASE WHEN prizm_cluster = 'rural' THEN 1 ELSE 0 END AS prizmrur,
    CASE WHEN prizm_cluster = 'urban' THEN 1 ELSE 0 END AS prizmub,
    CASE WHEN prizm_cluster = 'town' THEN 1 ELSE 0 END AS prizmtwn,
    {", ".join(f"CASE WHEN occupation = '{o}' THEN 1 ELSE 0 END AS {f}" for o, f in zip(_OCCUPATIONS, _OCC_FLAGS))},
    CASE WHEN marital_status = 'married' THEN 1 ELSE 0 END AS marryyes,
    CASE WHEN marital_status = 'unmarried' THEN 1 ELSE 0 END AS marryun FROM c""",
)
def _(spark, sf):
    occupation = F.element_at(F.array(*[F.lit(o) for o in _OCCUPATIONS]), (F.col("nationkey") % 9 + 1).cast("int"))
    marital = (
        F.when(F.col("marryyes") == 1, "married").when(F.col("customer_id") % 7 == 0, "unknown").otherwise("unmarried")
    )
    choices = wide(spark, sf, ["customer_id", "prizm_cluster", "nationkey", "marryyes"]).select(
        "customer_id",
        "prizm_cluster",
        F.when(F.col("nationkey") % 9 < 7, occupation).alias("occupation"),
        marital.alias("marital_status"),
    )
    return nz.expand_categories(choices)


@query(
    "stamp_lineage",
    f"{W_SQL} SELECT customer_id, 'csv' AS source, 'BATCH_20240101_000000' AS batch_id, true AS stamped FROM w",
)
def _(spark, sf):
    stamped = nz.stamp_lineage(wide(spark, sf, ["customer_id"]), "csv", "BATCH_20240101_000000")
    return stamped.withColumn("stamped", F.col("timestamp").isNotNull()).drop("timestamp")


@query(
    "clip_to_reference",
    f"""{prelude("drift")}, b AS (SELECT min(value) AS lo, max(value) AS hi FROM drift WHERE side = 'ref')
  SELECT event_id, {r6("greatest(least(value_drifted, hi + 0.05e0 * abs(hi)), lo - 0.05e0 * abs(lo))")} AS value_drifted
  FROM drift CROSS JOIN b WHERE side = 'live'""",
)
def _(spark, sf):
    drift = view(spark, sf, "drift")
    lo, hi = nz.reference_bounds(drift.where("side = 'ref'"), ["value"])["value"]
    live = drift.where("side = 'live'").select("event_id", "value_drifted")
    return _rounded(nz.clip_to_reference(live, {"value_drifted": (lo, hi)}), ["value_drifted"])


@query(
    "feature_projection",
    f"{FILLED_SQL}, d AS (SELECT *, {derived_sql(fields.DERIVED)} FROM wi) "
    f"SELECT {listed(fields.DERIVED, r6('{0}') + ' AS {0}')}, churn FROM d",
)
def _(spark, sf):
    derived = ft.derive(filled(spark, sf), fields.DERIVED)
    return _rounded(nz.feature_projection(derived), fields.DERIVED)


_ALIGNED = ["months", "webcap", "mou", "incmiss", "revenue"]


@query(
    "align_features",
    f"{W_SQL} SELECT customer_id, months, CAST(0 AS DOUBLE) AS webcap, mou, CAST(0 AS DOUBLE) AS incmiss, revenue FROM w",
)
def _(spark, sf):
    return nz.align_features(wide(spark, sf, ["customer_id", "months", "mou", "revenue"]), _ALIGNED, keep=["customer_id"])


_PACKED = ["recchrge", "months", "age2", "children", "prizm_cluster"]


@query(
    "pack_features_json",
    f"{W_SQL} SELECT customer_id, CAST(json_object({', '.join(f'{chr(39)}{c}{chr(39)}, {c}' for c in _PACKED)}) "
    "AS VARCHAR) AS features FROM w",
)
def _(spark, sf):
    return wide(spark, sf, ["customer_id", *_PACKED]).select("customer_id", scalars.pack(_PACKED).alias("features"))


@query(
    "unpack_features_json",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, CAST(NULL AS DOUBLE) AS absent FROM events",
)
def _(spark, sf):
    return view(spark, sf, "events").select("event_id", *scalars.unpack(F.col("props"), ["k", "absent"]))


@query(
    "encode_target",
    f"{RAW_SQL} SELECT customer_id, CASE WHEN regexp_replace(churndep, '{scalars.WHITE_ENDS}', '', 'g') IN ('True', 'Yes', 'true', 'yes', '1') THEN 1 ELSE 0 END "
    "AS churn FROM raw",
)
def _(spark, sf):
    raw = view(spark, sf, "raw").select("customer_id", F.col("churndep").alias("churn"))
    return ft.encode_target(raw)


# Imputation


@query("impute_median_mode", f"{FILLED_SQL} SELECT * REPLACE ({listed(GAPS, r6('{0}') + ' AS {0}')}) FROM wi")
def _(spark, sf):
    return _rounded(filled(spark, sf), GAPS)


@query(
    "impute_apply",
    f"""{W_SQL}, {TRAINING_SQL},
  m AS (SELECT median(revenue) AS revenue, median(mou) AS mou, median(overage) AS overage FROM train),
  a AS (SELECT median(age2) AS age2 FROM w)
  SELECT customer_id, {", ".join(f"{r6(f'coalesce(w.{c}, m.{c})')} AS {c}" for c in GAPS[:3])},
    {r6("coalesce(w.age2, a.age2)")} AS age2 FROM w CROSS JOIN m CROSS JOIN a""",
)
def _(spark, sf):
    df = landed(spark, sf, ["customer_id", "segment", *GAPS])
    stored = ft.fit_median_mode(training_part(df), GAPS[:3], [])
    return _rounded(ft.impute_production(df, stored, ["age2"]).drop("segment"), GAPS)


@query(
    "impute_mean_mode",
    f"""{W_SQL}, m AS (SELECT {listed(GAPS, 'avg({0}) AS {0}')}, (SELECT prizm_cluster FROM w WHERE prizm_cluster IS NOT NULL
      GROUP BY prizm_cluster ORDER BY count(*) DESC, prizm_cluster LIMIT 1) AS prizm_cluster FROM w)
  SELECT w.* EXCLUDE (customer_id, nationkey) REPLACE ({listed(GAPS, r6('coalesce(w.{0}, m.{0})') + ' AS {0}')},
    coalesce(w.prizm_cluster, m.prizm_cluster) AS prizm_cluster) FROM w CROSS JOIN m""",
)
def _(spark, sf):
    df = landed(spark, sf).drop("customer_id", "nationkey")
    return _rounded(ft.impute(df, ft.fit_mean_mode(df)), GAPS)


# Derived features


@query(
    "derived_features",
    f"{FILLED_SQL}, d AS (SELECT *, {derived_sql(fields.DERIVED)} FROM wi) "
    f"SELECT customer_id, {listed(fields.DERIVED, r6('{0}') + ' AS {0}')} FROM d",
)
def _(spark, sf):
    df = filled(spark, sf)
    names = ft.fit_derive(df)
    return _rounded(ft.derive(df, names).select("customer_id", *names), names)


def _group(group: str, names: list[str]) -> None:
    @query(
        f"derived_{group}",
        f"{FILLED_SQL}, d AS (SELECT *, {derived_sql(names)} FROM wi) "
        f"SELECT customer_id, {listed(names, r6('{0}') + ' AS {0}')} FROM d",
    )
    def _(spark, sf):
        sources = sorted({s for n in names for s in formulas.REGISTRY[n].sources})
        df = landed(spark, sf, ["customer_id", *sources])
        full = ft.impute(df, ft.fit_median_mode(df, [s for s in sources if s in GAPS], []))
        return _rounded(ft.derive(full, names).select("customer_id", *names), names)


for _name, _members in formulas.GROUPS.items():
    _group(_name, _members)

# With the nulls left in, features over gappy sources are skipped; without its source column, one is 0.
_LIVE = [n for n in fields.DERIVED if not set(formulas.REGISTRY[n].sources) & set(GAPS)]


@query(
    "derived_apply",
    f"{W_SQL} SELECT customer_id, "
    + ", ".join(
        f"CAST(0 AS DOUBLE) AS {n}" if n == "device_tenure_index" else f"{r6(FORMULA_SQL[n])} AS {n}" for n in _LIVE
    )
    + " FROM w",
)
def _(spark, sf):
    live = landed(spark, sf).drop("eqpdays")
    out = ft.derive_production(live, fields.DERIVED)
    names = [c for c in out.columns if c in fields.DERIVED]
    return _rounded(out.select("customer_id", *names), names)


# Encoding and scaling


@query(
    "label_encode",
    f"""{FILLED_SQL},
  s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT segment AS v FROM wi)),
  p AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT prizm_cluster AS v FROM wi)),
  r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT CAST(nationkey AS VARCHAR) AS v FROM wi))
  SELECT customer_id, CAST(s.code AS INTEGER) AS segment, CAST(p.code AS INTEGER) AS prizm_cluster,
    CAST(r.code AS INTEGER) AS nationkey
  FROM wi JOIN s ON s.v = segment JOIN p ON p.v = prizm_cluster JOIN r ON r.v = CAST(nationkey AS VARCHAR)""",
)
def _(spark, sf):
    columns = ["segment", "prizm_cluster", "nationkey"]
    df = landed(spark, sf, ["customer_id", *columns])
    df = ft.impute(df, ft.fit_median_mode(df, [], ["prizm_cluster"]))
    return ft.encode_labels(df, ft.fit_labels(df, columns))


@query(
    "label_encode_table",
    """SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS p_type,
    CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS p_brand FROM part""",
)
def _(spark, sf):
    df = view(spark, sf, "part").select("p_partkey", "p_type", "p_brand")
    return ft.encode_labels(df, ft.fit_labels(df, ["p_type", "p_brand"], inline=0), ["p_type", "p_brand"])


@query(
    "label_encode_apply",
    f"""{W_SQL}, {TRAINING_SQL},
  s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT segment AS v FROM train)),
  p AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code
        FROM (SELECT DISTINCT prizm_cluster AS v FROM train WHERE prizm_cluster IS NOT NULL))
  SELECT customer_id, CAST(coalesce(s.code, -1) AS INTEGER) AS segment,
    CAST(coalesce(p.code, -1) AS INTEGER) AS prizm_cluster
  FROM w LEFT JOIN s ON s.v = segment LEFT JOIN p ON p.v = prizm_cluster""",
)
def _(spark, sf):
    df = landed(spark, sf, ["customer_id", "segment", "prizm_cluster"])
    return ft.encode_labels(df, ft.fit_labels(training_part(df), ["segment", "prizm_cluster"]))


def _scaled_sql(names, stats_from):
    mean = ", ".join(f"avg({c}) AS {c}_m, coalesce(nullif(stddev_pop({c}), 0), 1) AS {c}_s" for c in names)
    return f"st AS (SELECT {mean} FROM {stats_from})"


@query(
    "standard_scale",
    f"{FILLED_SQL}, {_scaled_sql(NUMBERS, 'wi')} "
    f"SELECT customer_id, {listed(NUMBERS, r6('({0} - {0}_m) / {0}_s') + ' AS {0}')} FROM wi CROSS JOIN st",
)
def _(spark, sf):
    df = filled(spark, sf).select("customer_id", *NUMBERS)
    return _rounded(ft.scale(df, ft.fit_scale(df, NUMBERS)), NUMBERS)


@query(
    "scale_apply",
    f"{W_SQL}, {TRAINING_SQL}, {_scaled_sql(NUMBERS, 'train')} "
    f"SELECT customer_id, {listed(NUMBERS, r6('({0} - {0}_m) / {0}_s') + ' AS {0}')} FROM w CROSS JOIN st",
)
def _(spark, sf):
    df = landed(spark, sf, ["customer_id", "segment", *NUMBERS])
    scaled = ft.scale(df, ft.fit_scale(training_part(df), NUMBERS))
    return _rounded(scaled.drop("segment"), NUMBERS)


# Whole pipelines

_FIT_SQL = f"""{FILLED_SQL}, d AS (SELECT *, {derived_sql(fields.DERIVED)} FROM wi),
  {_scaled_sql(fields.DERIVED, 'd')}
  SELECT customer_id, {listed(fields.DERIVED, r6('({0} - {0}_m) / {0}_s') + ' AS {0}')}"""

_APPLY_SQL = f"""{W_SQL}, {TRAINING_SQL}, {filled_sql("train", "ti", "train")}, {filled_sql("train", "wi", "w")},
  td AS (SELECT *, {derived_sql(fields.DERIVED)} FROM ti), d AS (SELECT *, {derived_sql(fields.DERIVED)} FROM wi),
  {_scaled_sql(fields.DERIVED, 'td')}
  SELECT customer_id, {listed(fields.DERIVED, r6('({0} - {0}_m) / {0}_s') + ' AS {0}')} FROM d CROSS JOIN st"""


@query("preprocess_fit", f"{_FIT_SQL}, churn FROM d CROSS JOIN st")
def _(spark, sf):
    df = landed(spark, sf)
    params = pp.fit_preprocess(df, NUMBERS, CATEGORIES)
    return _rounded(pp.run_preprocess(df, params, keep=["customer_id"]), params.features)


@query("preprocess_apply", _APPLY_SQL)
def _(spark, sf):
    df = landed(spark, sf)
    params = pp.fit_preprocess(training_part(df), NUMBERS, CATEGORIES)
    return _rounded(pp.apply_preprocess(df, params, keep=["customer_id"]), params.features)


@query(
    "preprocess_wide_labels",
    """SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY CAST(o_orderkey AS VARCHAR)) - 1 AS INTEGER) AS order_name,
    CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS o_orderpriority FROM orders""",
)
def _(spark, sf):
    """An encoder with as many classes as orders, above the limit for lists, beside one with five."""
    orders = view(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderkey").cast("string").alias("order_name"), "o_orderpriority"
    )
    path, columns = scratch_path(spark, "params"), ["order_name", "o_orderpriority"]
    pp.save_params(pp.fit_preprocess(orders, [], columns), spark, path)
    return pp.apply_preprocess(orders, pp.load_params(spark, path), ["o_orderkey"], encode=columns)


@query("artifacts_roundtrip", f"{_FIT_SQL} FROM d CROSS JOIN st")
def _(spark, sf):
    df = landed(spark, sf)
    path = scratch_path(spark, "params")
    pp.save_params(pp.fit_preprocess(df, NUMBERS, CATEGORIES), spark, path)
    params = pp.load_params(spark, path)
    return _rounded(pp.apply_preprocess(df, params, keep=["customer_id"]), params.features)


