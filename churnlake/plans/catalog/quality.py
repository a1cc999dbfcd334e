"""Queries for contracts, row rules, gates and table profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import fields
from ...functions.scalars import r6 as _r6
from ...operators import quality as ql
from ..bindings import view, wide
from .base import query, r6
from .shared import FLAGS, NUMBERS, TEXTS, W_SQL, landed

# Columns of the contract that the bound table has, plus one declared but absent.
_CONTRACT = {
    c: {**spec, **({"min": 0.0} if c == "setprc" else {}), **({"max": 9.0} if c == "income" else {})}
    for c, spec in fields.column_contract().items()
    if c in NUMBERS or c in FLAGS or c in ("churn", "webcap")
}
_CONTRACT["prizm_cluster"] = {"dtype": "category", "allow_null": False, "allowed_values": ["rural", "urban", "town"]}
_CONTRACT["segment"] = {"dtype": "int", "allow_null": False}


def _rule_sql(name: str, spec: dict) -> list[tuple[str, str, str]]:
    if name == "webcap":
        return [(name, "present", "true")]
    whole = name in FLAGS or name == "churn"
    matches = {"float": name in NUMBERS or whole, "int": whole, "category": name == "prizm_cluster"}[spec["dtype"]]
    out = [(name, "type", "false" if matches else "true")]
    if not spec["allow_null"]:
        out.append((name, "not_null", f"{name} IS NULL"))
    if "min" in spec:
        out.append((name, "min", f"{name} < {spec['min']}"))
    if "max" in spec:
        out.append((name, "max", f"{name} > {spec['max']}"))
    if "allowed_values" in spec:
        values = ", ".join(repr(v) for v in spec["allowed_values"])
        out.append((name, "allowed_values", f"NOT coalesce({name} IN ({values}), false)"))
    return out


_CHECKS = [check for name, spec in _CONTRACT.items() for check in _rule_sql(name, spec)]
_CONTRACT_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{r}' AS rule, count(*) FILTER (WHERE {p}) AS violations FROM w" for c, r, p in _CHECKS
)


@query(
    "check_columns",
    f"""{W_SQL} SELECT v.issue, v.column_name, (SELECT count(*) FROM w) AS rows_concerned
  FROM (VALUES ('missing', 'webcap'), ('missing', 'mcycle'), ('unexpected', 'segment'), ('unexpected', 'nationkey'),
    ('unexpected', 'prizm_cluster'), ('unexpected', 'customer_id')) v(issue, column_name)""",
)
def _(spark, sf):
    return ql.check_columns(wide(spark, sf), [*NUMBERS, *FLAGS, "churn", "webcap", "mcycle"])


@query(
    "check_target",
    f"""{W_SQL}, c AS (SELECT churn, count(*) AS n FROM w GROUP BY churn)
  SELECT CAST(coalesce(sum(CASE WHEN churn IS NULL THEN n END), 0) AS BIGINT) AS nulls, count(churn) AS classes,
    {r6("max(CASE WHEN churn IS NOT NULL THEN n END) * 1e0 / sum(CASE WHEN churn IS NOT NULL THEN n END)")} AS max_share,
    (coalesce(sum(CASE WHEN churn IS NULL THEN n END), 0) = 0 AND count(churn) >= 2) AS valid,
    max(n) * 1e0 / sum(n) > 0.95 AS imbalanced FROM c""",
)
def _(spark, sf):
    return ql.check_target(wide(spark, sf, ["churn"])).withColumn("max_share", _r6(F.col("max_share")))


@query("contract_report", f"{W_SQL} {_CONTRACT_SQL}")
def _(spark, sf):
    return ql.contract_report(wide(spark, sf), _CONTRACT)


_DECLARED_SHORT = [c for c in _CONTRACT if c in {*NUMBERS, *FLAGS, *TEXTS, "churn"}]


@query("contract_projection", f"{W_SQL} SELECT {', '.join(_DECLARED_SHORT)} FROM w")
def _(spark, sf):
    return ql.contract_projection(wide(spark, sf), _CONTRACT)


@query(
    "validation_record",
    f"""{W_SQL}, r AS ({_CONTRACT_SQL}),
  i AS (SELECT string_agg(column_name || '.' || rule || ': ' || violations, '; ' ORDER BY column_name || '.' || rule
    || ': ' || violations) AS issues FROM r WHERE violations > 0)
  SELECT 'csv' AS source, 'random_forest' AS model, (SELECT count(*) FROM w) AS row_count, 61 AS column_count, issues,
    CASE WHEN issues IS NULL THEN 'Validated' ELSE 'Failed' END AS stage FROM i""",
)
def _(spark, sf):
    record = ql.validation_record(landed(spark, sf), _CONTRACT, "csv", "random_forest", stamp=False)
    return record.withColumn("issues", F.concat_ws("; ", "issues"))


# Row rules: the oracle states every rule on its own.

_RULES_SQL = [(f"{c}_non_negative", f"{c} < 0") for c in fields.NON_NEGATIVE]
_RULES_SQL += [
    ("age1_range", "age1 < 0 OR age1 > 120"),
    ("age2_range", "age2 < 0 OR age2 > 120"),
    ("income_range", "income < 0 OR income > 9"),
]
_RULES_SQL += [(f"{c}_binary", f"{c} NOT IN (0, 1)") for c in fields.BINARY if c in FLAGS]
_RULES_SQL += [
    ("age_order", "age1 < age2"),
    ("newcell_exclusive", "newcelly = 1 AND newcelln = 1"),
    ("newcell_present", "newcelly IS NULL AND newcelln IS NULL"),
    ("actvsubs_within_uniqsubs", "actvsubs > uniqsubs"),
    ("actvsubs_at_least_one", "uniqsubs IS NOT NULL AND actvsubs < 1"),
    ("retcall_has_calls", "retcall = 1 AND coalesce(retcalls, 0) < 1"),
    ("churn_binary", "churn NOT IN (0, 1)"),
]
_ERRORS_SQL = f"concat_ws(',', {', '.join(f'CASE WHEN {p} THEN {chr(39)}{n}{chr(39)} END' for n, p in _RULES_SQL)})"


@query("row_rules", f"{W_SQL} SELECT customer_id, {_ERRORS_SQL} AS errors FROM w")
def _(spark, sf):
    return ql.with_errors(wide(spark, sf)).select("customer_id", F.concat_ws(",", "errors").alias("errors"))


@query(
    "quarantine_split",
    f"""{W_SQL}, e AS (SELECT *, {_ERRORS_SQL} AS errors FROM w)
  SELECT customer_id, CASE WHEN errors = '' THEN 'valid' ELSE 'quarantine' END AS side, errors, revenue, age1, income
  FROM e""",
)
def _(spark, sf):
    valid, rejected = ql.quarantine_split(landed(spark, sf))
    data = ["customer_id", "revenue", "age1", "income"]
    return valid.select(*data, F.lit("valid").alias("side"), F.lit("").alias("errors")).unionByName(
        rejected.select(*data, F.lit("quarantine").alias("side"), F.concat_ws(",", "errors").alias("errors"))
    )


@query(
    "rule_summary",
    f"{W_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {p}) AS violations FROM w" for n, p in _RULES_SQL
    ),
)
def _(spark, sf):
    return ql.rule_summary(wide(spark, sf))


# Gates

_GATE_COLUMNS = [*NUMBERS, *FLAGS]


@query(
    "training_readiness",
    f"""{W_SQL}, g AS (SELECT count(*) FILTER (WHERE {' OR '.join(f'{c} IS NULL' for c in _GATE_COLUMNS)}) = 0 AS complete,
    count(*) FILTER (WHERE churn IS NULL) = 0 AS target, count(DISTINCT churn) >= 2 AS classes FROM w)
  SELECT 'features_complete' AS "check", complete AS passed FROM g UNION ALL SELECT 'target_complete', target FROM g
  UNION ALL SELECT 'features_numeric', true UNION ALL SELECT 'two_classes', classes FROM g""",
)
def _(spark, sf):
    return ql.training_readiness(wide(spark, sf, [*_GATE_COLUMNS, "churn"]))


@query(
    "quality_gate",
    f"""{W_SQL}, c AS (SELECT churn, count(*) AS n FROM w GROUP BY churn), g AS (SELECT sum(n) AS n, min(n) AS least FROM c),
  b AS (SELECT count(*) FILTER (WHERE {' OR '.join(f'{c} IS NULL' for c in _GATE_COLUMNS)}) AS bad FROM w)
  SELECT 'has_data' AS "check", n > 0 AS passed FROM g UNION ALL SELECT 'has_features', true
  UNION ALL SELECT 'no_nulls', bad = 0 FROM b UNION ALL SELECT 'has_target', true
  UNION ALL SELECT 'class_balance', least * 1e0 / n > 0.1 FROM g""",
)
def _(spark, sf):
    return ql.quality_gate(wide(spark, sf, [*_GATE_COLUMNS, "churn"]))


@query(
    "declared_limits",
    f"""{W_SQL}, c AS (SELECT churn, count(*) AS n FROM w GROUP BY churn), g AS (SELECT sum(n) AS n, min(n) AS least FROM c),
  b AS (SELECT sum({' + '.join(f'CASE WHEN {c} IS NULL THEN 1 ELSE 0 END' for c in _GATE_COLUMNS)}) AS nulls FROM w)
  SELECT 'enough_rows' AS "check", n >= 1000 AS passed FROM g
  UNION ALL SELECT 'few_nulls', nulls * 100e0 <= 5e0 * n * {len(_GATE_COLUMNS) + 1} FROM g, b
  UNION ALL SELECT 'balanced', least * 1e0 / n >= 0.1 FROM g""",
)
def _(spark, sf):
    return ql.declared_limits(wide(spark, sf, [*_GATE_COLUMNS, "churn"]))


# Profiles

_PROFILED = ["customer_id", "segment", "nationkey", *NUMBERS, *FLAGS, "prizm_cluster", "churn"]


@query(
    "null_profile",
    f"{W_SQL} SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls FROM w" for c in _PROFILED)
    + ") ORDER BY nulls DESC, column_name LIMIT 10",
)
def _(spark, sf):
    return ql.null_profile(wide(spark, sf))


_SUMMARY = {
    "count": "count({0})",
    "mean": r6("avg({0})"),
    "std": r6("stddev_samp({0})"),
    "min": r6("min({0})"),
    "p25": r6("quantile_cont({0}, 0.25)"),
    "p50": r6("quantile_cont({0}, 0.5)"),
    "p75": r6("quantile_cont({0}, 0.75)"),
    "max": r6("max({0})"),
}


@query(
    "describe_numeric",
    f"{W_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, " + ", ".join(f'{e.format(c)} AS "{n}"' for n, e in _SUMMARY.items()) + " FROM w"
        for c in NUMBERS
    ),
)
def _(spark, sf):
    out = ql.describe_numeric(landed(spark, sf, NUMBERS), NUMBERS)
    return out.withColumns({c: _r6(F.col(c)) for c in _SUMMARY if c != "count"})


# Model schemas

_DECLARED = {
    "revenue": "numeric", "months": "integer", "churn": "smallint", "segment": "varchar", "prizm_cluster": "text",
    "customer_id": "bigint", "webcap": "bigint", "nationkey": "double precision", "age1": "float64",
}


@query(
    "schema_drift",
    f"""{W_SQL} SELECT 'revenue' AS column_name, 'double' AS expected, 'double' AS actual, 'ok' AS verdict,
    count(revenue) AS filled_rows FROM w
  UNION ALL SELECT 'months', 'bigint', 'double', 'type_mismatch', count(months) FROM w
  UNION ALL SELECT 'churn', 'bigint', 'bigint', 'ok', count(churn) FROM w
  UNION ALL SELECT 'segment', 'string', 'string', 'ok', count(segment) FROM w
  UNION ALL SELECT 'prizm_cluster', 'string', 'string', 'ok', count(prizm_cluster) FROM w
  UNION ALL SELECT 'customer_id', 'bigint', 'bigint', 'ok', count(customer_id) FROM w
  UNION ALL SELECT 'webcap', 'bigint', '', 'missing', 0
  UNION ALL SELECT 'nationkey', 'double', 'bigint', 'type_mismatch', count(nationkey) FROM w
  UNION ALL SELECT 'age1', 'double', 'double', 'ok', count(age1) FROM w""",
)
def _(spark, sf):
    return ql.schema_drift(wide(spark, sf), _DECLARED)


@query(
    "schema_check",
    f"""{W_SQL} SELECT 'revenue' AS column_name, 'double' AS expected, 'double' AS actual, 'ok' AS verdict,
    count(revenue) AS filled_rows FROM w
  UNION ALL SELECT 'months', 'bigint', 'double', 'type_mismatch', count(months) FROM w
  UNION ALL SELECT 'webcap', 'bigint', '', 'missing', 0""",
)
def _(spark, sf):
    # Every order priority registers the schema of "model 7"; an older one and another model's must not count.
    kinds = view(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("model_type")).agg(
        F.max("o_orderdate").alias("newest"), F.min("o_orderdate").alias("oldest")
    )

    def named(name, when, columns):
        listed = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("dtype")) for c, t in columns.items()])
        return kinds.select("model_type", F.lit(name).alias("schema_name"), F.col(when).alias("created_at"), F.inline(listed))

    schemas = named("7_schema", "oldest", {"revenue": "numeric", "months": "integer", "webcap": "bigint"})
    schemas = schemas.unionByName(named("other", "newest", {"segment": "text"}))
    return ql.schema_check(wide(spark, sf), schemas, "1-URGENT", "7")


# A registry with one schema per priority class and month, named in turn by each pattern.
_REGISTRY = """SELECT o_orderpriority AS model_type,
    CASE month(o_orderdate) % 5 WHEN 0 THEN '{v}_schema' WHEN 1 THEN 'v{v}_schema' WHEN 2 THEN '{v}'
      WHEN 3 THEN 'schema_{v}' ELSE 'draft_{v}' END AS pattern,
    concat(CAST(year(o_orderdate) AS STRING), '_', CAST(month(o_orderdate) AS STRING)) AS version,
    max(o_orderdate) AS created_at
  FROM {orders} GROUP BY 1, 2, 3"""


@query(
    "resolve_schema",
    f"""WITH g AS ({_REGISTRY.replace("{orders}", "orders")}),
  reg AS (SELECT model_type, replace(pattern, '{{v}}', version) AS schema_name, created_at FROM g),
  req AS (SELECT DISTINCT model_type, version FROM g),
  tries AS (SELECT model_type, version, 0 AS priority, version || '_schema' AS schema_name FROM req
    UNION ALL SELECT model_type, version, 1, 'v' || version || '_schema' FROM req
    UNION ALL SELECT model_type, version, 2, version FROM req
    UNION ALL SELECT model_type, version, 3, 'schema_' || version FROM req),
  hit AS (SELECT t.model_type, t.version, arg_min(t.schema_name, t.priority) AS hit
    FROM tries t JOIN reg USING (model_type, schema_name) GROUP BY 1, 2),
  def AS (SELECT model_type, schema_name, row_number() OVER (PARTITION BY model_type
    ORDER BY created_at DESC, schema_name DESC) AS rn FROM reg)
  SELECT req.model_type, req.version, coalesce(hit.hit, def.schema_name) AS schema_name, hit.hit IS NULL AS is_default
  FROM req LEFT JOIN hit ON hit.model_type = req.model_type AND hit.version = req.version
  LEFT JOIN def ON def.model_type = req.model_type AND def.rn = 1""",
)
def _(spark, sf):
    orders = view(spark, sf, "orders")
    month = F.month("o_orderdate")
    version = F.concat_ws("_", F.year("o_orderdate").cast("string"), month.cast("string"))
    name = (
        F.when(month % 5 == 0, F.concat(version, F.lit("_schema")))
        .when(month % 5 == 1, F.concat(F.lit("v"), version, F.lit("_schema")))
        .when(month % 5 == 2, version)
        .when(month % 5 == 3, F.concat(F.lit("schema_"), version))
        .otherwise(F.concat(F.lit("draft_"), version))
    )
    registry = orders.groupBy(
        F.col("o_orderpriority").alias("model_type"), version.alias("version"), name.alias("schema_name")
    ).agg(F.max("o_orderdate").alias("created_at"))
    return ql.resolve_schema(registry, registry.select("model_type", "version").distinct())


