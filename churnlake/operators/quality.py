"""Validation of customer tables: contracts, row rules, readiness gates and profiles.

Whole-table checks are one aggregate over all columns; per-row rules are one projection.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields, rules
from .quantiles import exact_quantiles, is_numeric
from .ranking import beside

_INTEGER = ("bigint", "int", "smallint", "tinyint")


def _count_if(predicate: Column) -> Column:
    return F.count(F.when(predicate, 1))


def _as_rows(df: DataFrame, entries: Sequence[tuple], labels: Sequence[str], value: str) -> DataFrame:
    """One aggregate over ``df``, turned into one row per entry: the labels, then the aggregate."""
    aggregates = [agg.alias(f"a{i}") for i, (*_, agg) in enumerate(entries)]
    one = df.agg(*aggregates)
    rows = F.array(
        *[
            F.struct(*[F.lit(v).alias(n) for n, v in zip(labels, label)], F.col(f"a{i}").alias(value))
            for i, (*label, _) in enumerate(entries)
        ]
    )
    return one.select(F.inline(rows))


# Column sets and contracts


def check_columns(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Missing and unexpected columns, each with the number of rows concerned."""
    present = [c.strip().lower() for c in df.columns]
    wanted = [c.lower() for c in expected]
    issues = [("missing", c) for c in wanted if c not in present]
    issues += [("unexpected", c) for c in present if c not in wanted]
    rows = F.array(*[F.struct(F.lit(i).alias("issue"), F.lit(c).alias("column_name")) for i, c in issues])
    counted = df.agg(F.count(F.lit(1)).alias("rows_concerned"))
    if not issues:
        return counted.where(F.lit(False)).select(
            F.lit("").alias("issue"), F.lit("").alias("column_name"), "rows_concerned"
        )
    return counted.select(F.inline(rows), "rows_concerned")


def check_target(df: DataFrame, target: str = fields.TARGET, dominant: float = 0.95) -> DataFrame:
    """Null count, class count and largest class share of the target, with the verdicts."""
    counts = df.groupBy(F.col(target).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    known = F.col("value").isNotNull()
    return counts.agg(
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("nulls"),
        _count_if(known).alias("classes"),
        F.try_divide(F.max(F.when(known, F.col("n"))), F.sum(F.when(known, F.col("n")))).alias("max_share"),
    ).select(
        "nulls",
        "classes",
        "max_share",
        ((F.col("nulls") == 0) & (F.col("classes") >= 2)).alias("valid"),
        F.coalesce(F.col("max_share") > dominant, F.lit(False)).alias("imbalanced"),
    )


def _type_matches(declared: str, kind: str) -> bool:
    return {
        "float": is_numeric(kind),
        "int": kind in _INTEGER,
        "category": kind == "string",
    }.get(declared, False)


def contract_checks(df: DataFrame, contract: Mapping[str, Mapping]) -> list[tuple[str, str, Column]]:
    """``(column, rule, violation count)`` for every rule the contract states."""
    kinds = dict(df.dtypes)
    everything = F.count(F.lit(1))
    never = F.count(F.lit(None))
    checks: list[tuple[str, str, Column]] = []
    for name, spec in contract.items():
        if name not in kinds:
            checks.append((name, "present", everything))
            continue
        c = F.col(name)
        checks.append((name, "type", never if _type_matches(spec["dtype"], kinds[name]) else everything))
        if not spec.get("allow_null", True):
            checks.append((name, "not_null", _count_if(c.isNull())))
        if spec.get("min") is not None:
            checks.append((name, "min", _count_if(c < spec["min"])))
        if spec.get("max") is not None:
            checks.append((name, "max", _count_if(c > spec["max"])))
        if spec.get("allowed_values") is not None:
            allowed = F.coalesce(c.isin(*spec["allowed_values"]), F.lit(False))
            checks.append((name, "allowed_values", _count_if(~allowed)))
    return checks


def contract_report(df: DataFrame, contract: Mapping[str, Mapping]) -> DataFrame:
    """``(column_name, rule, violations)`` from one aggregate over the whole table."""
    return _as_rows(df, contract_checks(df, contract), ["column_name", "rule"], "violations")


def contract_projection(df: DataFrame, contract: Mapping[str, Mapping]) -> DataFrame:
    """The declared columns that exist, in contract order."""
    return df.select(*[c for c in contract if c in df.columns])


def validation_record(
    df: DataFrame, contract: Mapping[str, Mapping], source: str, model: str, stamp: bool = True
) -> DataFrame:
    """One row: rows, columns, issues, stage and origin, ready to append to a validation log."""
    report = contract_report(df, {**contract})
    total = df.agg(F.count(F.lit(1)).alias("row_count"))
    issue = F.concat_ws(": ", F.concat_ws(".", "column_name", "rule"), F.col("violations").cast("string"))
    found = report.where(F.col("violations") > 0).agg(F.sort_array(F.collect_list(issue)).alias("issues"))
    record = beside(total, found).select(
        F.lit(source).alias("source"),
        F.lit(model).alias("model"),
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        "issues",
        F.when(F.size("issues") == 0, "Validated").otherwise("Failed").alias("stage"),
    )
    return record.withColumn("checked_at", F.current_timestamp()) if stamp else record


# Row rules


def with_errors(df: DataFrame, which: Iterable[rules.RowRule] | None = None) -> DataFrame:
    """Add ``errors array<string>``; rules whose columns are absent do not apply."""
    chosen = rules.applicable(rules.customer_rules() if which is None else which, df.columns)
    return df.withColumn("errors", rules.errors(chosen))


def quarantine_split(df: DataFrame, which: Iterable[rules.RowRule] | None = None) -> tuple[DataFrame, DataFrame]:
    """Valid rows in the input layout, and rejected rows with their ``errors``."""
    checked = with_errors(df, which)
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def rule_summary(df: DataFrame, which: Iterable[rules.RowRule] | None = None) -> DataFrame:
    """``(rule, violations)`` for every applicable rule, from one aggregate."""
    chosen = rules.applicable(rules.customer_rules() if which is None else which, df.columns)
    return _as_rows(df, [(r.name, _count_if(r.broken)) for r in chosen], ["rule"], "violations")


# Gates


def training_readiness(df: DataFrame, target: str = fields.TARGET) -> DataFrame:
    """``(check, passed)``: no nulls in features or target, numeric features, at least two classes."""
    features = [c for c in df.columns if c != target]
    numeric = all(is_numeric(t) for c, t in df.dtypes if c != target)
    any_null = F.lit(False)
    for c in features:
        any_null = any_null | F.col(c).isNull()
    bounds = df.agg(
        (_count_if(any_null) == 0).alias("features_complete"),
        (_count_if(F.col(target).isNull()) == 0).alias("target_complete"),
        F.lit(numeric).alias("features_numeric"),
        F.coalesce(F.min(target) < F.max(target), F.lit(False)).alias("two_classes"),
    )
    return bounds.unpivot([], bounds.columns, "check", "passed")


def quality_gate(df: DataFrame, target: str = fields.TARGET, min_share: float = 0.1) -> DataFrame:
    """``(check, passed)`` for the five checks made before a retraining run."""
    any_null = F.lit(False)
    for c in df.columns:
        any_null = any_null | F.col(c).isNull()
    has_target = target in df.columns
    value = F.col(target) if has_target else F.lit(None)
    per_class = df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"), _count_if(any_null).alias("bad"))
    known = F.col("value").isNotNull()
    smallest = F.try_divide(F.min(F.when(known, F.col("n"))), F.sum("n"))
    gate = per_class.agg(
        (F.coalesce(F.sum("n"), F.lit(0)) > 0).alias("has_data"),
        F.lit(len(df.columns) > 1).alias("has_features"),
        (F.coalesce(F.sum("bad"), F.lit(0)) == 0).alias("no_nulls"),
        F.lit(has_target).alias("has_target"),
        F.coalesce(smallest > min_share, F.lit(False)).alias("class_balance"),
    )
    return gate.unpivot([], gate.columns, "check", "passed")


def declared_limits(
    df: DataFrame, target: str = fields.TARGET, min_rows: int = 1000, max_null_percent: float = 5.0, min_share: float = 0.1
) -> DataFrame:
    """``(check, passed)`` against row, null-percentage and class-balance limits."""
    cells = len(df.columns)
    nulls = F.lit(0)
    for c in df.columns:
        nulls = nulls + F.when(F.col(c).isNull(), 1).otherwise(0)
    per_class = df.groupBy(F.col(target).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.sum(nulls).alias("nulls"))
    gate = per_class.agg(
        (F.coalesce(F.sum("n"), F.lit(0)) >= min_rows).alias("enough_rows"),
        F.coalesce(
            F.sum("nulls") * 100.0 <= F.lit(max_null_percent) * F.sum("n") * F.lit(cells), F.lit(False)
        ).alias("few_nulls"),
        F.coalesce(F.try_divide(F.min("n"), F.sum("n")) >= min_share, F.lit(False)).alias("balanced"),
    )
    return gate.unpivot([], gate.columns, "check", "passed")


# Profiles


def null_profile(df: DataFrame, top: int = 10) -> DataFrame:
    """The columns with the most nulls."""
    entries = [(c, _count_if(F.col(c).isNull())) for c in df.columns]
    return _as_rows(df, entries, ["column_name"], "nulls").orderBy(F.col("nulls").desc(), "column_name").limit(top)


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum per numeric column."""
    kinds = dict(df.dtypes)
    names = [c for c in (columns or df.columns) if is_numeric(kinds[c])]
    quartiles = exact_quantiles(df, names, [0.25, 0.5, 0.75])
    entries = []
    for c in names:
        v = F.col(c).cast("double")
        low, mid, high = (F.lit(q).cast("double") for q in quartiles[c])
        entries.append(
            (
                c,
                F.struct(
                    F.count(v).alias("count"),
                    F.avg(v).alias("mean"),
                    F.stddev_samp(v).alias("std"),
                    F.min(v).alias("min"),
                    low.alias("p25"),
                    mid.alias("p50"),
                    high.alias("p75"),
                    F.max(v).alias("max"),
                ),
            )
        )
    return _as_rows(df, entries, ["column_name"], "s").select("column_name", "s.*")


# Model schemas


def schema_drift(df: DataFrame, declared: Mapping[str, str]) -> DataFrame:
    """Declared columns against those of ``df``: expected and actual type, verdict and filled rows."""
    kinds = dict(df.dtypes)
    entries = []
    for name, wanted in declared.items():
        expected = fields.TYPE_NAMES.get(wanted.lower(), wanted.lower())
        actual = fields.TYPE_NAMES.get(kinds.get(name, ""), kinds.get(name))
        verdict = "missing" if name not in kinds else ("ok" if actual == expected else "type_mismatch")
        filled = F.count(F.col(name)) if name in kinds else F.count(F.lit(None))
        entries.append((name, expected, actual or "", verdict, filled))
    return _as_rows(df, entries, ["column_name", "expected", "actual", "verdict"], "filled_rows")


def schema_check(df: DataFrame, schemas: DataFrame, model_type: str, version: str) -> DataFrame:
    """:func:`schema_drift` of ``df`` against the registered schema of a model version.

    ``schemas`` holds one row per declared column: ``model_type, schema_name, created_at, column_name, dtype``.  The
    version's schema is found by :func:`resolve_schema`; only its column list reaches the driver.
    """
    request = schemas.sparkSession.createDataFrame([(model_type, version)], "model_type string, version string")
    named = schemas.select("model_type", "schema_name", "created_at").distinct()
    found = resolve_schema(named, request).select("model_type", "schema_name")
    declared = schemas.join(found, ["model_type", "schema_name"]).select("column_name", "dtype").collect()
    return schema_drift(df, {r["column_name"]: r["dtype"] for r in declared})


def resolve_schema(registry: DataFrame, requests: DataFrame) -> DataFrame:
    """Find the schema of each requested ``(model_type, version)``.

    Name patterns are tried in order; without a match the model's default, then nothing.  Both
    sides are tables, so many requests resolve in one join.
    """
    v = F.col("version")
    patterns = F.array(
        F.concat(v, F.lit("_schema")), F.concat(F.lit("v"), v, F.lit("_schema")), v, F.concat(F.lit("schema_"), v)
    )
    tries = requests.select("model_type", "version", F.posexplode(patterns).alias("priority", "schema_name"))
    named = registry.groupBy("model_type", "schema_name").agg(F.max("created_at").alias("created_at"))
    hits = tries.join(named, ["model_type", "schema_name"])
    best = hits.groupBy("model_type", "version").agg(F.min_by("schema_name", "priority").alias("hit"))
    fallback = registry.groupBy("model_type").agg(
        F.max_by("schema_name", F.struct("created_at", "schema_name")).alias("default_name")
    )
    return (
        requests.join(best, ["model_type", "version"], "left")
        .join(fallback, "model_type", "left")
        .select(
            "model_type",
            "version",
            F.coalesce("hit", "default_name").alias("schema_name"),
            F.col("hit").isNull().alias("is_default"),
        )
    )
