"""Imputation, derived features, encoding and scaling as fit/apply pairs.

A fit runs aggregates and returns :class:`Params`; an apply is a projection and runs no job.  All
parameters are keyed by column name.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fields, formulas, scalars
from ..session import stage
from .quantiles import INTEGRAL, column_modes, exact_quantiles, is_numeric
from .ranking import measured, running_totals

# Encoders up to this many classes travel inside the plan; larger ones are joined as a table.
INLINE_CLASSES = 10_000
INLINE_BYTES = 8 * 1024 * 1024
HEAVY = 1 / 256  # share of the rows that makes a value of a wide column heavy
_SHORT_LIST = 48

PARAMS_SCHEMA = T.StructType(
    [
        T.StructField("step", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)


@dataclass
class Params:
    """Fitted state of a preprocessing run."""

    fills: dict[str, object] = field(default_factory=dict)
    features: list[str] = field(default_factory=list)
    classes: dict[str, list[str]] = field(default_factory=dict)
    scales: dict[str, tuple[float, float]] = field(default_factory=dict)
    variances: dict[str, float] = field(default_factory=dict)
    dtypes: dict[str, str] = field(default_factory=dict)
    target_classes: dict[str, int] = field(default_factory=dict)
    samples: int = 0
    # Encoders with too many classes for a list: a written table (column, value, code).
    wide: DataFrame | None = None

    def to_table(self, spark: SparkSession) -> DataFrame:
        """One row per fitted value."""
        rows = [("fill", c, type(v).__name__, str(v)) for c, v in self.fills.items()]
        rows += [("feature", f, str(i), f) for i, f in enumerate(self.features)]
        rows += [("class", c, str(i), v) for c, many in self.classes.items() for i, v in enumerate(many)]
        for c, (mean, scale) in self.scales.items():
            rows += [("scale", c, "mean", repr(mean)), ("scale", c, "scale", repr(scale))]
        rows += [("variance", c, "", repr(v)) for c, v in self.variances.items()]
        rows += [("dtype", c, "", t) for c, t in self.dtypes.items()]
        rows += [("target", v, "", str(code)) for v, code in self.target_classes.items()]
        rows += [("count", "samples", "", str(self.samples)), ("count", "features", "", str(len(self.features)))]
        return spark.createDataFrame(rows, PARAMS_SCHEMA)

    @staticmethod
    def from_table(table: DataFrame) -> Params:
        out = Params()
        cast = {"int": int, "float": float}
        rows = [r.asDict() for r in table.collect()]
        for r in rows:
            if r["step"] == "fill":
                out.fills[r["column"]] = cast.get(r["key"], str)(r["value"])
        out.features = [
            r["value"] for r in sorted((r for r in rows if r["step"] == "feature"), key=lambda r: int(r["key"]))
        ]
        for r in sorted((r for r in rows if r["step"] == "class"), key=lambda r: int(r["key"])):
            out.classes.setdefault(r["column"], []).append(r["value"])
        out.variances = {r["column"]: float(r["value"]) for r in rows if r["step"] == "variance"}
        out.dtypes = {r["column"]: r["value"] for r in rows if r["step"] == "dtype"}
        out.target_classes = {r["column"]: int(r["value"]) for r in rows if r["step"] == "target"}
        out.samples = next((int(r["value"]) for r in rows if r["step"] == "count" and r["column"] == "samples"), 0)
        means = {(r["column"], r["key"]): float(r["value"]) for r in rows if r["step"] == "scale"}
        out.scales = {c: (means[(c, "mean")], means[(c, "scale")]) for c, k in means if k == "mean"}
        return out


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, int]:
    columns = df.columns if columns is None else list(columns)
    if not columns:
        return {}
    row = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    return {c: row[f"n{i}"] for i, c in enumerate(columns)}


# Imputation


def fit_median_mode(
    df: DataFrame,
    numeric: Iterable[str] = tuple(fields.NUMERIC),
    categorical: Iterable[str] = tuple(fields.CATEGORICAL),
    nulls: Mapping[str, int] | None = None,
    unknown: str = "Unknown",
) -> dict[str, object]:
    """Fill values for the columns that hold nulls: median for numbers, mode for categories."""
    kinds = dict(df.dtypes)
    numeric = [c for c in numeric if c in kinds]
    categorical = [c for c in categorical if c in kinds]
    nulls = null_counts(df, [*numeric, *categorical]) if nulls is None else nulls
    medians = exact_quantiles(df, [c for c in numeric if nulls.get(c)], [0.5])
    gaps = [c for c in categorical if nulls.get(c)]
    modes = column_modes(df, gaps)
    fills: dict[str, object] = {c: q[0] for c, q in medians.items() if q[0] is not None}
    for c in gaps:
        if c in modes:
            fills[c] = modes[c]
        elif kinds[c] == "string":
            fills[c] = unknown
    return fills


def fit_mean_mode(df: DataFrame, drop: Iterable[str] = ()) -> dict[str, object]:
    """Fill values for every column with nulls: mean for numbers, mode for text; empty ones are skipped."""
    dropped = set(drop)
    kinds = {c: t for c, t in df.dtypes if c not in dropped}
    nulls = null_counts(df, list(kinds))
    numbers = [c for c, t in kinds.items() if is_numeric(t) and nulls[c]]
    texts = [c for c, t in kinds.items() if t == "string" and nulls[c]]
    fills: dict[str, object] = {}
    if numbers:
        row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(numbers)]).first()
        fills.update({c: row[f"m{i}"] for i, c in enumerate(numbers) if row[f"m{i}"] is not None})
    fills.update(column_modes(df, texts))
    return fills


def impute(df: DataFrame, fills: Mapping[str, object]) -> DataFrame:
    """Replace nulls by stored values.  Whole-number columns widen to double for a fractional fill."""
    kinds = dict(df.dtypes)

    def filled(c: str) -> Column:
        value = fills[c]
        if kinds[c] in INTEGRAL and isinstance(value, float) and not value.is_integer():
            return F.coalesce(F.col(c).cast("double"), F.lit(value))
        return F.coalesce(F.col(c), F.lit(value).cast(kinds[c]))

    return df.withColumns({c: filled(c) for c in fills if c in kinds})


def impute_production(df: DataFrame, fills: Mapping[str, object], batch_fallback: Sequence[str] = ()) -> DataFrame:
    """Impute from stored values; ``batch_fallback`` columns without one use the batch's own median or mode."""
    kinds = dict(df.dtypes)
    missing = [c for c in batch_fallback if c in kinds and c not in fills]
    extra = fit_median_mode(
        df, [c for c in missing if is_numeric(kinds[c])], [c for c in missing if not is_numeric(kinds[c])]
    )
    return impute(df, {**fills, **extra})


# Derived features


def usable_features(
    columns: Iterable[str], nulls: Mapping[str, int], names: Iterable[str] = tuple(formulas.REGISTRY)
) -> list[str]:
    """Features whose sources all exist and hold no null anywhere in the data set."""
    present = set(columns)
    out = []
    for name in names:
        sources = formulas.REGISTRY[name].sources
        if present.issuperset(sources) and not any(nulls.get(s) for s in sources):
            out.append(name)
    return out


def derive(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.withColumns({n: formulas.REGISTRY[n].build(F.col) for n in names})


def fit_derive(df: DataFrame, names: Iterable[str] = tuple(formulas.REGISTRY)) -> list[str]:
    """The features that can be derived from ``df``, decided by one null-count aggregate."""
    names = list(names)
    present = set(df.columns)
    sources = sorted({s for n in names for s in formulas.REGISTRY[n].sources if s in present})
    return usable_features(present, null_counts(df, sources), names)


def derive_production(df: DataFrame, fitted: Iterable[str], nulls: Mapping[str, int] | None = None) -> DataFrame:
    """Derive the features recorded at fit time.

    A feature with an absent source column is 0; one whose sources hold nulls in this batch is
    skipped.  Without ``nulls`` the null counts of the batch are taken first.
    """
    fitted = list(fitted)
    present = set(df.columns)
    whole = [n for n in fitted if present.issuperset(formulas.REGISTRY[n].sources)]
    if nulls is None:
        nulls = null_counts(df, sorted({s for n in whole for s in formulas.REGISTRY[n].sources}))
    usable = set(usable_features(present, nulls, whole))
    out = {n: formulas.REGISTRY[n].build(F.col) for n in fitted if n in usable}
    out.update({n: F.lit(0.0) for n in fitted if n not in whole})
    return df.withColumns(out)


# Label encoding


def fit_labels(df: DataFrame, columns: Sequence[str], inline: int = INLINE_CLASSES) -> dict[str, list[str]] | DataFrame:
    """Sorted distinct text values per column.

    Up to ``inline`` classes in total, and short ones, come back as lists.  More stay distributed, as a
    table ``(column, value, code)`` ranked without collecting any column into one task.
    """
    columns = list(columns)
    if not columns:
        return {}
    distinct = stage(distinct_values(df, columns), "distinct")
    rows, size = measured(distinct)
    if rows <= inline and size <= INLINE_BYTES:
        found = distinct.collect()
        return {c: sorted(r["value"] for r in found if r["column"] == c) for c in columns}
    return _coded_classes(distinct)


def _coded_classes(counted: DataFrame) -> DataFrame:
    """``column, value, code, share``: the rank of each value in its column, and its share of the column's rows."""
    ranked = running_totals(counted.withColumn("one", F.lit(1)), ["column"], ["value"], {"place": "one"}, {"rows": "n"})
    code = (F.col("place") - 1).cast("int").alias("code")
    return stage(ranked.select("column", "value", code, (F.col("n") / F.col("rows")).alias("share")), "classes")


def fit_encoders(
    df: DataFrame, columns: Sequence[str], inline: int = INLINE_CLASSES
) -> tuple[dict[str, list[str]], DataFrame | None]:
    """Lists of sorted classes for the columns with up to ``inline`` short ones, and a table of codes for the rest."""
    columns = list(columns)
    if not columns:
        return {}, None
    distinct = stage(distinct_values(df, columns), "distinct")
    sizes = distinct.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value")).alias("bytes"))
    few = [r["column"] for r in sizes.collect() if r["n"] <= inline and r["bytes"] <= INLINE_BYTES]
    lists: dict[str, list[str]] = {c: [] for c in columns}
    for r in distinct.where(F.col("column").isin(*few)).collect() if few else []:
        lists[r["column"]].append(r["value"])
    wide = distinct.where(~F.col("column").isin(*few)) if few else distinct
    if wide.isEmpty():
        return {c: sorted(v) for c, v in lists.items()}, None
    return {c: sorted(lists[c]) for c in few}, _coded_classes(wide)


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, value, n`` of the values in each column as text; equal values meet in the tasks first."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    long = text.unpivot([], list(columns), "column", "value")
    return long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def encode_labels(
    df: DataFrame, classes: Mapping[str, Sequence[str]] | DataFrame, columns: Sequence[str] | None = None, bounded: bool = False
):
    """Replace each value by its class index; values without a class are -1.  Lists of classes run no job.

    A table of classes is joined column by column, and sent to all tasks only if ``bounded`` says that its columns
    come from lists; otherwise Spark's own size estimates decide.  Where the table tells shares, values with a share of
    ``HEAVY`` or more, at most one in ``HEAVY`` of them, are read first and coded in place.  Their rows and those without
    a value need no partner, so they are dealt over all tasks.
    """
    if isinstance(classes, DataFrame):
        wanted = [c for c in (columns or df.columns) if c in df.columns]
        heavy: dict[str, dict[str, int]] = {c: {} for c in wanted}
        if "share" in classes.columns:
            for r in classes.where((F.col("share") >= HEAVY) & F.col("column").isin(wanted)).collect():
                heavy[r["column"]][r["value"]] = r["code"]
        for c in wanted:
            value, known = F.col(c).cast("string"), heavy[c]
            codes = classes.where(F.col("column") == c).select(F.col("value").alias("_v"), F.col("code").alias("_code"))
            settled = value.isNull() | value.isin(list(known)) if known else value.isNull()
            # No class begins with a zero character and the hash of a row.
            alone = F.concat(F.lit("\0"), F.xxhash64(*df.columns).cast("string"))
            in_place = F.element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), value) if known else F.lit(None)
            df = (
                df.withColumn("_key", value if bounded else F.when(settled, alone).otherwise(value))
                .join(F.broadcast(codes) if bounded else codes, F.col("_key") == F.col("_v"), "left")
                .withColumn(c, F.coalesce(in_place.cast("int"), "_code", F.lit(-1)))
                .drop("_v", "_code", "_key")
            )
        return df
    wanted = [c for c in classes if c in df.columns and (columns is None or c in columns)]
    short = [c for c in wanted if len(classes[c]) <= _SHORT_LIST]
    df = df.withColumns({c: _code_of(F.col(c).cast("string"), classes[c]) for c in short})
    long = [c for c in wanted if len(classes[c]) > _SHORT_LIST]
    if long:
        rows = [(c, v, i) for c in long for i, v in enumerate(classes[c])]
        table = df.sparkSession.createDataFrame(rows, "column string, value string, code int")
        df = encode_labels(df, table, long, bounded=True)
    return df


def _code_of(c: Column, classes: Sequence[str]) -> Column:
    if not classes:
        return F.lit(-1)
    code = F.when(c == classes[0], F.lit(0))
    for i, value in enumerate(classes[1:], start=1):
        code = code.when(c == value, F.lit(i))
    return code.otherwise(F.lit(-1))


# Target and scaling


def encode_target(df: DataFrame, column: str = fields.TARGET) -> DataFrame:
    """Text target by its accepted forms, numeric target by integer cast."""
    if dict(df.dtypes)[column] == "string":
        return df.withColumn(column, scalars.target(F.col(column)))
    return df.withColumn(column, F.col(column).cast("int"))


def fit_scale(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Population mean and standard deviation per column in one aggregate; a zero deviation becomes 1."""
    columns = list(columns)
    if not columns:
        return {}
    row = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(columns) if row[f"m{i}"] is not None}


def fit_moments(df: DataFrame, columns: Sequence[str]) -> tuple[dict[str, tuple[float, float]], dict[str, float], int]:
    """Scales as :func:`fit_scale` has them, population variances, and the number of rows, in one aggregate."""
    columns = list(columns)
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(columns)],
    ).first()
    known = [(i, c) for i, c in enumerate(columns) if row[f"m{i}"] is not None]
    scales = {c: (row[f"m{i}"], math.sqrt(row[f"v{i}"]) or 1.0) for i, c in known}
    return scales, {c: row[f"v{i}"] for i, c in known}, row["n"]


def scale(df: DataFrame, scales: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns(
        {c: (F.col(c) - F.lit(mean)) / F.lit(size) for c, (mean, size) in scales.items() if c in df.columns}
    )
