"""Bring arbitrary customer records into the canonical column layout."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields, scalars


def normalize_columns(df: DataFrame) -> DataFrame:
    """Lower-case, trimmed names with underscores for blanks."""
    return df.toDF(*[c.lower().strip().replace(" ", "_") for c in df.columns])


def canonical_rename(df: DataFrame, aliases: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Rename aliases to canonical names.

    Where several columns stand for one name, the canonical one wins, then the first alias listed;
    the others are dropped.
    """
    aliases = fields.ALIASES if aliases is None else aliases
    present = set(df.columns)
    meaning = {a: name for name, many in aliases.items() for a in many}
    chosen = {}
    for name, many in aliases.items():
        candidates = [c for c in (name, *many) if c in present]
        if candidates:
            chosen[name] = candidates[0]
    out = []
    for c in df.columns:
        name = meaning.get(c, c)
        if chosen.get(name, c) == c:
            out.append(F.col(f"`{c}`").alias(name))
    return df.select(*out)


def drop_columns(df: DataFrame, names: Iterable[str] = tuple(fields.INGEST_DROP)) -> DataFrame:
    return df.drop(*names)


def feature_projection(df: DataFrame, names: Sequence[str] = tuple(fields.DERIVED), target: str = fields.TARGET):
    """Only the derived features that exist, and the target."""
    present = set(df.columns)
    return df.select(*[c for c in (*names, target) if c in present])


def align_features(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the model's features in order: missing ones are 0, others go, ``keep`` passes through."""
    present = set(df.columns)
    aligned = [F.col(n) if n in present else F.lit(0.0).alias(n) for n in names]
    return df.select(*keep, *aligned)


def _replace(df: DataFrame, names: Iterable[str], build) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.withColumns({n: build(F.col(n), kinds[n]) for n in names if n in kinds})


def coerce_boolean(df: DataFrame, names: Iterable[str] = tuple(fields.FLAG_COLUMNS)) -> DataFrame:
    def build(c: Column, kind: str) -> Column:
        return scalars.flag(c) if kind == "string" else scalars.flag_number(c)

    return _replace(df, names, build)


def coerce_numeric(
    df: DataFrame,
    fractions: Iterable[str] = tuple(fields.FRACTION_COLUMNS),
    wholes: Iterable[str] = tuple(fields.WHOLE_COLUMNS),
) -> DataFrame:
    df = _replace(df, fractions, lambda c, _: scalars.fraction(c))
    return _replace(df, wholes, lambda c, _: scalars.whole(c))


def clean_category(df: DataFrame, names: Iterable[str] = tuple(fields.TEXT_CATEGORIES)) -> DataFrame:
    return _replace(df, names, lambda c, _: scalars.category(c.cast("string")))


def nan_to_null(df: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """NaN becomes null in every float column, or in the named ones."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    wanted = floats if names is None else [n for n in names if n in floats]
    return _replace(df, wanted, lambda c, _: scalars.nan_to_null(c))


def expand_categories(df: DataFrame, choices: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """Replace form choices by their 0/1 flags; flags already present are overwritten."""
    choices = fields.DROPDOWNS if choices is None else choices
    used = {k: v for k, v in choices.items() if k in df.columns}
    flags = {name for mapping in used.values() for name in mapping.values()}
    kept = [F.col(c) for c in df.columns if c not in flags and c not in used]
    return df.select(*kept, *scalars.choice_flags(used))


def stamp_lineage(df: DataFrame, source: str, batch_id: str | None = None) -> DataFrame:
    """Add ``source``, ``timestamp`` and ``batch_id``; the id defaults to the query's start time."""
    now = F.current_timestamp()
    batch = F.lit(batch_id) if batch_id else scalars.batch_id(now)
    return df.withColumns({"source": F.lit(source), "timestamp": now, "batch_id": batch})


def clip_to_reference(df: DataFrame, bounds: Mapping[str, tuple[float, float]], margin: float = 0.05) -> DataFrame:
    """Clamp to the reference range widened by ``margin`` of each bound's size."""

    def build(c: Column, kind: str, name: str) -> Column:
        lo, hi = bounds[name]
        return scalars.clip(c, F.lit(lo - margin * abs(lo)), F.lit(hi + margin * abs(hi)))

    kinds = dict(df.dtypes)
    return df.withColumns({n: build(F.col(n), kinds[n], n) for n in bounds if n in kinds})


def reference_bounds(df: DataFrame, names: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Minimum and maximum per column in one aggregate."""
    row = df.agg(*[F.min(n).alias(f"lo_{n}") for n in names], *[F.max(n).alias(f"hi_{n}") for n in names]).first()
    return {n: (row[f"lo_{n}"], row[f"hi_{n}"]) for n in names if row[f"lo_{n}"] is not None}


def normalize_records(df: DataFrame) -> DataFrame:
    """The ingest chain: names, aliases, unwanted columns, flags, numbers, categories."""
    df = drop_columns(canonical_rename(normalize_columns(df)))
    return clean_category(coerce_numeric(coerce_boolean(df)))
