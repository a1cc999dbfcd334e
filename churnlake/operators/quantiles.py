"""Exact quantiles and modes of many columns with bounded state."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .ranking import running_totals

INTEGRAL = ("bigint", "int", "smallint", "tinyint")
FLOATING = ("double", "float")
ACCURACY = 1000  # of the sketch: a rank is off by at most one in so many rows
COLLECTED = 1_000_000  # values inside brackets that the driver sorts itself; more are summed up by Spark
HELD = 1_000_000  # values inside brackets that a task keeps before it sends their counts on

_MOST = 1.7976931348623157e308


def is_numeric(kind: str) -> bool:
    return kind in INTEGRAL or kind in FLOATING or kind.startswith("decimal")


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], accuracy: int = ACCURACY
) -> dict[str, list[float | None]]:
    """Exact linearly interpolated quantiles, null and NaN skipped; ``None`` for a column without values.

    Two scans.  The first is one aggregate with a mergeable quantile sketch per column, which brackets every wanted
    rank by two values.  The second counts, column by column, what lies below, between and inside the brackets, and
    sends on the values inside, counted: a few thousandths of the rows for each rank.  The counts prove that a bracket
    holds its rank; if a sketch was off, the gap that holds it is the bracket of one more scan.
    """
    columns = list(dict.fromkeys(columns))
    if not columns:
        return {}
    out: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}
    sizes, brackets = _sketched(df, columns, probabilities, accuracy)
    positions = {c: [p * (n - 1) for p in probabilities] for c, n in sizes.items() if n}
    wanted = {c: sorted({f(p) for p in many for f in (math.floor, math.ceil)}) for c, many in positions.items()}
    picked: dict[tuple[str, int], float] = {}
    while any((c, r) not in picked for c, ranks in wanted.items() for r in ranks):
        open_ = {c: b for c, b in brackets.items() if any((c, r) not in picked for r in wanted.get(c, ()))}
        brackets = _narrowed(df, open_, wanted, picked)
    for c, many in positions.items():
        low, high = ([picked[c, f(p)] for p in many] for f in (math.floor, math.ceil))
        out[c] = [a if a == z else a + (p - math.floor(p)) * (z - a) for p, a, z in zip(many, low, high)]
    return out


def _value(column: str) -> Column:
    """The finite numbers of a column; infinities count as the greatest double."""
    c = F.col(column).cast("double")
    return F.when(c.isNotNull() & ~F.isnan(c), F.greatest(F.least(c, F.lit(_MOST)), F.lit(-_MOST)))


Brackets = list[tuple[float, float]]


def _sketched(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], accuracy: int):
    """Sizes, and for each column disjoint ascending brackets around the wanted ranks."""
    reach = 2.0 / accuracy
    edges = [min(1.0, max(0.0, p + side)) for p in probabilities for side in (-reach, reach)]
    named = []
    for i, c in enumerate(columns):
        v = _value(c)
        named += [F.count(v).alias(f"n{i}"), F.percentile_approx(v, edges, accuracy).alias(f"q{i}")]
    row = df.agg(*named).first()
    sizes = {c: row[f"n{i}"] for i, c in enumerate(columns)}
    found = {c: list(zip(row[f"q{i}"][::2], row[f"q{i}"][1::2])) for i, c in enumerate(columns) if sizes[c]}
    return sizes, {c: _disjoint(b) for c, b in found.items()}


def _disjoint(brackets: Brackets) -> Brackets:
    out: Brackets = []
    for lo, hi in sorted(brackets):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], hi)
        else:
            out.append((lo, hi))
    return out


_COUNTS = "column int, place int, value double, n bigint"


def _counted(df: DataFrame, brackets: dict[str, Brackets]) -> DataFrame:
    """``column, place, value, n``: how many values lie in place ``2 i`` (before bracket i) without a value, and how
    often each value of place ``2 i + 1`` (inside bracket i) occurs.  One scan; columns stay columns."""
    names = list(brackets)
    edges = [np.array([e for pair in brackets[c] for e in pair]) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gaps = [np.zeros(len(e) + 1, dtype=np.int64) for e in edges]
        held: list[list[np.ndarray]] = [[] for _ in names]
        size = 0
        for batch in batches:
            for i, e in enumerate(edges):
                v = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                # An even place is a gap; a value on either edge of a bracket is inside it.
                place = np.searchsorted(e, v, side="left")
                place += (place % 2 == 0) & (place < len(e)) & (v == e[np.minimum(place, len(e) - 1)])
                inside = place % 2 == 1
                gaps[i] += np.bincount(place[~inside], minlength=len(e) + 1)
                held[i].append(v[inside])
                size += int(inside.sum())
            if size >= HELD:
                yield _inside(held, edges)
                held, size = [[] for _ in names], 0
        yield _inside(held, edges)
        column, place = np.nonzero(_padded(gaps))
        n = _padded(gaps)[column, place]
        yield _count_rows(column, place, pa.nulls(len(n), pa.float64()), n)

    return df.select(*[_value(c).alias(c) for c in names]).mapInArrow(run, _COUNTS)


def _padded(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), max(map(len, rows))), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _inside(held: list[list[np.ndarray]], edges: list[np.ndarray]) -> pa.RecordBatch:
    column, place, value, n = [], [], [], []
    for i, parts in enumerate(held):
        v, times = np.unique(np.concatenate([np.empty(0), *parts]), return_counts=True)
        column.append(np.full(len(v), i))
        # The last edge at or below a value tells its bracket; brackets of one value have two equal edges.
        place.append(2 * ((np.searchsorted(edges[i][::2], v, side="right") - 1)) + 1)
        value.append(v)
        n.append(times)
    return _count_rows(np.concatenate(column), np.concatenate(place), pa.array(np.concatenate(value)), np.concatenate(n))


def _count_rows(column: np.ndarray, place: np.ndarray, value: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column.astype("i4")), pa.array(place.astype("i4")), value, pa.array(n.astype("i8"))],
        ["column", "place", "value", "n"],
    )


def _narrowed(df: DataFrame, brackets: dict[str, Brackets], wanted: dict[str, list[int]], picked: dict) -> dict[str, Brackets]:
    """Pick the order statistics that the brackets hold, and return brackets for the others."""
    names = list(brackets)
    counted = stage(_counted(df, brackets).groupBy("column", "place", "value").agg(F.sum("n").alias("n")), "brackets")
    sizes = {c: np.zeros(2 * len(brackets[c]) + 1, dtype=np.int64) for c in names}
    for r in counted.groupBy("column", "place").agg(F.sum("n").alias("n")).collect():  # two rows a bracket
        sizes[names[r["column"]]][r["place"]] = r["n"]
    below = {c: np.cumsum(n) - n for c, n in sizes.items()}
    asked, rest = [], {}
    for c in names:
        for rank in wanted[c]:
            if (c, rank) in picked:
                continue
            place = int(np.searchsorted(below[c], rank, side="right")) - 1
            lo, hi = _ends(brackets[c], place)
            if place % 2 == 0:  # the sketch was off
                rest.setdefault(c, []).append((lo, hi))
            elif lo == hi:
                picked[c, rank] = lo
            else:
                asked.append((names.index(c), place, rank - int(below[c][place]), rank))
    if asked:
        for column, rank, value in _selected(counted.where("value is not null"), asked):
            picked[names[column], rank] = value
    return {c: _disjoint(b) for c, b in rest.items()}


def _ends(brackets: Brackets, place: int) -> tuple[float, float]:
    """The values between which a place lies; a gap's ends are those of its neighbours."""
    if place % 2:
        return brackets[place // 2]
    return (brackets[place // 2 - 1][1] if place else -_MOST, brackets[place // 2][0] if place // 2 < len(brackets) else _MOST)


def _selected(values: DataFrame, asked: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, float]]:
    """``column, rank, value`` for ``(column, place, rank within the place, rank)``."""
    keys = ["column", "place"]
    if values.count() <= COLLECTED:
        found = sorted((r["column"], r["place"], r["value"], r["n"]) for r in values.collect())
        rows = {}
        for column, place, value, n in found:
            rows.setdefault((column, place), []).append((value, n))
        for column, place, inner, rank in asked:
            ends = np.cumsum([n for _, n in rows[column, place]])
            yield column, rank, rows[column, place][int(np.searchsorted(ends, inner, side="right"))][0]
        return
    summed = running_totals(values, keys, ["value"], {"upto": "n"})
    # One row per wanted rank, so the broadcast is as long as the caller's list.
    ranks = F.broadcast(values.sparkSession.createDataFrame(asked, "column int, place int, inner_rank bigint, rank bigint"))
    hit = (F.col("inner_rank") < F.col("upto")) & (F.col("inner_rank") >= F.col("upto") - F.col("n"))
    for r in summed.join(ranks, keys).where(hit).select("column", "rank", "value").collect():
        yield r["column"], r["rank"], r["value"]


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest one on ties; columns without values are absent.

    Values are counted as ``(column, value)`` rows with map-side combine, so a column with many
    distinct values spreads over all tasks.
    """
    kinds = dict(df.dtypes)
    families = {
        "bigint": [c for c in columns if kinds[c] in INTEGRAL],
        "double": [c for c in columns if is_numeric(kinds[c]) and kinds[c] not in INTEGRAL],
        "string": [c for c in columns if not is_numeric(kinds[c])],
    }
    modes: dict[str, object] = {}
    for kind, names in families.items():
        if not names:
            continue
        counted = value_counts(df, names, kind)
        best = counted.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))
        modes.update({r["column"]: r["mode"] for r in best.collect()})
    return modes


def value_counts(df: DataFrame, columns: Sequence[str], kind: str = "string", keys: Sequence[str] = ()) -> DataFrame:
    """``(keys…, column, value, n)`` for the non-null values of the named columns, cast to ``kind``."""
    typed = df.select(*keys, *[F.col(c).cast(kind).alias(c) for c in columns])
    long = typed.unpivot([F.col(k) for k in keys], list(columns), "column", "value")
    return long.where(F.col("value").isNotNull()).groupBy(*keys, "column", "value").agg(F.count(F.lit(1)).alias("n"))
