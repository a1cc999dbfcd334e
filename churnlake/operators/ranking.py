"""Exact ranks and running totals that never put a whole group into one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import spread
from ..session import stage

# Summaries up to this size are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 64 * 1024 * 1024

_BEFORE = (Window.unboundedPreceding, -1)
_UP_TO = (Window.unboundedPreceding, Window.currentRow)


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows and approximate bytes of a written table of numbers and texts, in one aggregate."""
    text = F.lit(16 * len(df.columns))
    for name, kind in df.dtypes:
        if kind == "string":
            text = text + F.coalesce(F.octet_length(name), F.lit(0))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(text), F.lit(0)).alias("size")).first()
    return row["n"], row["size"]


def broadcast_if_small(written: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a written table for broadcast when its measured size allows."""
    return F.broadcast(written) if measured(written)[1] <= max_bytes else written


def small_side(df: DataFrame, label: str) -> DataFrame:
    """Write a summary once, measure it, and mark it for broadcast only if it is small enough."""
    return broadcast_if_small(stage(df, label))


def join_on_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key matches a null key; the keys come from the left side."""
    renamed = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return left.join(renamed, same, how).drop(*[f"_k_{k}" for k in keys])


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, str],
    totals: Mapping[str, str] | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add ``sums`` (new name → summed column) accumulated in ``order`` within ``keys``.

    Rows are range-partitioned on ``keys + order`` and written once with their slice number, so a
    slice's place is fixed.  Totals of the slices (one row per slice and key) give every slice its
    starting value; inside a slice a window adds up.  ``totals`` adds whole-group sums in the same
    way.  ``keys + order`` should identify a row: group equal values first.
    """
    totals = dict(totals or {})
    order_by = [F.col(o).desc() if descending else F.col(o).asc() for o in order]
    sliced = stage(
        df.repartitionByRange(*[F.col(k) for k in keys], *order_by).withColumn("_slice", F.spark_partition_id()),
        "running",
    )
    needed = sorted({*sums.values(), *totals.values()})
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_slice").rowsBetween(*_BEFORE)
    per_slice = sliced.groupBy(*keys, "_slice").agg(*[F.sum(c).alias(f"_t_{c}") for c in needed])
    starts = per_slice.select(
        *keys,
        "_slice",
        *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n, c in sums.items()],
        *[F.sum(f"_t_{c}").over(whole).alias(n) for n, c in totals.items()],
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order_by).rowsBetween(*_UP_TO)
    running = sliced.withColumns({f"_r_{n}": F.sum(c).over(inside) for n, c in sums.items()})
    return join_on_same(running, small_side(starts, "starts"), [*keys, "_slice"]).select(
        *df.columns, *[(F.col(f"_r_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums], *totals
    )


def spread_rank(
    df: DataFrame,
    keys: Sequence[str],
    ids: Sequence[str],
    seed: int | str,
    name: str = "rank",
    size: str | None = None,
    digits: int = 4,
) -> DataFrame:
    """Add the 1-based rank of each row within ``keys`` in the order of its seeded MD5 key.

    Equal to ``row_number() over (partition by keys order by md5(seed|ids), ids)``.  The leading hex
    ``digits`` cut each key into ``16 ** digits`` even buckets; each bucket is ranked on its own and
    shifted by the sizes of the buckets before it.  ``size`` names a column for the number of rows in
    the group, which the bucket sizes give for free.  ``df`` is read twice; stage it if it is costly.
    """
    key = spread(seed, *[F.col(i) for i in ids])
    bucket = F.substring("_key", 1, digits)
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_bucket").rowsBetween(*_BEFORE)
    sizes = (
        df.select(*keys, key.alias("_key"))
        .groupBy(*keys, bucket.alias("_bucket"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *keys,
            "_bucket",
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_n").over(whole).alias("_size"),
        )
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_key", *ids)
    ranked = (
        df.withColumn("_key", key).withColumn("_bucket", bucket).withColumn("_within", F.row_number().over(inside))
    )
    return join_on_same(ranked, small_side(sizes, "buckets"), [*keys, "_bucket"]).select(
        *df.columns,
        (F.col("_within") + F.col("_before")).cast("bigint").alias(name),
        *([F.col("_size").alias(size)] if size else []),
    )


def beside(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The columns of single-row frames (ungrouped aggregates) next to those of ``first``.

    Every frame but the first has exactly one row, so nothing is multiplied.
    """
    out = first
    for other in others:
        out = out.join(other, F.lit(True))
    return out
