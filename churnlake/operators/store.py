"""The customer store and its ingestion log: upsert, insert-ignore, delete, export, paging.

The store is a table unique on ``(customer_id, ts)`` whose null timestamps never conflict, as in a
SQL unique constraint.  Every function returns the new state; :mod:`churnlake.sources.writers`
publishes it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import beside

KEY = ("customer_id", "ts")


def _keyed(df: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that can conflict, and rows whose key holds a null."""
    complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    return df.where(complete), df.where(~complete)


def one_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str], last: bool) -> DataFrame:
    """One row per key, the first or last in ``order``.

    An aggregate rather than a window: repeated keys shrink before the shuffle, so a key that holds
    a large share of the rows costs no more than any other.
    """
    rest = [c for c in df.columns if c not in key]
    pick = F.max_by if last else F.min_by
    chosen = pick(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*key).agg(chosen).select(*key, "_row.*").select(*df.columns)


def upsert(
    store: DataFrame,
    incoming: DataFrame,
    updates: Sequence[str],
    key: Sequence[str] = KEY,
    order: Sequence[str] = ("record_id",),
) -> DataFrame:
    """The store after an upsert that changes only ``updates`` on existing keys.

    Of several incoming rows with one key, the first in ``order`` is inserted or kept and the last
    one supplies the updated columns, as if they had arrived one after the other.
    """
    keyed, unkeyed = _keyed(incoming, key)
    rest = [c for c in incoming.columns if c not in key]
    arrived = keyed.groupBy(*key).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"),
        F.max_by(F.struct(*updates), F.struct(*order)).alias("_last"),
    )
    held, free = _keyed(store, key)
    old = held.select(*key, F.struct(*[c for c in store.columns if c not in key]).alias("_old"))
    both = old.join(arrived, list(key), "full_outer")

    def value(c: str) -> Column:
        kept = F.when(F.col("_old").isNotNull(), F.col(f"_old.{c}")).otherwise(F.col(f"_first.{c}"))
        if c in updates:
            return F.when(F.col("_last").isNotNull(), F.col(f"_last.{c}")).otherwise(kept).alias(c)
        return kept.alias(c)

    merged = both.select(*[F.col(c) if c in key else value(c) for c in store.columns])
    return merged.unionByName(free).unionByName(unkeyed.select(*store.columns))


def new_rows(
    store: DataFrame, incoming: DataFrame, key: Sequence[str] = KEY, order: Sequence[str] = ("record_id",)
) -> DataFrame:
    """The incoming rows an insert-ignore would add: first per key, not in the store yet."""
    keyed, unkeyed = _keyed(incoming, key)
    first = one_per_key(keyed, key, order, last=False)
    return first.join(store.select(*key), list(key), "left_anti").select(*incoming.columns).unionByName(unkeyed)


def insert_ignore(
    store: DataFrame, incoming: DataFrame, key: Sequence[str] = KEY, order: Sequence[str] = ("record_id",)
) -> DataFrame:
    return store.unionByName(new_rows(store, incoming, key, order).select(*store.columns))


def insert_counts(added: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row ``processed, saved, failed``."""
    saved = added.agg(F.count(F.lit(1)).alias("saved"))
    total = incoming.agg(F.count(F.lit(1)).alias("processed"))
    return beside(total, saved).select("processed", "saved", (F.col("processed") - F.col("saved")).alias("failed"))


def log_upsert(logs: DataFrame, entries: DataFrame, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Upsert log entries by ``batch_id``; counts, status and time change, the source is kept."""
    updates = [c for c in logs.columns if c not in ("batch_id", "source", "file_name")]
    return upsert(logs, entries, updates, ("batch_id",), order)


def delete_batch(df: DataFrame, batch_id: str) -> DataFrame:
    """Rows left after a batch is deleted; on a store partitioned by batch this prunes to the others."""
    return df.where(~F.col("batch_id").eqNullSafe(F.lit(batch_id)))


def deleted_count(df: DataFrame, batch_id: str) -> DataFrame:
    return df.where(F.col("batch_id") == batch_id).agg(F.count(F.lit(1)).alias("deleted"))


def between(df: DataFrame, source: str | None = None, start=None, end=None, ts: str = "ts") -> DataFrame:
    """The optional export filters, all of them pushed to the scan."""
    if source is not None:
        df = df.where(F.col("source") == source)
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(ts) <= F.lit(end))
    return df


def export(df: DataFrame, source: str | None = None, start=None, end=None, ts: str = "ts") -> DataFrame:
    """Filtered rows, newest first."""
    chosen = between(df, source, start, end, ts)
    tie = [c for c in ("record_id", "customer_id") if c in df.columns]
    return chosen.orderBy(F.col(ts).desc(), *tie)


def export_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("record"))


# Lookups and pages


def lookup(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def newest(df: DataFrame, n: int, by: str = "ts", tie: Sequence[str] = (), offset: int = 0) -> DataFrame:
    """A page in newest-first order; a top-k, never a full sort, as ``n + offset`` rows survive per task."""
    ordered = df.orderBy(F.col(by).desc(), *tie)
    return (ordered.offset(offset) if offset else ordered).limit(n)


def page_after(df: DataFrame, n: int, after: tuple, by: str = "ts", tie: str = "record_id") -> DataFrame:
    """The page that follows the row ``(by, tie)``: the filter reaches the scan, whatever the depth."""
    at, key = after
    later = (F.col(by) < F.lit(at)) | ((F.col(by) == F.lit(at)) & (F.col(tie) > F.lit(key)))
    return df.where(later).orderBy(F.col(by).desc(), tie).limit(n)


def oldest(df: DataFrame, n: int, by: str = "ts", tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(by, *tie).limit(n)


def batch_details(logs: DataFrame, store: DataFrame, batch_id: str) -> tuple[DataFrame, DataFrame]:
    """The log row with its record count, and the batch's records."""
    records = lookup(store, "batch_id", batch_id)
    count = records.agg(F.count(F.lit(1)).alias("records"))
    return beside(lookup(logs, "batch_id", batch_id), count), records


# Totals


def ingest_totals(store: DataFrame, logs: DataFrame) -> DataFrame:
    rows = store.agg(F.count(F.lit(1)).alias("total_records"))
    batches = logs.agg(
        F.count(F.lit(1)).alias("total_batches"),
        *[F.sum(f"records_{x}").alias(f"total_{x}") for x in ("processed", "saved", "failed")],
    )
    return beside(rows, batches)


def by_source(store: DataFrame) -> DataFrame:
    return store.groupBy("source").agg(F.count(F.lit(1)).alias("records"))


def ingest_summary(logs: DataFrame) -> DataFrame:
    """Batches and record counts per source and status."""
    return logs.groupBy("source", "status").agg(
        F.count(F.lit(1)).alias("batches"),
        *[F.sum(f"records_{x}").alias(x) for x in ("processed", "saved", "failed")],
        F.max("ts").alias("last_ts"),
    )


# Jobs


def job_rollup(jobs: DataFrame) -> DataFrame:
    """Status of each parent job from its sub-jobs.

    All completed: completed; else any failed: failed; else any running: running; else its own,
    which is that of its first sub-job.
    """
    status = F.col("status")
    return (
        jobs.groupBy("parent_id")
        .agg(
            F.count(F.lit(1)).alias("sub_jobs"),
            F.bool_and(status == "completed").alias("done"),
            F.bool_or(status == "failed").alias("broken"),
            F.bool_or(status == "running").alias("active"),
            F.min_by("status", F.struct("started_at", "job_id")).alias("own"),
        )
        .select(
            "parent_id",
            "sub_jobs",
            F.when(F.col("done"), "completed")
            .when(F.col("broken"), "failed")
            .when(F.col("active"), "running")
            .otherwise(F.col("own"))
            .alias("status"),
        )
    )


def rollup_with_parents(parents: DataFrame) -> DataFrame:
    """Roll-up for parent rows that list their sub-jobs: ``job_id, status, sub_jobs array<struct>``."""
    sub = parents.select(F.col("job_id").alias("parent_id"), F.explode("sub_jobs").alias("s")).select("parent_id", "s.*")
    rolled = sub.groupBy("parent_id").agg(
        F.bool_and(F.col("status") == "completed").alias("done"),
        F.bool_or(F.col("status") == "failed").alias("broken"),
        F.bool_or(F.col("status") == "running").alias("active"),
    )
    status = (
        F.when(F.col("done"), "completed")
        .when(F.col("broken"), "failed")
        .when(F.col("active"), "running")
        .otherwise(F.col("status"))
    )
    joined = parents.join(rolled, F.col("job_id") == F.col("parent_id"), "left")
    return joined.select(*[status.alias("status") if c == "status" else F.col(c) for c in parents.columns])


def list_jobs(jobs: DataFrame, status: str | None, limit: int) -> DataFrame:
    """Newest jobs of a status, with the number of all jobs and of those that match."""
    matches = F.lit(True) if status is None else F.col("status") == status
    counts = jobs.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(matches, 1)).alias("filtered"))
    page = jobs.where(matches).orderBy(F.col("started_at").desc(), "job_id").limit(limit)
    return beside(page, counts)
