"""Event-time aggregates that read the same on batch and streaming frames.

Spark's watermark needs a ``timestamp``; ``timestamp_ntz`` columns are cast in the session zone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_time(df: DataFrame, ts: str, watermark: str | None = None) -> DataFrame:
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, watermark) if watermark else df


def _flat(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "window"]
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *rest)


def plain_times(df: DataFrame) -> DataFrame:
    """Timestamps without zone, for comparison with tables that store them that way."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


def recent(df: DataFrame, ts: str, hours: int, limit: int, tie: Sequence[str] = ()) -> DataFrame:
    """The newest rows of the last hours before the newest event, at most ``limit``.

    The newest time is one aggregate served by column statistics; the range filter reaches the scan.
    """
    last = df.agg(F.max(ts)).first()[0]
    since = F.lit(last) - F.make_interval(hours=F.lit(hours))
    return df.where(F.col(ts) >= since).orderBy(F.col(ts).desc(), *tie).limit(limit)


def tumbling_rates(df: DataFrame, ts: str, size: str, seconds: float, by: Sequence[str] = (), watermark: str | None = None):
    """Events and events per second in each window."""
    timed = event_time(df, ts, watermark)
    counted = timed.groupBy(F.window(ts, size), *by).agg(F.count(F.lit(1)).alias("n"))
    return _flat(counted).withColumn("per_second", F.col("n") / F.lit(float(seconds)))


def tumbling_avg(df: DataFrame, ts: str, size: str, value: str, watermark: str | None = None) -> DataFrame:
    """Number of events and their mean value in each window."""
    timed = event_time(df, ts, watermark)
    grouped = timed.groupBy(F.window(ts, size)).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"))
    return _flat(grouped)


def sliding_counts(
    df: DataFrame, ts: str, by: Sequence[str], size: str = "1 hour", slide: str = "5 minutes", watermark: str | None = None
) -> DataFrame:
    """Counts per sliding window and group.

    Events are first counted in panes of one slide; only the panes are copied to the windows that
    cover them, so the copies grow with the groups and not with the events.
    """
    timed = event_time(df, ts, watermark)
    panes = timed.groupBy(F.window(ts, slide), *by).agg(F.count(F.lit(1)).alias("n"))
    slid = panes.groupBy(F.window(F.window_time("window"), size, slide).alias("window"), *by).agg(F.sum("n").alias("n"))
    return _flat(slid)


def latest_status(checks: DataFrame, monitor: str, ts: str, ok: Column | str = "ok", tie: Sequence[str] = ()) -> DataFrame:
    """Last status, its time, and the last time a check succeeded, per monitor.

    Of checks at one time the greatest ``tie`` columns count, and then the greatest status; they are returned too.
    """
    ok = F.col(ok) if isinstance(ok, str) else ok
    return checks.groupBy(monitor).agg(
        F.max(F.struct(F.col(ts).alias("last_ts"), *tie, "status")).alias("_last"),
        F.max(F.when(ok, F.col(ts))).alias("last_success"),
    ).select(monitor, "_last.*", "last_success")
