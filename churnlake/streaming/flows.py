"""Streaming flows: drift, alerts, ingest with quarantine, dedupe and scoring.

Sinks write one folder per micro-batch, so a replayed batch overwrites itself and readers see each
row once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import rules
from ..operators import drift as dr
from ..operators import quality as ql
from ..operators.normalize import normalize_records
from ..operators.ranking import small_side
from ..plans.scoring import score_rows
from ..session import scratch_path
from . import windows as wn


def read_files(
    spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", pattern: str | None = None, per_batch: int | None = None
) -> DataFrame:
    """A file stream.  ``pattern`` limits the file names, ``per_batch`` the files of one micro-batch."""
    reader = spark.readStream.schema(schema).format(kind)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.load(path)


def write_batches(
    stream: DataFrame,
    root: str,
    sinks: Callable[[DataFrame, Callable[[DataFrame], DataFrame]], Mapping[str, DataFrame]],
    trigger: Mapping[str, object] | None = None,
    mode: str = "append",
) -> StreamingQuery:
    """Write the frames that ``sinks`` derives from each micro-batch to ``root/<name>/batch=<n>``.

    A micro-batch is kept while its sinks are written, so that it runs once, and released afterwards; so is every
    frame that ``sinks(batch, keep)`` passes to ``keep``.
    """

    def write(batch: DataFrame, number: int) -> None:
        held: list[DataFrame] = []

        def keep(df: DataFrame) -> DataFrame:
            held.append(df.persist())
            return df

        try:
            for name, df in sinks(keep(batch), keep).items():
                df.write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
        finally:
            for df in held:
                df.unpersist()

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/_checkpoint").foreachBatch(write)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def run(query: StreamingQuery) -> None:
    """Wait for a bounded run to finish; its failure is raised here."""
    query.awaitTermination()


def written(spark: SparkSession, root: str, name: str, schema: T.StructType | str) -> DataFrame:
    """Everything a sink has received, without the batch number."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{root}/{name}")


# Drift


def drift_counts(
    live: DataFrame, bins: Mapping[str, Sequence[float] | None], ts: str = "ts", watermark: str = "10 minutes"
) -> DataFrame:
    """Closed one-hour windows every five minutes: counts per feature and bin."""
    return wn.sliding_counts(dr.binned(live, bins, [ts]), ts, ["feature", "bin"], watermark=watermark)


def monitor_drift(
    live: DataFrame,
    reference: DataFrame,
    columns: Sequence[str],
    root: str,
    target: str | None = None,
    trigger: Mapping[str, object] | None = None,
    watermark: str = "10 minutes",
) -> StreamingQuery:
    """Score every closed window against a fixed reference.

    Sinks: ``psi`` (one row per window and feature), ``summary`` (one per window) and ``alerts`` (only
    windows that require action).
    """
    bins = dr.plan_bins(reference, columns)
    shares = small_side(dr.reference_bins(reference, bins), "reference-bins")
    numeric = [c for c, edges in bins.items() if edges is not None]
    sizes = reference.agg(*[F.count(c).alias(c) for c in numeric]).first().asDict() if numeric else {}
    window = ["window_start", "window_end"]

    def sinks(batch: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> Mapping[str, DataFrame]:
        scored = dr.psi_of_groups(batch, shares, window)
        if sizes:
            scored = scored.join(dr.ks_of_groups(batch, shares, sizes, window), [*window, "feature"], "left")
        scored = keep(scored)
        return {"psi": scored, "summary": window_summaries(scored, target), "alerts": window_alerts(scored, target)}

    return write_batches(drift_counts(live, bins, watermark=watermark), root, sinks, trigger)


def window_summaries(scored: DataFrame, target: str | None) -> DataFrame:
    """Status of each window from its feature scores; the distribution drifts if enough numeric features shifted."""
    shifted = F.col("shifted").cast("double") if "shifted" in scored.columns else F.lit(None).cast("double")
    is_target = F.lit(False) if target is None else F.col("feature") == target
    per = scored.groupBy("window_start", "window_end").agg(
        F.count(F.when(~is_target, 1)).alias("total_features"),
        F.count(F.when(~is_target & (F.col("psi") > dr.FEATURE_LIMIT), 1)).alias("drifted_features"),
        F.coalesce(F.bool_or(F.when(is_target, F.col("psi") > dr.TARGET_LIMIT)), F.lit(False)).alias("target_drift"),
        F.coalesce(F.avg(F.when(~is_target, shifted)) >= dr.SHIFT_LIMIT, F.lit(False)).alias("distribution_drift"),
    )
    drifted = F.col("drifted_features") > 0
    status = F.when(F.col("target_drift"), "CRITICAL").when(drifted, "WARNING").otherwise("STABLE")
    return per.withColumns(
        {
            "feature_drift": drifted,
            "status": status,
            "requires_action": dr.requires_action(status, F.col("target_drift")),
        }
    )


def window_alerts(scored: DataFrame, target: str | None) -> DataFrame:
    """Alerts of the windows that require action."""
    raised = dr.alerts(window_summaries(scored, target), ["window_start", "window_end"])
    return raised.where("requires_action")


# Ingest


def ingest_records(
    stream: DataFrame,
    root: str,
    source: str,
    which: Sequence[rules.RowRule] | None = None,
    trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Normalise raw records and split them into ``good`` and ``quarantine``, with a ``log`` row per batch.
    """
    checked = ql.with_errors(normalize_records(stream), which)

    def sinks(batch: DataFrame, _) -> Mapping[str, DataFrame]:
        bad = F.size("errors") > 0
        log = batch.agg(
            F.count(F.lit(1)).alias("records_processed"),
            F.count(F.when(~bad, 1)).alias("records_saved"),
            F.count(F.when(bad, 1)).alias("records_failed"),
        ).select(F.lit(source).alias("source"), "*", F.current_timestamp().alias("ts"))
        return {"good": batch.where(~bad).drop("errors"), "quarantine": batch.where(bad), "log": log}

    return write_batches(checked, root, sinks, trigger)


def dedupe(stream: DataFrame, key: Sequence[str], ts: str, watermark: str = "10 minutes") -> DataFrame:
    """The first of the rows that share a key, remembered until the watermark passes it."""
    return wn.event_time(stream, ts, watermark).dropDuplicatesWithinWatermark(list(key))


# Scoring


def score(stream: DataFrame, model: PipelineModel, known: str | None = None) -> DataFrame:
    """Predictions of a fitted pipeline; a supplied label is its own prediction with confidence 1."""
    return score_rows(stream, model, known)


def collect_stream(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a bounded stream into a scratch table and return that table."""
    spark = stream.sparkSession
    root = scratch_path(spark, label)
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("checkpointLocation", f"{root}/_checkpoint")
        .trigger(availableNow=True)
        .start(f"{root}/table")
    )
    run(query)
    return spark.read.schema(stream.schema).parquet(f"{root}/table")
