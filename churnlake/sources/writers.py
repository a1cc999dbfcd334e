"""Sinks: snapshots with metadata, published table versions, exports, logs and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import fingerprint
from ..operators.ranking import beside, spread_rank
from ..operators.sampling import stratified_split


def content_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Row count and order-insensitive content hash, in one aggregate."""
    names = df.columns if columns is None else columns
    return df.agg(
        F.count(F.lit(1)).alias("record_count"),
        F.coalesce(fingerprint([F.col(n) for n in names]).cast("string"), F.lit("0")).alias("fingerprint"),
    )


def write_snapshot(df: DataFrame, root: str, snapshot_id: str, source: str) -> DataFrame:
    """Write a timestamped snapshot, publish a backup version from it, and append its metadata.

    The source is read once; backup and metadata come from the written snapshot.  The last backup stays the current
    one (see :func:`current`) until the new one is complete.
    """
    spark = df.sparkSession
    path = f"{root}/snapshots/snapshot_id={snapshot_id}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    publish(written, f"{root}/backup", snapshot_id)
    entry = content_fingerprint(written).select(
        F.lit(snapshot_id).alias("snapshot_id"),
        F.current_timestamp().alias("written_at"),
        F.lit(source).alias("source"),
        "record_count",
        "fingerprint",
    )
    entry.write.mode("append").parquet(f"{root}/metadata")
    return written


def publish(df: DataFrame, root: str, version: str, note: str = "") -> DataFrame:
    """Replace a table: write a new version, then append the row that makes it current.

    Readers follow the newest pointer row, so they see the old table or the new one, never a mix,
    and a failed write leaves the old one current.
    """
    spark = df.sparkSession
    path = f"{root}/version={version}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    pointer = written.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(version).alias("version"),
        F.current_timestamp().alias("published_at"),
        "row_count",
        F.lit(len(df.columns)).alias("feature_count"),
        F.lit(note).alias("note"),
    )
    pointer.write.mode("append").parquet(f"{root}/_versions")
    return written


def versions(spark: SparkSession, root: str) -> DataFrame:
    schema = "version string, published_at timestamp, row_count bigint, feature_count int, note string"
    return spark.read.schema(schema).parquet(f"{root}/_versions")


def current(spark: SparkSession, root: str) -> DataFrame:
    """The table's current version."""
    newest = versions(spark, root).orderBy(F.col("published_at").desc(), F.col("version").desc()).first()
    return spark.read.parquet(f"{root}/version={newest['version']}")


def write_export(df: DataFrame, path: str, kind: str = "csv") -> None:
    """CSV with a header or JSON records."""
    if kind == "csv":
        df.write.option("header", True).csv(path)
    elif kind == "json":
        df.write.option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"unknown export format {kind}")


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to a JSON-lines log."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def test_samples(
    df: DataFrame, label: str, row_id: str, features: Sequence[str], share: float = 0.2, seed: int = 42
) -> DataFrame:
    """A stratified test sample as ``(features, target, sample_id)`` rows numbered ``test_0…``."""
    chosen = stratified_split(df.select(row_id, label, *features), label, [row_id], share, seed, "_test").where("_test")
    numbered = spread_rank(chosen.drop("_test"), [], [row_id], seed, "_n")
    return numbered.select(
        F.struct(*[F.col(f).cast("double").alias(f) for f in features]).alias("features"),
        F.col(label).cast("int").alias("target"),
        F.concat(F.lit("test_"), (F.col("_n") - 1).cast("string")).alias("sample_id"),
    )


test_samples.__test__ = False


def retrain_report(results: DataFrame, evaluation: DataFrame, run_id: str, seconds: float) -> DataFrame:
    """One row: run, duration, per-model results, evaluation and overall status.

    ``results`` has one row per trained model, so the nested list is short.
    """
    listed = results.agg(F.sort_array(F.collect_list(F.struct("model", "status", "f1"))).alias("results"))
    nested = evaluation.select(F.struct(*evaluation.columns).alias("evaluation"))
    return beside(listed, nested).select(
        F.lit(run_id).alias("retraining_id"),
        F.lit(float(seconds)).alias("duration_seconds"),
        "results",
        "evaluation",
        F.when(F.col("evaluation.successful_models") > 0, "success").otherwise("failed").alias("overall_status"),
    )
