"""Model and schema registries kept as append-only tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .networks import Network
from .trees import Ensemble

KEPT_AS = {".trees": Ensemble, ".network": Network}  # ends of the paths of models kept as tables

REGISTRY_SCHEMA = (
    "model_type string, version string, path string, metrics map<string,double>, threshold double, created_at timestamp"
)


def training_schema_record(
    df: DataFrame, model_type: str, version: str, target: str, features: Sequence[str] | None = None
) -> DataFrame:
    """One row that describes a training set: columns, types, counts and class distribution."""
    names = [c for c in (features or df.columns) if c != target]
    kinds = dict(df.dtypes)
    per_class = df.groupBy(F.col(target).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    entry = F.map_from_entries(F.sort_array(F.collect_list(F.struct("value", "n"))))
    return per_class.agg(F.sum("n").alias("sample_count"), entry.alias("class_distribution")).select(
        F.lit(model_type).alias("model_type"),
        F.lit(version).alias("model_version"),
        F.array(*[F.lit(n) for n in names]).alias("required_columns"),
        F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.lit(kinds[n]) for n in names])).alias("dtypes"),
        F.lit(target).alias("target_column"),
        F.lit("1.0").alias("schema_version"),
        F.lit(len(names)).alias("feature_count"),
        "sample_count",
        "class_distribution",
    )


def register_model(
    model: PipelineModel | Ensemble | Network,
    root: str,
    model_type: str,
    version: str,
    metrics: Mapping[str, float],
    spark: SparkSession,
    threshold: float = 0.5,
) -> str:
    """Save a model under a new version and append its registry row, with the decision threshold fitted for it."""
    path = f"{root}/models/{model_type}/{version}" + "".join(end for end, kind in KEPT_AS.items() if isinstance(model, kind))
    model.save(path)
    values = {k: float(v) for k, v in metrics.items() if v is not None}
    row = spark.createDataFrame(
        [(model_type, version, path, values, float(threshold))],
        "model_type string, version string, path string, metrics map<string,double>, threshold double",
    )
    row.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(f"{root}/registry")
    return path


def registry(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(REGISTRY_SCHEMA).parquet(f"{root}/registry")


def latest_models(models: DataFrame) -> DataFrame:
    """The newest version per model type."""
    rest = [c for c in models.columns if c != "model_type"]
    newest = F.max_by(F.struct(*rest), F.struct("created_at", "version"))
    return models.groupBy("model_type").agg(newest.alias("m")).select("model_type", "m.*")


def list_models(models: DataFrame) -> DataFrame:
    """Versions per model type with the first, the newest and its name."""
    return models.groupBy("model_type").agg(
        F.count(F.lit(1)).alias("versions"),
        F.min("created_at").alias("first_created"),
        F.max("created_at").alias("last_created"),
        F.max_by("version", F.struct("created_at", "version")).alias("latest_version"),
    )


def load_latest(spark: SparkSession, root: str, model_type: str) -> PipelineModel | Ensemble | Network:
    return load_scorer(spark, root, model_type)[0]


def load_scorer(spark: SparkSession, root: str, model_type: str) -> tuple[PipelineModel | Ensemble | Network, float]:
    """The newest model of a type and its decision threshold."""
    row = latest_models(registry(spark, root)).where(F.col("model_type") == model_type).first()
    if row is None:
        raise LookupError(f"no registered model of type {model_type}")
    path = row["path"]
    own = [kind for end, kind in KEPT_AS.items() if path.endswith(end)]
    model = own[0].load(spark, path) if own else PipelineModel.load(path)
    return model, 0.5 if row["threshold"] is None else row["threshold"]
