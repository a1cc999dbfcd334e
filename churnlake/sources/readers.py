"""Scans: CSV, train/test pairs, databases, configured sources, fallbacks and labelled samples."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Schema = T.StructType | str


def read_csv(
    spark: SparkSession, path: str, schema: Schema, sep: str = ",", encoding: str = "utf-8", header: bool = True
) -> DataFrame:
    """CSV with a declared schema, so that no pass is spent on inference."""
    reader = spark.read.schema(schema).option("sep", sep).option("encoding", encoding).option("header", header)
    # Quoted fields follow the usual doubled-quote convention.
    return reader.option("quote", '"').option("escape", '"').csv(path)


def read_train_test(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both files in one frame, tagged ``dataset``; a column only one file has is null for the other."""
    tagged = train.withColumn("dataset", F.lit("train"))
    return tagged.unionByName(test.withColumn("dataset", F.lit("test")), allowMissingColumns=True)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str | None = None,
    query: str | None = None,
    partition_column: str | None = None,
    bounds: tuple[object, object] | None = None,
    partitions: int = 1,
    fetch_size: int = 10_000,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """A database scan, split on a partition column into parallel range reads.

    A query is read as a derived table, which allows the split; without a partition column the
    read is one task.
    """
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    source = table if table is not None else f"({query.rstrip().rstrip(';')}) q"
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", source).option("fetchsize", fetch_size)
    if partition_column is not None:
        if bounds is None:
            raise ValueError("a partition column needs its bounds")
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", str(bounds[0]))
            .option("upperBound", str(bounds[1]))
            .option("numPartitions", partitions)
        )
    return reader.options(**dict(options or {})).load()


def with_limit(query: str, rows: int) -> str:
    """Append a LIMIT unless the query has one."""
    text = query.strip().rstrip(";")
    return text if re.search(r"\blimit\b", text, re.IGNORECASE) else f"{text} LIMIT {rows}"


def read_with_fallback(
    sources: Sequence[tuple[str, Callable[[], DataFrame]]], max_rows: int | None = None, order: Sequence[str] = ()
) -> DataFrame:
    """The first source that can be read and is not empty, tagged ``data_source``.

    ``max_rows`` caps the fetch, in ``order`` where one is given.
    """
    problems = []
    for tag, load in sources:
        try:
            df = load()
            if df.isEmpty():
                problems.append(f"{tag}: empty")
                continue
        except (PySparkException, OSError) as e:
            problems.append(f"{tag}: {type(e).__name__}")
            continue
        if order:
            df = df.orderBy(*order)
        if max_rows is not None:
            df = df.limit(max_rows)
        return df.withColumn("data_source", F.lit(tag))
    raise FileNotFoundError("no source could be read: " + "; ".join(problems))


def read_configured(spark: SparkSession, config: Mapping[str, object]) -> DataFrame:
    """Reader chosen by ``config['type']``: csv, json, parquet, orc, table or database."""
    kind = config["type"]
    if kind == "csv":
        return read_csv(
            spark,
            config["path"],
            config["schema"],
            config.get("delimiter", ","),
            config.get("encoding", "utf-8"),
            config.get("has_header", True),
        )
    if kind in ("json", "parquet", "orc"):
        reader = spark.read.schema(config["schema"]) if config.get("schema") is not None else spark.read
        return reader.format(kind).load(config["path"])
    if kind == "table":
        return spark.table(config["name"])
    if kind == "database":
        return read_jdbc(
            spark,
            config["url"],
            config.get("table"),
            config.get("query"),
            config.get("partition_column"),
            config.get("bounds"),
            config.get("partitions", 1),
            config.get("fetch_size", 10_000),
            config.get("options"),
        )
    raise ValueError(f"unknown source type {kind}")


# Labelled samples


def _records(text: Column) -> Column:
    """The records of a JSON document, each as text: ``{"samples": […]}`` or a plain list."""
    inside = F.from_json(text, "samples array<string>")["samples"]
    return F.when(text.rlike(r"^\s*\["), F.from_json(text, "array<string>")).otherwise(inside)


def parse_samples(records: DataFrame, column: str = "record") -> DataFrame:
    """``(sample_id, target, features map<string,double>)`` from one JSON record per row.

    A record without ``features`` is flat: all keys but ``target`` are features.  A missing target is 0.
    """
    r = F.col(column)
    nested = F.from_json(r, "features map<string,double>, target double, sample_id string")
    flat = F.from_json(r, "map<string,double>")
    parsed = records.select(nested.alias("n"), flat.alias("f"))
    is_nested = F.col("n.features").isNotNull()
    target = F.when(is_nested, F.col("n.target")).otherwise(F.element_at("f", F.lit("target")))
    features = F.when(is_nested, F.col("n.features")).otherwise(F.map_filter("f", lambda k, _: k != "target"))
    return parsed.select(
        F.when(is_nested, F.col("n.sample_id")).alias("sample_id"),
        F.coalesce(target, F.lit(0)).cast("int").alias("target"),
        features.alias("features"),
    )


def read_samples(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Labelled samples.  ``lines`` reads one record per line, which splits; a document is one task per file."""
    if lines:
        return parse_samples(spark.read.text(path).select(F.col("value").alias("record")))
    documents = spark.read.text(path, wholetext=True)
    return parse_samples(documents.select(F.explode(_records(F.col("value"))).alias("record")))
