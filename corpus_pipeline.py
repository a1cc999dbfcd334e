"""A corpus pipeline over ``documents``: each stage works on all that the stage before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs.  All but the last return the columns of documents.
Ids identify documents: rows with one id stay or go together, and rows without an id stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake.llm import exact, near, packing, pii, quality
from churnlake.llm.scan import read_table
from churnlake.operators.ranking import small_side
from churnlake.session import stage


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the ids in ``dropped``, which are written first and sent to all tasks only if few."""
    return docs.join(small_side(dropped.select("doc_id").distinct(), "dropped"), "doc_id", "left_anti").select(*docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    scored = quality.score(docs, read_table(spark, sf_dir, "labels"))
    return _without(docs, scored.where("predicted = 0"))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return _without(docs, exact.exact_groups(docs).where("not kept"))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 of their five-word shingles the one with the smallest id stays."""
    return _without(docs, near.near_duplicates(docs, width=5, percent=80).where("not kept"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind, and ``n_chars`` follows."""
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", remove_copies),
    ("minhash near-dedup", remove_near_copies),
    ("pii", redact_personal_data),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None  # tests compare with a version that doesn't use Spark


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
