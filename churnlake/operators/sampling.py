"""Deterministic splits, samples and class balancing.

Every choice follows the seeded MD5 order of the row id, so it does not depend on partitioning,
repeats exactly, and survives the loss of an executor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fraction_of, spread
from ..session import stage
from .neighbors import knn
from .ranking import spread_rank


def stratified_folds(df: DataFrame, label: str, ids: Sequence[str], k: int, seed: int = 42, name: str = "fold") -> DataFrame:
    """Add a fold number 0..k-1; each class is dealt evenly over the folds."""
    ranked = spread_rank(df, [label], ids, seed, "_rank")
    return ranked.withColumn(name, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))


def stratified_split(
    df: DataFrame, label: str, ids: Sequence[str], test_share: float = 0.2, seed: int = 42, name: str = "is_test"
) -> DataFrame:
    """Mark ``round(test_share * n)`` rows of every class as test rows."""
    ranked = spread_rank(df, [label], ids, seed, "_rank", size="_size")
    quota = F.floor(F.col("_size") * F.lit(test_share) + F.lit(0.5))
    return ranked.select(*df.columns, (F.col("_rank") <= quota).alias(name))


def stratified_sample(
    df: DataFrame, label: str, ids: Sequence[str], size: int, min_per_class: int = 100, seed: int = 42
) -> DataFrame:
    """About ``size`` rows that represent every class.

    Per class ``max(min_per_class, int(size * share))`` rows, at most the whole class; a shortfall
    is made up from the rows left over.  Fewer rows than ``size`` are returned whole, and a single
    class is sampled plainly.
    """
    sizes = {r[label]: r["_size"] for r in class_sizes(df, label).collect()}
    total = sum(sizes.values())
    if total < size:
        return df
    if len(sizes) < 2:
        ranked = spread_rank(df, [], ids, seed, "_rank")
        return ranked.where(F.col("_rank") <= size).select(*df.columns)
    quotas = {c: min(n, max(min_per_class, int(size * n / total))) for c, n in sizes.items()}
    quota = F.lit(0)
    for c, q in quotas.items():
        quota = F.when(F.col(label).eqNullSafe(F.lit(c)), F.lit(q)).otherwise(quota)
    ranked = spread_rank(df, [label], ids, seed, "_rank").withColumn("_quota", quota)
    chosen = ranked.where(F.col("_rank") <= F.col("_quota")).select(*df.columns)
    short = size - sum(quotas.values())
    if short <= 0:
        return chosen
    rest = ranked.where(F.col("_rank") > F.col("_quota")).select(*df.columns)
    extra = spread_rank(rest, [], ids, f"{seed}+", "_rank").where(F.col("_rank") <= short).select(*df.columns)
    return chosen.unionByName(extra)


def sample_approximately(df: DataFrame, label: str, fractions: dict, seed: int = 42) -> DataFrame:
    """Bernoulli sample per class in one pass, without exact sizes."""
    return df.sampleBy(label, fractions, seed)


# Class balancing


def smote(
    df: DataFrame, label: str, row_id: str, features: Sequence[str], k: int = 5, seed: int = 42
) -> DataFrame:
    """Oversample the smaller class of two to the size of the larger one.

    Each synthetic row lies between a minority row and one of its ``k`` nearest minority
    neighbours.  Minority rows take turns as the base; neighbour and position derive from the
    seeded hash of base and copy number.  Returns ``row_id, features…, label, is_synthetic``;
    synthetic rows have negative ids.
    """
    sizes = sorted((r["_size"], r[label]) for r in class_sizes(df, label).collect())
    vector = [F.col(f).cast("double").alias(f) for f in features]
    base = df.select(row_id, *vector, label)
    original = base.withColumn("is_synthetic", F.lit(False))
    if len(sizes) < 2:
        return original
    (small, minority), (large, _) = sizes[0], sizes[-1]
    wanted = large - small
    if wanted == 0 or small < 2:
        return original
    few = base.where(F.col(label) == F.lit(minority)).select(row_id, F.array(*features).alias("_x"))
    near = knn(few, few, row_id, "_x", min(k, small - 1), exclude_self=True)
    lists = near.groupBy("left_id").agg(F.sort_array(F.collect_list(F.struct("rank", "right_id"))).alias("_near"))
    ranked = spread_rank(few, [], [row_id], seed, "_rank")
    copies = F.lit(wanted // small) + F.when(F.col("_rank") <= wanted % small, 1).otherwise(0)
    seeds = (
        ranked.join(lists, F.col(row_id) == F.col("left_id"))
        .withColumn("_copies", copies)
        .where(F.col("_copies") > 0)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    )
    pick = fraction_of(spread(f"{seed}n", F.col(row_id), F.col("_copy")))
    slot = (F.floor(pick * F.size("_near")) + 1).cast("int")
    chosen = seeds.select(
        row_id, "_rank", "_copy", "_x", F.element_at("_near", slot)["right_id"].alias("_other")
    ).join(few.select(F.col(row_id).alias("_other"), F.col("_x").alias("_y")), "_other")
    u = fraction_of(spread(f"{seed}u", F.col(row_id), F.col("_copy")))
    number = (F.col("_copy") - 1) * F.lit(small) + F.col("_rank")

    def between(i: int) -> Column:
        a, b = F.element_at("_x", i + 1), F.element_at("_y", i + 1)
        return a + u * (b - a)

    made = chosen.select(
        (-number).cast(dict(df.dtypes)[row_id]).alias(row_id),
        *[between(i).alias(f) for i, f in enumerate(features)],
        F.lit(minority).cast(dict(df.dtypes)[label]).alias(label),
        F.lit(True).alias("is_synthetic"),
    )
    return original.unionByName(made)


def tomek_links(df: DataFrame, label: str, row_id: str, vector: str) -> DataFrame:
    """Pairs of mutual nearest neighbours with different labels, ``(first_id, second_id)``."""
    nearest = knn(df, df, row_id, vector, 1, exclude_self=True).select("left_id", "right_id")
    labels = df.select(F.col(row_id).alias("_id"), F.col(label).alias("_label"))
    one = nearest.join(labels.withColumnsRenamed({"_id": "left_id", "_label": "_a"}), "left_id")
    # A mutual pair appears once in each direction; order the pair and keep those seen twice.
    pair = one.select(
        F.least("left_id", "right_id").alias("first_id"),
        F.greatest("left_id", "right_id").alias("second_id"),
        F.col("_a"),
    )
    return (
        pair.groupBy("first_id", "second_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_a").alias("_lo"), F.max("_a").alias("_hi"))
        .where((F.col("_n") == 2) & (F.col("_lo") != F.col("_hi")))
        .select("first_id", "second_id")
    )


def remove_links(df: DataFrame, links: DataFrame, row_id: str) -> DataFrame:
    """Drop both ends of every link."""
    ends = links.select(F.explode(F.array("first_id", "second_id")).alias(row_id)).distinct()
    return df.join(ends, row_id, "left_anti")


def smote_tomek(
    df: DataFrame, label: str, row_id: str, features: Sequence[str], k: int = 5, seed: int = 42
) -> DataFrame:
    """Oversample to parity, then remove both ends of every Tomek link."""
    balanced = stage(smote(df, label, row_id, features, k, seed), "smote")
    points = balanced.select(row_id, label, F.array(*features).alias("_x"))
    return remove_links(balanced, tomek_links(points, label, row_id, "_x"), row_id)
