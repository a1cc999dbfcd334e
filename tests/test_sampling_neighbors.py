"""Splits, samples, exact neighbours and class balancing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlake.operators import neighbors as nb
from churnlake.operators import sampling as sp
from churnlake.operators.neighbors import knn


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Keep small shuffles in many partitions, as they are on real data."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, "true")


def _labelled(spark, n=3000):
    return spark.range(n).select("id", (F.col("id") % 7 == 0).cast("int").alias("y"))


def test_folds_are_complete_and_even(spark):
    df = _labelled(spark)
    out = sp.stratified_folds(df, "y", ["id"], 5)
    assert out.count() == 3000 and out.select("id").distinct().count() == 3000
    for row in out.groupBy("y").pivot("fold").count().collect():
        sizes = [row[str(i)] for i in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_folds_do_not_depend_on_partitioning(spark):
    df = _labelled(spark)
    a = {r["id"]: r["fold"] for r in sp.stratified_folds(df, "y", ["id"], 3).collect()}
    b = {r["id"]: r["fold"] for r in sp.stratified_folds(df.repartition(13), "y", ["id"], 3).collect()}
    assert a == b


def test_split_shares(spark):
    out = sp.stratified_split(_labelled(spark), "y", ["id"])
    got = {r["y"]: (r["t"], r["n"]) for r in out.groupBy("y").agg(F.count_if("is_test").alias("t"), F.count("*").alias("n")).collect()}
    assert got == {0: (514, 2571), 1: (86, 429)}


def test_representative_sample(spark):
    df = _labelled(spark)
    out = sp.stratified_sample(df, "y", ["id"], 500, min_per_class=100)
    assert out.count() == 528 and out.select("id").distinct().count() == 528
    assert out.where("y = 1").count() == 100
    topped = sp.stratified_sample(df, "y", ["id"], 501, min_per_class=0)
    assert topped.count() == 501 and topped.select("id").distinct().count() == 501
    assert sp.stratified_sample(df, "y", ["id"], 5000).count() == 3000
    assert sp.stratified_sample(df.where("y = 1"), "y", ["id"], 50).count() == 50


def _brute(points, others, k, skip_self):
    out = []
    for i, x in points:
        d = sorted((float(np.sqrt(((np.array(x) - np.array(z)) ** 2).sum())), j) for j, z in others if not (skip_self and i == j))
        out += [(i, j, round(v, 9), r + 1) for r, (v, j) in enumerate(d[:k])]
    return sorted(out)


@pytest.mark.parametrize("pivots,block", [(1, 10_000), (9, 10_000), (9, 16), (40, 7)])
@pytest.mark.parametrize("shape", ["clusters", "grid"])
def test_neighbours_equal_brute_force(spark, pivots, block, shape):
    rng = np.random.default_rng(2)
    if shape == "grid":  # many exact ties and repeated points
        data = [(int(i), [float(a), float(b)]) for i, (a, b) in enumerate(rng.integers(0, 6, size=(160, 2)))]
    else:
        centres = rng.normal(scale=20, size=(5, 3))
        data = [(i, [float(v) for v in centres[i % 5] + rng.normal(size=3)]) for i in range(160)]
    df = spark.createDataFrame(data, "id bigint, v array<double>").repartition(4)
    got = knn(df, df, "id", "v", 4, exclude_self=True, pivots=pivots, block=block).collect()
    assert sorted((r["left_id"], r["right_id"], round(r["distance"], 9), r["rank"]) for r in got) == _brute(data, data, 4, True)


def test_neighbours_across_two_frames(spark):
    rng = np.random.default_rng(4)
    a = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(50)]
    b = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(3)]
    left, right = (spark.createDataFrame(d, "id bigint, v array<double>") for d in (a, b))
    got = knn(left, right, "id", "v", 5, pivots=2, block=8).collect()
    assert sorted((r["left_id"], r["right_id"], round(r["distance"], 9), r["rank"]) for r in got) == _brute(a, b, 5, False)
    assert knn(left, right.limit(0), "id", "v", 5).count() == 0


def test_neighbours_with_a_hot_cell(spark):
    """A third of the points are one and the same; blocks stay small and the result is exact."""
    rng = np.random.default_rng(6)
    data = [(i, [1.0, 1.0] if i % 3 == 0 else [float(x) for x in rng.normal(size=2)]) for i in range(300)]
    df = spark.createDataFrame(data, "id bigint, v array<double>")
    got = knn(df, df, "id", "v", 3, exclude_self=True, pivots=12, block=20).collect()
    assert sorted((r["left_id"], r["right_id"], round(r["distance"], 9), r["rank"]) for r in got) == _brute(data, data, 3, True)


def _imbalanced(spark):
    rng = np.random.default_rng(8)
    rows = [(i, float(rng.normal(2 * (i % 9 == 0))), float(rng.normal()), int(i % 9 == 0)) for i in range(450)]
    return spark.createDataFrame(rows, "id bigint, a double, b double, y int")


def test_smote_parity_and_convexity(spark):
    df = _imbalanced(spark)
    out = sp.smote(df, "y", "id", ["a", "b"])
    counts = {r["y"]: r["n"] for r in out.groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 400, 1: 400}
    assert out.select("id").distinct().count() == 800
    made = out.where("is_synthetic").collect()
    assert {r["y"] for r in made} == {1}
    few = np.array([(r["a"], r["b"]) for r in df.where("y = 1").collect()])
    for r in made:
        x = np.array([r["a"], r["b"]])
        d1 = np.sqrt(((few - x) ** 2).sum(axis=1))
        span = np.sqrt(((few[:, None] - few[None]) ** 2).sum(axis=2))
        # On the segment between two minority points: the two distances add up to its length.
        assert np.abs(d1[:, None] + d1[None, :] - span).min() < 1e-9


def test_smote_repeats_and_handles_one_class(spark):
    df = _imbalanced(spark)
    a, b = (sorted(map(tuple, sp.smote(d, "y", "id", ["a", "b"]).collect())) for d in (df, df.repartition(9)))
    assert a == b
    assert sp.smote(df.where("y = 0"), "y", "id", ["a", "b"]).count() == 400


def test_links_are_removed_on_both_ends(spark):
    df = spark.createDataFrame(
        [(1, 0.0, 0), (2, 0.1, 1), (3, 5.0, 0), (4, 5.2, 0), (5, 9.0, 1)], "id bigint, x double, y int"
    ).withColumn("v", F.array("x"))
    links = sp.tomek_links(df, "y", "id", "v")
    assert [tuple(r) for r in links.collect()] == [(1, 2)]
    assert sorted(r["id"] for r in sp.remove_links(df, links, "id").collect()) == [3, 4, 5]


def test_smote_tomek_leaves_no_link(spark):
    out = sp.smote_tomek(_imbalanced(spark), "y", "id", ["a", "b"])
    assert 0 < out.count() <= 800
    assert out.groupBy("y").count().count() == 2


@pytest.mark.parametrize("shape", ["spread", "copies"])
def test_cells_stay_bounded_at_many_times_the_rows(spark, shape, monkeypatch):
    """Cells divide level by level; only cells of equal points may be larger.  Neighbours stay exact."""
    for name, value in (("CELL_ROWS", 16), ("CELL_LIMIT", 2), ("FAN", 6)):
        monkeypatch.setattr(nb, name, value)
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 100, size=(900, 2))
    if shape == "copies":
        x[:300] = [1.0, 2.0]  # a third of all points
        x[300:400] = np.round(x[300:400])
    data = [(i, [float(v) for v in p]) for i, p in enumerate(x)]
    right = spark.createDataFrame(data, "id bigint, v array<double>").repartition(3)
    tree = nb._Tree(nb._points(right, "id", "v"), None, 3, 64, 42)
    sizes = tree.leaves.groupBy("cell").agg(F.count_if(F.col("d") > 0).alias("apart")).toPandas()["apart"]
    assert len(tree.levels) >= 3 and tree.leaves.count() == 900 and sizes.max() <= 32
    assert tree.routes(tree.leaves).count() < len(sizes) ** 2 / 2  # most of the tree is left out
    left = spark.createDataFrame([(5000 + i, [float(v) for v in p]) for i, p in enumerate(rng.uniform(-20, 120, size=(60, 2)))], right.schema)
    both = left.unionByName(right.where("id % 23 = 0"))
    got = knn(both, right, "id", "v", 3, exclude_self=True, block=64).collect()
    points = [(r["id"], r["v"]) for r in both.collect()]
    assert sorted((r["left_id"], r["right_id"], round(r["distance"], 9), r["rank"]) for r in got) == _brute(points, data, 3, True)


@pytest.mark.parametrize("sides,whole", [(2, False), (24, True)])
def test_in_many_dimensions_large_blocks_are_compared(spark, sides, whole, monkeypatch):
    """Where bounds leave out little, a row is copied once a large block and not once a cell."""
    for name, value in (("CELL_ROWS", 16), ("CELL_LIMIT", 2), ("FAN", 12), ("STEP_ROWS", 50), ("STEP_COLUMNS", 40)):
        monkeypatch.setattr(nb, name, value)
    used, blocks = [], nb._all_blocks
    monkeypatch.setattr(nb, "_all_blocks", lambda *given: used.append(given[2:]) or blocks(*given))
    rng = np.random.default_rng(7)
    far = 0 if whole else 100
    data = [(i, [float(v) + far * (i % 10) for v in p]) for i, p in enumerate(rng.normal(size=(400, sides)))]
    df = spark.createDataFrame(data, "id bigint, v array<double>").repartition(3)
    got = knn(df, df, "id", "v", 3, exclude_self=True).collect()
    assert sorted((r["left_id"], r["right_id"], round(r["distance"], 9), r["rank"]) for r in got) == _brute(data, data, 3, True)
    assert used == ([(400, 400)] if whole else [])


@pytest.mark.parametrize("sides", [2, 9])
def test_many_points_are_searched_for_in_regions(spark, sides, monkeypatch):
    """no cells there, which every point would meet more of the more points there are.  Neighbours stay exact."""
    sizes = {"TREE_ROWS": 100, "REGION_ROWS": 90, "PAIR_ROWS": 70, "LEAF_ROWS": 8, "LEAF_BLOCK": 16, "LEAF_LEFTS": 25}
    for name, value in sizes.items():
        monkeypatch.setattr(nb, name, value, raising=False)
    monkeypatch.setattr(nb, "_Tree", None)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, sides))
    x[:, 0] = np.round(x[:, 0])
    x[100:160] = np.round(x[100:160])  # ties and copies
    data = [(i, [float(v) for v in p]) for i, p in enumerate(x)]
    df = spark.createDataFrame(data, "id bigint, v array<double>").repartition(3)
    got = knn(df, df, "id", "v", 3, exclude_self=True).collect()
    assert sorted((r["left_id"], r["right_id"], round(r["distance"], 9), r["rank"]) for r in got) == _brute(data, data, 3, True)
    far = [(1000 + i, [float(v) for v in p]) for i, p in enumerate(rng.uniform(-9, 9, size=(90, sides)))]
    got = knn(spark.createDataFrame(far, df.schema), df, "id", "v", 2).collect()
    assert sorted((r["left_id"], r["right_id"], round(r["distance"], 9), r["rank"]) for r in got) == _brute(far, data, 2, False)


def test_equal_points_are_searched_for_once(spark, monkeypatch):
    """Many copies of few points: the search sees each point once, and rows that repeat don't hide other neighbours."""
    seen, searched = [], nb._searched
    monkeypatch.setattr(nb, "_searched", lambda tree, different, rights, n: seen.append((different.count(), rights.count())) or searched(tree, different, rights, n))
    data = [(i, [float(i % 5), 0.0]) for i in range(100)]
    df = spark.createDataFrame(data, "id bigint, v array<double>")
    got = knn(df, df, "id", "v", 2, exclude_self=True).collect()
    assert sorted((r["left_id"], r["right_id"], round(r["distance"], 9), r["rank"]) for r in got) == _brute(data, data, 2, True)
    assert seen == [(5, 15)]
    twice = spark.createDataFrame([(1, [0.0]), (1, [0.0]), (2, [1.0]), (3, [5.0])], "id bigint, v array<double>")
    near = sorted((r["left_id"], r["right_id"]) for r in knn(twice, twice, "id", "v", 1, exclude_self=True).collect())
    assert near == [(1, 2), (2, 1), (3, 2)]
