"""Plan shapes and the partitioned store."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlake.functions import fields
from churnlake.operators import quality as ql
from churnlake.operators import store as st
from churnlake.operators import quantiles as qt
from churnlake.operators.quantiles import value_counts
from churnlake.plans import preprocess as pp
from churnlake.session import scratch_path, stage
from churnlake.sources import commits as cm
from churnlake.sources import tables as tb


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _store(spark, rows):
    schema = "customer_id bigint, ts string, batch_id string, record_id bigint, revenue double, churn int"
    return spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_store_rewrites_only_touched_batches(spark):
    root = scratch_path(spark, "store")
    store = _store(spark, [(i, f"2024-01-{i:02d}", "ABC"[i % 3], i, 1.0, 0) for i in range(1, 25)])
    tb.create_store(store, root)
    before = {b: sorted(glob.glob(f"{root}/data/batch_id={b}/*/*.parquet")) for b in "ABC"}
    incoming = _store(spark, [(3, "2024-01-03", "D", 100, 9.0, 1), (50, "2024-02-01", "D", 101, 8.0, 1)])
    tb.upsert_store(spark, root, store.schema, incoming, ["revenue", "churn"])
    after = {b: sorted(glob.glob(f"{root}/data/batch_id={b}/*/*.parquet")) for b in "ABCD"}
    assert after["B"] == before["B"] and after["C"] == before["C"]
    assert after["A"] != before["A"] and after["D"]
    got = {r["customer_id"]: (r["batch_id"], r["revenue"]) for r in tb.read_store(spark, root, store.schema).collect()}
    assert len(got) == 25 and got[3] == ("A", 9.0) and got[50] == ("D", 8.0) and got[6] == ("A", 1.0)


def test_failed_commit_leaves_the_old_store(spark, monkeypatch):
    root = scratch_path(spark, "store")
    store = _store(spark, [(1, "2024-01-01", "A", 1, 1.0, 0), (2, "2024-01-02", "B", 2, 1.0, 0), (3, "2024-01-03", None, 3, 1.0, 0)])
    tb.create_store(store, root)

    def broken(*_):
        raise RuntimeError("lost before the commit")

    incoming = _store(spark, [(1, "2024-01-01", "A", 9, 7.0, 1), (3, "2024-01-03", None, 9, 7.0, 1)])
    with monkeypatch.context() as m:
        m.setattr(tb, "_commit", broken)
        with pytest.raises(RuntimeError):
            tb.upsert_store(spark, root, store.schema, incoming, ["revenue", "churn"])
    old = tb.read_store(spark, root, store.schema)
    assert sorted((r["customer_id"], r["revenue"]) for r in old.collect()) == [(1, 1.0), (2, 1.0), (3, 1.0)]
    tb.upsert_store(spark, root, store.schema, incoming, ["revenue", "churn"])
    new = tb.read_store(spark, root, store.schema)
    assert sorted((r["customer_id"], r["revenue"]) for r in new.collect()) == [(1, 7.0), (2, 1.0), (3, 7.0)]
    assert sorted((r["customer_id"], r["revenue"]) for r in old.collect()) == [(1, 1.0), (2, 1.0), (3, 1.0)]


def test_quantiles_take_two_scans_without_unpivot(spark, monkeypatch):
    """One sketch aggregate and one counting pass whatever the number of ranks; only values near a rank leave it."""
    df = spark.range(200_000).select((F.hash("id") / 7.0).alias("a"), (F.hash("id") % 5).alias("b"), F.lit(2.5).alias("c")).repartition(6)
    passes, found = [], qt._counted

    def counted(frame, brackets):
        rows = found(frame, brackets)
        passes.append((plan(rows), rows.where("value is not null").agg(F.sum("n")).first()[0]))
        return rows

    monkeypatch.setattr(qt, "_counted", counted)
    probabilities = [0.25, 0.5, 0.75]
    got = qt.exact_quantiles(df, ["a"], probabilities)
    assert got["a"] == pytest.approx(np.quantile([r[0] for r in df.select("a").collect()], probabilities), rel=1e-12)
    assert len(passes) == 1 and "Expand" not in passes[0][0] and "Join" not in passes[0][0]
    assert passes[0][1] <= 3 * 5 * 200_000 / qt.ACCURACY
    assert qt.exact_quantiles(df, ["b", "c"], [0.5])["c"] == [2.5]
    monkeypatch.setattr(qt, "COLLECTED", 0)  # ranks found by running totals
    monkeypatch.setattr(qt, "HELD", 50)
    assert qt.exact_quantiles(df, ["a"], probabilities) == got


def test_quantiles_survive_a_wrong_sketch(spark, monkeypatch):
    """Counts prove each bracket; a rank outside its bracket is found by one more scan."""
    df = spark.range(5000).select(F.col("id").cast("double").alias("a"))
    monkeypatch.setattr(qt, "_sketched", lambda *_: ({"a": 5000}, {"a": [(10.0, 12.0), (4000.0, 4100.0)]}))
    assert qt.exact_quantiles(df, ["a"], [0.0, 0.5, 0.81, 1.0]) == {"a": [0.0, 2499.5, pytest.approx(4049.19), 4999.0]}


def test_apply_plans_no_join(spark):
    df = spark.createDataFrame([(i, float(i), f"c{i}") for i in range(60)], "id bigint, months double, prizm_cluster string")
    params = pp.fit_preprocess(df, ["months"], ["prizm_cluster"])
    assert "Join" not in plan(pp.apply_preprocess(df, params, keep=["id"]))
    coded = pp.apply_preprocess(df, params, keep=["id"], encode=["prizm_cluster"])
    order = sorted(f"c{i}" for i in range(60))
    assert {r["id"]: r["prizm_cluster"] for r in coded.collect()} == {i: order.index(f"c{i}") for i in range(60)}


def test_store_insert_and_delete(spark):
    root = scratch_path(spark, "store")
    store = _store(spark, [(1, "2024-01-01", "A", 1, 1.0, 0), (2, "2024-01-02", "B/x", 2, 1.0, 0)])
    tb.create_store(store, root)
    counts = tb.insert_store(spark, root, store.schema, _store(spark, [(1, "2024-01-01", "C", 3, 5.0, 1), (4, None, "C", 4, 5.0, 1)]))
    assert tuple(counts.first()) == (2, 1, 1)
    assert tb.delete_store_batch(spark, root, store.schema, "B/x") == 1
    assert tb.delete_store_batch(spark, root, store.schema, "none") == 0
    assert sorted(r["customer_id"] for r in tb.read_store(spark, root, store.schema).collect()) == [1, 4]


def test_of_two_writers_one_wins_and_both_changes_count(spark, monkeypatch):
    """A second writer commits while the first works; the first finds its number taken and starts again."""
    root = scratch_path(spark, "store")
    store = _store(spark, [(1, "2024-01-01", "A", 1, 1.0, 0), (2, "2024-01-02", "B", 2, 1.0, 0)])
    tb.create_store(store, root)
    with pytest.raises(ValueError, match="there is a store"):
        tb.create_store(store, root)
    lost, commit = [], tb._commit

    def slow(spark, root, number, added, removed):
        if not lost:
            lost.append(number)
            other = _store(spark, [(1, "2024-01-01", "A", 9, 5.0, 1), (7, "2024-01-07", "C", 9, 5.0, 1)])
            with monkeypatch.context() as m:
                m.setattr(tb, "_commit", commit)
                tb.upsert_store(spark, root, store.schema, other, ["revenue"])
            assert not commit(spark, root, number, added, removed)
            return False
        return commit(spark, root, number, added, removed)

    monkeypatch.setattr(tb, "_commit", slow)
    incoming = _store(spark, [(1, "2024-01-01", "A", 9, 8.0, 1), (2, "2024-01-02", "B", 9, 8.0, 1)])
    tb.upsert_store(spark, root, store.schema, incoming, ["churn"])
    got = sorted((r["customer_id"], r["revenue"], r["churn"]) for r in tb.read_store(spark, root, store.schema).collect())
    assert got == [(1, 5.0, 1), (2, 1.0, 1), (7, 5.0, 1)]
    assert cm.state(spark, root).number == 2
    monkeypatch.setattr(tb, "_commit", lambda *_: False)
    with pytest.raises(tb.ConcurrentChange):
        tb.upsert_store(spark, root, store.schema, incoming, ["churn"])


def test_only_one_of_many_creates_a_file(spark):
    from multiprocessing.pool import ThreadPool

    root = scratch_path(spark, "log")
    with ThreadPool(8) as pool:
        won = pool.map(lambda i: cm.put_if_absent(spark, f"{root}/00.json", f"writer {i}"), range(8))
    text = open(f"{root}/00.json", encoding="utf-8").read()
    assert sum(won) == 1 and text == f"writer {won.index(True)}" and not glob.glob(f"{root}/*.draft")


def test_readers_load_a_snapshot_and_the_changes_after_it(spark, monkeypatch):
    monkeypatch.setattr(cm, "SNAPSHOT_EVERY", 3)
    root = scratch_path(spark, "store")
    store = _store(spark, [(i, f"2024-01-{i:02d}", "ABC"[i % 3], i, 1.0, 0) for i in range(1, 10)])
    tb.create_store(store, root)
    for n in range(5):
        tb.upsert_store(spark, root, store.schema, _store(spark, [(3, "2024-01-03", "A", 9, float(n), 1)]), ["revenue"])
    assert sorted(glob.glob(f"{root}/log/*.snapshot")) == [f"{root}/log/{3:020d}.snapshot"]
    now = cm.state(spark, root)
    files = {f.split("/log/")[1].split("/")[0] for f in now.pairs.inputFiles()}
    assert now.number == 5 and len(files) == 3  # the snapshot, commits 4 and 5
    assert now.pairs.count() == 3
    rows = {r["customer_id"]: r["revenue"] for r in tb.read_store(spark, root, store.schema).collect()}
    assert rows == {i: 1.0 for i in range(1, 10)} | {3: 4.0}


def test_cleaning_removes_what_no_commit_names(spark):
    root = scratch_path(spark, "store")
    store = _store(spark, [(1, "2024-01-01", "A/x", 1, 1.0, 0), (2, "2024-01-02", "B", 2, 1.0, 0), (3, "2024-01-03", None, 3, 1.0, 0)])
    tb.create_store(store, root)
    incoming = _store(spark, [(1, "2024-01-01", "A/x", 9, 7.0, 1), (3, "2024-01-03", None, 9, 7.0, 1)])
    tb.upsert_store(spark, root, store.schema, incoming, ["revenue"])
    tb._write(_store(spark, [(9, "2024-01-09", "B", 9, 9.0, 0)]), root)  # a writer that never committed
    before = sorted((r["customer_id"], r["revenue"]) for r in tb.read_store(spark, root, store.schema).collect())
    assert len(glob.glob(f"{root}/data/*/*")) == 6
    assert tb.clean_store(spark, root, older_than=3600) == 0
    assert tb.clean_store(spark, root, older_than=0) == 3
    assert len(glob.glob(f"{root}/data/*/*")) == 3
    assert sorted((r["customer_id"], r["revenue"]) for r in tb.read_store(spark, root, store.schema).collect()) == before


def test_batch_lookup_prunes_partitions_and_columns(spark):
    root = scratch_path(spark, "store")
    store = _store(spark, [(1, "2024-01-01", "A", 1, 1.0, 0)])
    tb.create_store(store, root)
    text = plan(st.lookup(tb.read_store(spark, root, store.schema), "batch_id", "A").select("customer_id"))
    filters = text.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "isnotnull(batch_id" in filters and "(version" in filters
    assert "ReadSchema: struct<customer_id:bigint>" in text


def test_export_filters_reach_the_scan(spark):
    table = stage(_store(spark, [(1, "2024-01-01", "A", 1, 1.0, 0)]).withColumn("source", F.lit("csv")), "flat")
    text = plan(st.between(table, "csv", F.lit("2024-01-01").cast("timestamp_ntz")))
    assert "EqualTo(source,csv)" in text and "GreaterThanOrEqual(ts" in text


def test_contract_is_one_aggregate(spark):
    columns = [*fields.NUMERIC, *fields.CATEGORICAL, "churn"]
    wide = stage(spark.range(10).select(*[F.col("id").cast("double").alias(c) for c in columns]), "wide")
    text = plan(ql.contract_report(wide, fields.column_contract()))
    assert text.count("Exchange") == 1 and text.count("FileScan") == 1


def test_row_rules_need_no_shuffle(spark):
    wide = stage(spark.range(10).select(*[F.col("id").cast("double").alias(c) for c in [*fields.NUMERIC, *fields.CATEGORICAL]]), "wide")
    text = plan(ql.with_errors(wide))
    assert "Exchange" not in text and "Python" not in text


def test_value_counts_combine_before_the_shuffle(spark):
    df = stage(spark.range(100).select((F.col("id") % 2).alias("a"), (F.col("id") % 3).alias("b")), "vc")
    text = plan(value_counts(df, ["a", "b"], "bigint"))
    assert text.count("HashAggregate") == 2 and text.count("Exchange") == 1


def test_upsert_shuffles_each_side_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store = stage(_store(spark, [(1, "2024-01-01", "A", 1, 1.0, 0)]), "s")
        text = plan(st.upsert(store, store, ["revenue"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Store and incoming rows by key; the rows without a complete key pass straight through.
    assert text.count("Exchange hashpartitioning") == 2 and "Cartesian" not in text
