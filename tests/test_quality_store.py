"""Normalisation, validation, and the store's mutation rules."""

import pytest
from pyspark.sql import functions as F

from churnlake.functions import fields
from churnlake.operators import customer360 as c360
from churnlake.operators import normalize as nz
from churnlake.operators import profile as pf
from churnlake.operators import quality as ql
from churnlake.operators import store as st
from churnlake.session import scratch_path
from churnlake.sources import readers as rd
from churnlake.sources import writers as wr

STORE = "customer_id bigint, ts timestamp_ntz, source string, batch_id string, record_id bigint, revenue double, churn int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _store(spark, data):
    df = spark.createDataFrame(data, STORE.replace("timestamp_ntz", "string"))
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_alias_precedence(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "month int, tenure int, mou int, minutes_of_use int")
    out = nz.canonical_rename(df)
    assert (out.columns, tuple(out.first())) == (["months", "mou"], (2, 3))


def test_flags(spark):
    df = spark.createDataFrame(
        [("YES", 1.0, True), ("1.0", 2.0, False), ("TRUE", 0.0, None), (None, None, None)],
        "truck string, rv double, travel boolean",
    )
    out = nz.coerce_boolean(df)
    assert [tuple(r) for r in out.collect()] == [(1, 1, 1), (0, 0, 0), (0, 0, 0), (0, 0, 0)]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "a double, b int")
    assert [r["a"] for r in nz.nan_to_null(df).collect()] == [None, 2.0]


def test_clip_widens_negative_bounds(spark):
    df = spark.createDataFrame([(-200.0,), (0.0,), (None,)], "a double")
    out = nz.clip_to_reference(df, {"a": (-100.0, -10.0)})
    assert [r["a"] for r in out.collect()] == [-105.0, -9.5, None]


def test_row_rules_on_examples(spark):
    ok = {c: 0.0 for c in fields.NUMERIC} | {c: 0 for c in fields.CATEGORICAL} | {"churn": 0, "uniqsubs": 1.0, "actvsubs": 1.0}
    bad = ok | {"age1": 40.0, "age2": 42.0}
    worse = ok | {"income": 10.0, "newcelly": 1, "newcelln": 1, "retcall": 1, "actvsubs": 2.0, "months": -1.0, "truck": 2}
    df = spark.createDataFrame([tuple(x.values()) for x in (ok, bad, worse)], list(ok))
    got = [r["errors"] for r in ql.with_errors(df).collect()]
    assert got[0] == [] and got[1] == ["age_order"]
    assert got[2] == [
        "months_non_negative", "income_range", "truck_binary", "newcell_exclusive", "actvsubs_within_uniqsubs",
        "retcall_has_calls",
    ]
    valid, rejected = ql.quarantine_split(df)
    assert (valid.count(), rejected.count()) == (1, 2) and valid.columns == df.columns


def test_contract_on_empty_and_one_class(spark):
    empty = spark.createDataFrame([], "revenue double, churn int")
    contract = {"revenue": {"dtype": "float", "allow_null": False}, "churn": {"dtype": "int", "allowed_values": [0, 1]}}
    assert all(r["violations"] == 0 for r in ql.contract_report(empty, contract).collect())
    assert not ql.check_target(empty).first()["valid"]
    gate = {r["check"]: r["passed"] for r in ql.quality_gate(empty).collect()}
    assert gate == {"has_data": False, "has_features": True, "no_nulls": True, "has_target": True, "class_balance": False}
    one = spark.createDataFrame([(1.0, 1), (2.0, 1)], "revenue double, churn int")
    checks = {r["check"]: r["passed"] for r in ql.training_readiness(one).collect()}
    assert checks["features_complete"] and not checks["two_classes"]
    assert ql.check_target(one).first()["imbalanced"]


def test_upsert_updates_only_listed_columns_and_is_idempotent(spark):
    store = _store(spark, [(1, "2024-01-01", "api", "A", 1, 1.0, 0), (2, None, "api", "A", 2, 2.0, 0)])
    new = _store(
        spark,
        [
            (1, "2024-01-01", "csv", "B", 10, 5.0, 1),
            (1, "2024-01-01", "csv", "B", 11, None, 1),
            (3, "2024-01-02", "csv", "B", 12, 7.0, 0),
            (3, "2024-01-02", "csv", "B", 13, 8.0, 1),
        ],
    )
    once = st.upsert(store, new, ["revenue", "churn"])
    got = {(r["customer_id"], r["record_id"]): (r["source"], r["revenue"], r["churn"]) for r in once.collect()}
    assert got == {(1, 1): ("api", None, 1), (2, 2): ("api", 2.0, 0), (3, 12): ("csv", 8.0, 1)}
    assert rows(st.upsert(once, new, ["revenue", "churn"])) == rows(once)


def test_insert_ignore_counts_and_null_keys(spark):
    store = _store(spark, [(1, "2024-01-01", "api", "A", 1, 1.0, 0)])
    new = _store(
        spark,
        [
            (1, "2024-01-01", "csv", "B", 10, 5.0, 1),
            (2, "2024-01-01", "csv", "B", 12, 6.0, 1),
            (2, "2024-01-01", "csv", "B", 11, 7.0, 1),
            (2, None, "csv", "B", 13, 8.0, 1),
            (2, None, "csv", "B", 14, 9.0, 1),
        ],
    )
    added = st.new_rows(store, new)
    assert sorted(r["record_id"] for r in added.collect()) == [11, 13, 14]
    counts = st.insert_counts(added, new).first().asDict()
    assert counts == {"processed": 5, "saved": 3, "failed": 2}
    assert st.insert_ignore(store, new).count() == 4


def test_hot_key_upsert_keeps_every_other_row(spark):
    """A third of the incoming rows share one key."""
    hot = [(1, "2024-01-01", "csv", "B", i, float(i), 1) for i in range(3000)]
    rest = [(i, "2024-01-02", "csv", "B", i, float(i), 0) for i in range(10_000, 16_000)]
    store = _store(spark, [(1, "2024-01-01", "api", "A", 0, 0.0, 0)])
    out = st.upsert(store, _store(spark, hot + rest), ["revenue", "churn"])
    assert out.count() == 6001
    assert out.where("customer_id = 1").first()["revenue"] == 2999.0


def test_job_rollup(spark):
    data = [("a", "x", "completed"), ("b", "x", "completed"), ("c", "y", "failed"), ("d", "y", "running"),
            ("e", "z", "running"), ("f", "z", "completed"), ("g", "q", "queued")]
    jobs = spark.createDataFrame(data, "job_id string, parent_id string, status string").withColumn(
        "started_at", F.current_timestamp()
    )
    got = {r["parent_id"]: r["status"] for r in st.job_rollup(jobs).collect()}
    assert got == {"x": "completed", "y": "failed", "z": "running", "q": "queued"}
    parents = spark.createDataFrame(
        [("p", "running", [("a", "completed")]), ("r", "pending", [])],
        "job_id string, status string, sub_jobs array<struct<job_id string, status string>>",
    )
    assert {r["job_id"]: r["status"] for r in st.rollup_with_parents(parents).collect()} == {"p": "completed", "r": "pending"}


def test_pages_meet(spark):
    df = spark.range(100).select(F.col("id").alias("record_id"), (F.col("id") % 7).alias("ts"))
    first = st.newest(df, 30, "ts", ["record_id"]).collect()
    by_offset = st.newest(df, 30, "ts", ["record_id"], offset=30).collect()
    last = first[-1]
    assert st.page_after(df, 30, (last["ts"], last["record_id"])).collect() == by_offset


def test_export_filters_and_formats(spark):
    store = _store(spark, [(i, f"2024-01-{i:02d}", "csv" if i % 2 else "api", "A", i, 1.0, 0) for i in range(1, 21)])
    out = st.export(store, "csv", F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-11").cast("timestamp_ntz"))
    assert [r["customer_id"] for r in out.collect()] == [11, 9, 7, 5]
    for kind in ("csv", "json"):
        path = scratch_path(spark, "export")
        wr.write_export(out, path, kind)
        back = spark.read.schema(out.schema).option("header", True).format(kind).load(path)
        assert rows(back) == rows(out)
    assert '"customer_id":11' in st.export_json(out).first()["record"]


def test_customer_360_takes_newest_rows_and_first_holder(spark):
    master = spark.createDataFrame([(1,), (2,)], "customer_id bigint")
    household = spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "id bigint, customer_id bigint, truck int")
    vehicles = spark.createDataFrame([(1, 1, 0), (1, 2, 1)], "id bigint, customer_id bigint, truck int")
    jobs = spark.createDataFrame([(5, 2, 1)], "id bigint, customer_id bigint, ocret int")
    out = c360.customer_360(master, {"household": household, "vehicles": vehicles, "occupation_profile": jobs})
    assert out.columns == ["customer_id", "truck", "occret"]
    assert rows(out) == [(1, 1, None), (2, 1, 1)]


def test_feature_types_approximate_kinds_are_exact(spark):
    df = spark.createDataFrame([(1, 5.0, "x", 0, 7), (2, 5.0, "y", 1, 7), (3, 6.0, "x", 0, 7)], "a int, b double, c string, t int, k int")
    exact = {r["column_name"]: r["kind"] for r in pf.feature_types(df, "t").collect()}
    assert exact == {"a": "continuous", "b": "binary", "c": "categorical", "k": "continuous"}
    assert exact == {r["column_name"]: r["kind"] for r in pf.feature_types(df, "t", counts="exact").collect()}


def test_comparison_of_a_set_with_itself(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a", 0), (2.0, 1.0, "b", 1), (4.0, 0.5, "a", 1)], "x double, y double, c string, t int")
    got = {(r["metric"], r["feature"]): r["value"] for r in pf.compare_datasets(df, df, "t", ["x", "y"], ["c"]).collect()}
    assert got.pop(("category_preservation", "c")) == 1.0
    assert all(v == 0.0 for v in got.values()) and len(got) == 4


def test_samples_in_all_layouts(spark, tmp_path):
    (tmp_path / "doc.json").write_text(
        '{"samples": [{"features": {"a": 1, "b": 2.5}, "target": 1, "sample_id": "s1"},\n {"features": {"a": 3}, "target": 0}]}'
    )
    (tmp_path / "list.json").write_text('\n [{"features": {"a": 4}, "target": 1}, {"a": 5, "target": 1}, {"a": 6}]')
    got = rows(rd.read_samples(spark, str(tmp_path)).select("sample_id", "target", F.element_at("features", F.lit("a"))))
    assert got == sorted([("s1", 1, 1.0), (None, 0, 3.0), (None, 1, 4.0), (None, 1, 5.0), (None, 0, 6.0)], key=str)


def test_fallback_and_limit(spark):
    assert rd.with_limit("SELECT * FROM t;", 5) == "SELECT * FROM t LIMIT 5"
    assert rd.with_limit("select * from t limit 3", 5) == "select * from t limit 3"
    good = spark.range(10)
    out = rd.read_with_fallback([("empty", lambda: good.limit(0)), ("csv", lambda: good)], 3, ["id"])
    assert [tuple(r) for r in out.collect()] == [(0, "csv"), (1, "csv"), (2, "csv")]
    with pytest.raises(FileNotFoundError):
        rd.read_with_fallback([("none", lambda: spark.read.parquet("/nonexistent/x"))])


def test_configured_readers(spark):
    df = spark.createDataFrame([(1, "a,b"), (2, 'say "x"')], "i int, s string")
    for kind in ("csv", "json", "parquet", "orc"):
        path = scratch_path(spark, "conf")
        writer = df.write.option("header", True).option("escape", '"')
        writer.format(kind).save(path)
        out = rd.read_configured(spark, {"type": kind, "path": path, "schema": df.schema})
        assert rows(out) == rows(df)
    with pytest.raises(ValueError):
        rd.read_configured(spark, {"type": "fax"})
    with pytest.raises(ValueError):
        rd.read_jdbc(spark, "jdbc:x:y")


def test_publish_switches_versions(spark):
    root = scratch_path(spark, "pub")
    wr.publish(spark.range(3), root, "v1")
    wr.publish(spark.range(5), root, "v2")
    assert wr.current(spark, root).count() == 5
    assert [r["row_count"] for r in wr.versions(spark, root).orderBy("version").collect()] == [3, 5]


def test_fingerprint_ignores_order_but_not_content(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string")
    b = spark.createDataFrame([(2, None), (1, "x")], "i int, s string")
    c = spark.createDataFrame([(1, "x"), (2, "x")], "i int, s string")
    f = [wr.content_fingerprint(d).first()["fingerprint"] for d in (a, b, c)]
    assert f[0] == f[1] != f[2]
