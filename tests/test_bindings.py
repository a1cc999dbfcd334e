"""The customer view that queries read, against its SQL over rows of its own."""

import pytest
from pyspark.sql import functions as F

from churnlake.plans import bindings


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """One customer has a third of all lines; keys repeat, are null or lead nowhere."""
    root = str(tmp_path_factory.mktemp("tables"))
    n = 3000

    def write(name, df):
        df.write.parquet(f"{root}/{name}.parquet")

    ids = spark.range(n)
    write("customer", spark.createDataFrame(
        [(i, i % 5, float(i), "ABC"[i % 3]) for i in range(40)] + [(7, 2, 1.0, "A"), (None, 1, 2.0, "B")],
        "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string",
    ))
    orders = ids.select(
        F.expr("CASE WHEN id % 97 = 0 THEN NULL WHEN id % 50 = 1 THEN id - 1 ELSE id END").alias("o_orderkey"),
        F.expr("CASE WHEN id % 3 = 0 THEN 5 WHEN id % 89 = 0 THEN NULL ELSE id % 45 END").alias("o_custkey"),
        F.expr("CAST('2000-01-01' AS TIMESTAMP_NTZ) + make_dt_interval(id % 700)").alias("o_orderdate"),
    )
    write("orders", orders)
    lines = spark.range(4 * n).select(
        F.expr("CASE WHEN id % 101 = 0 THEN NULL ELSE id % 3000 END").alias("l_orderkey"),
        F.expr("CASE WHEN id % 103 = 0 THEN NULL ELSE id % 210 END").alias("l_partkey"),
        F.expr("CASE WHEN id % 107 = 0 THEN NULL ELSE id % 37 END").alias("l_suppkey"),
        F.expr("CAST(id % 7 + 1 AS INT)").alias("l_linenumber"), F.expr("CAST(id % 50 AS DOUBLE)").alias("l_quantity"),
        F.expr("CAST(id % 1000 AS DOUBLE) + 0.25").alias("l_extendedprice"), F.expr("id % 11 / 100D").alias("l_discount"),
        F.expr("id % 9 / 100D").alias("l_tax"), F.expr("substr('RANX', CAST(id % 4 AS INT) + 1, 1)").alias("l_returnflag"),
        F.expr("CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'F' ELSE 'O' END").alias("l_linestatus"),
        F.expr("CAST('1998-01-01' AS TIMESTAMP_NTZ) + make_dt_interval(id % 900)").alias("l_shipdate"),
    )
    write("lineitem", lines)
    write("part", spark.createDataFrame(
        [(i % 199, None if i % 13 == 0 else f"type {i % 17}", f"brand {i % 6}") for i in range(202)] + [(None, "x", "y")],
        "p_partkey bigint, p_type string, p_brand string",
    ))
    return root


def test_the_customer_view_equals_its_sql(spark, folder):
    tables = {n: bindings.table(spark, folder, n) for n in ("customer", "orders", "lineitem", "part")}
    wanted = spark.sql(bindings.VIEWS["w"], **tables)
    got = bindings.wide(spark, folder)
    assert got.columns == wanted.columns and got.dtypes == wanted.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))
    assert got.where("customer_id = 5").count() == 1 and got.where("customer_id = 7").count() == 2
    some = ["customer_id", "uniqsubs", "churn"]
    assert sorted(map(str, bindings.wide(spark, folder, some).collect())) == sorted(map(str, wanted.select(*some).collect()))


def test_the_customer_view_passes_over_its_lines_once(spark, folder):
    text = bindings.wide(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Scan parquet") == 4 and "Generate" not in text and "Expand" not in text


def test_lines_of_an_order_leave_a_task_as_one_row(spark, folder):
    """The order's key is joined last, so that totals shrink before they are dealt by customer."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = bindings.wide(spark, folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.index("l_orderkey") < text.index("l_partkey")  # the upper join comes first in the plan


def test_tasks_of_the_customer_view_take_bounded_lines(spark, folder, monkeypatch):
    """F10 to F24: 12,000 lines in 12 parts of their order's key, though the session has 8 shuffle partitions."""
    monkeypatch.setattr(bindings, "TASK_LINES", 1000)
    tables = {n: bindings.table(spark, folder, n) for n in ("customer", "orders", "lineitem", "part")}
    got = bindings.wide(spark, folder)
    text = got._jdf.queryExecution().executedPlan().toString()
    dealt = next(line for line in text.splitlines() if "REPARTITION_BY_NUM" in line)
    assert "hashpartitioning(l_orderkey" in dealt and ", 12)" in dealt and text.count("Scan parquet") == 4
    assert "IsNotNull(l_orderkey)" in text  # lines without an order don't meet in one task
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.sql(bindings.VIEWS["w"], **tables).collect()))


def test_lines_meet_parts_in_bounded_tasks(spark, folder, monkeypatch):
    """F11 to F23: parts that aren't broadcast take the lines into 12 tasks too, not into the session's 8."""
    monkeypatch.setattr(bindings, "TASK_LINES", 1000)
    tables = {n: bindings.table(spark, folder, n) for n in ("customer", "orders", "lineitem", "part")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = bindings.wide(spark, folder)
        text = got._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in text.splitlines() if "hashpartitioning(l_partkey" in line]
        assert len(dealt) == 1 and ", 12)" in dealt[0] and text.count("Scan parquet") == 4
        assert "IsNotNull(l_partkey)" in text and "IsNotNull(p_partkey)" in text
        assert sorted(map(str, got.collect())) == sorted(map(str, spark.sql(bindings.VIEWS["w"], **tables).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
