"""Customer-churn views over the provided tables.

Each view is one SELECT that reads the same on Spark and on the SQL engine used as an oracle.  A name in
braces is another view or a table.  ``view`` returns the lazy DataFrame; ``prelude`` returns the
``WITH`` clause that puts the same views in front of an oracle query.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS: dict[str, str] = {}

# The customer view: per-customer totals, per-customer distinct counts, and the columns made of both.
_TOTALS = """
CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
  sum(l.l_quantity) AS mou,
  CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_tax AS DECIMAL(4,2))) AS DOUBLE) AS overage,
  CAST(sum(CASE WHEN l.l_linenumber = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS directas,
  CAST(sum(CASE WHEN l.l_discount >= 0.08 THEN 1 ELSE 0 END) AS DOUBLE) AS roam,
  sum(CASE WHEN year(l.l_shipdate) >= 1999 THEN l.l_quantity ELSE -l.l_quantity END) AS changem,
  CAST(sum(CASE WHEN year(l.l_shipdate) >= 1999 THEN 1 ELSE -1 END) AS DOUBLE) AS changer,
  CAST(sum(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS dropvce,
  CAST(sum(CASE WHEN l.l_returnflag = 'A' THEN 1 ELSE 0 END) AS DOUBLE) AS blckvce,
  CAST(sum(CASE WHEN l.l_returnflag = 'N' THEN 1 ELSE 0 END) AS DOUBLE) AS unansvce,
  CAST(sum(CASE WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) AS dropblk,
  CAST(sum(CASE WHEN l.l_linenumber = 7 THEN 1 ELSE 0 END) AS DOUBLE) AS custcare,
  CAST(sum(CASE WHEN l.l_linenumber = 6 THEN 1 ELSE 0 END) AS DOUBLE) AS threeway,
  CAST(sum(CASE WHEN l.l_linenumber = 5 THEN 1 ELSE 0 END) AS DOUBLE) AS callfwdv,
  CAST(sum(CASE WHEN l.l_linenumber = 4 THEN 1 ELSE 0 END) AS DOUBLE) AS callwait,
  sum(CASE WHEN l.l_linestatus = 'O' THEN l.l_quantity ELSE 0 END) AS mourec,
  CAST(sum(CASE WHEN l.l_linestatus = 'O' THEN 1 ELSE 0 END) AS DOUBLE) AS outcalls,
  CAST(sum(CASE WHEN l.l_linestatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) AS incalls,
  CAST(sum(CASE WHEN month(l.l_shipdate) BETWEEN 6 AND 8 THEN 1 ELSE 0 END) AS DOUBLE) AS peakvce,
  CAST(sum(CASE WHEN month(l.l_shipdate) BETWEEN 6 AND 8 THEN 0 ELSE 1 END) AS DOUBLE) AS opeakvce,
  CAST((year(max(o.o_orderdate)) - year(min(o.o_orderdate))) * 12
       + month(max(o.o_orderdate)) - month(min(o.o_orderdate)) AS DOUBLE) AS months,
  CAST((2002 - year(max(l.l_shipdate))) * 365 + (12 - month(max(l.l_shipdate))) * 30 AS DOUBLE) AS eqpdays,
  CASE WHEN max(o.o_orderdate) < TIMESTAMP '2001-01-01 00:00:00' THEN 1 ELSE 0 END AS churn
"""

_DISTINCT = {
    "recchrge": "o.o_orderkey",
    "uniqsubs": "l.l_suppkey",
    "actvsubs": "CASE WHEN l.l_linestatus = 'O' THEN l.l_suppkey END",
    "phones": "p.p_type",
    "models": "p.p_brand",
}

_CUSTOMER = """
SELECT c.c_custkey AS customer_id, c.c_mktsegment AS segment, c.c_nationkey AS nationkey,
  CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE f.revenue END AS revenue,
  CASE WHEN c.c_custkey % 7 = 0 THEN NULL ELSE f.mou END AS mou,
  f.recchrge, f.directas,
  CASE WHEN c.c_custkey % 13 = 0 THEN NULL ELSE f.overage END AS overage,
  f.roam, f.changem, f.changer, f.dropvce, f.blckvce, f.unansvce, f.custcare, f.threeway, f.mourec,
  f.outcalls, f.incalls, f.peakvce, f.opeakvce, f.dropblk, f.callfwdv, f.callwait, f.months,
  f.uniqsubs, f.actvsubs, f.phones, f.models, f.eqpdays,
  CAST(20 + c.c_custkey % 60 AS DOUBLE) AS age1,
  CASE WHEN c.c_custkey % 5 = 0 THEN NULL ELSE CAST(18 + c.c_custkey % 50 AS DOUBLE) END AS age2,
  CAST(c.c_custkey % 4 AS DOUBLE) AS refer,
  CAST(c.c_custkey % 12 AS DOUBLE) AS income,
  c.c_acctbal AS setprc,
  CASE WHEN c.c_custkey % 3 = 0 THEN 1 ELSE 0 END AS children,
  CASE WHEN c.c_custkey % 4 = 1 THEN 1 ELSE 0 END AS credita,
  CASE WHEN c.c_custkey % 4 = 2 THEN 1 ELSE 0 END AS creditaa,
  CASE WHEN c.c_custkey % 2 = 0 THEN 1 ELSE 0 END AS creditcd,
  CASE WHEN c.c_nationkey % 4 = 0 THEN 1 ELSE 0 END AS prizmrur,
  CASE WHEN c.c_nationkey % 4 = 1 THEN 1 ELSE 0 END AS prizmub,
  CASE WHEN c.c_nationkey % 4 = 2 THEN 1 ELSE 0 END AS prizmtwn,
  CASE WHEN c.c_custkey % 17 = 0 THEN 1 ELSE 0 END AS refurb,
  CASE WHEN c.c_custkey % 19 = 0 THEN 1 ELSE 0 END AS truck,
  CASE WHEN c.c_custkey % 23 = 0 THEN 1 ELSE 0 END AS rv,
  CASE WHEN c.c_nationkey % 9 = 0 THEN 1 ELSE 0 END AS occprof,
  CASE WHEN c.c_nationkey % 9 = 1 THEN 1 ELSE 0 END AS occcler,
  CASE WHEN c.c_nationkey % 9 = 2 THEN 1 ELSE 0 END AS occcrft,
  CASE WHEN c.c_nationkey % 9 = 3 THEN 1 ELSE 0 END AS occret,
  CASE WHEN c.c_nationkey % 9 = 4 THEN 1 ELSE 0 END AS occself,
  CASE WHEN c.c_custkey % 6 < 4 THEN 1 ELSE 0 END AS ownrent,
  CASE WHEN c.c_custkey % 6 < 3 THEN 1 ELSE 0 END AS marryyes,
  CASE WHEN c.c_custkey % 8 = 0 THEN 1 ELSE 0 END AS travel,
  CASE WHEN c.c_custkey % 9 = 0 THEN 1 ELSE 0 END AS pcown,
  CASE WHEN c.c_custkey % 10 < 2 THEN 1 ELSE 0 END AS newcelly,
  CASE WHEN c.c_custkey % 10 BETWEEN 1 AND 3 THEN 1 ELSE 0 END AS newcelln,
  CAST(c.c_custkey % 5 AS INT) AS retcalls,
  CAST(c.c_custkey % 3 AS INT) AS retaccpt,
  CASE WHEN c.c_custkey % 5 > 0 AND c.c_custkey % 31 > 0 THEN 1 ELSE 0 END AS retcall,
  CASE WHEN c.c_custkey % 29 = 0 THEN NULL ELSE
       CASE c.c_nationkey % 4 WHEN 0 THEN 'rural' WHEN 1 THEN 'urban' WHEN 2 THEN 'town' ELSE 'other' END END AS prizm_cluster,
  f.churn
"""

_JOINED = (
    "{orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey JOIN {part} p ON p.p_partkey = l.l_partkey"
)

VIEWS["w"] = (
    f"WITH f AS (SELECT o.o_custkey AS k, {_TOTALS.strip()}, "
    + ", ".join(f"CAST(count(DISTINCT {e}) AS DOUBLE) AS {n}" for n, e in _DISTINCT.items())
    + f" FROM {_JOINED} GROUP BY o.o_custkey)\n{_CUSTOMER.strip()}\nFROM {{customer}} c JOIN f ON f.k = c.c_custkey"
)

# The same view for Spark, in one aggregate.  The order's key is joined last: the lines of an order then lie together, and
# each task sends on about one row an order.  Several distinct counts would make Spark copy every wide row once per count;
# as sets they travel with the totals.  Both shrink before the shuffle, so a customer with many rows costs a task no more
# than its different values.  Orders are counted apart, since there may be as many of them as a customer has rows.
# Many lines are dealt over so many tasks that each sorts and adds up TASK_LINES on average: the session's number of
# shuffle partitions doesn't grow with the tables, and tasks that do would spill every line several times.  Parts are dealt
# alike: unless they are broadcast, the lines follow them into as many tasks.
TASK_LINES = 250_000

_LINES = "SELECT l.*, p.* FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey"

_FACTS = f"""
SELECT o.o_custkey AS k, {_TOTALS.strip()},
  {", ".join(f"CAST({f'count(DISTINCT {e})' if n == 'recchrge' else f'size(collect_set({e}))'} AS DOUBLE) AS {n}" for n, e in _DISTINCT.items()).replace("p.p_", "l.p_")}
FROM {{lines}} l JOIN {{orders}} o ON o.o_orderkey = l.l_orderkey
GROUP BY o.o_custkey
"""

VIEWS["raw"] = """
SELECT customer_id,
  CASE customer_id % 7 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'Y' WHEN 3 THEN '0'
                       WHEN 4 THEN 'TRUE' WHEN 5 THEN NULL ELSE '1' END AS children,
  CASE customer_id % 15 WHEN 0 THEN 'n/a' WHEN 1 THEN NULL WHEN 2 THEN 'nan' WHEN 3 THEN '1e10' WHEN 4 THEN '-inf'
                        WHEN 5 THEN '1e30' ELSE CAST(CAST(months AS INT) AS STRING) END AS tenure,
  CASE WHEN customer_id % 9 = 0 THEN 'abc' WHEN customer_id % 9 = 1 THEN 'NaN' ELSE CAST(CAST(mou AS BIGINT) AS STRING) || '.5' END AS minutes_of_use,
  CASE customer_id % 6 WHEN 0 THEN concat(chr(9), 'Rural', chr(10)) WHEN 1 THEN 'nan' WHEN 2 THEN 'None' WHEN 3 THEN 'URBAN'
                       WHEN 4 THEN concat(' ', chr(9)) ELSE ' town ' END AS prizm,
  CASE customer_id % 6 WHEN 0 THEN concat(chr(9), 'Yes') WHEN 1 THEN 'false' WHEN 2 THEN '1' WHEN 3 THEN 'maybe'
                       WHEN 4 THEN NULL ELSE 'No ' END AS churndep,
  'junk' AS x
FROM {w}
"""

VIEWS["store"] = """
SELECT o_custkey AS customer_id, o_orderdate AS ts,
  CASE WHEN min(o_orderkey) % 3 = 0 THEN 'api' WHEN min(o_orderkey) % 3 = 1 THEN 'csv' ELSE 'api_batch' END AS source,
  concat('BATCH_', CAST(year(o_orderdate) AS STRING), lpad(CAST(month(o_orderdate) AS STRING), 2, '0')) AS batch_id,
  min(o_orderkey) AS record_id, min(o_totalprice) AS revenue,
  CAST(min(o_orderkey) % 500 AS DOUBLE) AS mou, CAST(min(o_orderkey) % 2 AS INT) AS churn,
  concat(chr(123), '"recchrge":', CAST(min(o_orderkey) % 90 AS STRING), ',"webcap":1', chr(125)) AS features
FROM {orders} GROUP BY o_custkey, o_orderdate
"""

VIEWS["incoming"] = """
SELECT o_custkey + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1000000 END AS customer_id,
  CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderdate END AS ts,
  'csv' AS source, 'BATCH_NEW' AS batch_id, o_orderkey AS record_id,
  o_totalprice + 1 AS revenue, CAST(NULL AS DOUBLE) AS mou, 1 AS churn,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat(chr(123), '"recchrge":', CAST(o_orderkey AS STRING), chr(125)) END AS features
FROM {orders}
"""

VIEWS["logs"] = """
SELECT batch_id, min(source) AS source, count(*) AS records_processed,
  CAST(sum(CASE WHEN record_id % 17 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS records_saved,
  CAST(sum(CASE WHEN record_id % 17 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS records_failed,
  CASE WHEN sum(CASE WHEN record_id % 17 = 0 THEN 1 ELSE 0 END) > 20 THEN 'failed' ELSE 'success' END AS status,
  max(ts) AS ts
FROM {store} GROUP BY batch_id
"""

VIEWS["scores"] = """
SELECT customer_id, churn AS label, CAST((customer_id * 7919) % 700 + churn * 300 AS DOUBLE) / 1000.0 AS p,
  CAST(customer_id % 5 AS INT) AS fold, concat('depth=', CAST(customer_id % 5 % 3 AS STRING)) AS params
FROM {w}
"""

VIEWS["jobs"] = """
SELECT o_custkey AS parent_id, o_orderkey AS job_id,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_orderdate AS started_at
FROM {orders}
"""

VIEWS["drift"] = """
SELECT CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'ref' ELSE 'live' END AS side, event_id, ts, event_type,
  value, CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN value ELSE value * 2 + 5 END AS value_drifted,
  CAST(CASE WHEN ts >= TIMESTAMP '2024-01-16 00:00:00' OR event_id % 5 = 0 THEN 1 ELSE 0 END AS INT) AS label
FROM {events}
"""

_NAME = re.compile(r"{(\w+)}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None) -> DataFrame:
    """The customer view, or the named columns of it; the totals and counts of others are pruned."""
    names = None if columns is None else list(columns)
    lineitem, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    parts = -(-lineitem.count() // TASK_LINES)
    many = parts > spark.sparkContext.defaultParallelism
    lines = spark.sql(_LINES, lineitem=lineitem, part=part.repartition(parts, "p_partkey") if many else part)
    if many:
        lines = lines.repartition(parts, "l_orderkey")
    f = spark.sql(_FACTS, lines=lines, orders=table(spark, sf_dir, "orders"))
    customer = table(spark, sf_dir, "customer")
    out = spark.sql(f"{_CUSTOMER.strip()} FROM {{customer}} c JOIN {{f}} f ON f.k = c.c_custkey", customer=customer, f=f)
    return out if names is None else out.select(*names)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a plain table when no view has that name."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    if name == "w":
        return wide(spark, sf_dir)
    text = VIEWS[name]
    inputs = {n: view(spark, sf_dir, n) for n in set(_NAME.findall(text)) if n != "w"}
    if "{w}" in text:
        inputs["w"] = wide(spark, sf_dir, _W_USED[name])
    return spark.sql(text, **inputs)


# Customer columns that the views over the customer view read.
_W_USED = {"raw": ["customer_id", "months", "mou"], "scores": ["customer_id", "churn"]}


def prelude(*names: str) -> str:
    """``WITH`` clause defining the named views and all views they read, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for needed in _NAME.findall(VIEWS[name]):
                visit(needed)
            ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({_NAME.sub(lambda m: m.group(1), VIEWS[n]).strip()})" for n in ordered]
    return "WITH " + ",\n".join(parts)
