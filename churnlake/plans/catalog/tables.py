"""Queries over the customer store, the ingestion log, jobs and satellite tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import customer360 as c360
from ...operators import store as st
from ...operators.ranking import beside
from ...session import scratch_path
from ...sources import tables as tb
from ..bindings import prelude, view
from .base import query
from .shared import FLAGS, NUMBERS, W_SQL, landed

_STORE = prelude("store")
_LOGS = prelude("store", "logs")
_BOTH = prelude("store", "incoming")
_LAYOUT = "customer_id, ts, source, batch_id, record_id, revenue, mou, churn, features"


# Store mutations


_UPSERTED = f"""{_BOTH},
  f AS (SELECT *, row_number() OVER (PARTITION BY customer_id, ts ORDER BY record_id) AS a,
    row_number() OVER (PARTITION BY customer_id, ts ORDER BY record_id DESC) AS z FROM incoming WHERE ts IS NOT NULL),
  i AS (SELECT p.customer_id, p.ts, p.source, p.batch_id, p.record_id, q.revenue, q.mou, q.churn, q.features
    FROM f p JOIN f q ON p.customer_id = q.customer_id AND p.ts = q.ts WHERE p.a = 1 AND q.z = 1)
  SELECT s.customer_id, s.ts, s.source, s.batch_id, s.record_id,
    CASE WHEN i.ts IS NULL THEN s.revenue ELSE i.revenue END AS revenue,
    CASE WHEN i.ts IS NULL THEN s.mou ELSE i.mou END AS mou,
    CASE WHEN i.ts IS NULL THEN s.churn ELSE i.churn END AS churn,
    CASE WHEN i.ts IS NULL THEN s.features ELSE i.features END AS features
  FROM store s LEFT JOIN i ON i.customer_id = s.customer_id AND i.ts = s.ts
  UNION ALL SELECT {_LAYOUT} FROM i WHERE NOT EXISTS
    (SELECT 1 FROM store s WHERE s.customer_id = i.customer_id AND s.ts = i.ts)
  UNION ALL SELECT {_LAYOUT} FROM incoming WHERE ts IS NULL"""
_UPDATES = ["revenue", "mou", "churn", "features"]


@query("store_upsert", _UPSERTED)
def _(spark, sf):
    return st.upsert(view(spark, sf, "store"), view(spark, sf, "incoming"), _UPDATES)


def _stored(spark, sf):
    """The store as a partitioned table, and its schema."""
    store = view(spark, sf, "store")
    root = scratch_path(spark, "store")
    tb.create_store(store, root)
    return root, store.schema


@query("store_upsert_table", _UPSERTED)
def _(spark, sf):
    root, schema = _stored(spark, sf)
    tb.upsert_store(spark, root, schema, view(spark, sf, "incoming"), _UPDATES)
    return tb.read_store(spark, root, schema)


_ADDED = f"""added AS (SELECT {_LAYOUT} FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, ts ORDER BY record_id)
      AS a FROM incoming WHERE ts IS NOT NULL) i WHERE a = 1 AND NOT EXISTS
      (SELECT 1 FROM store s WHERE s.customer_id = i.customer_id AND s.ts = i.ts)
    UNION ALL SELECT {_LAYOUT} FROM incoming WHERE ts IS NULL)"""


@query("store_insert_ignore", f"{_BOTH}, {_ADDED} SELECT {_LAYOUT} FROM store UNION ALL SELECT {_LAYOUT} FROM added")
def _(spark, sf):
    return st.insert_ignore(view(spark, sf, "store"), view(spark, sf, "incoming"))


@query(
    "store_insert_table",
    f"{_BOTH}, {_ADDED} SELECT {_LAYOUT} FROM store UNION ALL SELECT {_LAYOUT} FROM added",
)
def _(spark, sf):
    root, schema = _stored(spark, sf)
    tb.insert_store(spark, root, schema, view(spark, sf, "incoming"))
    return tb.read_store(spark, root, schema)


@query(
    "store_insert_counts",
    f"""{_BOTH}, {_ADDED} SELECT p AS processed, s AS saved, p - s AS failed
  FROM (SELECT count(*) AS p FROM incoming) CROSS JOIN (SELECT count(*) AS s FROM added)""",
)
def _(spark, sf):
    store, incoming = view(spark, sf, "store"), view(spark, sf, "incoming")
    return st.insert_counts(st.new_rows(store, incoming), incoming)


# New log entries: every monthly batch again, half of them under a new name.
_ENTRIES = """SELECT CASE WHEN month(ts) <= 6 THEN batch_id ELSE batch_id || '_R' END AS batch_id, 'retry' AS source,
    count(*) AS records_processed, count(*) AS records_saved, CAST(0 AS BIGINT) AS records_failed,
    'success' AS status, max(ts) AS ts FROM {store} GROUP BY 1"""


@query(
    "log_upsert",
    f"""{_LOGS}, e AS ({_ENTRIES.format(store="store")})
  SELECT coalesce(l.batch_id, e.batch_id) AS batch_id, coalesce(l.source, e.source) AS source,
    coalesce(e.records_processed, l.records_processed) AS records_processed,
    coalesce(e.records_saved, l.records_saved) AS records_saved,
    coalesce(e.records_failed, l.records_failed) AS records_failed,
    coalesce(e.status, l.status) AS status, coalesce(e.ts, l.ts) AS ts
  FROM logs l FULL OUTER JOIN e ON l.batch_id = e.batch_id""",
)
def _(spark, sf):
    entries = spark.sql(_ENTRIES, store=view(spark, sf, "store"))
    return st.log_upsert(view(spark, sf, "logs"), entries)


@query(
    "store_delete_batch",
    f"""{_LOGS}, d AS (SELECT count(*) AS deleted FROM store WHERE batch_id = 'BATCH_199703')
  SELECT 'store' AS kind, batch_id, count(*) AS remaining, max(deleted) AS deleted FROM store CROSS JOIN d
  WHERE batch_id <> 'BATCH_199703' GROUP BY batch_id
  UNION ALL SELECT 'logs', batch_id, count(*), max(deleted) FROM logs CROSS JOIN d
  WHERE batch_id <> 'BATCH_199703' GROUP BY batch_id""",
)
def _(spark, sf):
    store, logs = view(spark, sf, "store"), view(spark, sf, "logs")
    batch = "BATCH_199703"
    left = (
        st.delete_batch(store, batch)
        .select(F.lit("store").alias("kind"), "batch_id")
        .unionByName(st.delete_batch(logs, batch).select(F.lit("logs").alias("kind"), "batch_id"))
    )
    remaining = left.groupBy("kind", "batch_id").agg(F.count(F.lit(1)).alias("remaining"))
    return beside(remaining, st.deleted_count(store, batch))


@query(
    "store_drop_batch",
    f"""{_STORE} SELECT {_LAYOUT}, (SELECT count(*) FROM store WHERE batch_id = 'BATCH_199703') AS deleted
  FROM store WHERE batch_id <> 'BATCH_199703'""",
)
def _(spark, sf):
    root, schema = _stored(spark, sf)
    deleted = tb.delete_store_batch(spark, root, schema, "BATCH_199703")
    return tb.read_store(spark, root, schema).withColumn("deleted", F.lit(deleted).cast("bigint"))


@query(
    "store_export",
    f"{_STORE} SELECT {_LAYOUT} FROM store WHERE source = 'csv' AND ts >= TIMESTAMP '1997-01-01 00:00:00' "
    "AND ts <= TIMESTAMP '1999-12-31 00:00:00'",
)
def _(spark, sf):
    start = F.expr("TIMESTAMP_NTZ '1997-01-01 00:00:00'")
    end = F.expr("TIMESTAMP_NTZ '1999-12-31 00:00:00'")
    return st.export(view(spark, sf, "store"), "csv", start, end)


# Lookups and pages


@query("lookup_customer", f"{_STORE} SELECT {_LAYOUT} FROM store WHERE customer_id = 77")
def _(spark, sf):
    return st.lookup(view(spark, sf, "store"), "customer_id", 77)


@query(
    "lookup_batch",
    f"{_STORE} SELECT {_LAYOUT} FROM store WHERE batch_id = 'BATCH_199805' ORDER BY ts, record_id LIMIT 100",
)
def _(spark, sf):
    return st.oldest(st.lookup(view(spark, sf, "store"), "batch_id", "BATCH_199805"), 100, "ts", ["record_id"])


@query("recent_logs", f"{_LOGS} SELECT * FROM logs ORDER BY ts DESC, batch_id LIMIT 10")
def _(spark, sf):
    return st.newest(view(spark, sf, "logs"), 10, "ts", ["batch_id"])


@query("page_customers", f"{_STORE} SELECT {_LAYOUT} FROM store ORDER BY ts DESC, record_id LIMIT 50 OFFSET 100")
def _(spark, sf):
    return st.newest(view(spark, sf, "store"), 50, "ts", ["record_id"], offset=100)


@query(
    "page_customers_keyset",
    f"""{_STORE}, a AS (SELECT ts, record_id FROM store ORDER BY ts DESC, record_id LIMIT 1 OFFSET 99)
  SELECT {", ".join("s." + c.strip() for c in _LAYOUT.split(","))} FROM store s, a
  WHERE s.ts < a.ts OR (s.ts = a.ts AND s.record_id > a.record_id) ORDER BY s.ts DESC, s.record_id LIMIT 50""",
)
def _(spark, sf):
    store = view(spark, sf, "store")
    last = st.newest(store.select("ts", "record_id"), 1, "ts", ["record_id"], offset=99).first()
    return st.page_after(store, 50, (last["ts"], last["record_id"]))


@query(
    "batch_head",
    f"{_STORE} SELECT customer_id, ts, record_id FROM store WHERE batch_id = 'BATCH_199901' ORDER BY ts, record_id LIMIT 20",
)
def _(spark, sf):
    batch = st.lookup(view(spark, sf, "store"), "batch_id", "BATCH_199901").select("customer_id", "ts", "record_id")
    return st.oldest(batch, 20, "ts", ["record_id"])


@query(
    "batch_details",
    f"""{_LOGS} SELECT l.batch_id, l.source, l.status, l.records_processed, (SELECT count(*) FROM store
    WHERE batch_id = 'BATCH_199901') AS records, s.record_id, s.customer_id
  FROM logs l JOIN store s ON s.batch_id = l.batch_id WHERE l.batch_id = 'BATCH_199901'""",
)
def _(spark, sf):
    log, records = st.batch_details(view(spark, sf, "logs"), view(spark, sf, "store"), "BATCH_199901")
    return log.select("batch_id", "source", "status", "records_processed", "records").join(
        records.select("batch_id", "record_id", "customer_id"), "batch_id"
    )


# Totals


@query(
    "ingest_totals",
    f"""{_LOGS} SELECT (SELECT count(*) FROM store) AS total_records, count(*) AS total_batches,
    CAST(sum(records_processed) AS BIGINT) AS total_processed, CAST(sum(records_saved) AS BIGINT) AS total_saved,
    CAST(sum(records_failed) AS BIGINT) AS total_failed FROM logs""",
)
def _(spark, sf):
    return st.ingest_totals(view(spark, sf, "store"), view(spark, sf, "logs"))


@query("ingest_by_source", f"{_STORE} SELECT source, count(*) AS records FROM store GROUP BY source")
def _(spark, sf):
    return st.by_source(view(spark, sf, "store"))


@query(
    "ingest_summary",
    f"""{_LOGS} SELECT source, status, count(*) AS batches, CAST(sum(records_processed) AS BIGINT) AS processed,
    CAST(sum(records_saved) AS BIGINT) AS saved, CAST(sum(records_failed) AS BIGINT) AS failed, max(ts) AS last_ts
  FROM logs GROUP BY source, status""",
)
def _(spark, sf):
    return st.ingest_summary(view(spark, sf, "logs"))


# Jobs

_JOBS = prelude("jobs")


@query(
    "job_rollup",
    f"""{_JOBS} SELECT parent_id, count(*) AS sub_jobs, CASE WHEN bool_and(status = 'completed') THEN 'completed'
    WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'running') THEN 'running'
    ELSE min(status) END AS status FROM jobs GROUP BY parent_id""",
)
def _(spark, sf):
    return st.job_rollup(view(spark, sf, "jobs"))


# Customers as parent jobs whose orders are the sub-jobs; some orders are still pending, and some customers have none.
_PARENT = """CASE customer_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' ELSE 'queued' END"""


@query(
    "job_rollup_parents",
    f"""WITH sub AS (SELECT o_custkey AS parent_id, CASE WHEN o_orderkey % 7 < 5 THEN 'completed' WHEN o_orderkey % 7 = 5
      THEN CASE WHEN o_orderkey % 2 = 0 THEN 'running' ELSE 'pending' END
      ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'pending' END END AS status FROM orders),
  r AS (SELECT parent_id, count(*) AS n, bool_and(status = 'completed') AS done, bool_or(status = 'failed') AS broken,
    bool_or(status = 'running') AS active FROM sub GROUP BY parent_id),
  p AS (SELECT c_custkey AS customer_id FROM customer)
  SELECT customer_id AS job_id, coalesce(n, 0) AS sub_jobs, CASE WHEN done THEN 'completed' WHEN broken THEN 'failed'
    WHEN active THEN 'running' ELSE {_PARENT} END AS status
  FROM p LEFT JOIN r ON parent_id = customer_id""",
)
def _(spark, sf):
    key = F.col("o_orderkey")
    status = (
        F.when(key % 7 < 5, "completed")
        .when(key % 7 == 5, F.when(key % 2 == 0, "running").otherwise("pending"))
        .otherwise(F.when(key % 5 == 0, "failed").otherwise("pending"))
    )
    listed = view(spark, sf, "orders").groupBy(F.col("o_custkey").alias("customer_id")).agg(
        F.collect_list(F.struct(key.alias("job_id"), status.alias("status"))).alias("sub_jobs")
    )
    parents = view(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id")).join(listed, "customer_id", "left")
    parents = parents.select(F.col("customer_id").alias("job_id"), F.expr(_PARENT).alias("status"), "sub_jobs")
    rolled = st.rollup_with_parents(parents)
    return rolled.withColumn("sub_jobs", F.coalesce(F.size(F.coalesce("sub_jobs", F.array())), F.lit(0)).cast("bigint"))


@query(
    "list_jobs",
    f"""{_JOBS} SELECT j.*, (SELECT count(*) FROM jobs) AS total,
    (SELECT count(*) FROM jobs WHERE status = 'running') AS filtered
  FROM (SELECT * FROM jobs WHERE status = 'running' ORDER BY started_at DESC, job_id LIMIT 25) j""",
)
def _(spark, sf):
    return st.list_jobs(view(spark, sf, "jobs"), "running", 25)


# Customer record from satellites.  Some customers have an older second row with other values, and
# some have no satellite rows at all.

_SPLIT = c360.split_satellites([*NUMBERS, *FLAGS, "churn"])


def _satellite_sql(name: str, columns: list[str]) -> str:
    fields = [f"{c360.RESPELT.get(c, c)} AS {c}" for c in columns]
    older = [f"{c360.RESPELT.get(c, c)} + 1 AS {c}" for c in columns]
    skip = "customer_id % 8 <> 3" if name != "vehicles" else "customer_id % 8 = 3"
    return (
        f"SELECT customer_id * 2 + 1 AS id, customer_id, {', '.join(fields)} FROM {{w}} WHERE {skip} "
        f"UNION ALL SELECT customer_id * 2 AS id, customer_id, {', '.join(older)} FROM {{w}} "
        f"WHERE {skip} AND customer_id % 10 = 0"
    )


def _c360_sql() -> str:
    parts, joins, seen = [], [], {}
    for name, columns in _SPLIT.items():
        parts.append(f"{name}_all AS ({_satellite_sql(name, columns).format(w='w')})")
        parts.append(
            f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY id DESC) AS rn "
            f"FROM {name}_all) WHERE rn = 1)"
        )
        joins.append(f"LEFT JOIN {name} ON {name}.customer_id = w.customer_id")
        for c in columns:
            seen.setdefault(c360.RESPELT.get(c, c), []).append(f"{name}.{c}")
    out = ", ".join(f"coalesce({', '.join(many)}) AS {c}" for c, many in seen.items())
    return f"{W_SQL}, {', '.join(parts)} SELECT w.customer_id, w.segment, {out} FROM w {' '.join(joins)}"


@query("customer_360", _c360_sql())
def _(spark, sf):
    df = landed(spark, sf)
    satellites = {name: spark.sql(_satellite_sql(name, columns), w=df) for name, columns in _SPLIT.items()}
    return c360.customer_360(df.select("customer_id", "segment"), satellites)
