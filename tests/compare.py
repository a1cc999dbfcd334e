"""Run a registered query and its oracle SQL side by side.

``python tests/compare.py [sf] [name ...]`` prints one line per query; with ``CHURNLAKE_SPREAD=1`` under
plans as they are on large data.
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

DATA = os.environ.get("CHURNLAKE_TESTDATA", "/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

# Engine type names that hold the same values.
SAME_TYPE = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz", "FLOAT": "float", "DATE": "date", "SMALLINT": "smallint", "TINYINT": "tinyint",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(value)
    if isinstance(value, decimal.Decimal):
        return str(value.normalize())
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows])


def compare(spark, con, sf_dir: str, run, sql: str) -> str:
    """Empty when both results agree, otherwise what differs."""
    df = run(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    ours = dict(df.dtypes)
    for name, kind in zip(rel.columns, rel.types):
        kind = str(kind)
        mapped = SAME_TYPE.get(kind, kind.lower())
        if mapped != ours[name].replace("timestamp_ltz", "timestamp") and not (
            mapped == "timestamp_ntz" and ours[name] == "timestamp"
        ):
            return f"type of {name}: {ours[name]} != {kind}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"first difference over columns {sorted(df.columns)}:\n   spark {a}\n   sql   {b}"
    return ""


def main(argv: list[str]) -> int:
    from churnlake.plans.catalog import ORACLES, QUERIES
    from churnlake.session import build_session

    sf = argv[0] if argv else "0.01"
    names = argv[1:] or list(QUERIES)
    conf = {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"}
    if os.environ.get("CHURNLAKE_SPREAD"):
        # As on large data: no automatic broadcast, and small shuffles stay in many partitions.
        conf |= {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    spark = build_session("compare", "local[8]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"{DATA}/sf{sf}"
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in ORACLES:
                diff = compare(spark, con, sf_dir, QUERIES[name], ORACLES[name])
                verdict = f"DIFF {diff}" if diff else "ok"
            else:
                verdict = f"rows {len(QUERIES[name](spark, sf_dir).collect())}"
        except Exception as e:  # noqa: BLE001
            verdict = f"ERROR {type(e).__name__}: {str(e)[:900]}"
        bad += verdict.startswith(("DIFF", "ERROR"))
        print(f"{name:28s} {time.time() - start:6.2f}s {verdict}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
