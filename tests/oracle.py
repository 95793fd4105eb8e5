"""Runs registered queries next to their SQL in DuckDB and reports differences.

    python tests/oracle.py [--dir DIR] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    """Engine-neutral form; numbers compare exactly after the query's own rounding."""
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, (int, float)):
        f = float(value)
        return "nan" if math.isnan(f) else f + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(data, key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, run, sql):
    df = run(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "rows-only", len(ours[1]), None
    result = con.execute(sql)
    theirs = rows_of([c[0] for c in result.description], result.fetchall())
    if ours[0] != theirs[0]:
        return "columns", len(ours[1]), (ours[0], theirs[0])
    if ours[1] != theirs[1]:
        only_a = [r for r in ours[1] if r not in set(theirs[1])][:2]
        only_b = [r for r in theirs[1] if r not in set(ours[1])][:2]
        return "values", len(ours[1]), (len(theirs[1]), only_a, only_b)
    return "match", len(ours[1]), None


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from scorelake.session import build_session

    sf_dir = "/root/testdata/sf0.01"
    if argv[:1] == ["--dir"]:
        sf_dir, argv = argv[1], argv[2:]
    spark = build_session("oracle", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    all_queries, sql = queries(), oracle_sql()
    for name in argv or all_queries:
        started = time.time()
        try:
            state, n, detail = compare(spark, con, sf_dir, all_queries[name], sql.get(name))
        except Exception as error:
            traceback.print_exc(limit=-2)
            state, n, detail = "error", 0, str(error)[:1500]
        bad += state not in ("match", "rows-only")
        print(f"{state:9} {name:32} rows={n:<7} {time.time() - started:6.2f}s", detail or "", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
