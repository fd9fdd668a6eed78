"""Run registered queries in Spark and their check SQL in DuckDB, and compare all rows.

Usage: python tests/compare.py [sf_dir] [name-substring | @module ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from matchlens.plans import catalog  # noqa: E402
from matchlens.session import local_session  # noqa: E402
from matchlens.sources.adapter import RAW  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in RAW:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, (int, float)):
        return "nan" if value != value else round(float(value), 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return str(value)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql: str) -> str:
    """Empty when both sides agree, else what differs."""
    left = bag(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    rel = con.sql(sql)
    right = bag(rel.columns, rel.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if left[1] != right[1]:
        only_spark, only_sql = left[1] - right[1], right[1] - left[1]
        return (
            f"rows {sum(left[1].values())} vs {sum(right[1].values())}; columns {left[0]}\n"
            f"   spark only ({sum(only_spark.values())}): {list(only_spark)[:3]}\n"
            f"   sql only   ({sum(only_sql.values())}): {list(only_sql)[:3]}"
        )
    return "" if left[1] else "EMPTY"


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.001"
    wanted = argv[1:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    checks = catalog.check_queries()
    for name, run in catalog.spark_queries().items():
        module = catalog.PLANS[name].__module__.rsplit(".", 1)[-1]
        if wanted and not any(w in name or w == f"@{module}" for w in wanted):
            continue
        began = time.time()
        try:
            df = run(spark, sf_dir)
            found = difference(df, con, checks[name]) if name in checks else f"(rows only: {df.count()})"
        except Exception as err:  # noqa: BLE001
            found = f"{type(err).__name__}: {str(err)[:1200]}"
        took = time.time() - began
        ok = not found or found.startswith("(rows only")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {took:.1f}s {found}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
