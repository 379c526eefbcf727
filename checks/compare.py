"""Run queries and their SQL side by side: python -m checks.compare [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from checks.oracle import ORACLE
from checks.queries import REGISTRY
from reelmill.session import drop_scratch, local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={'memory_limit': '6GB'})
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(rows: list[tuple], names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if v is None:
            return (0, "")
        if isinstance(v, bool):
            return (1, str(v))
        if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
            return (2, float(v) + 0.0) if not math.isnan(float(v)) else (3, "nan")
        return (4, str(v))

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def same(a: list[tuple], b: list[tuple], tolerance: float = 0.0) -> str:
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    for x, y in zip(a, b):
        for p, q in zip(x, y):
            if p != q and not (p[0] == q[0] == 2 and abs(p[1] - q[1]) <= tolerance):
                return f"{x} != {y}"
    return ""


def compare(spark, con, sf_dir: str, name: str) -> tuple[str, int, float, float]:
    start = time.time()
    df = REGISTRY[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    if name not in ORACLE:
        return "rows only", len(rows), spent, 0.0
    start = time.time()
    cur = con.execute(ORACLE[name])
    expected, names = cur.fetchall(), [d[0] for d in cur.description]
    sql_time = time.time() - start
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(rows), spent, sql_time
    return same(canonical(rows, df.columns), canonical(expected, names)) or "ok", len(rows), spent, sql_time


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(REGISTRY)
    spark = local_session("compare")
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        try:
            verdict, n, spent, sql = compare(spark, con, sf_dir, name)
        except Exception as exc:
            verdict, n, spent, sql = f"{type(exc).__name__}: {str(exc)[:600]}", -1, 0.0, 0.0
        bad += verdict not in ("ok", "rows only")
        print(f"{name:32s} {n:8d} rows {spent:6.2f}s sql {sql:5.2f}s {verdict[:900]}", flush=True)
    drop_scratch(spark)
    print("failed:", bad)


if __name__ == "__main__":
    main()
