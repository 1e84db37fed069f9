"""Run a query and its SQL on the same Parquet tables and compare the results exactly."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _clean(v: object) -> object:
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, int(v))
    if isinstance(v, float):
        return (2, "nan") if math.isnan(v) else (1, v + 0.0)
    if isinstance(v, int):
        return (1, v)
    if isinstance(v, (list, tuple)):
        return (3, tuple(_clean(x) for x in v))
    if isinstance(v, dict):
        return (4, tuple(sorted((str(k), _clean(x)) for k, x in v.items())))
    return (5, str(v))


def rows(names: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_clean(r[i]) for i in order) for r in data)


def check(spark: SparkSession, sf_dir: str, fn, sql: str | None) -> tuple[str, int, float]:
    """('ok' or what differs, row count, seconds)."""
    start = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return ("ok" if got else "no rows", len(got), took)
    c = connect(sf_dir)
    want = c.execute(sql)
    names = [x[0] for x in want.description]
    expected = want.fetchall()
    if sorted(names) != sorted(df.columns):
        return (f"columns {sorted(df.columns)} != {sorted(names)}", len(got), took)
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    types = {x[0]: kinds.get(str(x[1]), str(x[1])) for x in want.description}
    odd = [(n, t, types[n]) for n, t in df.dtypes if t != types[n] and not t.startswith(("array", "map"))]
    a, b = rows(df.columns, got), rows(names, expected)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return (f"{len(a)} vs {len(b)} rows; {diff}", len(got), took)
    return (f"types {odd}" if odd else "ok", len(got), took)


if __name__ == "__main__":
    from foldwise.plans.catalog import ORACLES, QUERIES
    from foldwise.session import local_session

    sf = sys.argv[1]
    wanted = sys.argv[2:] or list(QUERIES)
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    bad = 0
    for q in [n for n in QUERIES if any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in wanted)]:
        try:
            result, n, took = check(session, sf, QUERIES[q], ORACLES.get(q))
        except Exception as error:  # noqa: BLE001
            result, n, took = f"{type(error).__name__}: {str(error)[:700]}", -1, 0.0
        bad += result != "ok"
        print(f"{q:28s} {n:8d} {took:7.2f}s {'sql' if q in ORACLES else '   '} {result}", flush=True)
    print("bad:", bad)
