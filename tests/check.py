"""Run registered queries next to their check SQL.

    python tests/check.py SF_DIR [name fragment ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def same(spark_rows, spark_cols, sql_rows, sql_cols) -> str:
    """Empty if both results hold the same rows, else what differs."""
    if sorted(spark_cols) != sorted(sql_cols):
        return f"columns {sorted(set(spark_cols) ^ set(sql_cols))}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} != {len(sql_rows)}"
    order = sorted(spark_cols)
    a = [spark_cols.index(c) for c in order]
    b = [sql_cols.index(c) for c in order]
    left = sorted((tuple(r[i] for i in a) for r in spark_rows), key=repr)
    right = sorted((tuple(r[i] for i in b) for r in sql_rows), key=repr)
    bad = [(x, y) for x, y in zip(left, right) if x != y]
    if not bad:
        return ""
    x, y = bad[0]
    diff = [(c, p, q) for c, p, q in zip(order, x, y) if p != q]
    return f"{len(bad)} rows differ, first: {diff[:6]}"


def compare(spark, con, sf_dir, query, sql) -> str:
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return "" if rows else "no rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    kinds = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string"}
    for name, t in df.dtypes:
        if types.get(name) in kinds and kinds[types[name]] != t:
            return f"type of {name}: {t} != {types[name]}"
    return same(rows, df.columns, cur.fetchall(), names)


def main() -> int:
    from cartwave.registry import registry
    from cartwave.session import local_session

    sf_dir, parts = sys.argv[1], sys.argv[2:]
    spark, con, r = local_session(), connect(sf_dir), registry()
    failed = 0
    for name, query in r.queries.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, query, r.sql.get(name))
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += bool(problem)
        kind = "sql " if name in r.sql else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {time.time() - start:6.2f}s {name} {problem}",
              flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
