"""Run registered queries against their SQL in DuckDB and compare all rows.

``python tests/oracle.py [-s SF] [--tiny] [name ...]`` runs the named ones (or
all); ``--tiny`` sets limits so low that groups are split and nothing is
broadcast, which must not change a row.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        value = float(value)
        if math.isnan(value):
            return (3, "nan")
        return (2, round(value, 6) + 0.0)
    return (4, str(value))


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, folder, name, fn, sql, con):
    """None when equal, else a short text about the first difference."""
    df = fn(spark, folder)
    got = df.collect()
    if sql is None:
        return None if got else f"{name}: no rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    a, b = _rows(df.columns, got), _rows(names, want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            bad = [
                (n, p[1], q[1]) for n, p, q in zip(sorted(names), x, y) if p != q
            ]
            return f"first difference {bad} in {x}"
    if not a:
        return "no rows on either side"
    return None


def main(argv):
    from formbook.catalog import load
    from formbook.session import build_session

    sf = "0.01"
    if argv and argv[0] == "-s":
        sf, argv = argv[1], argv[2:]
    tiny = {}
    if argv and argv[0] == "--tiny":
        argv = argv[1:]
        tiny = {
            "spark.formbook.hotGroupRows": 5,
            "spark.formbook.hotGroupSplits": 3,
            "spark.formbook.broadcastRows": 2,
        }
    folder = f"/root/testdata/sf{sf}"
    spark = build_session(
        "oracle", "local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.driver.memory": "8g", **tiny}
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = load()
    con = connect(folder)
    names = [n for n in queries if not argv or any(n.startswith(a) for a in argv)]
    bad = []
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, folder, name, queries[name], oracles.get(name), con)
        except Exception as error:  # noqa: BLE001 - reported per query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        took = time.time() - start
        mark = "ok" if problem is None else "BAD"
        kind = "sql" if name in oracles else "rows"
        print(f"{mark:4s}{kind:5s}{took:6.2f}s  {name}  {problem or ''}", flush=True)
        if problem:
            bad.append(name)
    print(f"{len(names) - len(bad)} of {len(names)} ok; bad: {bad}")


if __name__ == "__main__":
    main(sys.argv[1:])
