"""Run registered queries against their SQL: ``python tests/compare.py sf0.001 [names]``."""

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from offerlode.session import sharing  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def database(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(value):
        if isinstance(value, float):
            return "nan" if math.isnan(value) else repr(value)
        return repr(value)

    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, folder, name, plan, sql):
    """(equal, spark rows, sql rows, first differing rows)."""
    with sharing():
        df = plan(spark, folder)
        left = rows_of(df.columns, [tuple(row) for row in df.collect()])
    if sql is None:
        return len(left) > 0, len(left), None, []
    result = con.sql(sql)
    if sorted(result.columns) != sorted(df.columns):
        return False, len(left), None, [sorted(df.columns), sorted(result.columns)]
    right = rows_of(result.columns, result.fetchall())
    only_left = sorted(set(left) - set(right))[:2]
    only_right = sorted(set(right) - set(left))[:2]
    return left == right, len(left), len(right), [only_left, only_right]


if __name__ == "__main__":
    from offerlode.queries.registry import ORACLES, QUERIES
    from offerlode.session import build_session

    folder = f"/root/testdata/{sys.argv[1]}"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = build_session(), database(folder)
    for name in names:
        started = time.time()
        try:
            equal, n, m, sample = compare(
                spark, con, folder, name, QUERIES[name], ORACLES.get(name))
            verdict = "ok" if equal and n else "DIFF"
        except Exception as failure:
            verdict, n, m, sample = "FAIL", 0, 0, str(failure)[:700]
        print(f"\n@ {verdict} {name} {n} {m} {time.time() - started:.1f}s",
              "" if verdict == "ok" else sample, flush=True)
