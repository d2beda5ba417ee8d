"""Compare registered queries with their SQL in DuckDB.

Command line: python -m tests.oracle_check [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return int(value) if value.is_integer() else value
    if hasattr(value, "item"):
        return plain(value.item())
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = [columns[i] for i in order]
    data = [tuple(plain(row[i]) for i in order) for row in rows]
    return key, sorted(data, key=repr)


def oracle_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return rows_of(names, cursor.fetchall())


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def difference(spark, sf_dir: str, build, sql: str) -> str | None:
    got_names, got = spark_rows(build(spark, sf_dir))
    want_names, want = oracle_rows(sf_dir, sql)
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if got == want:
        return None
    mine, theirs = set(got), set(want)
    return (
        f"rows {len(got)} vs {len(want)}; only here {sorted(mine - theirs, key=repr)[:3]}; "
        f"only in SQL {sorted(theirs - mine, key=repr)[:3]}"
    )


def main() -> int:
    from trackframe import catalog
    from trackframe.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    queries, oracles = catalog.load()
    names = sys.argv[2:] or list(queries)
    spark = local_session(cores="8")
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in oracles:
                problem = difference(spark, sf_dir, queries[name], oracles[name])
                note = "sql"
            else:
                count = queries[name](spark, sf_dir).count()
                problem, note = (None, f"rows={count}") if count else ("no rows", "rows")
        except Exception as error:  # noqa: BLE001
            problem, note = f"{type(error).__name__}: {str(error)[:1500]}", "error"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok'} {name} [{note}] {time.time() - start:.1f}s "
              f"{problem or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
