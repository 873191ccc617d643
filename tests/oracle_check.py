"""Compare queries with their SQL on one scale: ``python -m tests.oracle_check [sf] [key ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(round(value, 6))
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, Counter(tuple(_cell(r[c]) for c in names) for r in df.collect())


def oracle_rows(con, sql: str):
    table = con.execute(sql).to_arrow_table() if hasattr(con, "to_arrow_table") else con.execute(sql).fetch_arrow_table()
    names = sorted(table.column_names)
    columns = [table.column(c).to_pylist() for c in names]
    return names, Counter(tuple(_cell(v) for v in row) for row in zip(*columns)), table.schema


def difference(spark, con, build, sql: str, sf_dir: str) -> str | None:
    """None when equal, otherwise a description."""
    df = build(spark, sf_dir)
    names, got = spark_rows(df)
    want_names, want, _ = oracle_rows(con, sql)
    if names != want_names:
        return f"columns {names} != {want_names}"
    if got != want:
        extra, missing = got - want, want - got
        return (f"rows {sum(got.values())} vs {sum(want.values())}; "
                f"only spark {list(extra.items())[:2]}; only sql {list(missing.items())[:2]}")
    return None if got else "both empty"


def main() -> None:
    from brookmart.session import build_session
    from __spark_entry__ import oracle_sql, queries

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, builds = connect(sf_dir), oracle_sql(), queries()
    bad = 0
    for key in sys.argv[2:] or builds:
        start = time.time()
        try:
            problem = difference(spark, con, builds[key], sqls[key], sf_dir) if key in sqls else "no sql"
        except Exception as error:  # reported, not hidden
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {key} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} problems; only in one map: {sorted(set(sqls) ^ set(builds))}")


if __name__ == "__main__":
    main()
