"""Compare catalogue queries with their SQL statements.

``python -m tests.check_oracle [scale] [query ...]``
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TIMES = {"spark": 0.0, "sql": 0.0}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark: SparkSession, con, name: str, fn, sql: str | None, sf_dir: str) -> str | None:
    """None when equal, else a description of the difference."""
    df = fn(spark, sf_dir)
    start = time.time()
    got = df.collect()
    TIMES["spark"] = time.time() - start
    mine = rows_of(df.columns, got)
    if not mine:
        return "no rows"
    if sql is None:
        return None
    start = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    found = cur.fetchall()
    TIMES["sql"] = time.time() - start
    theirs = rows_of(names, found)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        return f"{len(bad)} of {len(mine)} rows differ on {sorted(names)}: {bad[0]}"
    return None


def session(cpus: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries

    scale = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{scale}"
    spark, con = session(), duck(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    sql, failed = oracle_sql(), 0
    for name, fn in queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, fn, sql.get(name), sf_dir)
        except Exception as error:  # report and go on with the other queries
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        mark = "FAIL" if problem else "ok" if name in sql else "ok (rows only)"
        print(f"{mark:15} {time.time() - start:6.2f}s spark {TIMES['spark']:.2f} sql {TIMES['sql']:.2f} {name} {problem or ''}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
