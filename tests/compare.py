"""Run queries against their SQL oracles: ``python tests/compare.py SF_DIR [NAME ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(rows: list[tuple], columns: list[str]) -> list[tuple]:
    """Rows with columns in name order, as sortable text."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


def compare(spark: SparkSession, con, name: str, sf_dir: str) -> tuple[bool, str]:
    df = entry.queries()[name](spark, sf_dir)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    res = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in res.description]
    want = normal(res.fetchall(), columns)
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    if got == want:
        return True, f"{len(got)} rows"
    only = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
    return False, f"{len(got)} != {len(want)} rows, e.g. {only}"


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(entry.oracle_sql())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            good, note = compare(spark, con, name, sf_dir)
        except Exception as e:  # report and go on with the next query
            good, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not good
        print(f"{'ok  ' if good else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{bad} failed of {len(names)}")
    return bad


if __name__ == "__main__":
    sys.exit(main())
