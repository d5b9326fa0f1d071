"""Compare registered queries with their SQL in DuckDB: ``python tests/check_oracles.py [sf] [name...]``."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.files.maxPartitionBytes", "2m")
        .config("spark.sql.files.openCostInBytes", "1m")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is not None, str(v)) for v in row)


def _shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


def compare(df, con, sql: str) -> str | None:
    """None if columns, types and values agree, else what differs first."""
    names = sorted(df.columns)
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} != {sorted(rel.columns)}"
    theirs_types = dict(zip(rel.columns, map(str, rel.types)))
    wrong = {n: (t, theirs_types[n]) for n, t in df.dtypes if TYPES.get(theirs_types[n]) != t}
    if wrong:
        return f"types {wrong}"
    order = [rel.columns.index(n) for n in names]
    ours = sorted(tuple(_shown(v) for v in row) for row in df.select(*names).collect())
    theirs = sorted(tuple(_shown(row[i]) for i in order) for row in rel.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(bad)} of {len(ours)} rows differ, first {bad[0]}" if bad else None


def main() -> int:
    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    chosen = sys.argv[2:]
    spark, con = session(), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    oracles, failed = entry.oracle_sql(), []
    for name, query in entry.queries().items():
        if chosen and not any(name.startswith(c) for c in chosen):
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                rows = ""
            else:
                found = df.collect()
                problem, rows = (None if found else "no rows"), f" rows only: {len(found)} {found[0] if found else ''}"
        except Exception as error:  # noqa: BLE001
            problem, rows = "".join(traceback.format_exception_only(error)).strip()[:1500], ""
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s{rows} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
        spark.catalog.clearCache()
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
