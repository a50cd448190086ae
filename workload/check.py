"""Compare the queries with their SQL on one folder of tables: ``python -m workload.check [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from workload.queries import REGISTRY, TABLES


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("lynceus")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _cell(value):
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_cell(r[n]) for n in names) for r in df.collect()), key=_key)


def sql_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(_cell(r[i]) for i in order) for r in cur.fetchall()), key=_key)


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def differences(spark, con, sf, name, sql) -> str | None:
    names, rows = spark_rows(REGISTRY[name](spark, sf))
    if sql is None:
        return None if rows else "no rows"
    other_names, other = sql_rows(con, sql)
    if names != other_names:
        return f"columns {names} / {other_names}"
    if len(rows) != len(other):
        only = [r for r in rows if r not in other][:2], [r for r in other if r not in rows][:2]
        return f"rows {len(rows)} / {len(other)}: {only}"
    for a, b in zip(rows, other):
        if a != b:
            return f"{dict(zip(names, a))}\n      / {dict(zip(names, b))}"
    return None


def main(argv: list[str]) -> int:
    from workload.oracles import ORACLES

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con = session(), connect(sf)
    bad = 0
    for name in argv[1:] or list(REGISTRY):
        start = time.time()
        try:
            problem = differences(spark, con, sf, name, ORACLES.get(name))
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        took = time.time() - start
        kind = "sql" if name in ORACLES else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {name} [{kind}] {took:.1f}s {problem or ''}", flush=True)
        bad += bool(problem)
    print(f"{bad} differences")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
