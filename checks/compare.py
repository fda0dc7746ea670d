"""Runs registered queries and their SQL side by side: python -m checks.compare DIR [names]."""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.oracles import all_sql
from checks.queries import all_queries

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def key(row):
    return tuple((v is not None, str(type(v)), v) for v in row)


def differences(spark_rows, sql_rows, tolerance: float = 1.1e-6):
    """Rows that differ, floats compared with a tolerance of one rounding step."""
    if len(spark_rows) != len(sql_rows):
        return [("rows", len(spark_rows), len(sql_rows))]
    out = []
    for a, b in zip(spark_rows, sql_rows):
        for x, y in zip(a, b):
            close = (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= tolerance)
            if x != y and not close:
                out.append((a, b))
                break
    return out


def run(spark: SparkSession, con, folder: str, name: str):
    df = all_queries()[name](spark, folder)
    columns = sorted(df.columns)
    ours = [tuple(r) for r in df.select(columns).collect()]
    sql = all_sql().get(name)
    if sql is None:
        return len(ours), None, None
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    if sorted(names) != columns:
        return len(ours), [("columns", columns, sorted(names))], None
    order = [names.index(c) for c in columns]
    theirs = [tuple(r[i] for i in order) for r in relation.fetchall()]
    exact = sorted(ours, key=key) == sorted(theirs, key=key)

    def loose(row):
        return tuple((v is not None, 0.0 if v is None else round(v, 4)) if isinstance(v, float)
                     else (v is not None, str(v)) for v in row)

    return len(ours), differences(sorted(ours, key=loose), sorted(theirs, key=loose)), exact


def main() -> None:
    folder, chosen = sys.argv[1], sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    for name in chosen or all_queries():
        start = time.time()
        try:
            rows, different, exact = run(spark, con, folder, name)
        except Exception as error:  # report and go on with the next query
            print(f"{name}: ERROR {type(error).__name__} {str(error)[:600]}", flush=True)
            continue
        verdict = "no sql" if different is None else "ok" if exact else (
            "CLOSE" if not different else f"DIFF {len(different)} {str(different[:2])[:500]}")
        print(f"{name}: {rows} rows, {verdict}, {time.time() - start:.1f}s", flush=True)


if __name__ == "__main__":
    main()
