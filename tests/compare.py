"""Run registered queries next to their SQL: ``python tests/compare.py [sf_dir] [name ...]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from surveyspark.runtime import get_spark  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def rows_of(pdf_rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        (tuple(row[i] for i in order) for row in pdf_rows), key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(spark, connection, name, sf_dir):
    start = time.time()
    result = entry.queries()[name](spark, sf_dir)
    got = rows_of([tuple(r) for r in result.collect()], result.columns)
    spark_time = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows only ({len(got[1])})", spark_time, 0.0, len(got[1])
    start = time.time()
    relation = connection.sql(sql)
    want = rows_of(relation.fetchall(), relation.columns)
    sql_time = time.time() - start
    if got[0] != want[0]:
        return f"COLUMNS {got[0]} != {want[0]}", spark_time, sql_time, len(got[1])
    if len(got[1]) != len(want[1]):
        return f"ROWS {len(got[1])} != {len(want[1])}", spark_time, sql_time, len(got[1])
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if bad:
        return f"VALUES {len(bad)} of {len(got[1])}: {bad[:2]}", spark_time, sql_time, len(got[1])
    return "ok", spark_time, sql_time, len(got[1])


def connect(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("compare", **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8",
                                    "spark.driver.memory": "16g", "spark.ui.enabled": "false",
                                    "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    failed = 0
    for name in sys.argv[2:] or entry.queries():
        try:
            verdict, spark_time, sql_time, n = compare(spark, connection, name, sf_dir)
        except Exception as error:  # report and go on to the next query
            verdict, spark_time, sql_time, n = f"ERROR {str(error)[:1500]}", 0.0, 0.0, 0
        failed += not (verdict == "ok" or verdict.startswith("rows only"))
        print(f"{name:34s} {spark_time:6.2f}s {sql_time:6.2f}s {n:8d}  {verdict}", flush=True)
    print("failed:", failed)
