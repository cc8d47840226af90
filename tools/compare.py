"""Run queries and their SQL counterparts on the same tables and compare every value.

    python tools/compare.py [--sf DIR] [--columns] [name ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from aisleframe.session import local_session  # noqa: E402
from catalog.doubles import DOUBLES  # noqa: E402
from catalog.oracles import oracle  # noqa: E402
from catalog.queries import QUERIES  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem".split()
KINDS = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(r[i] for i in order) for r in records]
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(spark, con, name, sf_dir):
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spark_time = time.time() - start
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    start = time.time()
    rel = con.sql(oracle(name, doubles))
    problems = []
    if sorted(DOUBLES.get(name, ())) != sorted(doubles):
        problems.append(f"catalog/doubles.py should list {doubles}")
    types = dict(zip(rel.columns, [str(t) for t in rel.types], strict=True))
    want = rel.fetchall()
    duck_time = time.time() - start
    mine = {f.name: KINDS[f.dataType.simpleString()] for f in df.schema.fields}
    if mine != types:
        problems.append(f"schema {sorted(set(mine.items()) ^ set(types.items()))}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    elif set(mine) == set(types):
        a, b = rows_of(df.columns, got), rows_of(rel.columns, want)
        bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
        if bad:
            problems.append(f"{len(bad)} rows differ, e.g. {sorted(mine)}\n   {bad[0][0]}\n   {bad[0][1]}")
    return problems, len(got), spark_time, duck_time, doubles


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--columns", action="store_true")
    parser.add_argument("--plain", action="store_true", help="session without any settings")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    if args.plain:
        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config(
            "spark.sql.session.timeZone", "America/New_York"
        ).getOrCreate()
    else:
        spark = local_session()
    con = duck(args.sf)
    failed = 0
    table = {}
    for name in args.names or QUERIES:
        try:
            problems, n, ts, td, doubles = compare(spark, con, name, args.sf)
            table[name] = doubles
        except Exception as e:  # noqa: BLE001
            problems, n, ts, td = [f"{type(e).__name__}: {str(e)[:600]}"], 0, 0, 0
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name:26} rows {n:7} spark {ts:6.2f}s sql {td:6.2f}s",
              *problems, flush=True)
    if args.columns:
        print("DOUBLES = {")
        for name, cols in table.items():
            print(f'    "{name}": {tuple(cols)!r},'.replace("'", '"'))
        print("}")
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
