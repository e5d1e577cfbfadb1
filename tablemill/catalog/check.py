"""Compare registered queries with their SQL on one folder of tables (needs duckdb)."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

from tablemill.catalog import ORACLES, QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


FAMILY = {"BIGINT": "int", "INTEGER": "int", "SMALLINT": "int", "TINYINT": "int", "tinyint": "int", "HUGEINT": "huge", "DOUBLE": "float",
          "FLOAT": "float", "VARCHAR": "text", "BOOLEAN": "bool", "bigint": "int", "int": "int",
          "smallint": "int", "double": "float", "float": "float", "string": "text", "boolean": "bool"}


def compare(spark, folder: str, name: str):
    import duckdb

    start = time.time()
    df = QUERIES[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if name not in ORACLES:
        return "rows-only", len(got), took, ""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    rel = con.execute(ORACLES[name])
    columns = [d[0] for d in rel.description]
    kinds = {d[0]: FAMILY.get(str(d[1]), str(d[1])) for d in rel.description}
    want = rows_of(columns, rel.fetchall())
    note = ""
    if sorted(columns) != sorted(df.columns):
        return "COLUMNS", len(got), took, f"{sorted(df.columns)} vs {sorted(columns)}"
    ours = {f.name: FAMILY.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    odd = {c: (ours[c], kinds[c]) for c in ours if ours[c] != kinds[c]}
    if odd:
        note = f"types {odd}"
    if len(got) != len(want):
        return "ROWS", len(got), took, f"{len(got)} vs {len(want)} {note}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return "VALUES", len(got), took, f"{len(bad)} differ, e.g. {bad[0][0]} vs {bad[0][1]} {note}"
    return ("ok" if not note else "TYPES"), len(got), took, note


def main(argv):
    from tablemill.session import build_session

    folder = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    wanted = argv[2:]
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    failed = 0
    for name in QUERIES:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            status, n, took, note = compare(spark, folder, name)
        except Exception as error:  # report and go on with the next query
            status, n, took, note = "ERROR", 0, 0.0, str(error)[:500].replace("\n", " ")
        failed += status not in ("ok", "rows-only")
        if status == "rows-only" and n == 0:
            failed += 1
        print(f"{status:10s} {took:6.2f}s {n:7d} {name} {note}", flush=True)
    print(f"{failed} failed", flush=True)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
