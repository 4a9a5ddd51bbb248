"""Runs registered queries beside their SQL twins and compares columns, types and values."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "hugeint": "huge", "integer": "int", "double": "float", "float": "float", "string": "str", "varchar": "str", "boolean": "bool"}


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{round(v, 6) + 0.0:.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{norm(k)}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def rows_of(names, rows):
    at = [names.index(n) for n in sorted(names)]
    return sorted(tuple(norm(r[i]) for i in at) for r in rows)


def compare(spark, con, sf: str, fn, sql: str | None):
    """Problems found, as a list of texts, and the number of rows."""
    got = fn(spark, sf)
    names, kinds = list(got.columns), {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in got.schema}
    rows = [tuple(r.asDict(True).values()) if len(set(names)) == len(names) else tuple(r) for r in got.collect()]
    if len(set(names)) != len(names):
        return ["repeated column names"], len(rows)
    if sql is None:
        return ([] if rows else ["no rows"]), len(rows)
    rel = con.sql(sql)
    want_names = rel.columns
    want_kinds = {n: KINDS.get(str(t).lower(), str(t).lower()) for n, t in zip(want_names, rel.types)}
    want = rel.fetchall()
    bad = []
    if sorted(names) != sorted(want_names):
        return [f"columns {sorted(names)} != {sorted(want_names)}"], len(rows)
    for n in names:
        simple = {"int", "float", "str", "bool", "huge"}
        if kinds[n] != want_kinds[n] and (kinds[n] in simple or want_kinds[n] in simple):
            bad.append(f"type of {n}: {kinds[n]} != {want_kinds[n]}")
    a, b = rows_of(names, rows), rows_of(list(want_names), want)
    if len(a) != len(b):
        bad.append(f"rows {len(a)} != {len(b)}")
    elif a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        bad.append(f"{len(diff)} rows differ, first {diff[0]} (columns {sorted(names)})")
    if not a:
        bad.append("no rows")
    return bad, len(a)


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from flowlab.session import build_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session("local[8]", 8, "8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracles, failed = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            bad, n = compare(spark, con, sf, fn, oracles.get(name))
        except Exception as e:  # noqa: BLE001
            bad, n = [f"{type(e).__name__}: {str(e)[:1500]}"], -1
        failed += bool(bad)
        print(f"{'FAIL' if bad else 'ok  '} {name} rows={n} {time.time() - t:.1f}s {'' if name in oracles else 'rows-only'} {'; '.join(bad)}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
