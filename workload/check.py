"""Compare every registered query with its reference SQL: ``python -m workload.check 0.001 [name ...]``."""

from __future__ import annotations

import math
import sys
import tempfile
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> str:
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return f"rows-only ({len(got)} rows)" if got else "EMPTY"
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS spark={sorted(df.columns)} sql={sorted(columns)}"
    if got != want:
        in_got, in_want = set(got), set(want)
        only_got = [r for r in got if r not in in_want][:2]
        only_want = [r for r in want if r not in in_got][:2]
        return f"DIFFERENT {len(got)} vs {len(want)} rows\n   spark {only_got}\n   sql   {only_want}"
    kinds = {d[0]: str(d[1]) for d in cur.description}
    return f"ok ({len(got)} rows)" + ("" if got else " EMPTY") + _types(df, kinds)


EXPECTED = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
            "timestamp": "TIMESTAMP", "float": "FLOAT"}


def _types(df, kinds) -> str:
    bad = [f"{f.name}: {f.dataType.simpleString()} / {kinds[f.name]}" for f in df.schema
           if EXPECTED.get(f.dataType.simpleString()) != kinds[f.name]]
    return "  TYPES " + "; ".join(bad) if bad else ""


def main() -> int:
    from rolemill.plans.session import build_session
    import workload

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    names = sys.argv[2:] or list(workload.QUERIES)
    spark = build_session("check", cores=8, shuffle_partitions=8, shared_dir=tempfile.mkdtemp(prefix="rolemill-"))
    spark.sparkContext.setLogLevel("OFF")
    con, bad = connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            result = compare(spark, con, sf_dir, name, workload.QUERIES[name], workload.SQL.get(name))
        except Exception as err:  # noqa: BLE001
            result = f"ERROR {type(err).__name__}: {str(err)[:700]}"
        bad += not result.startswith(("ok", "rows-only")) or "TYPES" in result or "EMPTY" in result
        print(f"{name:28s} {time.time() - start:6.1f}s  {result}", flush=True)
    print(f"{len(names)} queries, {bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
